"""Listing, opening and line-wise reading by path, and crawls that meet failing files."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F
from test_crawl import PROSE, table_text, training_rows

from lakeprofile.operators.lines import find_tables_in_lines
from lakeprofile.plans.crawl import crawl, records_done, write_errors
from lakeprofile.plans.extract import extract
from lakeprofile.plans.large import extract_large
from lakeprofile.plans.refine import refine_columns
from lakeprofile.sources import metadata, stores


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, data in {
        "a/plain.txt": b"words here", "a/empty.txt": b"", "a/_marked.csv": table_text(30).encode(), "_folder/x.txt": PROSE.encode(),
        ".hidden/deep/seen.txt": b"text", "a/.dot": b"not listed", "b/c/d/e.txt": b"deep", "odd [1]{a}* 50%41 ü+.txt": b"odd",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "none").mkdir()
    os.symlink(root / "a", root / "again")  # a link to a folder is not followed
    os.symlink(root / "a/plain.txt", root / "link.txt")
    os.symlink(root / "nowhere", root / "broken.txt")
    return root


def walked(root):
    return {
        f"file:{os.path.join(folder, name)}" for folder, _, names in os.walk(root) for name in names if not name.startswith(".")
    }


def test_listing_equals_a_plain_walk(spark, tree, monkeypatch):
    monkeypatch.setattr(stores, "FOLDERS_PER_TASK", 2)
    rows = stores.list_tree(spark, str(tree)).collect()
    assert {r.path for r in rows} == walked(tree) and len(rows) == len(walked(tree)) == 9
    for r in rows:
        if r.error is None:
            facts = os.stat(r.path[5:])
            assert r.length == facts.st_size and abs(r.modificationTime.timestamp() - facts.st_mtime) < 0.002
    assert {r.path.rsplit("/", 1)[1]: r.error_kind for r in rows if r.error} == {"broken.txt": "vanished"}
    gone = stores.list_tree(spark, str(tree / "nowhere")).collect()
    assert [(r.path, r.error_kind) for r in gone] == [(f"file:{tree}/nowhere", "vanished")]
    assert stores.list_tree(spark, str(tree / "none")).collect() == []


def test_names_of_stores():
    assert stores.canonical("/a/b") == stores.canonical("file:///a/b") == stores.canonical("file:/a/b") == "file:/a/b"
    assert stores.canonical("s3a://lake/x y") == "s3a://lake/x y" and stores.local_name("hdfs://n:1/a") is None


def split(data):
    at = 0
    for piece in data.splitlines(keepends=True):
        end = 2 if piece.endswith(b"\r\n") else 1 if piece[-1:] in (b"\n", b"\r") else 0
        yield at, piece[: len(piece) - end]
        at += len(piece)


def test_ranges_give_every_line_once():
    rng = random.Random(1)
    for _ in range(3000):
        data = bytes(rng.choice(b"ab\n\r") for _ in range(rng.randint(0, 40)))
        size, chunk = rng.randint(1, 12), rng.randint(1, 9)
        ranges = range(0, max(len(data), 1), size)
        assert [x for s in ranges for x in stores.lines_between(io.BytesIO(data), s, s + size, chunk)] == list(split(data))


def test_positions_belong_to_the_file(spark, tmp_path):
    """However a file is cut, and whatever changes between the steps, its lines and its table stay the same."""
    text = (PROSE + "\n" + table_text(200)).replace("\n", "\r\n")
    (tmp_path / "t.csv").write_bytes(text.encode())
    files = stores.list_tree(spark, str(tmp_path)).withColumn("valid", F.lit(True))
    found = []
    for cut, least in ((1 << 20, "1"), (97, "7"), (1000, "64")):
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        lines = stores.read_lines(files, cut)
        assert [(r.position, r.line.encode()) for r in lines.orderBy("position").collect()] == list(split(text.encode()))
        tables = find_tables_in_lines(lines.select("path", "position", "line"))
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        found.append([sorted(map(str, t.collect())) for t in (tables.tables, tables.columns, tables.headers)])
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found[0] == found[1] == found[2] and "n_rows=195" in found[0][0][0]


def test_a_crawl_goes_on_after_failing_files(spark, tree, tmp_path):
    for limit in (0, 1 << 20):
        target = str(tmp_path / f"records-{limit}")
        crawl(spark, str(tree), target, inline_limit=limit, batch_files=4)
        records = metadata.read_records(spark, target)
        assert {r.path for r in records.collect()} == walked(tree) and records.count() == 9
        write_errors(records, str(tmp_path / f"errors-{limit}"))
        errors = {r.path.rsplit("/", 1)[1]: (r.kind, r.message) for r in spark.read.parquet(str(tmp_path / f"errors-{limit}")).collect()}
        assert errors.keys() == {"broken.txt", "empty.txt"} and errors["empty.txt"] == ("empty", "empty content")
        assert errors["broken.txt"][0] == "vanished" and errors["broken.txt"][1]
        marked = records.where("file = '_marked.csv'").first()
        assert marked.extractors == ["columnar"] and marked.n_rows == 25
        # What is recorded is not read again, but for files that could not be looked up.
        crawl(spark, str(tree), target, inline_limit=limit)
        assert metadata.read_records(spark, target).count() == 10


def test_files_that_go_between_listing_and_reading(spark, tree):
    listing = stores.stored(stores.list_tree(spark, str(tree)).where("error is null"), "listing")
    (tree / "a/plain.txt").unlink()
    (tree / "b/c/d/e.txt").unlink()
    (tree / "b/c/d/e.txt").mkdir()
    small, large = extract(stores.read_listed(listing)), extract_large(listing)
    for records in (small, large):
        rows = {r.path[len(f"file:{tree}/") :]: r for r in records.collect()}
        assert len(rows) == 8
        assert rows["a/plain.txt"].error_kind == rows["link.txt"].error_kind == "vanished"
        assert rows["b/c/d/e.txt"].error_kind == "unreadable" and rows["b/c/d/e.txt"].checksum is None
        assert rows["_folder/x.txt"].error is None and rows["a/_marked.csv"].delimiter == ","


def test_crawl_from_a_path_list(spark, tree, tmp_path):
    wanted = [f"{tree}/a/_marked.csv", f"file:{tree}/_folder/x.txt", f"{tree}/missing.txt", f"{tree}/a", f"{tree}/a/_marked.csv"]
    (tmp_path / "paths").write_text("\n".join(wanted) + "\n\n")
    rows = spark.createDataFrame([(p,) for p in wanted], "path string")
    for i, paths in enumerate((str(tmp_path / "paths"), rows)):
        target = str(tmp_path / f"records-{i}")
        crawl(spark, None, target, paths=paths)
        got = {r.path[len(f"file:{tree}/") :]: r for r in metadata.read_records(spark, target).collect()}
        assert {n: (r.extractors, r.error_kind) for n, r in got.items()} == {
            "a/_marked.csv": (["columnar"], None), "_folder/x.txt": ([], None), "missing.txt": ([], "vanished"), "a": ([], "unreadable"),
        }
    with pytest.raises(ValueError):
        crawl(spark, str(tree), str(tmp_path / "x"), paths=rows)


def test_classify_only_crawl_resumes(spark, tree, tmp_path):
    for limit in (0, 1 << 20):
        target = str(tmp_path / f"verdicts-{limit}")
        crawl(spark, str(tree), target, classify_only=True, inline_limit=limit)
        verdicts = spark.read.json(target)
        assert set(verdicts.columns) >= {"path", "modified", "size", "route", "extractors", "error_kind", "error"}
        got = {r.path.rsplit("/", 1)[1]: (r.route, r.extractors) for r in verdicts.collect()}
        assert len(got) == 9 and got["_marked.csv"] == ("text", ["columnar"]) and got["x.txt"] == ("text", ["lda"])
        assert records_done(spark, target).where("modificationTime is not null").count() == 8
        (tree / "late.csv").write_text(table_text(20))
        crawl(spark, str(tree), target, classify_only=True, inline_limit=limit)
        again = [r.path.rsplit("/", 1)[1] for r in spark.read.json(target).collect()]
        assert again.count("late.csv") == 1 and again.count("_marked.csv") == 1
        (tree / "late.csv").unlink()


def test_only_files_with_a_sentinel_are_opened_again(spark, tmp_path):
    root = tmp_path / "tables"
    root.mkdir()
    for i in range(6):
        (root / f"{i}.csv").write_text(table_text(60, sentinel_every=4 if i < 2 else None))
    for limit in (0, 1 << 20):
        records = stores.stored(extract(stores.read_listed(stores.list_tree(spark, str(root)))), "records")
        for i in range(2, 6):
            (root / f"{i}.csv").rename(root / f".{i}")  # opening one of these would fail
        refined = refine_columns(records, training_rows(spark), inline_limit=limit)
        columns = {(r.file, c.name): c for r in refined.collect() for c in r.columns}
        for i in range(6):
            assert columns[f"{i}.csv", "temp"].min[0] == 10.0
            assert columns[f"{i}.csv", "temp"].n_values == (45 if i < 2 else 60)
            (root / f".{i}").exists() and (root / f".{i}").rename(root / f"{i}.csv")


def test_written_files_are_read_back(spark, tmp_path):
    content = [("a/x.txt", bytearray(b"one")), ("b/_y", bytearray(b"")), ("c/d/z z.bin", bytearray(range(256)))]
    files = spark.createDataFrame([*content, ("none", None)], "path string, content binary")
    assert stores.write_files(files, str(tmp_path / "out")).count() == 4
    got = stores.read_listed(stores.list_tree(spark, str(tmp_path / "out"))).collect()
    prefix = len(f"file:{tmp_path}/out/")
    assert {r.path[prefix:]: bytes(r.content) for r in got} == {**{p: bytes(c) for p, c in content}, "none": b""}


def test_small_files_share_the_tasks_that_read_their_lines(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text(f"a{i}\nb\n")
    listing = stores.list_tree(spark, str(tmp_path))
    seen = []
    real = stores.spread
    try:
        stores.spread = lambda *a, **b: seen.append(real(*a, **b)) or seen[-1]
        lines = stores.read_lines(listing.select("path", "length", F.lit(True).alias("valid")))
    finally:
        stores.spread = real
    assert lines.count() == 600
    assert seen[0].rdd.getNumPartitions() <= 64


def test_small_files_share_a_batch(spark, tmp_path, monkeypatch):
    """Files are handed on together up to a bound of bytes, each with its own row, content and error."""
    paths = [f"{tmp_path}/{i}" for i in range(5)]
    for i in (0, 1, 3, 4):
        (tmp_path / str(i)).write_bytes(b"x" * i)
    rows = spark.createDataFrame([(p, None, i) for i, p in enumerate(paths)], "path string, modificationTime timestamp, length bigint")

    class Dealt:
        schema = rows.schema

        def select(self, *_):
            return self

        def mapInArrow(self, read, _):
            return read

    monkeypatch.setattr(stores, "spread", lambda _: Dealt())
    read = stores.read_listed(rows)
    [batch] = rows.coalesce(1).toArrow().combine_chunks().to_batches()
    for most, sizes in ((4 << 20, [5]), (1, [2, 2, 1])):
        monkeypatch.setattr(stores, "CHUNK_BYTES", most)
        parts = list(read([batch]))
        assert [len(p) for p in parts] == sizes
        found = [r for p in parts for r in p.to_pylist()]
        assert [r["path"] for r in found] == paths and [r["length"] for r in found] == list(range(5))
        assert [r["content"] for r in found] == [b"", b"x", None, b"xxx", b"xxxx"]
        assert [r["error_kind"] for r in found] == [None, None, "vanished", None, None]
