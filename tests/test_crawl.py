"""The whole job on a small folder tree."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from lakeprofile.operators.cleaning import clean_features, usable_records
from lakeprofile.operators.discover import find_tables, table_columns
from lakeprofile.operators.features import column_features
from lakeprofile.operators.tree import edges
from lakeprofile.plans import train
from lakeprofile.plans.crawl import classify, crawl, records_done, write_errors
from lakeprofile.plans.extract import extract
from lakeprofile.plans.refine import refine, refine_columns
from lakeprofile.plans.topics import TopicModel, train_topics
from lakeprofile.sources import files as sources
from lakeprofile.sources import metadata
from lakeprofile.streaming.incremental import incremental_crawl

PROSE = "Rivers carry water from the mountains to the sea while forests keep the soil in place. "
SPACE = "Stars and planets move through space; a telescope gathers their light at night. "


def table_text(rows, sentinel_every=None, preamble=""):
    lines = [preamble, "Depth,Temp,Site"] if preamble else ["Depth,Temp,Site"]
    for i in range(rows):
        temp = -999 if sentinel_every and i % sentinel_every == 0 else 10 + i % 7
        lines.append(f"{i},{temp},s{i % 3}")
    return "\n".join(lines) + "\n"


@pytest.fixture()
def lake(tmp_path):
    root = tmp_path / "lake"
    content = {
        "rivers/report.txt": (PROSE * 8).encode(),
        "rivers/data.csv": table_text(40).encode(),
        "rivers/deep/levels.csv": table_text(60, sentinel_every=4).encode(),
        "space/notes.txt": (SPACE * 8).encode(),
        "space/image.jpg": b"\xff\xd8\xff\xe0" + bytes(100),
        "space/grid.nc": b"CDF\x01" + bytes(64),
        "space/page.xml": ("<?xml version='1.0'?>\n<a>\n" + SPACE + "\n</a>\n").encode(),
        "latin.txt": (PROSE + "Größe ").encode("latin-1"),
        ".hidden": b"secret",
    }
    for name, data in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(PROSE * 5,), (SPACE * 5,)] * 10, "text string")
    return train_topics(docs, k=2, iterations=10)


def by_name(spark, target, root):
    prefix = len(f"file:{root}/")
    rows = metadata.read_records(spark, str(target)).collect()
    names = [r["path"][prefix:] for r in rows]
    assert len(set(names)) == len(names)
    return dict(zip(names, rows))


def test_crawl_records_every_visible_file(spark, lake, tmp_path, model):
    target = tmp_path / "records"
    crawl(spark, str(lake), str(target), topic_model=model, path_list=str(tmp_path / "paths"))
    got = by_name(spark, target, lake)
    assert sorted(got) == sorted(
        ["rivers/report.txt", "rivers/data.csv", "rivers/deep/levels.csv", "space/notes.txt", "space/image.jpg",
         "space/grid.nc", "space/page.xml", "latin.txt"]
    )
    extractors = {n: list(r["extractors"]) for n, r in got.items()}
    assert extractors["rivers/data.csv"] == ["columnar"]
    assert extractors["rivers/report.txt"] == extractors["latin.txt"] == extractors["space/page.xml"] == ["lda"]
    assert extractors["space/grid.nc"] == ["netcdf"]
    assert extractors["space/image.jpg"] == []
    data = got["rivers/data.csv"]
    assert data["delimiter"] == "," and list(data["headers"]) == ["depth", "site", "temp"] and data["n_rows"] == 35
    assert [c["name"] for c in data["columns"]] == ["depth", "temp"]
    assert abs(sum(t["weight"] for t in got["space/notes.txt"]["topics"]) - 1) < 1e-9
    assert len(got["space/notes.txt"]["tags"]) == 10
    assert sources.read_path_list(spark, str(tmp_path / "paths")).count() == 8


def test_content_without_bytes_is_recorded_as_an_error(spark, tmp_path):
    files = spark.createDataFrame([("a/x.txt", bytearray()), ("a/y.txt", bytearray(b"words here"))], "path string, content binary")
    records = extract(files)
    assert records.filter("file = 'x.txt'").first()["mime_type"] == "inode/x-empty"
    write_errors(records, str(tmp_path / "errors"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "errors")).collect()] == [("a/x.txt", "empty", "empty content")]


def test_crawl_goes_on_where_it_stopped(spark, lake, tmp_path):
    target = str(tmp_path / "records")
    crawl(spark, str(lake), target)
    assert records_done(spark, target).count() == 8
    (lake / "late.csv").write_text(table_text(20))
    os.utime(lake / "rivers/data.csv", (1, 1))
    crawl(spark, str(lake), target, batch_files=1)
    names = [r["file"] for r in metadata.read_records(spark, target).select("file").collect()]
    assert sorted(names).count("late.csv") == 1 and names.count("data.csv") == 2 and len(names) == 10
    crawl(spark, str(lake), target, overwrite=True)
    assert metadata.read_records(spark, target).count() == 9


def test_large_files_give_the_same_records(spark, lake, tmp_path, model):
    (lake / "rivers/long.csv").write_text(table_text(300, preamble=PROSE))
    (lake / "rivers/odd name [1]{a}* 50%41 ü+.csv").write_text(table_text(30))
    crawl(spark, str(lake), str(tmp_path / "whole"), topic_model=model)
    crawl(spark, str(lake), str(tmp_path / "lines"), topic_model=model, inline_limit=0, batch_files=5)
    whole, lines = by_name(spark, tmp_path / "whole", lake), by_name(spark, tmp_path / "lines", lake)
    assert sorted(whole) == sorted(lines)
    text = [n for n, r in whole.items() if r["mime_type"].startswith("text")]
    assert len(text) == 8
    for name in text:
        a, b = whole[name], lines[name]
        for field in ("mime_type", "size", "extractors", "delimiter", "n_rows", "headers", "columns", "tags"):
            assert a[field] == b[field], (name, field)
        assert [(t["topic"], round(t["weight"], 2)) for t in a["topics"] or []] == [
            (t["topic"], round(t["weight"], 2)) for t in b["topics"] or []
        ], name
    assert lines["space/image.jpg"]["extractors"] == []
    assert lines["rivers/long.csv"]["checksum"] == whole["rivers/long.csv"]["checksum"] and lines["rivers/long.csv"]["error"] is None


def test_classification_only(spark, lake):
    got = {r["path"].split("/")[-1]: list(r["extractors"]) for r in classify(spark, str(lake)).collect()}
    assert got["data.csv"] == ["columnar"] and got["notes.txt"] == ["lda"] and got["grid.nc"] == ["netcdf"]
    assert got["image.jpg"] == []


def training_rows(spark):
    """Columns with and without a sentinel of -999."""
    texts = [(i, table_text(40 + i, sentinel_every=4 if i % 2 else None)) for i in range(20)]
    files = spark.createDataFrame(texts, "path int, text string")
    rows = column_features(table_columns(find_tables(files), "path"))
    label = F.when(F.col("min")[0] == -999, -999).otherwise(0)
    return rows.select(F.concat_ws("/", "path", "ordinal").alias("tid"), "features", label.alias("label"))


def test_sentinels_are_inferred_and_left_out(spark, lake):
    files = sources.read_files(spark, str(lake))
    records = extract(files, sentinel_training=training_rows(spark))
    columns = {
        (r["file"], c["name"]): c for r in records.filter("columns is not null").collect() for c in r["columns"]
    }
    assert columns["levels.csv", "temp"]["min"][0] == 10.0 and columns["levels.csv", "temp"]["n_values"] == 45
    assert columns["levels.csv", "depth"]["n_values"] == 60 and columns["data.csv", "temp"]["n_values"] == 40


def test_sentinels_of_large_files(spark, lake, tmp_path):
    training = training_rows(spark)
    crawl(spark, str(lake), str(tmp_path / "records"), sentinel_training=training, inline_limit=0)
    got = by_name(spark, tmp_path / "records", lake)
    temp = [c for c in got["rivers/deep/levels.csv"]["columns"] if c["name"] == "temp"][0]
    assert temp["min"][0] == 10.0 and temp["n_values"] == 45


def test_refinement(spark, lake, tmp_path, model):
    target = str(tmp_path / "records")
    crawl(spark, str(lake), target, topic_model=model)
    records = metadata.read_records(spark, target)
    refined = refine(records, sources.read_files(spark, str(lake)), model, training_rows(spark))
    metadata.write_records(refined, str(tmp_path / "refined"), "overwrite")
    got = by_name(spark, tmp_path / "refined", lake)
    assert len(got) == 8
    assert {n for n, r in got.items() if r["topics_source"] == "neighbours"} == {
        "rivers/data.csv", "rivers/deep/levels.csv", "space/image.jpg", "space/grid.nc",
    }
    report, data, levels = got["rivers/report.txt"], got["rivers/data.csv"], got["rivers/deep/levels.csv"]
    assert [t["topic"] for t in data["topics"]] == [t["topic"] for t in report["topics"]]
    assert data["tags"] == report["tags"] and levels["tags"] == report["tags"]
    temp = [c for c in levels["columns"] if c["name"] == "temp"][0]
    assert temp["min"][0] == 10.0
    assert [c["n_values"] for c in data["columns"]] == [40, 40]


def test_incremental_crawl_reads_each_file_once(spark, lake, tmp_path):
    target, checkpoint = str(tmp_path / "stream"), str(tmp_path / "checkpoint")
    def run():
        query = incremental_crawl(spark, str(lake), target, checkpoint, files_per_batch=4)
        query.awaitTermination()

    run()
    assert metadata.read_records(spark, target).count() == 8
    (lake / "late.csv").write_text(table_text(20))
    run()
    run()
    records = metadata.read_records(spark, target)
    assert records.count() == 9 and records.filter("file = 'late.csv'").count() == 1


def test_topic_model_survives_storage(spark, tmp_path, model):
    model.save(str(tmp_path / "model"))
    loaded = TopicModel.load(str(tmp_path / "model"))
    assert loaded.vectorizer.vocabulary == model.vectorizer.vocabulary
    assert loaded.lda.vocabSize() == model.lda.vocabSize()


def test_training_csv_round_trip(spark, tmp_path):
    texts = [(f"lake/t{i}.csv", table_text(30 + i)) for i in range(3)]
    files = spark.createDataFrame(texts, "path string, text string")
    columns = table_columns(find_tables(files), "path")
    metadata.write_training_csv(columns, str(tmp_path / "csv"))
    features = list(sources.S.FEATURE_NAMES)
    rows = metadata.read_training_csv(spark, str(tmp_path / "csv"), "column", features)
    assert rows.count() == 6
    cleaned = {r["id"]: r["features"] for r in clean_features(rows, "fields").collect()}
    assert cleaned["lake/|t0.csv|depth"] == [0.0, 1.0, 1.0, 1.0, 2.0, 29.0, 1.0, 28.0, 1.0, 27.0]
    names = train.name_training(spark, str(tmp_path / "csv"))
    assert {r["name"] for r in names.collect()} == {"depth", "temp"}
    sentinels = train.sentinel_training(spark, str(tmp_path / "csv"))
    assert [r["label"] for r in sentinels.collect()] == [0.0] * 6
    train.save_knn(sentinels, str(tmp_path / "knn"))
    assert train.load_knn(spark, str(tmp_path / "knn")).count() == 6
    header = (next((tmp_path / "csv").glob("*.csv"))).read_text().splitlines()[0].split(",")
    assert len(header) == len(set(header)) == 15


def test_stored_tree_and_json(spark, tmp_path):
    paths = spark.createDataFrame([("a/b",), ("a/c",)], "path string")
    metadata.write_tree(edges(paths), str(tmp_path / "tree"))
    assert metadata.read_tree(spark, str(tmp_path / "tree")).count() == 3
    files = spark.createDataFrame([("a/t.csv", bytearray(table_text(20).encode()))], "path string, content binary")
    record = json.loads(metadata.records_to_json(extract(files)).first()["json"])
    assert record["file"] == "t.csv" and record["columns"][0]["name"] == "depth"
    assert usable_records(extract(files)).count() == 1


def test_name_model(spark, tmp_path):
    rows = [(f"{n}{i}", n, [float(base + i % 5)] * 10) for n, base in (("depth", 0), ("year", 1990)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, name string, features array<double>")
    model = train.train_names(df)
    train.save_names(model, str(tmp_path / "names"))
    again = train.load_names(str(tmp_path / "names"))
    got = train.predict_names(df, again)
    assert got.filter("name = predicted_name").count() == 120 and got.filter("certainty < 0.5").count() == 0
    pooled = train.name_holdout_predictions(df, "id", splits=2)
    assert pooled.count() == 4


def test_best_setting_of_the_grid(spark):
    rows = [(i, [float(i % 2 * 10 + i % 3), float(i % 5)], int(i % 2)) for i in range(60)]
    grid = train.knn_grid(spark.createDataFrame(rows, "id long, features array<double>, label int"))
    assert grid.count() == 60
    assert train.best_setting(grid).first()["accuracy"] == 1.0


def odd_files(lake):
    (lake / "space/shot.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(60))
    (lake / "rivers/packed.csv.gz").write_bytes(gzip.compress(table_text(30).encode()))
    (lake / "rivers/named.csv.gz").write_text(table_text(30))
    (lake / "rivers/latin.csv").write_bytes(table_text(30).replace("Site", "Größe").encode("latin-1"))
    (lake / "space/dos.txt").write_bytes((PROSE * 30).replace(". ", ".\r\n").encode())


def test_all_kinds_of_large_files_give_the_same_records(spark, lake, tmp_path, model):
    odd_files(lake)
    crawl(spark, str(lake), str(tmp_path / "whole"), topic_model=model)
    crawl(spark, str(lake), str(tmp_path / "lines"), topic_model=model, inline_limit=0)
    whole, lines = by_name(spark, tmp_path / "whole", lake), by_name(spark, tmp_path / "lines", lake)
    assert sorted(whole) == sorted(lines) and len(whole) == 13
    for name in whole:
        for field in whole[name].asDict():
            if field != "topics":
                assert whole[name][field] == lines[name][field], (name, field)
        a, b = ([(t["topic"], t["weight"]) for t in r[name]["topics"] or []] for r in (whole, lines))
        assert [t for t, _ in a] == [t for t, _ in b] and all(abs(x - y) < 0.01 for (_, x), (_, y) in zip(a, b)), name
    kinds = [sorted((r["path"], r["route"], r["delimiter"], tuple(r["extractors"])) for r in classify(spark, str(lake), n).collect()) for n in (0, 500, 8_000_000)]
    assert len(kinds[0]) == 13 and kinds[0] == kinds[1] == kinds[2]


def test_the_stream_and_the_refinement_take_large_files(spark, lake, tmp_path):
    odd_files(lake)
    target = str(tmp_path / "stream")
    incremental_crawl(spark, str(lake), target, str(tmp_path / "checkpoint"), inline_limit=300).awaitTermination()
    records = metadata.read_records(spark, target)
    assert records.count() == 13 and records.filter("size > 300").count() > 3
    refined = refine_columns(records, training_rows(spark), sources.read_files(spark, str(lake), 300))
    levels = [r for r in refined.collect() if r["file"] == "levels.csv"][0]
    temp = [c for c in levels["columns"] if c["name"] == "temp"][0]
    assert levels["size"] > 300 and temp["min"][0] == 10.0 and temp["n_values"] == 45
