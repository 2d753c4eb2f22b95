"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import chunks, free_names, light, shared_folder, stored

WINDOW = 13  # words of a window
SHARE = 20  # a document is contaminated when one word in so many is hit
WINDOWS_PER_BLOCK = 500_000  # windows that one broadcast holds; a larger benchmark is scanned in several blocks
BLOCK_BYTES = 1 << 26  # of window texts in a block
HIT_ROWS = 100_000  # documents with hits whose scans are broadcast
SPLIT_BYTES = 1 << 22

SCAN_TYPE = "n_words bigint, hits array<struct<start:int,end:int>>, items array<string>"

# Bytes that belong to words stay (capitals as small letters), all others separate. Bytes of non-ASCII characters
# are all above 0x7F, so whole texts can be cut as UTF-8.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BETWEEN = b" \x01 "  # no word: 0x01 never survives the normal form
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL)


def words_of(text: str | None) -> list[bytes]:
    return normalised(text or "").split()


class WindowSet(NamedTuple):
    """The windows of one block of the benchmark, ready for numpy."""

    vocabulary: dict[bytes, int]
    tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[tuple[str, ...]]]]

    @classmethod
    def build(cls, windows: dict[tuple[bytes, ...], set[str]]) -> WindowSet:
        vocabulary = {w: i for i, w in enumerate(sorted({w for window in windows for w in window}))}
        tables = []
        for length in sorted({len(w) for w in windows}):
            own = sorted(w for w in windows if len(w) == length)
            ids = np.array([[vocabulary[x] for x in w] for w in own], dtype=np.uint64).reshape(len(own), length)
            seed = 1
            while True:  # until no two different windows share a hash
                factors = np.random.default_rng(seed).integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
                hashes = (ids * factors).sum(axis=1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            order = np.argsort(hashes)
            items = [tuple(sorted(windows[own[i]])) for i in order]
            tables.append((length, factors, hashes[order], ids[order].astype(np.int64), items))
        return cls(vocabulary | {_BETWEEN.strip(): -2}, tables)

    def ids(self, data: bytes) -> np.ndarray:
        """Word ids of a normal form, -1 for words that no window has, -2 between texts."""
        get, parts, at = self.vocabulary.get, [], 0
        while at < len(data):
            stop = len(data) if at + SPLIT_BYTES >= len(data) else data.rfind(b" ", at, at + SPLIT_BYTES) + 1
            if stop <= at:  # one word longer than a split
                stop = data.find(b" ", at + SPLIT_BYTES) + 1 or len(data)
            words = data[at:stop].split()
            found = np.fromiter(map(get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
            parts.append(found)
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: words, hit runs of words as (start, end), items with a window in the text."""
        ids = self.ids(_BETWEEN.join(map(normalised, texts)))
        ends = np.append(np.flatnonzero(ids == -2), len(ids))
        starts = np.append(0, ends[:-1] + 1)
        unknown = np.append(0, np.cumsum(ids < 0))
        cover, owners = np.zeros(len(ids) + 1, dtype=np.int32), []
        for length, factors, hashes, windows, items in self.tables:
            if length > len(ids):
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            sums = np.zeros(len(at), dtype=np.uint64)
            for i in range(length):
                sums += ids[at + i].astype(np.uint64) * factors[i]
            slot = np.minimum(np.searchsorted(hashes, sums), len(hashes) - 1)
            same = hashes[slot] == sums
            at, slot = at[same], slot[same]
            for i in range(length):  # verification, word by word
                same = ids[at + i] == windows[slot, i]
                at, slot = at[same], slot[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            owners.append((np.searchsorted(ends, at), slot, items))
        found: list[set[str]] = [set() for _ in texts]
        for texts_hit, slots, items in owners:
            for text, slot in set(zip(texts_hit.tolist(), slots.tolist())):
                found[text].update(items[slot])
        hit = np.cumsum(cover[:-1]) > 0
        edges = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        for text, a, b in zip(np.searchsorted(ends, first).tolist(), first.tolist(), last.tolist()):
            runs[text].append((a - int(starts[text]), b - int(starts[text])))
        counts = (ends - starts).tolist()
        return [(n, r, sorted(f)) for n, r, f in zip(counts, runs, found)]


def benchmark_windows(benchmark: DataFrame, text_col: str, id_col: str, window: int) -> DataFrame:
    """The different windows of each item: columns item and window (words in normal form, joined by blanks)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("item", pa.string()), ("window", pa.binary())])
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"]):
                words = words_of(text.as_py())
                size = min(window, len(words))
                places = range(len(words) - size + 1 if words else 0)
                for first in range(0, len(places), 1 << 14):
                    held = {b" ".join(words[at : at + size]) for at in places[first : first + (1 << 14)]}
                    yield pa.RecordBatch.from_pydict({"item": [item.as_py()] * len(held), "window": list(held)}, schema=kind)

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.where("item is not null and text is not null").mapInArrow(cut, "item string, window binary").distinct()


def window_set(windows: DataFrame) -> WindowSet:
    """One block of windows on the driver; its size is bounded by the caller."""
    held: dict[tuple[bytes, ...], set[str]] = {}
    for batch in windows.select("item", "window").toArrow().to_batches():
        for item, window in zip(batch["item"], batch["window"]):
            held.setdefault(tuple(window.as_py().split(b" ")), set()).add(item.as_py())
    return WindowSet.build(held)


def _scanner(broadcast):
    from pyspark.sql.functions import arrow_udf

    run_type = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(run_type)), ("items", pa.list_(pa.string()))])

    @arrow_udf(SCAN_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        windows, out = broadcast.value, []
        for run in chunks(texts.to_pylist()):
            out += windows.scan(run)
        rows = [{"n_words": n, "hits": [{"start": a, "end": b} for a, b in r], "items": f} for n, r, f in out]
        return pa.array(rows, type=kind)

    return scan


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    windows_per_block: int = WINDOWS_PER_BLOCK,
    out_col: str = "scan",
) -> DataFrame:
    """``docs`` with one more column ``scan`` = (n_words, hits, items), which replaces one of that name.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, one without words has
    none. ``hits`` are the runs of document words (start, end exclusive, counted in words) inside any occurrence of a
    window, ``items`` the ids of the items with an occurring window, sorted as strings. Nulls and empty texts have no
    words; items without id or text are passed over; repeated items and rows are each worked on as they are; with an
    empty benchmark nothing is hit. Rows are neither moved nor dropped and no other column is touched.

    Windows are made and stored by Spark. Up to ``windows_per_block`` of them are broadcast. A larger benchmark is dealt
    into blocks of about that size by a hash of window and item, so that a window of many items is dealt too. One
    block after the other comes to the driver, is broadcast, scanned for over all documents and released; only documents
    with hits leave a row, and the rows of a document are united.
    """
    spark = docs.sparkSession
    windows = stored(benchmark_windows(benchmark, item_text, item_id, window), "windows")
    n_windows, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    n_blocks = max(math.ceil(n_windows / windows_per_block), math.ceil(size / BLOCK_BYTES), 1)
    if n_blocks == 1:
        return docs.withColumn(out_col, _scanner(spark.sparkContext.broadcast(window_set(windows)))(F.col(text_col)))
    folder = shared_folder(spark, "blocks")
    block = F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)).cast("int")
    windows.withColumn("block", block).write.partitionBy("block").parquet(folder)
    dealt = spark.read.schema("item string, window binary, block int").parquet(folder)

    row, n_words, found = free_names(docs, "row", "n_words", "found")
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(n_words, _word_count(F.col(text_col)))
    numbered = stored(numbered, "documents")
    passes = []
    for b in range(n_blocks):
        held = spark.sparkContext.broadcast(window_set(dealt.where(F.col("block") == b)))
        scanned = numbered.select(row, _scanner(held)(F.col(text_col)).alias(found)).where(F.size(F.col(found)["hits"]) > 0)
        passes.append(stored(scanned, "hits"))
        held.destroy()
    hits = functools.reduce(DataFrame.unionByName, passes).groupBy(row).agg(
        _joined(F.flatten(F.collect_list(F.col(found)["hits"]))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(found)["items"])))).alias("items"),
    )
    hits = stored(hits.select(row, F.struct("hits", "items").alias(found)), "united")
    scan = F.struct(
        F.col(n_words).alias("n_words"),
        F.coalesce(F.col(found)["hits"], F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
        F.coalesce(F.col(found)["items"], F.array().cast("array<string>")).alias("items"),
    )
    return numbered.join(light(hits, HIT_ROWS), row, "left").withColumn(out_col, scan).drop(row, n_words, found)


def _word_count(text: Column) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(words_of(text)) for run in chunks(t.as_py() for t in texts) for text in run], type=pa.int64())

    return count(text)


def _joined(hits: Column) -> Column:
    """Hit runs of several blocks as sorted runs, those that touch or overlap joined."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(runs: Column, hit: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], hit["end"]).alias("end"))
        met = (F.size(runs) > 0) & (last["end"] >= hit["start"])
        return F.when(met, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(hit)))

    return F.aggregate(F.array_sort(hits), empty, add)


def n_hit(scan: Column) -> Column:
    return F.aggregate(
        scan["hits"], F.lit(0).cast("bigint"), lambda a, h: a + (h["end"] - h["start"]).cast("bigint")
    )


def is_contaminated(scan: Column, share: int = SHARE) -> Column:
    """True when any word is hit and at least one word in ``share`` is."""
    return (n_hit(scan) > 0) & (n_hit(scan) * share >= scan["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated documents; all others stay as they are."""
    (scan,) = free_names(docs, "scan")
    scanned = scan_documents(docs, benchmark, out_col=scan, **options)
    return scanned.where(~is_contaminated(F.col(scan))).drop(scan)


def cut_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit spans (from the first to the last word of a run) taken out of their texts."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for text, runs in zip(texts.to_pylist(), hits.to_pylist()):
            if text is None or not runs:
                out.append(text)
                continue
            spans, kept, at = [m.span() for m in _WORD.finditer(_ascii_lower(text))], [], 0
            for run in runs:
                kept.append(text[at : spans[run["start"]][0]])
                at = spans[run["end"] - 1][1]
            out.append("".join([*kept, text[at:]]))
        return pa.array(out, type=pa.string())

    (scan,) = free_names(docs, "scan")
    scanned = scan_documents(docs, benchmark, text_col=text_col, out_col=scan, **options)
    return scanned.withColumn(text_col, cut(text_col, F.col(scan)["hits"])).drop(scan)


def _ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})
