"""Token counts of flat token files: end-of-document ids are searched block by block, and a prefix scan stitches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_TOKENS = 1 << 19
BLOCKS_PER_GROUP = 256  # blocks that one step of the prefix scan takes together
BLOCKS = "file string, block bigint, tokens binary"


def read_token_files(spark: SparkSession, path: str, id_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, tokens) of flat binary files of little-endian ids; bytes of a torn last id are left out.

    A file is read by one task as one value, so files should be of bounded size, as token shards are; Spark refuses
    those above two gigabytes.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    size = block_tokens * id_bytes
    whole = F.floor(F.length("content") / id_bytes) * id_bytes
    blocks = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(whole / size) - 1, F.lit(0)).cast("bigint"))
    cut = files.withColumn("whole", whole.cast("int")).select("file", "whole", "content", F.explode(blocks).alias("block"))
    at = (F.col("block") * size).cast("int")
    part = F.substring(F.col("content"), at + 1, F.least(F.lit(size), F.col("whole") - at))
    return cut.select("file", "block", part.alias("tokens"))


def count_tokens(blocks: DataFrame, separator: int, id_bytes: int = 2, blocks_per_group: int = BLOCKS_PER_GROUP) -> DataFrame:
    """One row per document of the token files: file, ordinal (from 0), first (its first token's place), n_tokens.

    ``blocks`` has the columns file, block (0, 1, ...) and tokens (little-endian ids of ``id_bytes`` bytes). A document
    ends before a separator; tokens behind the last separator of a file are a document without an end, and an
    empty rest is none. So files without tokens have no documents, and two separators in a row hold an empty one.
    Null blocks are empty. Repeated (file, block) pairs are not defined. Further columns are left out.

    Blocks are searched where they are read and leave only their size, number of separators and document ends. Sums
    over all earlier blocks of a file come from a prefix scan in two steps: within groups of blocks, and over groups,
    so a file of any length is never ordered as a whole except for one row per group.
    """

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{id_bytes}")
        for batch in batches:
            sizes, ends = [], []
            for value in batch["tokens"]:
                data = value.as_buffer() if value.is_valid else b""
                ids = np.frombuffer(data, dtype=kind, count=len(memoryview(data)) // id_bytes)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["block"], pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                names=["file", "block", "size", "ends"],
            )

    found = blocks.select("file", "block", "tokens").mapInArrow(search, "file string, block bigint, size bigint, ends array<bigint>")
    sums = found.withColumns(
        {
            "n": F.size("ends").cast("bigint"),
            # Where the last separator of a block stands, counted from the start of the block; null without one.
            "last": F.get("ends", F.size("ends") - 1),
            "group": F.floor(F.col("block") / blocks_per_group),
        }
    )
    inside = W.partitionBy("file", "group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    step = sums.withColumns({"tokens_in": F.coalesce(F.sum("size").over(inside), F.lit(0)), "docs_in": F.coalesce(F.sum("n").over(inside), F.lit(0))})
    step = step.withColumn("end_in", F.max(F.col("tokens_in") + F.col("last")).over(inside))
    totals = step.groupBy("file", "group").agg(
        F.sum("size").alias("tokens"), F.sum("n").alias("docs"), F.max(F.col("tokens_in") + F.col("last")).alias("end")
    )
    over = W.partitionBy("file").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    before = totals.withColumns(
        {"tokens_before": F.coalesce(F.sum("tokens").over(over), F.lit(0)), "docs_before": F.coalesce(F.sum("docs").over(over), F.lit(0))}
    )
    before = before.withColumn("end_before", F.max(F.col("tokens_before") + F.col("end")).over(over))
    all_tokens = F.sum("tokens").over(W.partitionBy("file"))
    before = before.withColumns({"all": all_tokens, "docs_all": F.sum("docs").over(W.partitionBy("file"))})
    before = before.withColumn("final_end", F.max(F.col("tokens_before") + F.col("end")).over(W.partitionBy("file")))

    stitched = step.join(before.drop("tokens", "docs", "end"), ["file", "group"])
    base = F.col("tokens_before") + F.col("tokens_in")
    previous = F.coalesce(F.col("tokens_before") + F.col("end_in"), F.col("end_before"), F.lit(-1))
    placed = stitched.select(
        "file", (F.col("docs_before") + F.col("docs_in")).alias("base_doc"), base.alias("base"), previous.alias("previous"), "ends"
    )
    each = placed.select("file", "base_doc", "base", "previous", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("previous")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1)) + 1
    ended = each.select(
        "file",
        (F.col("base_doc") + F.col("i")).alias("ordinal"),
        start.alias("first"),
        (F.col("base") + F.col("end") - start).alias("n_tokens"),
    )
    rest = before.groupBy("file").agg(F.max("docs_all").alias("ordinal"), F.max("all").alias("all"), F.max("final_end").alias("end"))
    rest = rest.withColumn("first", F.coalesce(F.col("end") + 1, F.lit(0))).withColumn("n_tokens", F.col("all") - F.col("first"))
    return ended.unionByName(rest.where("n_tokens > 0").select("file", "ordinal", "first", "n_tokens"))


def write_token_blocks(
    docs: DataFrame, path: str, vocabulary: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes documents by byte-level BPE and writes each task's flat token stream, with a separator behind each
    document, as blocks, and the ids of its documents in stream order beside them (``kind`` tokens or ids).

    Nothing in a block says where documents begin. Blocks are Parquet rows, so streams of any length are read in
    parts. Null and empty texts have no tokens; null ids are kept.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken
        from pyspark import TaskContext

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        file, block, place = f"part-{TaskContext.get().partitionId():06d}", 0, 0
        held: list[np.ndarray] = []
        size = 0

        def row(kind: str, at: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": [kind], "file": [file], "block": [at], "tokens": [data]})

        end = np.array([separator], dtype="<u2")
        for batch in batches:
            ids = batch["id"]
            known = ids.fill_null(-(1 << 63)).to_numpy()
            if len(known):
                yield row("ids", place, known.astype("<i8").tobytes())
                place += len(known)
            for text in batch["text"]:
                text = text.as_py() or ""
                held += [np.array(encoding.encode_ordinary(text), dtype="<u2"), end]
                size += len(held[-2]) + 1
                while size >= BLOCK_TOKENS:
                    flat = np.concatenate(held)
                    yield row("tokens", block, flat[:BLOCK_TOKENS].tobytes())
                    held, size, block = [flat[BLOCK_TOKENS:]], len(flat) - BLOCK_TOKENS, block + 1
        if size:
            yield row("tokens", block, np.concatenate(held).tobytes())

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    done = rows.mapInArrow(encode, f"kind string, {BLOCKS}")
    done.write.partitionBy("kind").option("compression", "zstd").parquet(path)


def counts_by_document(spark: SparkSession, path: str, separator: int) -> DataFrame:
    """doc_id, file, ordinal, first and n_tokens of all documents in token blocks written by ``write_token_blocks``."""
    blocks = spark.read.schema(f"{BLOCKS}").parquet(f"{path}/kind=tokens")
    counts = count_tokens(blocks, separator)

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, place, data in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["tokens"]):
                ids = np.frombuffer(data.as_buffer(), dtype="<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(ids)), pa.array(place + np.arange(len(ids))), pa.array(ids, mask=ids == -(1 << 63))],
                    names=["file", "ordinal", "doc_id"],
                )

    written = spark.read.schema(f"{BLOCKS}").parquet(f"{path}/kind=ids")
    ids = written.mapInArrow(unpack, "file string, ordinal bigint, doc_id bigint")
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "first", "n_tokens")
