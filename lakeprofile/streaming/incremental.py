"""The crawl as a stream: each run reads the files that have arrived since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeprofile.functions import scalar as S
from lakeprofile.plans.extract import extract
from lakeprofile.plans.large import extract_large
from lakeprofile.sources.files import BINARY_SCHEMA, INLINE_LIMIT
from lakeprofile.sources.stores import read_listed, stored


def incremental_crawl(
    spark: SparkSession,
    root: str,
    target: str,
    checkpoint: str,
    *,
    records: Callable[[DataFrame], DataFrame] = extract,
    large_records: Callable[[DataFrame], DataFrame] = extract_large,
    files_per_batch: int = 10_000,
    inline_limit: int = INLINE_LIMIT,
) -> StreamingQuery:
    """Start a query that writes the records of all new files and then ends.

    The checkpoint remembers which files are done. A batch that is repeated after a failure replaces its own
    The checkpoint remembers which files are done. A batch that is repeated after a failure replaces its own
    folder below ``target``, so no record is written twice. ``records`` turns (path, modificationTime, length, content,
    error_kind, error) into records, for example `extract` with its models bound; ``large_records`` turns the listing of
    files above ``inline_limit`` into theirs, for example `extract_large` with the same models bound. The stream itself
    carries names only; the tasks of a batch open its files, and one that fails meanwhile is recorded with its error.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .filter(~S.is_hidden(S.file_name(F.col("path"))))
        .select("path", "length", "modificationTime")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        listing = stored(batch, "batch")
        small = F.col("length") <= inline_limit
        counts = listing.agg(F.count_if(small).alias("small"), F.count_if(~small).alias("large")).first()
        mode = "overwrite"
        if counts["small"]:
            records(read_listed(listing.where(small))).write.mode(mode).json(f"{target}/batch={batch_id}")
            mode = "append"
        if counts["large"]:
            large_records(listing.where(~small)).write.mode(mode).json(f"{target}/batch={batch_id}")

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
