"""The crawl: list, skip what is done, extract or classify, write."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.plans.extract import classify_files, extract
from lakeprofile.plans.large import classify_large, extract_large
from lakeprofile.plans.refine import refine_columns
from lakeprofile.plans.topics import TopicModel
from lakeprofile.sources.files import INLINE_LIMIT, pending, read_path_list, write_path_list
from lakeprofile.sources.metadata import RECORD_SCHEMA, read_records, write_records
from lakeprofile.sources.stores import list_paths, list_tree, read_listed, stored

KEYS = ["path", "length", "modificationTime"]
BATCH_FILES = 100_000
VERDICT = ["modified", "size", "error_kind", "error"]


def records_done(spark: SparkSession, target: str) -> DataFrame:
    """(path, length, modificationTime) of the records or verdicts written so far; empty if there are none."""
    try:
        done = read_records(spark, target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        done = spark.createDataFrame([], RECORD_SCHEMA)
    return done.select("path", F.col("size").alias("length"), F.col("modified").alias("modificationTime"))


def listed(spark: SparkSession, root: str | None, paths: str | DataFrame | None) -> DataFrame:
    """The listing of a folder, or of the files that a path list (its place, or its rows) names. Made in tasks."""
    if (root is None) == (paths is None):
        raise ValueError("give a folder or a list of paths")
    if paths is None:
        return list_tree(spark, root)
    return list_paths(spark, read_path_list(spark, paths) if isinstance(paths, str) else paths)


def failed_records(listing: DataFrame) -> DataFrame:
    """Records of the files that could not even be looked up, with their error."""
    found = listing.withColumns({"content": F.lit(None).cast("binary")})
    return extract(found)


def _verdicts(files: DataFrame) -> DataFrame:
    size = files.withColumn("modified", F.col("modificationTime"))
    return classify_files(size, "modified", "length", "error_kind", "error").withColumnRenamed("length", "size")


def _large_verdicts(listing: DataFrame) -> DataFrame:
    found = classify_large(listing, "modificationTime", "size", "error_kind", "error")
    return found.withColumnRenamed("modificationTime", "modified")


def crawl(
    spark: SparkSession,
    root: str | None,
    target: str,
    *,
    paths: str | DataFrame | None = None,
    overwrite: bool = False,
    classify_only: bool = False,
    topic_model: TopicModel | None = None,
    sentinel_training: DataFrame | None = None,
    lda_preamble: bool = True,
    inline_limit: int = INLINE_LIMIT,
    batch_files: int = BATCH_FILES,
    path_list: str | None = None,
) -> None:
    """Write the metadata records of all files below ``root`` as JSON lines to ``target``.

    Instead of ``root`` (None), ``paths`` names the files: the place of a path list, or rows of (path). ``path_list``
    is where to write the list of what was found. With ``classify_only`` the records are verdicts: path, modified,
    size, route, delimiter and the extractors that would accept the file.

    Without ``overwrite`` files already recorded with the same size and time are skipped, so a crawl that stopped can
    simply be started again. Files up to ``inline_limit`` bytes are read whole, larger ones in ranges. Files are taken
    in batches of about ``batch_files``, each written when it is done. Listing, opening and reading happen in tasks; the
    driver sees counts. A file that fails becomes a record with its error and the crawl goes on; `write_errors` puts
    errors in a table of their own.
    """
    listing = listed(spark, root, paths)
    if path_list is not None:
        write_path_list(listing.where("error is null"), path_list)
    if not overwrite:
        listing = pending(listing, records_done(spark, target), KEYS)
    listing = stored(listing, "pending")

    def whole(part: DataFrame) -> DataFrame:
        files = read_listed(part)
        if classify_only:
            return _verdicts(files)
        records = extract(files, topic_model, None, lda_preamble)
        if sentinel_training is None:
            return records
        return refine_columns(stored(records, "records"), sentinel_training, inline_limit=inline_limit)

    def in_ranges(part: DataFrame) -> DataFrame:
        return _large_verdicts(part) if classify_only else extract_large(part, topic_model, sentinel_training, lda_preamble)

    def failed(part: DataFrame) -> DataFrame:
        return _verdicts(part.withColumn("content", F.lit(None).cast("binary"))) if classify_only else failed_records(part)

    size = F.coalesce("length", F.lit(0))
    kinds = {
        "failed": (F.col("error").isNotNull(), failed),
        "small": (F.col("error").isNull() & (size <= inline_limit), whole),
        "large": (F.col("error").isNull() & (size > inline_limit), in_ranges),
    }
    batches = max(1, -(-listing.count() // batch_files))
    mode = "overwrite" if overwrite else "append"
    for batch in range(batches):
        mine = listing.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == batch)
        counts = mine.agg(*[F.count_if(rule).alias(name) for name, (rule, _) in kinds.items()]).first()
        for name, (rule, records) in kinds.items():
            if counts[name]:
                write_records(records(mine.where(rule)), target, mode)
                mode = "append"


def write_errors(records: DataFrame, target: str) -> None:
    """(path, kind, message) of the records that could not be used in full."""
    errors = records.filter(F.col("error").isNotNull())
    errors.select("path", F.col("error_kind").alias("kind"), F.col("error").alias("message")).write.mode("overwrite").parquet(target)


def classify(spark: SparkSession, root: str | None, inline_limit: int = INLINE_LIMIT, paths: str | DataFrame | None = None) -> DataFrame:
    """Which extractor would accept each file, without extracting anything. Files above the limit are read in ranges."""
    listing = listed(spark, root, paths).where("error is null")
    small = F.col("length") <= inline_limit
    return classify_files(read_listed(listing.where(small))).unionByName(classify_large(listing.where(~small)))
