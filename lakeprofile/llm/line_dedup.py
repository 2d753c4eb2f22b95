"""Line dedup: repeated runs of lines from suffix ranks by prefix doubling; later copies are deleted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeprofile.llm.common import free_names, settle, stored
from lakeprofile.operators.ranks import global_positions

LEAST_WORDS = 50  # words of a run whose later copies are deleted
BROADCAST_NUMBERS = 4_000_000  # line numbers (and ten more for each document) that a broadcast holds
_KEY = ["doc", "h"]


def _ranked(suffixes: DataFrame) -> DataFrame:
    """``suffixes`` (pos, r1, r2) with ``rank``, the number of suffixes that are smaller by (r1, r2), and ``first``, the
    smallest position of those that are equal; suffixes without an equal are left out.

    Only distinct pairs are sorted, by ranges, so one frequent line is one row there; the join back may split it.
    """
    pairs = suffixes.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("many"), F.min("pos").alias("first"))
    pairs = stored(pairs, "pairs")
    placed = global_positions(pairs.where("many > 1"), ["r1", "r2", "first"])
    names = placed.select("r1", "r2", "first", F.col("position").alias("rank"))
    return suffixes.join(names, ["r1", "r2"]).select("pos", "rank", "first")


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Ranks of the line suffixes by their first 1, 2, 4, ... lines, each a table (pos, rank, first).

    ``lines`` has the columns pos, r1 and r2, the line in 128 bits, of repeated lines; consecutive positions are
    consecutive lines, and a gap separates lines that no run joins. The ranks order the suffixes as a suffix array does, up to that depth: suffixes of
    equal rank are one interval of the array whose common prefix has at least that many lines, and ``first`` is the
    first place where that prefix stands. Suffixes that are alone in their interval drop out, since nothing longer can
    be repeated there; doubling ends when none are left.
    """
    level = stored(_ranked(lines.select("pos", "r1", "r2")), "ranks")
    levels, depth = [], 1
    while not level.isEmpty():
        levels.append(level)
        behind = level.select((F.col("pos") - depth).alias("pos"), F.col("rank").alias("r2"))
        # Stored, since pairs are counted in it and ranks are joined to it.
        doubled = stored(level.select("pos", F.col("rank").alias("r1")).join(behind, "pos"), "doubled")
        level = stored(_ranked(doubled), "ranks")
        depth *= 2
    return levels


def repeated_lengths(levels: list[DataFrame]) -> DataFrame:
    """Per position the longest run of lines from there that stands somewhere before: columns pos, length (0 left out).

    The lengths of common prefixes follow from the ranks, largest depth first: a run is prolonged by 2 ** i lines if the
    suffixes with the same prolonged run, an interval of the suffix array, include an earlier one.
    """
    found = None
    for i in reversed(range(len(levels))):
        step = 1 << i
        fresh = levels[i].where("first < pos").select("pos", F.lit(step).cast("bigint").alias("length"), F.col("first").alias("name"))
        if found is None:
            found = stored(fresh, "lengths")
            continue
        # ``name`` is the first place of the run so far; a longer run is named by it and the rank behind it. Suffixes at
        # which that run stands for the first time count as well: they are the earlier ones.
        level = levels[i].select(F.col("pos").alias("at"), "rank")
        own = found.withColumn("at", F.col("pos") + F.col("length")).join(level, "at")
        firsts = found.select(F.col("name").alias("pos"), "length", "name").distinct()
        firsts = firsts.withColumn("at", F.col("pos") + F.col("length")).join(level, "at")
        both = own.select("name", "length", "rank", "pos").union(firsts.select("name", "length", "rank", "pos"))
        least = both.groupBy("name", "length", "rank").agg(F.min("pos").alias("least"))
        longer = own.join(least, ["name", "length", "rank"]).where("least < pos")
        longer = longer.select("pos", (F.col("length") + step).alias("length"), F.col("least").alias("name"))
        # At one position a prolonged run is longer than the run itself, and that one longer than a fresh one.
        longest = F.max(F.struct("length", "name")).alias("run")
        every = longer.union(found.select("pos", "length", "name")).union(fresh)
        found = stored(every.groupBy("pos").agg(longest).select("pos", "run.length", "run.name"), "lengths")
    return found.select("pos", "length")


def _words(line: Column) -> Column:
    cut = F.btrim(line, F.lit(" \t\x0b\f\r"))
    return F.when(cut == "", 0).otherwise(F.size(F.split(cut, "[\\x20\\x09-\\x0D]+")))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines that occur more than once, with columns doc, h, line, r1, r2 (a 128-bit hash of the line), words and pos.

    Unique lines end every run, so only the others take part in the suffix ranks. ``pos`` numbers lines in the order of
    the documents, with a gap behind each document.
    """
    lines = docs.where(F.col("text").isNotNull()).select(
        *_KEY, F.posexplode(F.split("text", "\n")).alias("line", "content")
    )
    lines = lines.select(
        *_KEY,
        "line",
        F.xxhash64("content").alias("r1"),
        F.xxhash64(F.lit("line"), "content").alias("r2"),
        _words(F.col("content")).alias("words"),
    )
    many = lines.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Rows equal in id and text are one document.
    active = stored(lines.join(many, ["r1", "r2"]).distinct(), "repeated-lines")
    order = global_positions(active.select(*_KEY).distinct(), _KEY)
    stride = (active.agg(F.max("line")).first()[0] or 0) + 2
    placed = active.join(order.select(*_KEY, F.col("position").alias("place")), _KEY)
    return stored(placed.withColumn("pos", F.col("place") * F.lit(stride).cast("bigint") + F.col("line")), "placed-lines")


def later_copies(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc, h and the sorted numbers of the lines to delete (``gone``) for documents that have any."""
    lines = repeated_lines(docs)
    levels = suffix_ranks(lines.select("pos", "r1", "r2"))
    if not levels:
        return lines.groupBy(*_KEY).agg(F.collect_list("line").alias("gone")).limit(0)
    lengths = repeated_lengths(levels)
    in_doc = W.partitionBy("place").orderBy("pos")
    counted = lines.select(*_KEY, "line", "place", "pos", "words", F.sum("words").over(in_doc).alias("sum"))
    last = counted.select(F.col("pos").alias("last"), F.col("sum").alias("upto"))
    runs = lengths.join(counted.select("pos", "sum", "words"), "pos").withColumn("last", F.col("pos") + F.col("length") - 1)
    runs = runs.join(last, "last").where(F.col("upto") - F.col("sum") + F.col("words") >= least_words)
    marked = counted.join(runs.select("pos", (F.col("last") + 1).alias("end")), "pos", "left")
    reach = F.max("end").over(in_doc.rowsBetween(W.unboundedPreceding, 0))
    gone = marked.withColumn("reach", reach).where(F.col("reach") > F.col("pos"))
    return gone.groupBy(*_KEY).agg(F.array_sort(F.collect_list("line")).alias("gone"))


def delete_repeated_runs(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    count_col: str = "lines_deleted",
) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from their texts, and the number of such lines.

    Lines end at line feeds. A run is a sequence of whole consecutive lines of one document; it is deleted where the
    same sequence stands before, in a document with a smaller id or further up in the same one, and has at least
    ``least_words`` words. So each run is kept once, at its first place, and short repeated lines stay unless they
    belong to a longer run. A text of which all lines go becomes empty.

    Null and empty texts stay as they are. A null id comes before all others; texts that share an id are ordered by a
    hash; rows equal in id and text are one document and are treated alike. All other columns are kept, and a column
    named like ``count_col`` is replaced. An empty table gives no rows.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts, lists):
            text, gone = text.as_py(), gone.as_py()
            if text is not None and gone:
                deleted = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in deleted)
            out.append(text)
        done = pa.array(out, type=pa.string())
        del out
        settle()
        return done

    # Else a condition on the text that follows, moved below this column, would have each text cut a second time, in
    # Python workers of its own.
    cut = cut.asNondeterministic()
    # The key of a document: its id, and a hash of its text and of whether the id is null.
    doc, h, gone = free_names(docs, "doc", "h", "gone")
    whole_key = (F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))), F.xxhash64(F.col(text_col), F.col(id_col).isNull()))
    keyed = docs.withColumns(dict(zip((doc, h), whole_key)))
    narrow = keyed.select(F.col(doc).alias("doc"), F.col(h).alias("h"), F.col(text_col).alias("text"))
    deleted = stored(later_copies(narrow, least_words), "deleted-lines").toDF(doc, h, gone)
    # Texts are moved only if the deletions are too many to be sent to them.
    numbers = deleted.agg(F.sum(F.size(gone) + 10)).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        deleted = F.broadcast(deleted)
    done = keyed.join(deleted, [doc, h], "left").withColumn(text_col, cut(F.col(text_col), F.col(gone)))
    number = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("bigint")
    return done.withColumn(count_col, number).drop(doc, h, gone)
