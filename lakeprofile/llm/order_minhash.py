"""Order MinHash fingerprints: minimal occurrence-numbered word k-mers, hashed as tuples in their text order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeprofile.llm.common import stored
from lakeprofile.operators.ranks import global_positions

K = 3  # words of a k-mer
TUPLES = 64  # tuples of a fingerprint
CHARS_PER_PARTITION = 8_000_000  # characters whose k-mers one task sorts
BLANKS = " \t\n\v\f\r"
WORD_CHARS = 16  # longer words are cut into pieces
PIECE_CHARS = 4  # characters of a piece; one begins at each character
# Fixed value: scripts that put no blanks between words.
UNSPACED = "[" + "".join(rf"\p{{Is{s}}}" for s in "Han Hiragana Katakana Thai Lao Khmer Myanmar Tibetan".split()) + "]"

PROBES = 16  # other halves that an empty one looks at in its own order before it takes the first filled one

_POS_BITS = 32
_KEY = ["k", "h"]


def _pieces(word: Column) -> Column:
    """All runs of ``PIECE_CHARS`` characters of a word, or the word if it is shorter."""
    return F.transform(
        F.array(F.split(word, "")),
        lambda c: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(c) - PIECE_CHARS, F.lit(0))),
            lambda i: F.concat_ws("", *(F.get(c, i + j) for j in range(PIECE_CHARS))),
        ),
    )[0]


def _words(text: Column) -> Column:
    """The words of a text; long ones and runs of unspaced scripts as their pieces."""
    # Lengths are cheap to compare, and keep the pattern from plain ASCII.
    wide = lambda x: F.octet_length(x) > F.length(x)
    apart = F.when(wide(text) & F.regexp_like(text, F.lit(UNSPACED)), F.regexp_replace(text, f"({UNSPACED}+)", " $1 ")).otherwise(text)
    words = F.split(F.btrim(apart, F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+")

    def is_cut(word: Column) -> Column:
        return (F.length(word) > WORD_CHARS) | (wide(word) & F.regexp_like(word, F.lit("^" + UNSPACED)))

    cut = lambda w: F.flatten(F.transform(w, lambda x: F.when(is_cut(x), _pieces(x)).otherwise(F.array(x))))
    return F.transform(F.array(words), lambda w: F.when(F.exists(w, is_cut), cut(w)).otherwise(w))[0]


def kmers(text: Column, k: int = K) -> Column:
    """Hashes of all runs of ``k`` words in text order; a text of fewer words is one run, one without words none."""
    runs = F.transform(
        F.array(_words(text)),  # the words are cut once
        lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))),
        ),
    )[0]
    return F.when(F.btrim(text, F.lit(BLANKS)) != "", runs)


def probe(place: Column, attempt: Column, tuples: int) -> Column:
    """The half (2 x tuple + half) that an empty one looks at in its so-many-th attempt."""
    return F.pmod(F.hash(place, attempt), F.lit(2 * tuples))


def _tuple_hashes(slots: Column, tuples: int) -> Column:
    """One hash per tuple from the k-mers that stand in its two halves, given as one array (2 x tuple + half).

    An empty half borrows the k-mer of another half: the first filled one of its probes, else the first filled of all. If
    that is the k-mer of its partner it takes the next filled one after it. So every tuple has two k-mers if the
    text has two, and their order in the text counts; a text of one k-mer has that one in all tuples.
    """
    prio = lambda c: F.shiftright(c, _POS_BITS)
    pos = lambda c: c.bitwiseAND((1 << _POS_BITS) - 1)

    def at(all_slots: Column, filled: Column, place: Column) -> Column:
        tries = [F.get(all_slots, probe(place, F.lit(attempt), tuples)) for attempt in range(PROBES)]
        return F.coalesce(F.get(all_slots, place), *tries, F.get(filled, F.lit(0)))

    def after(filled: Column, kmer: Column) -> Column:
        return F.get(filled, F.pmod(F.array_position(filled, kmer).cast("int"), F.size(filled)))

    def in_order(a: Column, b: Column) -> Column:
        return (
            F.when(a == b, F.hash(prio(a), F.lit(0)))
            .when(pos(a) <= pos(b), F.hash(prio(a), F.lit(0), prio(b), F.lit(1)))
            .otherwise(F.hash(prio(b), F.lit(1), prio(a), F.lit(0)))
        )

    def hashed(all_slots: Column, filled: Column, t: Column) -> Column:
        pair = F.array(F.struct(at(all_slots, filled, 2 * t).alias("a"), at(all_slots, filled, 2 * t + 1).alias("b")))
        # A half of its own keeps its k-mer; the borrowed one gives way.
        own = F.get(all_slots, 2 * t + 1).isNotNull()
        return F.transform(
            pair,
            lambda p: F.when(p["a"] != p["b"], in_order(p["a"], p["b"]))
            .when(own, in_order(after(filled, p["b"]), p["b"]))
            .otherwise(in_order(p["a"], after(filled, p["a"]))),
        )[0]

    whole = F.transform(
        F.array(F.struct(slots.alias("s"), F.array_compact(slots).alias("f"))),
        lambda x: F.transform(
            F.sequence(F.lit(0), F.lit(tuples - 1)),
            lambda t: F.when(F.size(x["f"]) > 0, hashed(x["s"], x["f"], t)),
        ),
    )
    return whole[0]


def fingerprint_pairs(texts: DataFrame, tuples: int = TUPLES) -> DataFrame:
    """Fingerprints of two texts per row and their likeness.

    ``texts`` has the key columns k and h (unique, and the table is partitioned by them), left, right, and ``note``,
    a string that is handed through. Returns k, h, note, left_print and right_print (arrays of ``tuples`` integers,
    all null for a text without words) and likeness.

    Each k-mer is numbered among its equals in its text. A hash of k-mer and number names a tuple, one of its two
    halves, and a priority; the k-mer of least priority stands for the half, and the two of a tuple are hashed in the
    order in which they stand in the text; empty halves borrow (`_tuple_hashes`). All grouping is by the key first, so
    nothing is moved.
    """
    sides = F.array(F.col("left"), F.col("right"))
    rows = texts.select(*_KEY, "note", F.posexplode(sides).alias("side", "text"))
    # A text without words still gets a row, and the first row of a text carries the note.
    cut = rows.select(*_KEY, "side", "note", F.posexplode_outer(kmers(F.col("text"))).alias("pos", "kmer"))
    cut = cut.withColumn("note", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("note")))
    same = W.partitionBy(*_KEY, "side", "kmer").orderBy("pos")
    mixed = cut.withColumn("x", F.when(F.col("kmer").isNotNull(), F.xxhash64("kmer", F.row_number().over(same))))
    mixed = mixed.select(
        *_KEY,
        "side",
        "note",
        F.pmod("x", F.lit(tuples)).cast("int").alias("tuple"),
        F.shiftrightunsigned("x", 31).bitwiseAND(1).cast("int").alias("half"),
        F.shiftleft(F.shiftrightunsigned("x", 33), _POS_BITS).bitwiseOR(F.col("pos").cast("bigint")).alias("packed"),
    )
    least = [
        F.min(F.when((F.col("side") == s) & (F.col("half") == p), F.col("packed"))).alias(f"m{s}{p}")
        for s in (0, 1)
        for p in (0, 1)
    ]
    chosen = mixed.groupBy(*_KEY, "tuple", "note").agg(*least)
    # The row with the note is a group of its own; its k-mer is united with the others of its tuple here.
    again = [F.min(f"m{s}{p}").alias(f"m{s}{p}") for s in (0, 1) for p in (0, 1)]
    notes = F.max("note").alias("note")
    chosen = chosen.groupBy(*_KEY, "tuple").agg(*again, notes)
    entry = F.struct("tuple", "m00", "m01", "m10", "m11")
    gathered = chosen.groupBy(*_KEY).agg(
        F.max("note").alias("note"), F.collect_list(F.when(F.col("tuple").isNotNull(), entry)).alias("entries")
    )
    by_tuple = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["tuple"], e)))
    full = gathered.select(*_KEY, "note", by_tuple.alias("of"))
    places = F.sequence(F.lit(0), F.lit(tuples - 1))

    def slots(side: int) -> Column:
        return F.flatten(F.transform(places, lambda t: F.array(*(F.col("of")[t][f"m{side}{half}"] for half in (0, 1)))))

    full = full.select(*_KEY, "note", slots(0).alias("left_slots"), slots(1).alias("right_slots"))
    full = full.select(
        *_KEY, "note", *(_tuple_hashes(F.col(f"{name}_slots"), tuples).alias(f"{name}_print") for name in ("left", "right"))
    )
    return full.withColumn("likeness", likeness(F.col("left_print"), F.col("right_print")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among those that either fingerprint has; 1 if neither has any."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda e: e))
    return F.when(used == 0, 1.0).otherwise(equal / used)


def shown(fingerprint: Column) -> Column:
    """The tuples as hexadecimal numbers joined by dots, ``-`` for an empty one (all of a text without words)."""
    return F.array_join(F.transform(fingerprint, lambda x: F.coalesce(F.lower(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF))), F.lit("-"))), ".")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tuples: int = TUPLES) -> DataFrame:
    """Fingerprints of each text and of the text whose last third is replaced by the start of the next document.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (arrays), near_edited, near_next. The
    next document has the next smaller id; after the last comes the first. The last floor(n_chars / 3) characters
    are replaced by as many (or all) of the next one's first. Likeness is the share of equal tuples; two texts
    without words have 1, one of them without words 0. Words of more than ``WORD_CHARS`` characters and runs of scripts
    without blanks count as their pieces of ``PIECE_CHARS`` characters, one from each character.

    A null text is empty. A null id comes after all others. Texts that share an id are ordered by a hash; rows equal
    in id and text count once in the order and each get a row. A single document is its own next one. An empty table
    gives no rows; further columns are left out.

    Texts are shuffled once by key, and the part that the neighbour takes over once more; k-mers never are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A null id differs from all others in the hash.
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("k"),
        F.xxhash64(text, F.col(id_col).isNull()).alias("h"),
        text.alias("text"),
    )
    narrow = stored(keyed.select("doc_id", *_KEY, F.length("text").alias("n_chars")), "documents")
    size = narrow.agg(F.sum("n_chars")).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / CHARS_PER_PARTITION))

    # Ascending positions: the next document in descending order stands one before, that of the first is the last.
    numbered = global_positions(narrow.select(*_KEY, "n_chars").distinct(), [*_KEY, "n_chars"])
    numbered = numbered.withColumn("wanted", F.pmod(F.col("position") - 1, F.col("n")))
    behind = numbered.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("position").alias("wanted"))
    nexts = stored(numbered.join(behind, "wanted").select(*_KEY, "n_chars", "k2", "h2"), "next")

    cut = F.floor(F.col("n_chars") / 3).cast("int")
    # One row per key: a text, whom it follows, and how many characters that one takes over.
    takers = nexts.select(
        F.col("k2").alias("k"), F.col("h2").alias("h"), F.col("k").alias("k0"), F.col("h").alias("h0"), cut.alias("taken")
    )
    whole = keyed.select(*_KEY, "text").repartition(parts, *_KEY).groupBy(*_KEY).agg(F.first("text").alias("text"))
    placed = whole.join(takers.hint("merge"), _KEY)
    starts = placed.select(
        F.col("k0").alias("k"), F.col("h0").alias("h"), F.col("text").substr(F.lit(1), F.col("taken")).alias("start")
    )
    lengths = whole.withColumn("keep", F.length("text") - F.floor(F.length("text") / 3).cast("int"))
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("keep")), F.col("start"))
    pairs = lengths.join(starts.repartition(parts, *_KEY).hint("merge"), _KEY).select(*_KEY, F.col("text").alias("left"), edited.alias("right"))
    pairs = pairs.withColumn("note", F.sha2("right", 256))
    prints = stored(fingerprint_pairs(pairs, tuples), "fingerprints")

    of_next = prints.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("left_print").alias("next_print"))
    return (
        narrow.join(nexts.drop("n_chars"), _KEY)
        .join(prints, _KEY)
        .join(of_next, ["k2", "h2"])
        .select(
            "doc_id",
            F.col("n_chars").cast("bigint").alias("n_chars"),
            F.col("note").alias("edited_sha256"),
            F.col("left_print").alias("fingerprint"),
            F.col("right_print").alias("edited_fingerprint"),
            F.col("likeness").alias("near_edited"),
            likeness(F.col("left_print"), F.col("next_print")).alias("near_next"),
        )
    )
