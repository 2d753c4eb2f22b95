import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakeprofile.llm import order_minhash as O


def prints(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in O.edit_fingerprints(df, **options).collect()}


def test_edited_texts_and_likeness(spark):
    base = " ".join(f"w{i % 97}" for i in range(300))
    texts = [base, base, " ".join(f"v{i}" for i in range(300)), "", None, "two words", "é"]
    out = prints(spark, texts)
    order = sorted(range(len(texts)), reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    for i, text in enumerate(texts):
        text, other = text or "", texts[following[i]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert out[i].n_chars == len(text)
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    assert out[0].fingerprint == out[1].fingerprint and out[1].near_next == 1
    assert out[2].near_next == 0 and 0.05 < out[2].near_edited < 0.8
    assert out[4].near_next == 1 and set(out[3].fingerprint) == {None}


def test_order_and_number_of_words_count(spark):
    words = [f"w{i}" for i in range(200)]
    swapped = words[100:] + words[:100]
    rows = [(1, 1, " ".join(words), " ".join(swapped)), (2, 2, " ".join(words), " ".join(words * 2)), (3, 3, "a", "a")]
    df = spark.createDataFrame(rows, "k long, h long, left string, right string").withColumn("note", F.lit("n"))
    out = {r.k: r for r in O.fingerprint_pairs(df).collect()}
    assert 0.2 < out[1].likeness < 0.95  # nearly the same k-mers, halves swapped
    assert 0.05 < out[2].likeness < 0.6  # every k-mer twice
    assert out[3].likeness == 1 and all(r.note == "n" for r in out.values())


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(5, "a b c d e f", "q"), (5, "a b c d e f", "q"), (None, "x y", None), (2, "z", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    out = O.edit_fingerprints(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 2), (False, 5), (False, 5), (True, 0)]
    assert len({tuple(r.fingerprint) for r in out if r.doc_id == 5}) == 1
    assert O.edit_fingerprints(df.limit(0)).collect() == []
    blank = O.edit_fingerprints(spark.createDataFrame([(1, " ")], "doc_id long, text string"))
    assert set(blank.select(O.shown(F.col("fingerprint")).alias("s")).first().s) == {"-", "."}
    assert "-" not in O.edit_fingerprints(df).select(O.shown(F.col("fingerprint")).alias("s")).first().s


@pytest.mark.parametrize(
    ("first", "last", "blank"),
    [(0x4E00, 0x5E00, ""), (0x3041, 0x3096, ""), (0x0E01, 0x0E2E, ""), (0x61, 0x7A, "\xa0"), (0x41, 0x5A, ""), (0x1F600, 0x1F64F, "")],
)
def test_texts_without_blanks_keep_their_likeness(spark, first, last, blank):
    draw = random.Random(first)
    base, other = (blank.join("".join(chr(draw.randint(first, last)) for _ in range(5)) for _ in range(120)) for _ in range(2))
    out = prints(spark, [other, base])
    assert 0.1 < out[1].near_edited < 0.9 and out[1].near_next < 0.1
    rows = [(1, 1, base, "x" + base), (2, 2, base + " tail of words", base[:300] + base[310:])]
    df = spark.createDataFrame(rows, "k long, h long, left string, right string").withColumn("note", F.lit("n"))
    assert min(r.likeness for r in O.fingerprint_pairs(df).collect()) > 0.6  # all places behind an edit move


def test_short_words_are_one_piece(spark):
    df = spark.createDataFrame([("a bc  def" + "g" * 13 + "\n",), ("ab中文字x " + "y" * 17,), ("中",), ("",)], "t string")
    out = [r.w for r in df.select(O._words(F.col("t")).alias("w")).collect()]
    assert out[0] == ["a", "bc", "def" + "g" * 13]
    assert out[1] == ["ab", "中文字", "x", *["yyyy"] * 14] and out[2] == ["中"]
    assert [r.n for r in df.select(F.size(O.kmers(F.col("t"))).alias("n")).collect()] == [1, 15, 1, None]


def likenesses(spark, pairs):
    rows = [(i, i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k long, h long, left string, right string").withColumn("note", F.lit("n"))
    return {r.k: r for r in O.fingerprint_pairs(df).collect()}


def test_short_texts_keep_their_order(spark):
    """The two halves of a text swapped: nearly the same k-mers, half of the pairs in another order."""
    sizes = (20, 24, 40, 60, 100, 200)
    pairs = []
    for size in sizes:
        for i in range(8):
            words = [f"w{i}x{j}" for j in range(size)]
            pairs.append((" ".join(words), " ".join(words[size // 2 :] + words[: size // 2])))
    out = likenesses(spark, pairs)
    means = [sum(out[8 * s + i].likeness for i in range(8)) / 8 for s in range(len(sizes))]
    for size, mean in zip(sizes, means):
        common = (size - 4) / size  # of all k-mers of both texts; two of each cross the middle
        assert abs(mean - common**2 / 2) < 0.1, means
    assert all(0.05 <= r.likeness <= 0.8 for r in out.values())


def plain_fingerprint(spark, text, tuples=O.TUPLES):
    """The fingerprint by loops; Spark is asked for the hashes of single values only."""
    words = text.split()
    runs = [words[i : i + O.K] for i in range(max(len(words) - O.K, 0) + 1)] if words else []
    seen, keyed = {}, []
    for pos, run in enumerate(runs):
        seen[tuple(run)] = seen.get(tuple(run), 0) + 1
        keyed.append((pos, *[*run, None, None][: O.K], seen[tuple(run)]))
    df = spark.createDataFrame(keyed or [(0, None, None, None, 0)], "pos int, a string, b string, c string, nth int")
    xs = {r.pos: r.x for r in df.select("pos", F.xxhash64(F.xxhash64("a", "b", "c"), "nth").alias("x")).collect()}
    slots = [None] * (2 * tuples)
    for pos in range(len(runs)):
        bits = xs[pos] % (1 << 64)
        place, prio = 2 * (xs[pos] % tuples) + (bits >> 31 & 1), bits >> 33
        prio -= (prio >> 31) << 32  # as the upper half of a signed number
        if slots[place] is None or (prio, pos) < slots[place]:
            slots[place] = (prio, pos)
    filled = [s for s in slots if s is not None]
    if not filled:
        return [None] * tuples
    grid = spark.range(2 * tuples).select(F.col("id").cast("int").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(O.PROBES - 1))).alias("nth"))
    table, parts = [[] for _ in range(2 * tuples)], []
    for r in grid.select("place", O.probe(F.col("place"), F.col("nth"), tuples).alias("x")).orderBy("place", "nth").collect():
        table[r.place].append(r.x)
    borrow = lambda place: next((slots[i] for i in table[place] if slots[i] is not None), filled[0])
    after = lambda kmer: filled[(filled.index(kmer) + 1) % len(filled)]
    for t in range(tuples):
        a, b = slots[2 * t] or borrow(2 * t), slots[2 * t + 1] or borrow(2 * t + 1)
        if a == b and slots[2 * t + 1] is not None:
            a = after(b)
        elif a == b:
            b = after(a)
        first, last = ((a, 0), (b, 1)) if a[1] <= b[1] else ((b, 1), (a, 0))
        parts.append((t, first[0][0], first[1], *((last[0][0], last[1]) if a != b else (None, None))))
    df = spark.createDataFrame(parts, "t int, p long, i int, q long, j int")
    one, two = F.hash("p", F.lit(0)), F.hash("p", "i", "q", "j")
    return [r.x for r in df.select("t", F.when(F.col("q").isNull(), one).otherwise(two).alias("x")).orderBy("t").collect()]


def test_fingerprints_equal_plain_loops(spark):
    draw = random.Random(9)
    some = [f"w{i}" for i in range(12)]
    texts = ["", "a", "a b", "a b c", "a b c d", "a a a a a a", *(" ".join(draw.choices(some, k=n)) for n in (9, 33, 300))]
    out = likenesses(spark, [(t, t[: len(t) // 2]) for t in texts])
    for i, text in enumerate(texts):
        assert list(out[i].left_print) == plain_fingerprint(spark, text), text
        assert list(out[i].right_print) == plain_fingerprint(spark, text[: len(text) // 2]), text
