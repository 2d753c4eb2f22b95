"""Secret scans: fixed patterns, and tokens that pass a battery of randomness tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeprofile.llm.common import stored

# The patterns and least lengths (whole match, or group 2 of an assignment) of the base kinds.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

KINDS = ("assign", "access", "hex", "random")

# Runs of the characters of encodings; the tests decide which of them are random.
TOKEN = "[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {
    "digits": ("^[0-9]+$", "0123456789"),
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "upper hex": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "lower": ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    "upper": ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "letters": ("^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64url": ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    "base64": ("^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
# Characters that names and words use with unlike frequency: common and rarer letters, low and high digits, signs.
GROUPS = ("aeinorst", "bcdfghjklmpquvwxyz", "AEINORST", "BCDFGHJKLMPQUVWXYZ", "012", "3456789", "+/-_")
# One half of each alphabet for the runs: vowels with the rarest consonants, so that syllables make too many runs.
HALF = "aeiouyjqxzkvwAEIOUYJQXZKVW01234+-"
FALSE_DISCOVERIES = 0.05  # share of ordinary tokens among the reported ones that is aimed at
LEAST_RECALL = 0.93  # share of random tokens that is reported in any case
_EVEN = 30  # steps of p-values above one half, where ordinary tokens are scarce
LENGTH_CLASSES = (32, 64, 128)  # tokens are judged among tokens of like length
_STEPS = 100  # p-values are rounded up to this many steps per power of ten
_LAST_STEP = 1500


def matches(text: Column, pattern: str, hint: str, group: int = 0) -> Column:
    """All leftmost matches as (gap before it, its length, length of a group), in characters.

    The texts between matches are what ``split`` leaves, so positions follow from lengths alone. Texts without the
    ``hint`` (a cheaper pattern) are not searched.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), F.transform(part, F.length).alias("part"))
    found = F.transform(
        zipped,
        lambda m: F.struct(
            m["gap"].alias("gap"), F.length(m["whole"]).alias("n"), m["part"].alias("part"), m["whole"].alias("token")
        ),
    )
    # The text behind the last match has a gap but no match.
    return F.when(text.rlike(hint), F.slice(found, 1, F.size(whole)))


def _tagged(found: Column, kind: int) -> Column:
    """Matches with their kind and place among them; only the last kind keeps its texts."""
    none = F.array().cast("array<struct<gap:int,n:int,part:int,token:string>>")
    return F.transform(
        F.coalesce(found, none),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("at"),
            m["gap"].alias("gap"),
            m["n"].alias("n"),
            m["part"].alias("part"),
            (m["token"] if kind == KINDS.index("random") else F.lit(None).cast("string")).alias("token"),
        ),
    )


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def _normal_tail(z: Column, t: Column) -> Column:
    """P(N > z) for z >= 0 and t = 1 / (1 + 0.2316419 z) (Abramowitz and Stegun 26.2.17)."""
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def randomness(rows: DataFrame, token: str = "token") -> DataFrame:
    """``rows`` with ``p``: how well a token passes as random draws from the alphabet of its encoding.

    The encoding is the smallest alphabet that holds all characters. The tests, each scaled by the exact or usual moments
    at the token's length: chi-squared of the character counts (upper tail), split into the part between groups of
    characters and the part within them, since a short token has few characters per letter but enough per group; runs in
    and out of one half of the alphabet; and serial correlation of neighbours (both tails). Fisher's rule combines them.
    """
    alphabet, sizes = F.lit(None).cast("string"), F.lit(None).cast("array<double>")
    for pattern, letters in reversed(ALPHABETS.values()):
        fits = F.col(token).rlike(pattern)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
        own = F.array(*(F.lit(float(sum(c in group for c in letters))) for group in GROUPS))
        sizes = F.when(fits, own).otherwise(sizes)
    # "_" and "-" beside "+" and "/" in one token: both spellings of the last two values.
    plain = F.when(F.col("__a").endswith("+/"), F.translate(F.col(token), "-_", "+/")).otherwise(F.col(token))
    in_group = lambda group: (F.col("__n") - F.length(F.translate(F.col(token), group, ""))).cast("double")
    mean = F.col("__sum") / F.col("__n")
    n, k = F.col("__n").cast("double"), F.col("__k").cast("double")
    ones = F.col("__ones").cast("double")
    both = 2 * ones * (n - ones)
    add = lambda a, x: a + x
    zero = F.lit(0).cast("bigint")
    out = (
        rows.withColumn("__a", alphabet)
        .withColumn("__k", F.length("__a"))
        .withColumn("__g", sizes)
        .withColumn("__t", F.filter(F.split(plain, ""), lambda c: c != ""))
        .withColumn("__v", F.transform("__t", lambda c: F.expr("1L") * (F.position(c, F.col("__a")) - 1)))
        .withColumn("__h", F.transform("__t", lambda c: F.position(c, F.lit(HALF)) > 0))
        .withColumn("__n", F.size("__v"))
        .withColumn("__o", F.array(*map(in_group, GROUPS)))
        .withColumn("__sum", F.aggregate("__v", zero, add))
        .withColumn("__squares", F.aggregate("__v", zero, lambda a, x: a + x * x))
        .withColumn("__next", F.slice("__v", 2, F.greatest(F.col("__n") - 1, F.lit(1))))
        .withColumn("__here", F.slice("__v", 1, F.greatest(F.col("__n") - 1, F.lit(1))))
        .withColumn("__lag", F.aggregate(F.zip_with("__here", "__next", lambda a, b: a * b), zero, add))
        .withColumn(
            "__counts",
            F.aggregate(
                F.transform(
                    F.array_distinct("__v"), lambda x: F.size(F.filter("__v", lambda y: y == x)).cast("bigint")
                ),
                zero,
                lambda a, x: a + x * x,
            ),
        )
        .withColumn("__ones", F.size(F.filter("__h", lambda x: x)))
        .withColumn(
            "__runs",
            1
            + F.aggregate(
                F.zip_with(
                    F.slice("__h", 1, F.greatest(F.col("__n") - 1, F.lit(1))),
                    F.slice("__h", 2, F.greatest(F.col("__n") - 1, F.lit(1))),
                    lambda a, b: (a != b).cast("bigint"),
                ),
                zero,
                add,
            ),
        )
    )
    shares = F.zip_with("__o", "__g", lambda o, g: F.when(g > 0, o * o * k / (n * g)).otherwise(0.0))
    spread = F.col("__squares") - n * mean * mean
    first, last = F.element_at("__v", 1), F.element_at("__v", -1)
    lagged = F.col("__lag") - mean * (2 * F.col("__sum") - first - last) + (n - 1) * mean * mean
    # Every quantity that is used more than once is a column of its own, which keeps the generated code small.
    out = out.withColumns(
        {
            "__both": both,
            "__spread": spread,
            "__lagged": lagged,
            "__between": F.aggregate(shares, F.lit(0.0), add) - n,
            "__df": (F.size(F.filter("__g", lambda g: g > 0)) - 1).cast("double"),
        }
    )
    runs_var = F.col("__both") * (F.col("__both") - n) / (n * n * (n - 1))
    df, rest = F.col("__df"), k - 1 - F.col("__df")
    within = k * F.col("__counts") / n - n - F.col("__between")
    cube = F.pow(F.greatest(F.col("__between"), F.lit(0.0)) / df, F.lit(1 / 3))  # Wilson and Hilferty's normal form
    out = out.withColumns(
        {
            "__z1": (within - rest) / F.sqrt(2 * rest * (n - 1) / n),
            "__z2": F.coalesce((F.col("__runs") - (F.col("__both") / n + 1)) / F.sqrt(F.nullif(runs_var, F.lit(0.0))), F.sqrt(n)),
            "__z3": F.coalesce((F.col("__lagged") / F.nullif("__spread", F.lit(0.0)) + 1 / n) * F.sqrt(n), F.sqrt(n)),
            "__z4": (cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        }
    )
    tests = [f"__z{i}" for i in (1, 2, 3, 4)]
    out = out.withColumns({f"{z}_t": 1 / (1 + 0.2316419 * F.abs(z)) for z in tests})
    out = out.withColumns({f"{z}_p": _normal_tail(F.abs(z), F.col(f"{z}_t")) for z in tests})
    upper = [F.when(F.col(z) >= 0, F.col(f"{z}_p")).otherwise(1 - F.col(f"{z}_p")) for z in ("__z1", "__z4")]
    ps = (*upper, 2 * F.col("__z2_p"), 2 * F.col("__z3_p"))
    out = out.withColumn("__x", -sum(F.ln(F.greatest(p, F.lit(1e-300))) for p in ps))
    x = F.col("__x")
    p = F.least(F.exp(-x) * (1 + x + x * x / 2 + x * x * x / 6), F.lit(1.0))  # chi-squared tail with eight degrees of freedom
    return out.withColumn("p", p).drop(*(c for c in out.columns if c.startswith("__")))


def token_class(token: Column) -> Column:
    """Tokens are judged among tokens of like length and of the same kind: mixed, letters only, digits only."""
    found = F.lit(0)
    for i, least in enumerate(LENGTH_CLASSES):
        found = F.when(F.length(token) >= least, F.lit(i + 1)).otherwise(found)
    letters, digits = token.rlike("^[A-Za-z]+$"), token.rlike("^[0-9]+$")
    return found + (len(LENGTH_CLASSES) + 1) * F.when(letters, 1).when(digits, 2).otherwise(0)


def _step(p: Column) -> Column:
    """The step of a p-value, rounded up: 10 ** (-step / 100) is never below it."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-15))) * _STEPS), F.lit(_LAST_STEP)).cast("int")


def limits(tested: DataFrame, rate: float = FALSE_DISCOVERIES, recall: float = LEAST_RECALL) -> DataFrame:
    """Per class the step from which on tokens are ordinary: columns class, limit, reported, ordinary.

    What is controlled is the list that a user reads. Random tokens have even p-values, so twice the tokens with p above
    one half estimates how many there are, and what a cut reports beyond their share is ordinary (``ordinary`` is that
    estimated share of the ``reported``). The cut is the one of smallest p at which that share is at most ``rate``, but
    never one that leaves out more than 1 - ``recall`` of the random tokens: where ordinary tokens look too much alike,
    that one is taken and the share is larger. Only a row per class and step is ordered, however many tokens there are.
    """
    floor = math.floor(-math.log10(1 - recall) * _STEPS)
    counts = tested.groupBy("class", "step").agg(F.count(F.lit(1)).alias("n"))
    # Every class has a count, perhaps of none, at the strictest cut.
    least = counts.select("class", F.lit(floor).alias("step"), F.lit(0).cast("bigint").alias("n")).distinct()
    up_to = W.partitionBy("class").orderBy("step").rangeBetween(W.unboundedPreceding, -1)
    all_of = W.partitionBy("class")
    cuts = counts.unionByName(least).groupBy("class", "step").agg(F.sum("n").alias("n"))
    cuts = cuts.withColumn("reported", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    random = F.sum(F.when(F.col("step") < _EVEN, F.col("n")).otherwise(0)).over(all_of) / (1 - 10 ** (-_EVEN / _STEPS))
    cuts = cuts.withColumn("random", random)
    kept = F.col("random") * (1 - F.pow(F.lit(10.0), -F.col("step") / _STEPS))
    share = F.greatest(1 - kept / F.greatest(F.col("reported"), F.lit(1)), F.lit(0.0))
    cuts = cuts.withColumn("ordinary", F.when(F.col("reported") > 0, share).otherwise(0.0)).where(F.col("step") >= floor)
    order = F.when((F.col("step") == floor) | (F.col("ordinary") <= rate), F.col("step"))
    best = F.max_by(F.struct("step", "reported", "ordinary"), order)
    return cuts.groupBy("class").agg(best.alias("b")).select(
        "class", F.col("b")["step"].alias("limit"), F.col("b")["reported"].alias("reported"), F.col("b")["ordinary"].alias("ordinary")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per document: its id as ``doc_id`` and ``spans``, array of (start, kind, end) sorted by start, then kind.

    ``kind`` is a place in ``KINDS``; positions are characters (code points) with the end exclusive. The base kinds
    are the fixed patterns, leftmost and non-overlapping per kind, matches below the least length dropped. ``random``
    spans are tokens of 20 or more characters that pass as random and overlap no base span. Each class of tokens (length;
    mixed, letters only, digits only) has its own cut, which aims at a share of ``rate`` of ordinary tokens among the
    reported ones and reports at least ``LEAST_RECALL`` of the random ones (`limits`).

    Nulls and empty texts have no spans. Repeated rows, repeated and null ids give a row each. An empty table gives no
    rows; further columns are left out. Texts are searched where they are read; only spans are moved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyword = "(?i)password|passwd|secret|token|api_?key"
    kinds = [
        matches(text, ASSIGN, keyword, 2),
        matches(text, ACCESS, "AKIA"),
        matches(text, HEX, "[0-9a-f]{32}"),
        matches(text, TOKEN, TOKEN),
    ]
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,n:int,part:int,token:string>>")
    tagged = [_tagged(m, kind) for kind, m in enumerate(kinds)]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )
    found = rows.select("row", "doc_id", F.explode_outer(F.concat(none, *tagged)).alias("m")).select("row", "doc_id", "m.*")
    # Tokens are tested where they are read; their texts stay there.
    found = randomness(found).withColumn("class", F.when(F.col("token").isNotNull(), token_class(F.col("token"))))
    found = found.withColumn("step", F.when(F.col("token").isNotNull(), _step(F.col("p")))).drop("token", "p")
    before = W.partitionBy("row", "kind").orderBy("at")
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before)).withColumn(
        "start", F.col("end") - F.col("n")
    )
    least = F.element_at(F.array(*(F.lit(LEAST.get(k, 0)) for k in KINDS)), F.col("kind") + 1)
    valid = F.col("part") >= least
    # Base spans around a token: the furthest end of those before it, the nearest start of those behind it.
    by_start = W.partitionBy("row").orderBy("start", "kind", "end")
    base = F.col("valid") & (F.col("kind") < 3)
    placed = placed.withColumn("valid", F.coalesce(valid, F.lit(False)))
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(W.unboundedPreceding, -1))
    # Read backwards, as a frame that ends with the partition is begun anew for every row.
    by_end = W.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    behind = F.min(F.when(base, F.col("start"))).over(by_end.rowsBetween(W.unboundedPreceding, -1))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(behind, F.col("end")) >= F.col("end"))
    kept = stored(
        placed.select(
            "row",
            "doc_id",
            "kind",
            "start",
            "end",
            F.when(base, F.lit(True)).otherwise(F.lit(False)).alias("base"),
            F.when(free, F.col("class")).alias("class"),
            F.when(free, F.col("step")).alias("step"),
        ),
        "spans",
    )
    cuts = limits(kept.where("step is not null"), rate).select("class", "limit")
    final = kept.join(F.broadcast(cuts), "class", "left")  # at most one row per class
    random = F.col("step").isNotNull() & (F.col("step") < F.col("limit"))
    span = F.struct(F.col("start").cast("bigint").alias("start"), "kind", F.col("end").cast("bigint").alias("end"))
    spans = F.array_sort(F.collect_list(F.when(F.col("base") | random, span)))
    return final.groupBy("row", "doc_id").agg(spans.alias("spans")).drop("row")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )
