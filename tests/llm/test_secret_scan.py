import math
import random
import re
from collections import Counter

from lakeprofile.llm import secret_scan as S

ASSIGN = re.compile("""((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PARTS = "token|=|:| |'|\"|abc|AKIA|ABCD1234|é|𝔘|0f3a0f3a0f3a0f3a|Secret|API_key|-|.|\n|deadbeef|xY9kLm2Q".split("|")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return tuple(sorted(found))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))), "x") for i in range(800)]
    rows += [(1, None, "x"), (None, "token=abcdefgh", "x"), (7, "", "x"), (7, "", "x"), (8, "secret=token: abcdefgh12", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = S.scan(df).collect()
    got = Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.spans if s.kind < 3)) for r in out)
    assert got == Counter((i, brute(t)) for i, t, _ in rows)
    for r in out:
        base = [s for s in r.spans if s.kind < 3]
        for s in r.spans:
            assert s.kind < 3 or not any(b.start < s.end and s.start < b.end for b in base)
    shown = {r.doc_id: r.shown for r in S.scan(df).select("doc_id", S.listed(S.F.col("spans")).alias("shown")).collect()}
    assert shown[None] == "assign:0:14"


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(rng.choice(letters) for _ in range(rng.choice([24, 40, 80]))) for _ in range(150)]
    plain = ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "000000000000000000000000000000000000a"]
    rows = [(i, f"see {t} here") for i, t in enumerate(secrets + plain * 20)]
    out = {r.doc_id: r.spans for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(bool(out[i]) for i in range(len(secrets)))
    assert found >= 0.9 * len(secrets)
    assert not any(s.kind == 3 for i in range(len(secrets), len(rows)) for s in out[i])
    first = next(i for i in range(len(secrets)) if out[i])
    assert (out[first][0].start, out[first][0].end) == (4, 4 + len(secrets[first]))


def test_p_values_are_spread_under_randomness(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("0123456789abcdef") for _ in range(64)),) for _ in range(600)]
    p = sorted(r.p for r in S.randomness(spark.createDataFrame(rows, "token string")).collect())
    assert 0 < p[0] and p[-1] <= 1 and 0.3 < p[300] < 0.7 and sum(x < 0.05 for x in p) < 80


def test_empty_table(spark):
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
LETTERS = ALPHABETS[1] + ALPHABETS[2]
ALPHABETS += [LETTERS, LETTERS + ALPHABETS[0], LETTERS + ALPHABETS[0] + "-_", ALPHABETS[1] + ALPHABETS[0]]
NAMES = "customer order item total user account service manager factory request handler payment history status shipping address".split()
NAMES += "invoice product category stock price report daily weekly config reader writer session cache index table column".split()


def test_recall_of_all_alphabets_among_ordinary_names(spark):
    """Planted tokens of one and more character classes among as many ordinary names: recall, and what a user reads."""
    rng = random.Random(23)
    secrets = ["".join(rng.choice(a) for _ in range(rng.choice([20, 24, 32, 40, 64]))) for a in ALPHABETS for _ in range(120)]
    camel, snake, joined = [], [], []
    while len(camel) < 500:
        parts = rng.sample(NAMES, 4)
        camel += [x for x in ["".join(p.title() for p in parts) + str(rng.randint(1, 99))] if len(x) >= 20]
        snake += ["_".join(parts) + f"_{rng.randint(1, 99)}"]
        joined += ["".join(parts)]
    kinds = [secrets, camel, snake, joined]
    rows = [(i, f"see {t} here", k) for i, (k, t) in enumerate((k, t) for k, kind in enumerate(kinds) for t in kind)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    out = {r.doc_id: r.n for r in S.scan(df).select("doc_id", S.F.size(S.F.filter("spans", lambda s: s["kind"] >= 2)).alias("n")).collect()}
    share = [sum(out[i] > 0 for i, _, k in rows if k == kind) / len(kinds[kind]) for kind in range(4)]
    by_alphabet = [sum(out[120 * a + i] > 0 for i in range(120)) / 120 for a in range(len(ALPHABETS))]
    assert share[0] >= 0.9 and min(by_alphabet) >= 0.85, (share, by_alphabet)
    assert max(share[1:]) <= 0.1, share
    reported = [sum(out[i] > 0 for i, _, k in rows if k == kind) for kind in range(4)]
    assert sum(reported[1:]) <= 1.5 * S.FALSE_DISCOVERIES * sum(reported), reported  # what is controlled is an estimate


def test_limits_by_hand(spark):
    """Even p-values and a lump of ordinary tokens: the cut leaves the lump out where recall allows it, and says so if not."""
    rows = [(0, int(-100 * math.log10((i + 0.5) / 1000))) for i in range(1000)]  # random tokens only
    rows += [(1, s) for _, s in rows] + [(1, 400)] * 3000  # ordinary ones at p = 0.0001
    rows += [(2, s) for c, s in rows if c == 0] + [(2, 100)] * 1000  # ordinary ones at p = 0.1
    rows += [(3, 900)] * 50  # ordinary ones only
    out = {r["class"]: r for r in S.limits(spark.createDataFrame(rows, "class int, step int")).collect()}
    floor = math.floor(-100 * math.log10(1 - S.LEAST_RECALL))
    assert out[0].limit > 250 and out[0].ordinary < 0.02
    assert floor < out[1].limit <= 400 and out[1].ordinary <= S.FALSE_DISCOVERIES and 900 < out[1].reported <= 1000
    assert out[2].limit == floor and 0.45 < out[2].ordinary < 0.55
    assert out[3].limit <= 900 and out[3].reported == 0  # tokens at the limit are left out
