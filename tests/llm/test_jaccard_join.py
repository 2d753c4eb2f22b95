import random
import re
from collections import Counter

import pytest

from lakeprofile.llm import jaccard_join as J
from lakeprofile.llm.components import components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows, rule):
    sets = [shingles(t, rule.words) for _, t in rows]
    pairs = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= rule.percent * len(sets[i] | sets[j])
    ]
    root = roots(len(rows), pairs)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, root))


def corpus(seed):
    rng = random.Random(seed)
    common = "all of this is common to very many texts and follows here in full length".split()
    texts = []
    for _ in range(14):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
            texts.append(" ".join(copy if rng.random() < 0.5 else common + copy))
    texts += ["", None, "  \t\n", "One", "one", "two words", "TWO WORDS", "é É", "é é"]
    return texts


@pytest.mark.parametrize(("seed", "rule", "whole"), [(1, J.Rule(3, 90), 32), (2, J.Rule(5, 80), 2), (3, J.Rule(2, 50), 1)])
def test_components_equal_brute_force(spark, monkeypatch, seed, rule, whole):
    monkeypatch.setattr(J, "WHOLE_LIST", whole)  # short lists go through rounds of pivots as well
    monkeypatch.setattr(J, "SHORT_LIST", 2 * seed)  # and are split by size
    rows = list(enumerate(corpus(seed)))
    rows += [(3, rows[3][1]), (3, "another text with this id"), (None, rows[0][1]), (None, "alone without an id")]
    df = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, sid binary")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df, rule).collect())
    assert got == brute(rows, rule)


def test_one_document_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(4, base), (2, base + " end"), (2, base + " end"), (9, "quite different"), (None, base), (5, None), (5, ""), (6, "")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    kept = J.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, base + " end"), (5, ""), (5, ""), (6, ""), (9, "quite different")]
    assert J.keep_first(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    names = list(range(60))
    rng.shuffle(names)
    pairs = list(zip(names[:30], names[1:30])) + [(names[40], x) for x in names[41:]] + [(names[0], names[0])]
    found = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: min(g) for g in (names[:30], names[40:]) for x in g}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_are_cut_for_all_texts_at_once_and_listed_once():
    texts = ["The  the\tTHE\x0bÄ\x1c\x85", "", " \n", "a", "the \ud800 x\u3000y", ""]
    distinct, index, per_text = J.words_of(texts)
    flat, at = [distinct[i] for i in index], 0
    for text, n in zip(texts, per_text):
        data = text.encode("utf-8", "surrogatepass")
        lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), data)
        assert flat[at : at + n] == re.findall(rb"[^\x20\x09-\x0d]+", lower)
        at += n
    assert at == len(flat) and len(distinct) == len(set(distinct)) < len(flat)
    assert [len(x) for x in J.words_of([])] == [0, 0, 0]
