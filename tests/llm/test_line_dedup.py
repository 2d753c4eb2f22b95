import random
from collections import defaultdict

import pytest

from lakeprofile.llm import line_dedup as L


def brute(rows, least):
    """For every line the longest run from there that begins earlier as well, found by comparing all places."""
    places, texts, out = defaultdict(list), [], {}
    for d, (i, text) in enumerate(sorted(r for r in rows if r[1] is not None)):
        lines, gone = text.split("\n"), set()
        texts.append(lines)
        for s, line in enumerate(lines):
            best = 0
            for e, u in places[line]:
                other, n = texts[e], 0
                while s + n < len(lines) and u + n < len(other) and lines[s + n] == other[u + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(x.split()) for x in lines[s : s + best]) >= least:
                gone |= set(range(s, s + best))
            places[line].append((d, s))
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def corpora():
    rng = random.Random(5)
    yield 3, [(i, "\n".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))) for i in range(40)]
    rows = [(i, "\n".join(rng.choice("abcdefgh") + " x" for _ in range(rng.randint(0, 30)))) for i in range(30)]
    rows += [(200 + i, "\n".join("abcdefghabcdefghabcdefghabcdefgh"[i : 20 + i])) for i in range(6)]
    yield 4, [*rows, (300, "\n".join("z" * 20)), (301, "\n".join("z" * 9))]


@pytest.mark.parametrize(("least", "rows"), list(corpora()))
def test_equals_brute_force(spark, least, rows):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, gone int")
    out = L.delete_repeated_runs(df, least)
    assert out.columns[:3] == ["doc_id", "text", "gone"] and out.columns[3:] == ["lines_deleted"]
    found = {r.doc_id: r for r in out.collect()}
    expected = brute(rows, least)
    assert {i: r.text for i, r in found.items()} == expected
    for i, text in rows:
        assert found[i].lines_deleted >= (text != expected[i])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(51))
    rows = [(1, None), (2, ""), (3, f"a\n{long}"), (4, f"{long}\nb"), (5, "a\nb"), (6, long), (None, long), (6, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.text if r.text is not None else "none") for r in L.delete_repeated_runs(df).collect())
    # The null id comes first and keeps the run; rows equal in id and text are one document.
    assert found == [(0, long), (1, "none"), (2, ""), (3, "a"), (4, "b"), (5, "a\nb"), (6, ""), (6, "")]
    assert L.delete_repeated_runs(df.limit(0)).collect() == []
