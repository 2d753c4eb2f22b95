import random
import re

from lakeprofile.llm import decontamination as D


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, content in items:
        theirs = words(content)
        size = min(window, len(theirs))
        for at in range(len(theirs) - size + 1 if theirs else 0):
            for p in range(len(own) - size + 1):
                if own[p : p + size] == theirs[at : at + size]:
                    hit |= set(range(p, p + size))
                    found.add(item)
    return len(own), len(hit), sorted(found)


def case(seed):
    rng = random.Random(seed)
    some = "The cat É sat-on ß x1 日本 Mat a a".split(" ")
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(some) for _ in range(n))
    items = [(str(i), text(rng.choice([0, 1, 2, 5, 9]))) for i in range(6)]
    docs = [text(rng.randint(0, 60)) for _ in range(40)] + ["", None, "...", items[3][1]]
    return docs, items


def spread(hits):
    return sum(h["end"] - h["start"] for h in hits)


def test_scan_equals_brute_force(spark):
    for seed, block in ((1, D.WINDOWS_PER_BLOCK), (2, 1)):  # one broadcast, and many blocks
        docs, items = case(seed)
        df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)], "doc_id long, text string, scan int")
        bench = spark.createDataFrame([*items, (None, "cat"), ("n", None)], "item_id string, text string")
        out = D.scan_documents(df, bench, window=4, windows_per_block=block)
        assert out.columns == ["doc_id", "text", "scan"]
        for r in out.collect():
            assert (r.scan.n_words, spread(r.scan.hits), r.scan["items"]) == brute(r.text, items, 4), r.text


def test_contamination_rule_and_removal(spark):
    clean = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"q{i}" for i in range(13))
    rows = [(1, clean), (2, f"{clean} {passage}"), (3, f"{passage} {clean[:600]}"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("b", passage.upper())], "item_id string, text string")
    kept = D.drop_contaminated(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 4]  # 13 of 413 words are less than one in 20
    cut = {r.doc_id: r.text for r in D.cut_hits(df, bench).collect()}
    assert cut[2] == clean + " " and cut[3] == " " + clean[:600] and cut[1] == clean and cut[4] is None


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id string, text string")
    assert D.scan_documents(df, bench).first().scan == (2, [], [])
    assert D.scan_documents(df.limit(0), bench).collect() == []


def test_words_longer_than_a_split():
    block = D.WindowSet.build({(b"a",): {"i"}})
    long = "x" * (D.SPLIT_BYTES + 10)
    assert [r[0] for r in block.scan([f"a {long} a", "", "a"])] == [3, 0, 1]


def test_blocks_of_a_window_of_many_items(spark):
    """One passage in all items, several blocks: hits and items are united, rows and their columns stay."""
    passage = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(f"i{n}", f"{passage} x{n} y{n}") for n in range(60)], "item_id string, text string")
    rows = [(1, f"a b {passage} c", 7), (1, f"a b {passage} c", 7), (None, passage + " x5 y5", None), (3, None, 1), (4, "q1 q2", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    one, many = (D.scan_documents(df, bench, windows_per_block=n) for n in (10_000, 100))
    assert one.columns == many.columns and one.schema["scan"].dataType.simpleString() == many.schema["scan"].dataType.simpleString()
    key = lambda r: (str(r.doc_id), str(r.text), r.row, r.scan.n_words, tuple(map(tuple, r.scan.hits)), tuple(r.scan["items"]))
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))
    assert {len(r.scan["items"]) for r in many.collect()} == {0, 60}
