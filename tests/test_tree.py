import random
from collections import defaultdict

from lakeprofile.operators import tree as G


def ring_walk(files, labelled):
    """Nearest labelled files by widening rings over the tree, as (distance, {topic: weight})."""
    neighbours = defaultdict(set)
    for path in files:
        parts = path.split("/")
        for d in range(len(parts)):
            a, b = "/".join(parts[:d]), "/".join(parts[: d + 1])
            neighbours[a].add(b)
            neighbours[b].add(a)
    results = {}
    for start in files:
        if start in labelled:
            continue
        ring, seen, distance = {start}, {start}, 0
        while ring and not any(n in labelled for n in ring):
            ring = {m for n in ring for m in neighbours[n]} - seen
            seen |= ring
            distance += 1
        mix = defaultdict(float)
        for n in ring:
            for topic, weight in labelled.get(n, []):
                mix[topic] += weight
        if mix:
            total = sum(mix.values())
            results[start] = (distance, {t: round(w / total, 9) for t, w in mix.items()})
    return results


def random_files(rng, n):
    files = set()
    for _ in range(n):
        depth = rng.randint(0, 4)
        files.add("/".join([f"d{rng.randint(0, 2)}" for _ in range(depth)] + [f"f{rng.randint(0, 30)}.txt"]))
    return sorted(files)


def mixed(spark, files, labelled):
    paths = spark.createDataFrame([(f,) for f in files if f not in labelled], "path string")
    rows = [(p, t, w) for p, topics in labelled.items() for t, w in topics]
    topics = spark.createDataFrame(rows, "path string, topic int, weight double")
    got = defaultdict(lambda: [None, {}])
    for r in G.nearest_mix(paths, topics).collect():
        got[r["path"]][0] = r["distance"]
        got[r["path"]][1][r["topic"]] = round(r["weight"], 9)
    return {p: tuple(v) for p, v in got.items()}


def test_nearest_mix_equals_a_ring_walk(spark):
    rng = random.Random(11)
    for _ in range(6):
        files = random_files(rng, 80)
        chosen = rng.sample(files, rng.choice([1, 3, 15]))
        labelled = {f: [(t, rng.randint(1, 4) / 4) for t in rng.sample(range(5), 2)] for f in chosen}
        assert mixed(spark, files, labelled) == ring_walk(files, labelled)


def test_one_directory_holding_nearly_everything(spark):
    files = [f"big/f{i}" for i in range(500)] + ["small/g"]
    labelled = {"small/g": [(1, 1.0)]}
    got = mixed(spark, files, labelled)
    assert len(got) == 500 and set(map(str, got.values())) == {str((4, {1: 1.0}))}


def test_without_labelled_files_nothing_is_mixed(spark):
    assert mixed(spark, ["a/b", "c"], {}) == {}


def test_edges(spark):
    df = spark.createDataFrame([("/a/b/f",), ("a/g",)], "path string")
    assert sorted(map(tuple, G.edges(df).collect())) == [("", "a"), ("a", "a/b"), ("a", "a/g"), ("a/b", "a/b/f")]


def test_ancestors(spark):
    df = spark.createDataFrame([("a/b/f",)], "path string")
    assert sorted((r["ancestor"], r["up"]) for r in G.ancestors(df).collect()) == [
        ("", 3), ("a", 2), ("a/b", 1), ("a/b/f", 0),
    ]
