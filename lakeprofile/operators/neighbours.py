"""Exact nearest neighbours, the distance-weighted vote and its parameter grid.

A training table whose size has been checked is handed to the tasks that scan the queries, so the queries are
not shuffled. A larger one is cut into blocks around pivots; a query visits only the blocks that can hold one
of its neighbours, judged by the triangle inequality. Either way a task keeps the best ``k`` per query and
block, and pairs of rows never leave it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeprofile.functions import patterns as P
from lakeprofile.session import ensure_checkpoint_dir

# The functions below run in Python workers, where this package need not be installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_VALUES = 4_000_000  # numbers in a training table small enough to hand to every task
BLOCK_ROWS = 32_768
QUERY_ROWS = 1024
TILE_ROWS = 4096  # training rows whose distances to a batch of queries are held at once
CACHED_ROWS = 32
PAIRS = 1 << 16
LARGEST_FOR_PRODUCTS = 1e100
VISITS_PER_CHUNK = 32 * QUERY_ROWS
PIVOTS = 64


class _Train(NamedTuple):
    """Training rows by rising distance from their centre; rows with entries that are not finite are never near."""

    points: np.ndarray
    centre: np.ndarray
    size: np.ndarray  # distance from the centre
    tids: np.ndarray
    place: np.ndarray  # of the id among all ids
    labels: np.ndarray
    held: dict  # split -> its rows, rising

    @classmethod
    def of(cls, train: pd.DataFrame, metric: str, mode: str) -> _Train:
        points = np.stack(train["features"].to_numpy()).astype(float)
        usable = np.isfinite(points).all(axis=1)
        points, train = points[usable], train[usable]
        centre = np.median(points, axis=0) if len(points) else np.zeros(points.shape[1])
        size = _sizes(points - centre, metric)
        order = np.argsort(size, kind="stable")
        train = train.iloc[order]
        held: dict = {}
        if mode == "splits":
            for i, splits in enumerate(train["held_out"]):
                for split in splits:
                    held.setdefault(split, []).append(i)
        place = train["tid"].rank(method="dense", na_option="top").to_numpy()
        return cls(
            points[order], centre, size[order], train["tid"].to_numpy(), place, train["label"].to_numpy(),
            {split: np.array(rows) for split, rows in held.items()},
        )


def _sizes(points: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt((points * points).sum(axis=1)) if metric == "euclidean" else np.abs(points).sum(axis=1)


def _exact(queries: np.ndarray, train: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows, summed dimension by dimension so that equal vectors give equal distances."""
    total = np.zeros(len(queries))
    for q, t in zip(queries.T, train.T):
        gap = q - t
        total += gap * gap if metric == "euclidean" else np.abs(gap)
    return np.sqrt(total) if metric == "euclidean" else total


def _direct(queries: np.ndarray, train: np.ndarray, metric: str) -> np.ndarray:
    """Matrix of (squared) distances for numbers too large for products."""
    total = np.zeros((len(queries), len(train)))
    for q, t in zip(queries.T, train.T):
        gap = q[:, None] - t[None, :]
        total += gap * gap if metric == "euclidean" else np.abs(gap)
    return total


def _rough(queries: np.ndarray, train: np.ndarray, metric: str, kind: type) -> np.ndarray:
    """Matrix of (squared) distances up to rounding: a matrix product, or sums of larger entries, |a - b| = 2 max - a - b."""
    q, t = queries.astype(kind), train.astype(kind)
    if metric == "euclidean":
        rough = q @ t.T
        rough *= -2
        rough += (queries * queries).sum(axis=1).astype(kind)[:, None]
        rough += (train * train).sum(axis=1).astype(kind)[None, :]
        return rough
    rough = np.zeros((len(q), len(t)), kind)
    columns, larger = np.ascontiguousarray(t.T), np.empty((CACHED_ROWS, len(t)), kind)
    for start in range(0, len(q), CACHED_ROWS):
        rows = q[start : start + CACHED_ROWS]
        out, held = rough[start : start + CACHED_ROWS], larger[: len(rows)]
        for i, column in enumerate(columns):
            np.maximum(rows[:, i, None], column[None, :], out=held)
            out += held
        out *= 2
    rough -= queries.sum(axis=1).astype(kind)[:, None]
    rough -= train.sum(axis=1).astype(kind)[None, :]
    return rough


def _first_of_rows(row: np.ndarray, column: np.ndarray, dist: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best pairs of each row in (distance, id) order, and their ranks."""
    order = np.lexsort((place[column], dist, row))
    row, column, dist = row[order], column[order], dist[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    kept = rank <= k
    return row[kept], column[kept], dist[kept], rank[kept]


def _best_of_batch(points: np.ndarray, size: np.ndarray, skipped, train: _Train, k: int, metric: str) -> tuple[np.ndarray, ...]:
    """(row, column, dist, rank) of the ``k`` nearest training rows of a batch of queries.

    Tiles of training rows are met outward from the batch by their distance from the centre; a tile that the triangle
    inequality rules out for every query is passed over. Rough distances only choose the pairs: all that can be among
    the best within the bound of the rounding error are computed exactly. ``skipped`` gives the pairs of a tile that
    do not count. No more than one tile of distances is held.
    """
    n, dims = train.points.shape
    squared = metric == "euclidean"
    largest = max(np.abs(points).max(), np.abs(train.points).max(), np.abs(train.centre).max())
    # What centring itself rounds away, over all dimensions.
    centring = 8 * np.finfo(float).eps * largest * dims
    centred = points - train.centre
    starts = np.arange(0, n, TILE_ROWS)
    low, high = train.size[starts], train.size[np.minimum(starts + TILE_ROWS, n) - 1]
    away = np.maximum(np.maximum(low - size.max(), size.min() - high), 0) + 1e-9 * np.abs(low + high - size.min() - size.max())
    best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    reach = np.full(len(points), np.inf)  # the distance of the worst pair kept
    for i in np.argsort(away, kind="stable"):
        gap = np.maximum(np.maximum(low[i] - size, size - high[i]), 0)
        if not (gap <= reach * (1 + 1e-9) + centring + 1e-9 * (size + high[i])).any():
            continue
        at = slice(starts[i], min(starts[i] + TILE_ROWS, n))
        bound = reach * reach if squared else reach
        spread = size.max() + high[i]
        wide = spread * spread if squared else spread
        round_off = (2 * spread * centring + centring * centring) if squared else centring
        if largest > LARGEST_FOR_PRODUCTS:
            rough, slack = _direct(points, train.points[at], metric), 0.0
        else:
            slack = 4 * (dims + 8) * float(np.finfo(np.float32).eps) * wide + round_off
            kind = np.float32
            if not slack <= 0.01 * np.median(bound) or not np.isfinite(bound).any() or wide > 1e30:
                kind, slack = np.float64, 4 * (dims + 8) * float(np.finfo(float).eps) * wide + round_off
            rough = _rough(centred, train.points[at] - train.centre, metric, kind)
        for rows, columns in skipped(at):
            rough[rows, columns] = np.inf
        if rough.shape[1] > k and not np.isfinite(bound).all():
            bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
        # Infinity marks what does not count; rounding upward keeps a bound of single precision safe.
        limit = np.minimum(bound * (1 + 1e-9) + slack, np.finfo(rough.dtype).max)
        limit = np.nextafter(limit.astype(rough.dtype), np.array(np.inf, rough.dtype))
        limit = np.minimum(limit, np.finfo(rough.dtype).max)
        row, column = np.divmod(np.flatnonzero(rough <= limit[:, None]), rough.shape[1])
        if not len(row):
            continue
        column = column + at.start
        dist = np.concatenate(
            [_exact(points[row[a : a + PAIRS]], train.points[column[a : a + PAIRS]], metric) for a in range(0, len(row), PAIRS)]
        )
        near = np.isfinite(dist) & (dist <= reach[row])
        *best, rank = _first_of_rows(*(np.concatenate(x) for x in zip(best, (row[near], column[near], dist[near]))), train.place, k)
        full = rank == k
        reach[best[0][full]] = best[2][full]
    return _first_of_rows(*best, train.place, k)


def _best(queries: pd.DataFrame, train: _Train, k: int, metric: str, mode: str) -> Iterator[pd.DataFrame]:
    """The ``k`` nearest training rows of each query in (distance, id) order, batch by batch."""
    if queries.empty or not len(train.points):
        return
    points = np.stack(queries["features"].to_numpy()).astype(float)
    usable = np.isfinite(points).all(axis=1)
    points, queries = points[usable], queries[usable]
    size = _sizes(points - train.centre, metric)
    order = np.argsort(size, kind="stable")
    codes, ids = pd.factorize(train.tids) if mode == "others" else (None, None)
    rows_of_code = np.argsort(codes, kind="stable") if mode == "others" else None
    for start in range(0, len(order), QUERY_ROWS):
        mine = order[start : start + QUERY_ROWS]
        batch = queries.iloc[mine]
        pairs = []
        if mode == "others":
            own = pd.Index(ids).get_indexer(batch["qid"].to_numpy())
            first, last = (np.searchsorted(codes, own, side, sorter=rows_of_code) for side in ("left", "right"))
            count = np.where(own >= 0, last - first, 0)
            row = np.repeat(np.arange(len(mine)), count)
            column = rows_of_code[np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]
            pairs.append((row, column))
        elif mode == "splits":
            splits = batch["split"].to_numpy()
            for split in pd.unique(splits):
                pairs.append((np.flatnonzero(splits == split), train.held.get(split, np.zeros(0, int))))

        def skipped(at: slice, pairs=pairs):
            for row, column in pairs:
                if mode == "others":
                    inside = (column >= at.start) & (column < at.stop)
                    yield row[inside], column[inside] - at.start
                else:
                    a, b = np.searchsorted(column, (at.start, at.stop))
                    yield row[:, None], column[None, a:b] - at.start

        row, column, dist, rank = _best_of_batch(points[mine], size[mine], skipped, train, k, metric)
        yield pd.DataFrame(
            {
                "qid": batch["qid"].to_numpy()[row], "split": batch["split"].to_numpy()[row], "tid": train.tids[column],
                "label": train.labels[column], "dist": dist, "rank": rank,
            }
        )


def _distinct_enough(train: DataFrame, k: int) -> DataFrame:
    """Copies of one vector can supply at most ``k`` neighbours: keep the ``k + 1`` smallest ids of each.

    One more than ``k``, because a query may have to skip itself.
    """
    copies = W.partitionBy("features").orderBy("tid")
    return train.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1).drop("_copy")


def _in_blocks(queries: DataFrame, train: DataFrame, k: int, metric: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the (block, chunk) groups in which they have to meet.

    Every training row belongs to the cell of its nearest pivot; cells are cut into blocks of bounded size. With
    ``reach`` the distance within which a query surely has ``k`` neighbours, a block is left out when its rows
    are all farther away: they lie between ``low`` and ``high`` from their pivot.
    """
    ensure_checkpoint_dir(train.sparkSession)
    pivots = [
        [float(x) for x in r["features"]]
        for r in train.select("features", F.xxhash64("tid").alias("_h")).orderBy("_h").limit(PIVOTS).collect()
    ]
    centres = F.array(*[F.array(*[F.lit(x) for x in p]) for p in pivots])

    def distances(features):
        def to(centre):
            if metric == "euclidean":
                squares = F.zip_with(features, centre, lambda a, b: (a - b) * (a - b))
                return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
            gaps = F.zip_with(features, centre, lambda a, b: F.abs(a - b))
            return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)

        return F.transform(centres, to)

    def nearest_pivot(column: str):
        return (F.array_position(column, F.array_min(column)) - 1).cast("int")

    placed = (
        train.withColumn("_to", distances(F.col("features")))
        .withColumn("cell", nearest_pivot("_to"))
        .withColumn("_dist", F.array_min("_to"))
        .drop("_to")
        .checkpoint()
    )
    # Cells differ in size: the number of blocks follows the count of each cell.
    sizes = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_dist").alias("low"),
        F.max("_dist").alias("high"),
    )
    # Rows that a query must skip cannot count as its neighbours: itself, or those held out in its split.
    if "held_out" in train.columns:
        held = (
            placed.select("cell", F.explode("held_out").alias("_split"))
            .groupBy("cell", "_split")
            .agg(F.count(F.lit(1)).alias("_held"))
            .groupBy("cell")
            .agg(F.max("_held").alias("_skipped"))
        )
        sizes = sizes.join(held, "cell", "left")
    else:
        sizes = sizes.withColumn("_skipped", F.lit(1))
    cells = [
        (r["cell"], r["low"], r["high"], r["_n"], r["_n"] - (r["_skipped"] or 0)) for r in sizes.collect()
    ]  # at most one row per pivot
    groups = _groups({c: n for c, _, _, n, _ in cells}, np.array(pivots))
    rows_of = {}
    for c, _, _, n, _ in cells:
        rows_of[groups[c]] = rows_of.get(groups[c], 0) + n
    blocks = {g: -(-n // BLOCK_ROWS) for g, n in rows_of.items()}
    cell_list = F.array(
        *[
            F.struct(
                F.lit(c).alias("cell"), F.lit(groups[c]).alias("group"),
                F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(n).alias("n"),
            )
            for c, lo, hi, _, n in cells
        ]
    )
    group_of = F.create_map(*[x for c, g in groups.items() for x in (F.lit(c), F.lit(g))])
    blocks_of = F.create_map(*[x for g, b in blocks.items() for x in (F.lit(g), F.lit(b))])
    placed = (
        placed.withColumn("cell", F.element_at(group_of, F.col("cell")))
        .withColumn("block", F.pmod(F.xxhash64("tid"), F.element_at(blocks_of, F.col("cell"))).cast("int"))
        .drop("_dist")
    )

    # All rows of a cell lie within the pivot distance plus the radius of the cell.
    reaches = F.transform(
        cell_list,
        lambda c: F.when(c["n"] >= k, F.get(F.col("_to"), c["cell"]) + c["high"]).otherwise(F.lit(float("inf"))),
    )
    slack = 1 + 1e-9
    wanted = F.filter(
        cell_list,
        lambda c: (F.get(F.col("_to"), c["cell"]) - c["high"] <= F.col("_reach") * slack)
        & (c["low"] - F.get(F.col("_to"), c["cell"]) <= F.col("_reach") * slack),
    )
    visits = (
        queries.withColumn("_to", distances(F.col("features")))
        .withColumn("_reach", F.array_min(reaches))
        .withColumn("_groups", F.array_distinct(F.transform(wanted, lambda c: c["group"])))
        .select("qid", "split", "features", "_groups")
    )
    return visits.withColumn("_blocks", F.transform("_groups", lambda g: F.element_at(blocks_of, g))), placed


def _groups(sizes: dict[int, int], pivots: np.ndarray) -> dict[int, int]:
    """The group of each cell: cells are strung from pivot to nearest pivot, and small ones in a row share a group of up
    to ``BLOCK_ROWS`` rows, so that a query goes to few blocks where none can be ruled out."""
    left, chain = set(sizes), []
    while left:
        gap = [0.0 if not chain else float(np.abs(pivots[c] - pivots[chain[-1]]).sum()) for c in sorted(left)]
        chain.append(sorted(left)[int(np.argmin(gap))])
        left.remove(chain[-1])
    groups, group, held = {}, 0, 0
    for c in chain:
        if held and held + sizes[c] > BLOCK_ROWS:
            group, held = group + 1, 0
        groups[c] = group
        held += sizes[c]
    return groups


def _met(visits: DataFrame, placed: DataFrame, per_chunk: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the chunk in which they meet: blocks with many visits are cut by the counted visits.

    A training row goes once to each chunk of its own block, so once only unless the block is hot, and not at all if
    no query visits it. Queries are stored with the groups they visit, as visits are counted before they are dealt.
    """
    ensure_checkpoint_dir(visits.sparkSession)
    stored = visits.checkpoint()
    pairs = F.flatten(
        F.zip_with("_groups", "_blocks", lambda g, n: F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda b: F.struct(g.alias("cell"), b.alias("block"))))
    )

    def dealt(*columns: str) -> DataFrame:
        return stored.select(*columns, F.explode(pairs).alias("_at")).select(*columns, "_at.cell", "_at.block")

    counted = dealt().groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / per_chunk).cast("int").alias("_chunks")).checkpoint()
    few = F.broadcast(counted)  # a row per block
    met = dealt("qid", "split", "features").join(few, ["cell", "block"])
    met = met.withColumn("chunk", F.pmod(F.xxhash64("qid", "split"), F.col("_chunks")).cast("int"))
    placed = placed.join(few, ["cell", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return met.drop("_chunks"), placed.drop("_chunks")


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int = P.NEIGHBOURS,
    metric: str = "euclidean",
    mode: str = "all",
    broadcast_values: int = BROADCAST_VALUES,
    visits_per_chunk: int = VISITS_PER_CHUNK,
) -> DataFrame:
    """(qid, split, tid, label, dist, rank): the ``k`` nearest training rows of each query by (dist, tid).

    ``queries`` holds (qid, features) and optionally ``split``; ``train`` holds (tid, features, label). With
    mode ``others`` a query skips the training row of its own id; with mode ``splits`` it skips the rows whose
    array ``held_out`` names the split of the query. Beyond ``broadcast_values`` numbers the training table is cut into
    blocks; ``visits_per_chunk`` bounds the queries that meet a block in one task.
    """
    if "split" not in queries.columns:
        queries = queries.withColumn("split", F.lit(0))
    doubles = "array<double>"
    queries = queries.select("qid", "split", F.col("features").cast(doubles).alias("features"))
    extra = ["held_out"] if mode == "splits" else []
    train = train.select("tid", F.col("features").cast(doubles).alias("features"), "label", *extra)
    if mode != "splits":
        train = _distinct_enough(train, k)
    schema = T.StructType(
        [
            queries.schema["qid"],
            queries.schema["split"],
            train.schema["tid"],
            train.schema["label"],
            T.StructField("dist", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )
    n_values = train.agg(F.sum(F.size("features"))).first()[0] or 0
    # Few splits of small rows would leave cores idle, both in the scan and in the distances to the pivots.
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    queries = queries.repartition(tasks, "qid", "split")
    if n_values <= broadcast_values:
        found = train.toPandas()
        if found.empty:
            return queries.sparkSession.createDataFrame([], schema)
        table = _Train.of(found, metric, mode)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _best(batch, table, k, metric, mode)

        # All neighbours of a query are found together, in order.
        return queries.mapInPandas(scan, schema)
    visits, placed = _met(*_in_blocks(queries, train.repartition(tasks, "tid"), k, metric), visits_per_chunk)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [] if left.empty or right.empty else [*_best(left, _Train.of(right, metric, mode), k, metric, mode)]
        return pd.concat(found) if found else pd.DataFrame(columns=schema.names)

    group = ["cell", "block", "chunk"]
    candidates = visits.groupBy(*group).cogroup(placed.groupBy(*group)).applyInPandas(meet, schema)
    order = W.partitionBy("qid", "split").orderBy("dist", "tid")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame, weights: str = "distance") -> DataFrame:
    """(qid, split, prediction, certainty): the label with the largest summed weight, the smaller label on ties.

    With distance weights a neighbour counts by the inverse of its distance, and those at distance zero, where
    there are any, outvote all others.
    """
    per_query = W.partitionBy("qid", "split")
    if weights == "distance":
        exact = F.min("dist").over(per_query) == 0
        weight = F.when(exact, (F.col("dist") == 0).cast("double")).otherwise(
            F.try_divide(F.lit(1.0), F.col("dist"))
        )
    else:
        weight = F.lit(1.0)
    by_label = (
        neighbours.withColumn("_w", weight).groupBy("qid", "split", "label").agg(F.sum("_w").alias("_w"))
    )
    # The best label: largest weight, then smallest label.
    best = F.min(F.struct((-F.col("_w")).alias("w"), F.col("label").alias("label")))
    return (
        by_label.groupBy("qid", "split")
        .agg(best.alias("_best"), F.sum("_w").alias("_all"))
        .select(
            "qid",
            "split",
            F.col("_best.label").alias("prediction"),
            (-F.col("_best.w") / F.col("_all")).alias("certainty"),
        )
    )
