"""Shards from a weighted hash tree: region, rack and shard are drawn one after the other by weighted hash draws."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeprofile.llm.common import stored
from lakeprofile.operators.ranks import global_positions

LAW = "key"
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 5
OVERHEAD = 16  # bytes that a row takes besides its text
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


class Shard(NamedTuple):
    name: str
    number: int
    weight: float = 1.0


Tree = list[list[list[Shard]]]  # regions of racks of shards
EMPTY = Shard("", -1, 0.0)  # fills up shorter racks


def tree(
    shards: int,
    founding: int | None = None,
    racks: int = RACKS_PER_REGION,
    per_rack: int = SHARDS_PER_RACK,
    weights: Sequence[float] | None = None,
) -> Tree:
    """The tree over ``shards`` shards: the first ``founding`` ones (all by default) fill regions of ``racks`` racks
    with ``per_rack`` shards each, every later one opens a region of its own.

    So the tree of one more shard has one more region and is otherwise the same, and the draws between regions move
    rows into that region only. ``weights`` are those of the shards, 1 by default; 0 empties a shard.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    founding = min(shards, founding or shards)
    all_shards = [Shard(f"shard {i}", i, 1.0 if weights is None else float(weights[i])) for i in range(shards)]
    size = racks * per_rack
    regions = [all_shards[i : min(i + size, founding)] for i in range(0, founding, size)]
    regions += [[s] for s in all_shards[founding:]]
    return [[r[i : i + per_rack] for i in range(0, len(r), per_rack)] for r in regions]


def _race(key: Column, name: Column, weight: Column) -> Column:
    """-ln(draw) / weight; a child without weight never wins."""
    digits = F.substring(F.md5(F.concat(key, F.lit("|"), name).cast("binary")), 1, _DIGITS)
    chance = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return F.when(weight > 0, -F.ln(chance) / weight).otherwise(float("inf"))


def _winner(key: Column, children: Column) -> Column:
    """The place of the winner among ``children``, an array of (name, weight)."""
    races = F.transform(children, lambda c, i: F.struct(_race(key, c["name"], c["weight"]).alias("d"), i.alias("i")))
    return F.array_min(races)["i"]


def _lookup(table: Sequence, *at: Column) -> Column:
    """``table[at[0]][at[1]]...`` of a nested literal table whose rows have equal lengths."""
    found = _literal(table)
    for place in at:
        found = F.element_at(found, place + 1)
    return found


def _literal(table) -> Column:
    if isinstance(table, list):
        return F.array(*map(_literal, table))
    if isinstance(table, tuple):
        return F.struct(F.lit(table[0]).alias("name"), F.lit(table[1]).alias("weight"))
    return F.lit(table)


def assign(rows: DataFrame, key: Column, tree: Tree, out_col: str) -> DataFrame:
    """``rows`` with the shard of each key, found by descending the tree.

    At each level the child with the smallest -ln(draw) / weight is entered. A draw depends on the key and the name of
    the child only, so a key leaves a child only if its weight falls or that of a sibling rises: movement stays in
    the subtrees whose weights change. A key takes one draw per child on its way, not one per shard.
    """
    racks = max(len(r) for r in tree)
    slots = max(len(k) for r in tree for k in r)
    full = [[(k + [EMPTY] * slots)[:slots] for k in (r + [[]] * racks)[:racks]] for r in tree]
    if not any(s.weight > 0 for r in full for k in r for s in k):
        raise ValueError("all weights are zero")
    of_shards = [[[(s.name, float(s.weight)) for s in k] for k in r] for r in full]
    of_racks = [[(f"rack of {k[0].name}", sum(float(s.weight) for s in k)) for k in r] for r in full]
    of_regions = [(f"region of {r[0][0].name}", sum(w for _, w in racks)) for r, racks in zip(full, of_racks)]
    numbers = [[[s.number for s in k] for k in r] for r in full]
    region, rack, slot = F.col("__region"), F.col("__rack"), F.col("__slot")
    return (
        rows.withColumn("__region", _winner(key, _literal(of_regions)))
        .withColumn("__rack", _winner(key, _lookup(of_racks, region)))
        .withColumn("__slot", _winner(key, _lookup(of_shards, region, rack)))
        .withColumn(out_col, _lookup(numbers, region, rack, slot))
        .drop("__region", "__rack", "__slot")
    )


def shards_of(docs: DataFrame, shards: int, founding: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    The law is ``key``: the id and the number of shards decide. ``grown_shard`` is the shard under one shard more
    (with the same ``founding``); it differs from ``shard`` only where the row moves into the new shard. ``slot``
    counts the rows of a shard from 0 without gaps in the order of id, size and checksum. Size is the bytes of the
    text (null: none) plus 16. Rows that repeat an id share its shard and have slots of their own; a null id is the
    key ``null``. An empty table gives no rows; further columns are left out.

    Texts are reduced to sizes and checksums where they are read; only these narrow rows are sorted, by ranges that
    split a large shard over many tasks.
    """
    founding = founding or shards
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign(narrow, key, tree(shards, founding), "shard")
    placed = stored(assign(placed, key, tree(shards + 1, founding), "grown_shard"), "shards")
    numbered = global_positions(placed, ["shard", "doc_id", "size", "text_crc32", "grown_shard"])
    # One row per shard.
    first = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    first = first.withColumn("__first", F.sum("n").over(W.orderBy("shard")) - F.col("n")).drop("n")
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("position") - F.col("__first")).alias("slot"),
        "grown_shard",
    )
