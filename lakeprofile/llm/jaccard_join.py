"""N-gram Jaccard join by grouped prefixes: collapse, filter group pairs, expand and verify members."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import chunks, free_names, light, settle, stored
from lakeprofile.llm.components import components

WORDS_PER_SHINGLE = 5
PERCENT = 80
COUNT_BITS = 20  # word counts are kept in a table of that many bits, whatever the number of words
FILTER_BITS = (22, 30)  # least and most bits (as powers of two) of a filter; in between it has sixteen per key
BROADCAST_PAIRS = 200_000  # pairs whose set ids, or documents whose keys, are broadcast
WHOLE_LIST = 64  # lists up to this length are compared pair by pair, longer ones by pivots first
SHORT_LIST = 64  # lists above this length are split by the sizes of their members
BEFORE = 4  # an entry of a list carries so many shared tokens that stand before its own

_SPLIT = 1 << 22
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])  # bytes between words
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Rule(NamedTuple):
    """What a shingle is, and when two sets of them link: 100 * intersection >= percent * union."""

    words: int = WORDS_PER_SHINGLE
    percent: int = PERCENT

    def prefix(self, size: int) -> int:
        """Of two linked sets, each in the common order, the first so many tokens have one in common."""
        return size - (self.percent * size + 99) // 100 + 1


def words_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of the texts (A-Z lower-cased), the place of each of all words in that list, and the number of
    words of each text. Words are cut and numbered for all texts at once."""
    parts = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(parts).translate(_LOWER), dtype=np.uint8)
    gap = _GAP[data]
    edges = np.flatnonzero(np.diff(gap, prepend=True))  # a text ends with a gap, so each word has a start and an end
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    bounds = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
    per_text = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), per_text


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingles of texts, and the weight of each shingle when word counts are given."""

    def __init__(self, rule: Rule, counts: np.ndarray | None = None):
        self.rule, self.counts = rule, counts
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.weights = np.zeros(0, dtype=np.uint16)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words."""
        import xxhash

        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            fresh = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), dtype=np.uint64, count=len(new))
            self.hashes = np.concatenate((self.hashes, fresh))
            if self.counts is not None:
                slots = np.fromiter(map(zlib.crc32, new), dtype=np.int64, count=len(new)) & (len(self.counts) - 1)
                self.weights = np.concatenate((self.weights, _weights(self.counts[slots])))
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def _shingles(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """The hash of each run of so many words; runs of another length have hashes of their own."""
        total = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            total = _mixed(total * _ODD[3] + hashes[i : i + len(total)])
        return total

    def sets(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Per text the sorted distinct shingles and, given word counts, their weights: the least of their words."""
        if len(self.known) > 300_000:
            self.__init__(self.rule, self.counts)
        words, index, per_text = words_of(texts)
        flat = self._ids(words)[index]
        k, hashes = self.rule.words, self.hashes[flat]
        runs = self._shingles(hashes, k) if len(flat) >= k else None  # of all texts at once; those across two are left out
        least = weights = None
        if self.counts is not None:
            weights = self.weights[flat]
            if runs is not None:
                least = weights[: len(runs)]
                for i in range(1, k):
                    least = np.minimum(least, weights[i : i + len(runs)])
        at = 0
        for n in per_text.tolist():
            start = at
            at += n
            if not n:
                yield np.zeros(0, dtype=np.uint64), None if weights is None else np.zeros(0, dtype=np.uint16)
            elif n < k:
                yield self._shingles(hashes[start:at], n), None if weights is None else weights[start:at].min(keepdims=True)
            else:
                here = slice(start, at - k + 1)
                if least is None:
                    found = np.sort(runs[here])
                    yield found[_firsts(found)], None
                else:
                    order = np.argsort(runs[here])
                    found = runs[here][order]
                    first = _firsts(found)
                    yield found[first], least[here][order][first]


def _weights(counts: np.ndarray) -> np.ndarray:
    """Counts as numbers of 16 bits that never fall as the counts rise."""
    return (np.log2(counts + 1.0) * 1024).astype(np.uint16)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Whether each number differs from the one before."""
    first = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return first


def _set_id(tokens: np.ndarray) -> bytes:
    """128 bits that only the set decides."""
    one, two = tokens.sum(dtype=np.uint64), _mixed(tokens ^ _ODD[0]).sum(dtype=np.uint64)  # shingles are spread already
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def _parities(tokens: np.ndarray) -> np.ndarray:
    """Whether each of 256 classes of shingles has an odd number of members, as four numbers."""
    odd = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def word_counts(docs: DataFrame, bits: int = COUNT_BITS) -> np.ndarray:
    """How often words occur, in a table of 2 ** bits counters that words share by a checksum.

    A counter is never below the count of its words, and so never below that of a shingle with one of them. The
    table has the same size for any input; that is all the driver receives.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for run in chunks(batch["text"].to_pylist()):
                found, index, _ = words_of(run)
                slots = np.fromiter(map(zlib.crc32, found), dtype=np.int64, count=len(found)) & (len(table) - 1)
                np.add.at(table, slots, np.bincount(index, minlength=len(found)))
        used = np.flatnonzero(table)
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"slot": part, "n": table[part]})

    totals = docs.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = totals.toArrow()
    table = np.zeros(1 << bits, dtype=np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return table


def signatures(docs: DataFrame, rule: Rule, counts) -> DataFrame:
    """Per document: id, hash of its text, size of its set, set id, the prefix (the shingles that come first in the common
    order), and the parities of its classes of shingles.

    The order is by weight, then by hash. A shingle of high frequency has a high weight, as all its words have, so it
    stands last in every document and hardly ever gets into a prefix.
    """

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rule, counts.value)
        for batch in batches:
            sizes, ids, prefixes, bits = [], [], [], []
            for run in chunks(batch["text"].to_pylist()):
                for tokens, weights in shingler.sets(run):
                    n = len(tokens)
                    sizes.append(n)
                    ids.append(_set_id(tokens))
                    bits.append(_parities(tokens))
                    first = np.argsort(weights, kind="stable")[: rule.prefix(n)]  # tokens are sorted already
                    prefixes.append(tokens[first if n else first[:0]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    batch["h"],
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                names=["id", "h", "n", "sid", "prefix", "bits"],
            )
        del shingler  # with the words it knows, before the process goes on to other tasks
        settle()

    rows = docs.select("id", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(sign, "id bigint, h bigint, n bigint, sid binary, prefix array<bigint>, bits array<bigint>")


class Filter(NamedTuple):
    """A bitmap of hashed keys. It has at most 2 ** 30 bits (128 MB); with more keys than that it passes more others on,
    which the join behind it tells apart."""

    bits: int
    words: np.ndarray

    @staticmethod
    def of(keys: DataFrame, column) -> Filter:
        least, most = FILTER_BITS
        bits = min(most, max(least, (16 * keys.count()).bit_length()))
        place = F.pmod(F.xxhash64(column), F.lit(1 << bits))
        found = (
            keys.select(F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
            .groupBy("word")
            .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
            .toArrow()
        )
        words = np.zeros(1 << (bits - 6), dtype=np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        return Filter(bits, words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & ((1 << self.bits) - 1)
        return (self.words[at >> 6] >> (at & 63)) & 1


def shared_prefixes(signed: DataFrame) -> DataFrame:
    """sid, n, bits, id (the smallest), length of the prefix, and its tokens that other sets have too as (i, token).

    Tokens are counted first, alone. Most are in the prefix of one set only; a filter takes them out of the prefixes
    before these are moved, and the join with the shared tokens takes out what is left of them.
    """
    tokens = signed.select(F.explode("prefix").alias("token"), F.xxhash64("sid").alias("key"))
    ends = tokens.groupBy("token").agg(F.min("key").alias("one"), F.max("key").alias("other"))
    shared = stored(ends.where("one <> other").select("token"), "shared-tokens")
    broadcast = signed.sparkSession.sparkContext.broadcast(Filter.of(shared, "token"))

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = broadcast.value
        for batch in batches:
            lists, hashes = batch["prefix"], batch["hashes"].flatten().to_numpy()
            ends_ = np.cumsum(np.asarray(lists.value_lengths()))
            hit = np.flatnonzero(filter_.has(hashes))
            row = np.searchsorted(ends_, hit, side="right")
            starts = ends_ - np.asarray(lists.value_lengths())
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(ends_))))).astype(np.int32)
            places = pa.array(hit - starts[row] + 1, pa.int64())
            for_rows = [pa.ListArray.from_arrays(offsets, v) for v in (places, lists.flatten().take(pa.array(hit)))]
            columns = [*(batch[c] for c in ("sid", "n", "bits", "id", "length")), *for_rows]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "n", "bits", "id", "length", "i", "token"])

    rows = signed.where("n > 0").select(
        "sid", "n", "bits", "id", F.size("prefix").alias("length"), "prefix",
        F.transform("prefix", lambda t: F.xxhash64(t)).alias("hashes"),
    )
    schema = "sid binary, n bigint, bits array<bigint>, id bigint, length int, i array<bigint>, token array<bigint>"
    rows = rows.mapInArrow(hits, schema).where(F.size("i") > 0)
    firsts = [F.first(c).alias(c) for c in ("n", "bits", "length", "i", "token")]
    sets = stored(rows.groupBy("sid").agg(F.min("id").alias("id"), *firsts), "prefixes")
    broadcast.destroy()
    postings = sets.select("sid", F.explode(F.arrays_zip("i", "token")).alias("e")).select("sid", "e.*")
    # Postings are many, so they carry nothing but the set, the place and the token; what else is known joins afterwards.
    kept = postings.join(shared, "token").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("kept"))
    return kept.join(sets.drop("i", "token"), "sid")


def whole_sets(docs: DataFrame, rule: Rule, wanted: DataFrame) -> DataFrame:
    """sid and sorted 64-bit shingles of at least the wanted sets, stored; ``wanted`` holds the id of a document with each.

    Documents are passed over by a filter of their ids; a false hit or a repeated id adds rows that no pair asks for or
    that give a link twice.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(Filter.of(wanted, "id"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, filter_ = Shingler(rule), broadcast.value
        for batch in batches:
            hit = np.flatnonzero(filter_.has(batch["place"].to_numpy()))
            texts = batch["text"].take(pa.array(hit)).to_pylist()
            for run in chunks(texts):
                ids, sets = [], []
                for tokens, _ in shingler.sets(run):
                    ids.append(_set_id(tokens))
                    sets.append(tokens.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], names=["sid", "tokens"])
        del shingler
        settle()

    found = docs.select("text", F.xxhash64("id").alias("place")).mapInArrow(cut, "sid binary, tokens binary")
    found = stored(found, "sets")
    broadcast.destroy()
    return found


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of set ids that link."""
    from pyspark.sql.functions import arrow_udf

    percent = rule.percent

    @arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.array(out, type=pa.bool_())

    both = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    needed = both.select(F.col("a").alias("sid")).union(both.select("b")).distinct()
    if both.count() <= BROADCAST_PAIRS:  # then so few sets are asked for that the others need not be moved
        needed = F.broadcast(needed)
    asked = sets.join(needed, "sid", "left_semi")
    left = asked.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    right = asked.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    return both.join(left, "a").join(right, "b").where(linked("ta", "tb")).select("a", "b")


ENTRY = ["sid", "n", "i", "s", "before", "bits", "alone"]


def _may_link(rule: Rule):
    """Whether an entry of a list and the entry ``p`` can link: by sizes, by places, and by parities.

    Both share a token, the i-th of each. Before it stand s tokens that any other prefix has as well. The others are in
    no other prefix, and so not in the other set either, as there they would stand before the shared token too. What can
    be common is the shared token, the s before it, and what stands behind it. A class of shingles with different
    parities has a member that one set lacks.
    """
    n, m, percent = F.col("n"), F.col("p.n"), rule.percent
    most = 1 + F.least("s", "p.s") + F.least(n - F.col("i"), m - F.col("p.i"))
    apart = sum(F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("p.bits", F.lit(k)))) for k in range(4))
    by_size = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    by_place = 100 * most >= percent * (n + m - most)
    return by_size & by_place & ((100 + percent) * (n + m - apart) >= 2 * percent * (n + m))


def _pivot_pairs(entries: DataFrame, buckets: int, rule: Rule) -> DataFrame:
    """Pairs of the members of each list with its pivots, one per bucket: the member with the fewest tokens of its own.

    Pivots are minima, which are taken in the tasks first; they are few, so the join may split a long list.
    """
    bucket = F.pmod(F.xxhash64("sid"), F.lit(buckets))
    pivots = (
        entries.groupBy("list", bucket.alias("bucket"))
        .agg(F.min(F.struct("alone", *ENTRY[:-1], "comp")).alias("p"))
        .drop("bucket")
    )
    joined = entries.join(pivots, "list").where((F.col("comp") != F.col("p.comp")) & _may_link(rule))
    return joined.select(F.col("p.sid").alias("a"), F.col("sid").alias("b"))


def _all_pairs(entries: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of members in different components, for lists of bounded length.

    Longer lists are split by size: a set links with larger ones of its own band of sizes and of the next one only. A pair
    that has one of the tokens just before this one in common too is left to the list of that token: both sets are
    there, in different components, so that list is open as well and compares them in this round or in a later one.
    """
    width = math.log(100 / rule.percent) * 1.000001 if rule.percent < 100 else 1e-6
    band = F.floor(F.log(F.col("n").cast("double")) / width)
    short = F.col("long") <= SHORT_LIST
    other = F.struct(*ENTRY, "comp").alias("p")
    smaller = entries.where(~short).withColumn("band", F.explode(F.array(band, band + 1)))
    larger = entries.where(~short).select("list", band.alias("band"), other)
    whole = entries.where(short)
    in_order = (F.col("n") < F.col("p.n")) | ((F.col("n") == F.col("p.n")) & (F.col("sid") < F.col("p.sid")))
    apart = in_order & (F.col("comp") != F.col("p.comp"))
    asked = apart & _may_link(rule) & ~F.arrays_overlap("before", "p.before")
    pair = (F.col("sid").alias("a"), F.col("p.sid").alias("b"))
    of_long = smaller.join(larger, ["list", "band"]).where(asked).select(*pair)
    return whole.join(whole.select("list", other), "list").where(asked).select(*pair).union(of_long)


def linked_sets(docs: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """sid and comp of every set that has a link to another set; comp is the smallest sid of its component."""
    remaining = shared_prefixes(signed)

    # Collapse: sets with the same remaining prefix and size are one group, named by its smallest member.
    def entry(e, s):
        before = F.slice("kept", F.greatest(s - F.lit(BEFORE - 1), F.lit(1)), F.least(s, F.lit(BEFORE)))
        tokens = F.transform(before, lambda x: x["token"])
        return F.struct(e["token"].cast("string").alias("list"), e["i"].alias("i"), s.alias("s"), tokens.alias("before"))

    remaining = remaining.select(
        "sid", "n", "id", "bits", F.transform("kept", entry).alias("entries"),
        F.transform("kept", lambda e: e["token"]).alias("tokens"), (F.col("length") - F.size("kept")).alias("alone"),
    )
    remaining = stored(remaining, "members")
    groups = remaining.groupBy("tokens", "n").agg(
        F.min(F.struct("alone", "sid", "bits", "entries")).alias("first"), F.count(F.lit(1)).alias("members")
    )
    groups = stored(groups.select("tokens", "n", "first.*", "members"), "groups")
    whole = whole_sets(docs, rule, remaining.select("id"))

    def exploded(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode("entries").alias("e"), "sid", "n", "bits", "alone").select(
            "e.*", "sid", "n", "bits", "alone"
        ).select("list", *ENTRY)

    # First the group pairs of each token's list, and the members of each group, by one pivot each.
    several = groups.where("members > 1").select("tokens", "n", F.hex("sid").alias("list"))
    inner = remaining.join(several, ["tokens", "n"]).select(
        "list", "sid", "n", F.lit(1).cast("bigint").alias("i"), F.lit(0).alias("s"),
        F.array().cast("array<bigint>").alias("before"), "bits", "alone",
    )
    first = exploded(groups).unionByName(inner).withColumn("comp", F.col("sid"))
    links = stored(_verified(_pivot_pairs(first, 1, rule), whole, rule), "links")
    comps = components(links)

    # Then expand: whatever is still apart within a list is compared, by more pivots each round in long lists.
    lists = exploded(remaining)
    reach, buckets = WHOLE_LIST, 4
    while True:
        labels = light(comps.select(F.col("node").alias("sid"), "label"), BROADCAST_PAIRS)
        entries = lists.join(labels, "sid", "left")
        entries = entries.withColumn("comp", F.coalesce("label", "sid")).drop("label")
        state = entries.groupBy("list").agg(
            F.count(F.lit(1)).alias("long"), F.min("comp").alias("c1"), F.max("comp").alias("c2")
        )
        entries = stored(entries.join(state.where("c1 <> c2").select("list", "long"), "list"), "open-lists")
        longest = entries.agg(F.max("long")).first()[0]
        if longest is None:
            break
        pairs = _all_pairs(entries.where(F.col("long") <= reach), rule)
        if longest > reach:
            pairs = pairs.union(_pivot_pairs(entries.where(F.col("long") > reach), buckets, rule))
        found = stored(_verified(pairs, whole, rule), "links")
        if not found.isEmpty():
            links = links.union(found)
            comps = components(links)
        if longest <= reach:
            break
        lists = entries.where(F.col("long") > reach).select("list", *ENTRY)
        reach, buckets = reach * 8, buckets * 4
    return comps.select(F.col("node").alias("sid"), F.col("label").alias("comp"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, set_id, label and component_id.

    A document's set holds its distinct shingles of ``rule.words`` words (A-Z lower-cased); a shorter text is one
    shingle, a null, empty or blank text has none and links with nothing (its label is null). Two sets link by
    ``rule.percent``; equal sets always do. ``label`` names the component and ``component_id`` is the smallest id that
    links reach. Rows that repeat an id are documents of their own with that id; null ids are passed over when the
    smallest is taken, unless there is no other. Further columns are left out; an empty table gives no rows.

    Equal sets are one set throughout. No pairs within a group are listed: members are compared with a pivot first and
    with each other only while they are in different components, and no link is lost by that.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(word_counts(rows))
    signed = stored(signatures(rows, rule, counts), "signatures")
    counts.destroy()
    comps = linked_sets(rows, signed, rule)
    classes = signed.where("n > 0").groupBy("sid").agg(F.min("id").alias("id"))
    labelled = classes.join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    smallest = labelled.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_set = labelled.join(smallest, "comp").select("sid", F.col("comp").alias("label"), "component_id")
    columns = ["id", "h", "n", "sid", "label", "component_id"]
    empty = signed.where("n = 0").withColumns({"label": F.lit(None).cast("binary"), "component_id": F.col("id")})
    full = signed.where("n > 0").join(of_set, "sid")
    return (
        full.select(*columns)
        .union(empty.select(*columns))
        .toDF("doc_id", "text_hash", "n_shingles", "set_id", "label", "component_id")
    )


def keep_first(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id (null ids last), then text hash.

    Documents without words all stay. Of rows equal in id and text one stays. All columns are kept.
    """
    found = stored(near_duplicates(docs, rule, id_col, text_col), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = found.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(rank).alias("w")).select("w.doc_id", "w.text_hash")
    # A null id is told apart by the second key column.
    names = free_names(docs, "key", "null_key", "key_hash")
    own = F.col(id_col).cast("bigint")
    keyed = docs.withColumns(dict(zip(names, (F.coalesce(own, F.lit(0)), own.isNull(), F.xxhash64(text_col)))))
    found_key = (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("text_hash"))
    key = [c.alias(n) for c, n in zip(found_key, names)]
    linked = found.where(F.col("label").isNotNull()).select("doc_id", "text_hash")
    firsts = stored(first.select(*key), "first-documents")
    # Most documents stay, so those that go are looked up; texts are moved only if these are too many to be sent.
    losers = stored(linked.select(*key).distinct().join(firsts, names, "left_anti"), "later-documents")
    kept = keyed.join(light(losers, BROADCAST_PAIRS), names, "left_anti")
    twins = stored(linked.select(*key).groupBy(*names).count().where("count > 1").drop("count"), "equal-rows")
    if not twins.isEmpty():
        one = kept.join(light(twins, BROADCAST_PAIRS), names, "left_semi").dropDuplicates(names)
        kept = kept.join(light(twins, BROADCAST_PAIRS), names, "left_anti").unionByName(one)
    return kept.drop(*names)
