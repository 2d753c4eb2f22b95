"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import chunks, settle

SPACE = "▁"  # the piece character that stands for a blank
CACHED_WORDS = 100_000  # words of the younger generation that a task remembers; then it becomes the older one
CACHED_BYTES = 4_000_000  # and the bytes of these words
RUN_CHARS = 1 << 19  # of texts that are encoded at once
SLOT_BITS = 20
CODE_POINTS = 0x110000

_NONE = np.iinfo(np.int32).max  # rank of a pair that does not merge
_SHARED = -2  # a slot with several keys
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _one_by_one)


class Codec:
    """The tables of a BPE model with byte fallback, and its encoder and decoder for batches of texts.

    Only the vocabulary, the scores and the kinds of the pieces are taken from the model file. The model must add a
    dummy blank in front and change nothing else in a text.
    """

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        probe = "  AÅﬁ b \t"
        if model.decode(model.encode(probe)) != probe or model.encode("a") == model.encode("a", add_bos=True):
            raise ValueError("this model normalises texts; only models that keep them are supported")
        size = len(model)
        pieces = [model.id_to_piece(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        plain = [not (byte[i] or model.is_control(i) or model.is_unknown(i)) for i in range(size)]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in range(size):
            if byte[i]:
                self.byte_ids[int(pieces[i][1:-1], 16)] = i
        if sum(byte) != 256:
            raise ValueError("this model has no byte fallback")
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("this model has pieces that span words")
        # Characters that occur in pieces but are none themselves get symbols behind the vocabulary.
        symbols = dict(ids)
        for char in sorted({c for p in ids for c in p} - ids.keys()):
            symbols[char] = len(symbols) + size
        self.size = size
        self.of_char = np.full(CODE_POINTS, -1, dtype=np.int32)
        for char, symbol in symbols.items():
            if len(char) == 1:
                self.of_char[ord(char)] = symbol
        scores = {p: model.get_score(i) for p, i in ids.items()}
        rank = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        found: dict[int, tuple[int, int]] = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank[scores[piece]], i
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.ranks = np.array([found[k][0] for k in sorted(found)], dtype=np.int32)
        self.merged = np.array([found[k][1] for k in sorted(found)], dtype=np.int32)
        self.slots = _slot_tables(self.keys)
        # A line feed that no longer piece has is a word of its own.
        self.lines_alone = not any("\n" in p and len(p) > 1 for p in ids)
        self._cut_blanks(max((len(p) for p in ids if not p.strip(SPACE)), default=0))
        texts = [b""] * size
        for i in range(size):
            texts[i] = bytes([int(pieces[i][1:-1], 16)]) if byte[i] else pieces[i].replace(SPACE, " ").encode() if plain[i] else b""
        self.leading_blank = np.array([plain[i] and pieces[i].startswith(SPACE) for i in range(size)])
        self.piece_lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.piece_starts = np.concatenate(([0], np.cumsum(self.piece_lengths)[:-1]))
        self.piece_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.forget()

    def _cut_blanks(self, longest: int) -> None:
        """Let long runs of blanks begin with words of the longest blank piece, if this model cuts them that way.

        All blank pieces may share one rank, which allows one merge a round; the cut keeps such runs linear.
        """
        self.blanks = 0  # the blanks of such a word; 0 if runs are not cut
        if longest < 2:
            return
        runs = [self._encode_words([b" " * n])[0].tolist() for n in range(2 * longest, 5 * longest)]
        whole = self._encode_words([b" " * longest])[0].tolist()
        if all(b == whole + a for a, b in zip(runs, runs[longest:])):
            self.blanks = longest

    def forget(self) -> None:
        self.young, self.old = _Words(), _Words()

    # ---- merge rounds

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the rank is ``_NONE`` where the pair does not merge."""
        key = left.astype(np.int64) << 32 | right
        at = self.slots[0][_slot(key, 0)]
        for level, table in enumerate(self.slots[1:], 1):
            shared = np.flatnonzero(at == _SHARED)
            if not len(shared):
                break
            at[shared] = table[_slot(key[shared], level)]
        hit = (at >= 0) & (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.merged[at], -1)

    def _merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols left of each word when no pair merges any more, their first characters, and their number per word.

        A round takes the smallest pair rank of each word and merges its occurrences from the left, as many of them
        as the word-by-word order of the model would merge before it looks at another rank. Words without a pair
        leave the arrays.
        """
        word = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, into = self._next(symbols, word)
        while len(symbols):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, heads)
            per = np.diff(np.append(heads, len(word)))
            alive = np.repeat(least < _NONE, per)
            if not alive.all():
                out = ~alive
                done.append((word[out], symbols[out], at[out]))
                word, symbols, at, rank, into = word[alive], symbols[alive], at[alive], rank[alive], into[alive]
                if not len(symbols):
                    break
                per, least = per[least < _NONE], least[least < _NONE]
            least = np.repeat(least, per)
            site = self._leftmost(np.flatnonzero(rank == least))
            site = self._in_order(site, symbols, word, into, least)
            symbols[site] = into[site]
            keep = np.ones(len(symbols), dtype=bool)
            keep[site + 1] = False
            # Only the pairs around a merge are new.
            fresh = np.zeros(len(symbols), dtype=bool)
            fresh[site] = True
            before = site - 1
            before = before[before >= 0]
            before = np.where(keep[before], before, before - 1)  # that pair was merged as well
            fresh[before[before >= 0]] = True
            word, symbols, at = word[keep], symbols[keep], at[keep]
            rank, into, fresh = rank[keep], into[keep], np.flatnonzero(fresh[keep])
            rank[fresh], into[fresh] = self._next(symbols, word, fresh)
        if not done:
            return symbols, at, np.zeros(len(lengths), dtype=np.int64)
        word, symbols, at = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at, kind="stable")
        return symbols[order], at[order], np.bincount(word, minlength=len(lengths))

    def _next(self, symbols, word, at=None):
        """Rank and merged symbol of the pairs that begin at ``at`` (everywhere by default)."""
        at = np.arange(len(symbols)) if at is None else at
        after = np.minimum(at + 1, len(symbols) - 1)
        inside = (after > at) & (word[after] == word[at])
        return self._pairs(np.where(inside, symbols[at], -1), symbols[after])

    @staticmethod
    def _leftmost(site: np.ndarray) -> np.ndarray:
        """Of sites that overlap (i, i + 1, ...), every other one from the left."""
        run = np.flatnonzero(np.append(True, np.diff(site) != 1))
        place = np.arange(len(site)) - np.repeat(run, np.diff(np.append(run, len(site))))
        return site[place % 2 == 0]

    def _in_order(self, site, symbols, word, into, least):
        """The sites of each word up to the first whose merge makes a pair of the same or a better rank."""
        last = len(symbols) - 1
        left = site - 1
        has_left = (left >= 0) & (word[np.maximum(left, 0)] == word[site])
        beside = np.append(False, site[1:] == site[:-1] + 2) & has_left  # the left neighbour was merged just before
        left_symbol = np.where(beside, into[np.append(0, site[:-1])], symbols[np.maximum(left, 0)])
        right = np.minimum(site + 2, last)
        has_right = (site + 2 <= last) & (word[right] == word[site])
        a, _ = self._pairs(np.where(has_left, left_symbol, -1), into[site])
        b, _ = self._pairs(np.where(has_right, into[site], -1), symbols[right])
        stops = (np.minimum(a, b) <= least[site]).astype(np.int64)
        before = np.cumsum(stops) - stops  # sites before this one, in all words, that stop
        first = np.flatnonzero(np.append(True, word[site[1:]] != word[site[:-1]]))
        base = np.repeat(before[first], np.diff(np.append(first, len(site))))
        return site[before == base]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (none of them empty), flat, and their number per word."""
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        joined = b"".join(words)
        points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(points == 32, ord(SPACE), points)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        leads = np.frombuffer(joined, dtype=np.uint8) & 0xC0 != 0x80  # the first byte of each character
        lengths = np.add.reduceat(leads, np.append(0, ends[:-1]), dtype=np.int64)
        symbols, at, counts = self._merge(self.of_char[points], lengths)
        raw = (symbols < 0) | (symbols >= self.size)
        if not raw.any():
            return symbols, counts
        # Characters without a piece become their UTF-8 bytes.
        char = points[at].astype(np.int64)
        width = np.where(raw, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF), 1)
        ends = np.cumsum(width)
        ids = np.repeat(symbols, width)
        data = "".join(map(chr, char[raw].tolist())).encode("utf-8", "surrogatepass")
        ids[np.repeat(raw, width)] = self.byte_ids[np.frombuffer(data, dtype=np.uint8)]
        starts = np.concatenate(([0], np.cumsum(counts)))
        sums = np.concatenate(([0], ends))
        return ids, np.diff(sums[starts])

    # ---- texts

    def _words(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words of the texts, the places of all their words in that list, and the words up to each text.

        A word begins at each text, at the first blank of a run, and at and behind a line feed that is a word of its own.
        """
        parts = [(" " + t.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = b"".join(parts)
        bytes_ = np.frombuffer(data, dtype=np.uint8)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))))
        blank = bytes_ == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        if self.lines_alone:
            feed = bytes_ == 10
            begins |= feed
            begins[1:] |= feed[:-1]
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        longest = self.blanks
        if longest and b" " * (3 * longest) in data:
            for at, part in zip(bounds.tolist(), parts):
                for run in re.finditer(b" {%d,}" % (3 * longest), part):
                    begins[at + run.start() : at + run.end() - 2 * longest + 1 : longest] = True
        starts = np.flatnonzero(begins)
        offsets = pa.py_buffer(np.append(starts, len(data)))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        return distinct, words.indices.to_numpy(), np.searchsorted(starts, bounds)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, flat, and the offset of each text (one more than texts)."""
        if len(self.young.known) > CACHED_WORDS or self.young.bytes > CACHED_BYTES:
            self.young, self.old = _Words(), self.young
        distinct, index, per_text = self._words(texts)
        young, old = self.young, self.old
        at = young.places(distinct)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            at[unknown] = len(young.known) + np.arange(len(unknown))
            words = [distinct[i] for i in unknown.tolist()]
            before = old.places(words)  # words of the older generation are carried over, not merged again
            new, again = np.flatnonzero(before < 0), np.flatnonzero(before >= 0)
            ids, per = self._encode_words([words[i] for i in new.tolist()])
            sizes = np.zeros(len(words), dtype=np.int64)
            sizes[new], sizes[again] = per, old.starts[before[again] + 1] - old.starts[before[again]]
            starts = np.zeros(len(words), dtype=np.int64)
            starts[new], starts[again] = len(old.ids) + np.cumsum(per) - per, old.starts[before[again]]
            young.add(words, gathered(np.concatenate((old.ids, ids)), starts, sizes), sizes)
        at = at[index]
        starts, sizes = young.starts[at], young.starts[at + 1] - young.starts[at]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        return gathered(young.ids, starts, sizes), offsets[per_text]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids: pieces joined, blanks restored, the blank in front taken off."""
        sizes = self.piece_lengths[ids]
        data = gathered(self.piece_bytes, self.piece_starts[ids], sizes).tobytes()
        bounds = np.concatenate(([0], np.cumsum(sizes)))[offsets].tolist()
        first = np.minimum(offsets[:-1], max(len(ids) - 1, 0))
        leads = (self.leading_blank[ids[first]] if len(ids) else np.zeros(len(first), dtype=bool)) & (np.diff(offsets) > 0)
        return [data[a + x : b].decode("utf-8", "each-byte") for a, b, x in zip(bounds, bounds[1:], leads.tolist())]


class _Words:
    """Words and their ids, flat; ``starts`` has one more entry than there are words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it is not known."""
        return np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def add(self, words: list[bytes], ids: np.ndarray, per: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.bytes += sum(map(len, words))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(per)))


def _slot(key: np.ndarray, level: int) -> np.ndarray:
    """The slot of each key in the table of a level, by multiplicative hashing."""
    spread = (key.view(np.uint64) ^ (key.view(np.uint64) >> np.uint64(29))) * _ODD[level % len(_ODD)]
    return (spread >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_tables(keys: np.ndarray) -> list[np.ndarray]:
    """Tables from slot to the place of a key: -1 where there is none; keys that share a slot stand in the next table."""
    tables, left = [], np.arange(len(keys))
    while len(left) or not tables:
        slot = _slot(keys[left], len(tables))
        alone = np.bincount(slot, minlength=1 << SLOT_BITS) == 1
        table = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        table[slot] = np.where(alone[slot], left, _SHARED)
        tables.append(table)
        left = left[~alone[slot]]
    return tables


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``values[start : start + size]`` one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One codec per process and model; a task has it forget its words when it ends."""
    return Codec(model_file)


def coder(model_file: str):
    """Column function: text to its ids and the text that they decode to (struct<ids:array<int>,decoded:string>).

    Nulls and empty texts have no ids and decode to the empty text. Both fields come from one pass, a run at a time, so a
    text is encoded once and a task holds no more than a run beside its batch and what it returns for it. Words are
    forgotten with the task: its process lives on, through stages that have no use for them.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<ids:array<int>,decoded:string>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = codec(model_file)
        try:
            for texts in batches:
                yield coded(model, texts)
        finally:
            model.forget()
            settle()

    return code


def coded(model: Codec, texts: pa.Array) -> pa.Array:
    """The ids of each text of a batch and the text that they decode to."""
    parts = []
    for run in chunks((t.as_py() for t in texts), RUN_CHARS):
        ids, offsets = model.encode(run)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        parts.append(pa.StructArray.from_arrays([lists, pa.array(model.decode(ids, offsets), pa.string())], fields=_CODED))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(_CODED))


_CODED = [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]


def encode_decode(
    docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded"
) -> DataFrame:
    """``docs`` with the ids of each whole text and the text that these ids decode to.

    No begin or end ids and no sampling. A null or empty text has no ids and decodes to the empty text; blanks and
    the character that stands for them in pieces decode to blanks, all else comes back as it was. Rows stay where
    they are, repeated ones too; columns of the two new names are replaced, no other column is touched.
    """
    both: Column = coder(model_file)(F.col(text_col))
    return docs.withColumns({ids_col: both["ids"], decoded_col: both["decoded"]})
