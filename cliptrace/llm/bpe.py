"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A batch of texts is one corpus.  Its distinct pre-tokens are laid out in one
symbol array; an inverted index maps each merge rank to the positions whose
adjacent pair has it.  Ranks are replayed in ascending order over all words at
once, and a merge updates only its two touched neighbours in the index.

Nulls encode as empty texts.  Texts of any length are encoded whole; repeated
rows are encoded alike; an empty table stays empty.  Columns with the names of
the output are replaced, others are kept.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_bytes, only

#: Bound on the rank file that is broadcast, in bytes.
MAX_VOCABULARY_BYTES = 64 << 20
#: Distinct space-led chunks that a worker remembers between batches.
CACHE_ENTRIES = 250_000
# Fixed value: the pattern for which texts may be cut before spaces, and a run
# of letters with one space before it is one match.
_CUTTING = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.iinfo(np.int32).max
_SPACE_BEFORE_WORD = regex.compile(r"(?= \S)", regex.V1)


class MergeTable:
    """Ranks of a byte-level vocabulary and the pairs that they merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for b, r in ranks.items():
            self.token[r] = b
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes {missing[:5]}")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for b, r in ranks.items():
            for cut in range(1, len(b)):
                left, right = ranks.get(b[:cut]), ranks.get(b[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(r)
        keys, merged = np.array(keys, np.int64), np.array(merged, np.int32)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], merged[order]
        # A token that can join a neighbour into an earlier rank must be merged
        # one place at a time; all others are merged at all places at once.
        self.hasty = np.zeros(self.size, bool)
        for part in (self.keys // self.size, self.keys % self.size):
            self.hasty[part[self.merged < part]] = True
        self.token_len = np.array([len(b) for b in self.token], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)))
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)

    @classmethod
    def from_tiktoken(cls, raw: bytes) -> MergeTable:
        """From the lines ``base64 rank`` of a tiktoken file."""
        pairs = (line.split() for line in raw.splitlines() if line)
        return cls({base64.b64decode(a): int(b) for a, b in pairs})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``_NONE`` where a pair does not merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], _NONE) if len(self.keys) else np.full(len(key), _NONE, np.int32)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all ``words``, flat, and the number of ids of each."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lens.sum())
        if not n:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[np.cumsum(lens)[lens > 0] - 1] = n  # n: no neighbour
        before = np.empty(n + 1, np.int32)
        before[:] = n
        linked = np.flatnonzero(after < n)
        before[after[linked]] = linked
        alive = np.ones(n + 1, bool)
        pair = np.full(n + 1, _NONE, np.int32)
        pair[linked] = self.rank(sym[linked], sym[after[linked]])
        # The inverted index: rank -> arrays of positions, filled by one sort.
        found = np.flatnonzero(pair[:n] != _NONE).astype(np.int32)
        found = found[np.argsort(pair[found], kind="stable")]
        ranks, starts = np.unique(pair[found], return_index=True)
        index: dict[int, list[np.ndarray]] = {int(r): [p] for r, p in zip(ranks, np.split(found, starts[1:]), strict=True)} if len(found) else {}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            pos = pos[alive[pos] & (pair[pos] == r)]
            if not len(pos):
                continue
            if self.hasty[r]:
                first = np.ones(len(pos), bool)
                first[1:] = word_of[pos[1:]] != word_of[pos[:-1]]
                if not first.all():
                    index[r] = [pos[~first]]
                    heapq.heappush(heap, r)
                pos = pos[first]
            elif len(pos) > 1:
                touching = after[pos[:-1]] == pos[1:]
                if touching.any():  # overlapping places: every second one of a run, from its left
                    run = np.flatnonzero(np.concatenate(([True], ~touching)))
                    place = np.arange(len(pos)) - np.repeat(run, np.diff(np.append(run, len(pos))))
                    pos = pos[place % 2 == 0]
            right = after[pos]
            beyond = after[right]
            sym[pos] = r
            alive[right] = False
            after[pos] = beyond
            before[beyond] = pos
            pair[right] = _NONE
            pair[pos] = _NONE
            has = beyond < n
            left = before[pos]
            had = left < n
            here = np.concatenate((pos[has], left[had]))
            if len(here):
                got = self.rank(sym[here], sym[after[here]])
                pair[here] = got
                ok = got != _NONE
                if ok.any():
                    here, got = here[ok], got[ok]
                    if len(got) > 1:
                        order = np.argsort(got, kind="stable")
                        here, got = here[order], got[order]
                        edge = np.flatnonzero(got[1:] != got[:-1]) + 1
                    else:
                        edge = ()
                    lo = 0
                    for hi in [*edge, len(got)]:
                        q = int(got[lo])
                        if q in index:
                            index[q].append(here[lo:hi])
                        else:
                            index[q] = [np.unique(here[lo:hi])]
                            heapq.heappush(heap, q)
                        lo = hi
        keep = alive[:n]
        return sym[keep], np.bincount(word_of[keep], minlength=len(words)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, one after another."""
        lens = self.token_len[ids]
        return self.token_bytes[_ragged(self.token_at[ids], lens)]


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


class _Places(dict):
    """Piece -> its place among the learned chunks; a new piece gets the next
    place and is noted.  -1: a piece that is empty or begins with white space,
    so that a pre-token may reach over the space before it."""

    def __init__(self, lead: str, new: list[str]):
        super().__init__()
        self.lead, self.new = lead, new

    def __missing__(self, piece: str) -> int:
        if self.lead and (not piece or piece[0].isspace()):
            self[piece] = -1
            return -1
        self.new.append(self.lead + piece)
        self[piece] = n = self.size()
        return n


class Encoder:
    """Encodes batches of texts and remembers chunks between them."""

    def __init__(self, table: MergeTable, pattern: str, cache: int = CACHE_ENTRIES):
        self.table, self.cache = table, cache
        self.find = lambda text, each=regex.compile(pattern).finditer: [m[0] for m in each(text) if m[0]]
        self.cutting = pattern == _CUTTING  # another pattern is run over whole texts
        self._forget()

    def _forget(self) -> None:
        self.new: list[str] = []
        self.learned = 0
        # A text is cut before each space that a non-space follows; no
        # pre-token reaches over such a cut.
        self.led, self.first = _Places(" ", self.new), _Places("", self.new)
        self.led.size = self.first.size = lambda: self.learned + len(self.new) - 1
        self.ids = [np.empty(0, np.int32)]
        self.lens = [np.empty(0, np.int64)]

    def _places(self, text: str) -> np.ndarray:
        """The places of the chunks of a text."""
        if not text:
            return np.empty(0, np.int32)
        if not self.cutting:
            return np.array([self.first[text]], np.int32)
        parts = text.split(" ")
        head = self.first[parts[0]]
        found = np.fromiter(map(self.led.__getitem__, parts), np.int32, len(parts))
        found[0] = head
        if found.min() >= 0:
            return found
        parts = [c for c in _SPACE_BEFORE_WORD.split(text) if c]
        return np.fromiter((self.led[c[1:]] if c[0] == " " and c[1:2].strip() else self.first[c] for c in parts), np.int32, len(parts))

    def _learn(self, new: list[str]) -> None:
        find = self.find
        pieces = [[c] if self.cutting and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else find(c) for c in new]
        words = list({w: None for p in pieces for w in p})
        place = {w: i for i, w in enumerate(words)}
        flat, n = self.table.replay([w.encode() for w in words])
        at = np.concatenate(([0], np.cumsum(n)))
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.fromiter((place[w] for p in pieces for w in p), np.int64, int(counts.sum()))
        self.ids.append(flat[_ragged(at[order], n[order])])
        total = np.concatenate(([0], np.cumsum(n[order])))
        edge = np.concatenate(([0], np.cumsum(counts)))
        self.lens.append(total[edge[1:]] - total[edge[:-1]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of ids of each."""
        if self.learned > self.cache:
            self._forget()
        each = [self._places(t) for t in texts]
        if self.new:
            self._learn(self.new)
            self.learned += len(self.new)
            self.new.clear()
        counts = np.fromiter(map(len, each), np.int64, len(each))
        which = np.concatenate(each) if each else np.empty(0, np.int32)
        self.ids, self.lens = [np.concatenate(self.ids)], [np.concatenate(self.lens)]
        n = self.lens[0]
        at = np.cumsum(n) - n
        flat = self.ids[0][_ragged(at[which], n[which])]
        total = np.concatenate(([0], np.cumsum(n[which])))
        edge = np.concatenate(([0], np.cumsum(counts)))
        return flat, total[edge[1:]] - total[edge[:-1]]


#: Characters of text that are encoded at a time, and rows that are returned.
SLICE_CHARS, SLICE_ROWS = 3 << 20, 2_048


def _slices(sizes: list[int], most: int, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (held + n > most or i - lo >= rows):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _offsets(lens: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lens))).astype(np.int32)


def _apply(rows: DataFrame, vocabulary: str, pattern: str | None, source: str, ids: str | None, decoded: str | None) -> DataFrame:
    """Encode column ``source`` (or take it as ids, without a pattern), decode
    if asked, and append the results; columns of these names are replaced."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    ranks = broadcast_bytes(rows.sparkSession, raw, len(raw), MAX_VOCABULARY_BYTES, "BPE ranks")
    added = {n.lower() for n in (ids, decoded) if n}
    keep = [c for c in rows.columns if c.lower() not in added]
    fields = [rows.schema[c] for c in keep]
    if ids:
        fields.append(T.StructField(ids, T.ArrayType(T.IntegerType(), False), False))
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType(), False))
    lead, n_keep = rows.select(F.col(source).alias("_source"), *[F.col(c) for c in keep]), len(keep)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = only(("bpe", hash(ranks.value), pattern), lambda: Encoder(MergeTable.from_tiktoken(ranks.value), pattern or ""))
        for batch in batches:
            given = batch.column(0)
            sizes = (pc.binary_length(given) if pattern else pc.list_value_length(given)).fill_null(0).to_pylist()
            for lo, hi in _slices(sizes, SLICE_CHARS):
                part = given.slice(lo, hi - lo)
                if pattern:
                    flat, n = encoder.encode([t or "" for t in part.to_pylist()])
                else:
                    n = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    flat = part.flatten().to_numpy(zero_copy_only=False)
                columns = [batch.column(1 + k).slice(lo, hi - lo) for k in range(n_keep)]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(_offsets(n)), pa.array(flat, pa.int32())))
                if decoded:
                    lens = encoder.table.token_len[flat]
                    total = np.concatenate(([0], np.cumsum(lens)))
                    edge = total[_offsets(n)].astype(np.int32)
                    columns.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(edge), pa.py_buffer(encoder.table.decode(flat))]))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return lead.mapInArrow(of, T.StructType(fields))


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids array<int>``: the token ids of each whole text.

    ``vocabulary`` is the path of a tiktoken rank file, read by the driver and
    broadcast (its size is checked).  A null text gives an empty array; rows,
    repeated ones too, stay as they are; an empty table stays empty.
    """
    return _apply(docs, vocabulary, pattern, text, ids, None)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the column ``decoded binary``: the bytes of each array of ids.

    A null array decodes to no bytes.
    """
    return _apply(encoded, vocabulary, None, ids, None, out)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids, in one pass over the rows."""
    return _apply(docs, vocabulary, pattern, text, ids, out)
