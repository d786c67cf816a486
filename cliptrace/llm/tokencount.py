"""Token counts by rank-synchronous array merging.

The pre-tokens of a sentence-piece model are held as ragged numpy arrays.  In
each round every sequence merges its lowest-rank (best-scored, then leftmost)
pair, all sequences at once; the symbols that survive are counted.

Counts equal the library's without begin, end or added special tokens.  Null
texts count as empty; texts of any length are counted whole, by the same merges;
repeated rows count alike; an empty table stays empty.  A column of the output's
name is replaced, others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_bytes, only

#: Bound on the model file that is broadcast, in bytes.
MAX_MODEL_BYTES = 64 << 20
#: Distinct units that a worker remembers between batches.
CACHE_ENTRIES = 600_000
#: Symbols that are merged in one ragged array.
SYMBOLS_AT_ONCE = 1 << 20
_SPACE = "▁"  # the model's sign for a space
_NONE = np.iinfo(np.int64).max


# The number that marks a user-defined piece in a model file, and
# characters that usual normalizers change.
_USER_DEFINED = 4
_PROBE = "ﬁ Ａ  é e\u0301 ①  x "


def _piece_types(raw: bytes) -> Iterator[int]:
    """The type of each piece of a model file (field 3 of its messages 1)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(data):
            name, kind = divmod(number(), 8)
            if kind == 0:
                yield name, number()
            else:
                n = {1: 8, 5: 4}.get(kind) or number()
                yield name, data[at : at + n]
                at += n

    for name, piece in fields(raw):
        if name == 1:
            yield next((v for f, v in fields(piece) if f == 3), 1)


class PieceModel:
    """Pieces and scores of a sentence-piece BPE model with byte fallback."""

    def __init__(self, raw: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        if _USER_DEFINED in set(_piece_types(raw)):
            raise ValueError("user-defined pieces are not supported")
        if sp.normalize(_PROBE).replace(_SPACE, " ") != " " + _PROBE:
            raise ValueError("models that normalize texts are not supported")
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in normal}
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.rank_of = rank.astype(np.int64)
        self.size = n + 5  # n + k: a character without a piece, of k bytes
        if any(_SPACE in p.lstrip(_SPACE) for p in self.id):
            raise ValueError("pieces with a space inside them are not supported")
        self.weight = np.concatenate((np.ones(n, np.int64), np.arange(5)))
        code = np.arange(0x110000)
        self.start = (n + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int32)
        keys, to = [], []
        for p, i in self.id.items():
            if len(p) == 1:
                self.start[ord(p)] = i
            for cut in range(1, len(p)):
                a, b = self._part(p[:cut], n), self._part(p[cut:], n)
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    to.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]
        # Ranks whose merge can make a pair of an earlier rank, or that several
        # pieces share: their places are merged one at a time.
        self.hasty = np.bincount(self.rank_of[normal], minlength=n) > 1
        for part in (self.keys // self.size, self.keys % self.size):
            known = part < n
            earlier = self.rank_of[self.to[known]] < self.rank_of[part[known]]
            self.hasty[self.rank_of[part[known][earlier]]] = True

    def _part(self, p: str, n: int) -> int | None:
        return self.id.get(p)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; rank ``_NONE`` where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        to = np.where(hit, self.to[at], 0)
        return np.where(hit, self.rank_of[to], _NONE), to

    def count(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit.  Units of like length are merged together, so
        that a long one does not keep short ones waiting."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        out = np.zeros(len(units), np.int64)
        order = np.argsort(lens, kind="stable")
        order = order[lens[order] > 0]
        total, size = np.cumsum(lens[order]), np.frexp(lens[order].astype(float))[1]
        lo = 0
        while lo < len(order):
            hi = min(int(np.searchsorted(total, total[lo] - lens[order[lo]] + SYMBOLS_AT_ONCE, side="right")), int(np.searchsorted(size, max(size[lo], 6), side="right")))
            at = order[lo : max(hi, lo + 1)]
            out[at] = self._ragged([units[i] for i in at], lens[at])
            lo += len(at)
        return out

    def _ragged(self, units: list[str], lens: np.ndarray) -> np.ndarray:
        """Rounds of merges: in each, every sequence applies its lowest-rank
        pair, at all its places at once where no merge of that rank can lead to
        an earlier one, else at the leftmost."""
        sym = self.start[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)].astype(np.int64)
        out, seq = np.zeros(len(units), np.int64), np.arange(len(units))
        first = np.cumsum(lens) - lens
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            rank[:-1] = self.pairs(sym[:-1], sym[1:])[0]
        rank[first + lens - 1] = _NONE
        while True:
            low = np.minimum.reduceat(rank, first)
            done = low == _NONE
            if done.any():
                out[seq[done]] = np.add.reduceat(self.weight[sym], first)[done]
                keep = np.repeat(~done, lens)
                sym, rank = sym[keep], rank[keep]
                lens, seq, low = lens[~done], seq[~done], low[~done]
                if not len(seq):
                    return out
                first = np.cumsum(lens) - lens
            hit = np.flatnonzero(rank == np.repeat(low, lens))
            owner = np.searchsorted(first, hit, side="right") - 1
            lead = np.ones(len(hit), bool)
            lead[1:] = owner[1:] != owner[:-1]
            # Overlapping places: every second one of a run, from its left.
            run = np.ones(len(hit), bool)
            run[1:] = hit[1:] != hit[:-1] + 1
            begin = np.flatnonzero(run)
            apart = (np.arange(len(hit)) - np.repeat(begin, np.diff(np.append(begin, len(hit))))) % 2 == 0
            chosen = np.where(self.hasty[low[owner]], lead, apart)
            at, owner = hit[chosen], owner[chosen]
            sym[at] = self.pairs(sym[at], sym[at + 1])[1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank = sym[keep], rank[keep]
            lens = lens - np.bincount(owner, minlength=len(lens))
            first = np.cumsum(lens) - lens
            at = at - np.arange(len(at))  # one symbol went for each place before
            rank[at] = _NONE
            last = (first + lens - 1)[owner]
            p = at[at < last]
            rank[p] = self.pairs(sym[p], sym[p + 1])[0]
            p = at[at > first[owner]]
            rank[p - 1] = self.pairs(sym[p - 1], sym[p])[0]


_CUT = re.compile(f"(?<=[^{_SPACE}])(?={_SPACE})")


class Counter:
    """Counts tokens of batches of texts and remembers units between them."""

    def __init__(self, model: PieceModel, cache: int = CACHE_ENTRIES):
        self.model, self.cache, self.known = model, cache, {}

    @staticmethod
    def units(text: str) -> list[str]:
        """Pieces that no merge crosses, each led by its space signs: no piece
        of the model has a space sign after another character."""
        if not text:
            return []
        if _SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return _CUT.split(_SPACE + text.replace(" ", _SPACE))
        return text.split(" ")  # the sign before each is added where it is counted

    def count(self, texts: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.cache:
            known.clear()
        parts = [self.units(t) for t in texts]
        new = list({u: None for p in parts for u in p if u not in known})
        if new:
            full = [u if u[:1] == _SPACE else _SPACE + u for u in new]
            known.update(zip(new, self.model.count(full).tolist(), strict=True))
        get = known.__getitem__
        return np.fromiter((sum(map(get, p)) for p in parts), np.int64, len(parts))


def count_tokens(docs: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the column ``n_tokens long``.

    ``model`` is the path of a sentence-piece file, read by the driver and
    broadcast (its size is checked).  A null or empty text has 0 tokens.
    """
    with open(model, "rb") as f:
        raw = f.read()
    sent = broadcast_bytes(docs.sparkSession, raw, len(raw), MAX_MODEL_BYTES, "piece model")

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = only(("tokens", hash(sent.value)), lambda: Counter(PieceModel(sent.value)))
        for batch in batches:
            yield pd.Series(counter.count(["" if t is None else t for t in batch.tolist()]))

    return docs.withColumn(out, of(F.col(text)))
