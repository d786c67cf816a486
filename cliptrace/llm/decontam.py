"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of normalized words.  At every word of
a text that can begin a passage close to an item, a window of the item's size is
embedded by the CGK random walk, which turns a small edit distance into a small
Hamming distance.  Repeated bit sampling of the embeddings brings windows and
items together; an exact edit distance, free at both ends of the window, decides.

A window is left out before embedding only if too few of its word pairs occur in
any item: ``k`` edits destroy at most ``2 k`` of an item's pairs, so that this
loses nothing.  A similarity at which edits could leave an item no pair (below
about 0.6, depending on the lengths) is an error.

Embeddings drift apart with the number of edits, so that a walk finds less the
longer an item is.  Items of about each length are therefore tried out with as
many substitutions, insertions or deletions as are allowed, and walks are added
until sampling reaches the target ``recall`` with all of them.  Lengths at which
``MAX_WALKS`` walks do not (and all, for a recall of 1) are searched for by the
windows that share enough word pairs with one item, which loses nothing.

An item is found where an edit distance of at most ``(1 - similarity)`` of its
words remains; short ones (below five words at 0.8) are thereby found verbatim
only, one word as that word.  Characters of scripts that are written without
spaces are words of their own.

Null and empty texts match nothing; items without any word are searched for in
vain; repeated items are all reported.  Texts of any length are searched whole,
repeated rows alike; of an item's passages the closest, then the first, is
reported.  Empty tables give no matches.  A column of the output's name is
replaced, others are kept.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_bytes, fresh, only

#: Bytes of item text that one pass over the documents searches for; a larger
#: benchmark is searched for in several passes.
MAX_ITEM_BYTES = 4 << 20
#: Bytes of a slice's index that may be broadcast.
MAX_INDEX_BYTES = 512 << 20
#: Words of chunks that a worker remembers between batches.
CACHE_ENTRIES = 400_000
#: Words of text whose windows are made at a time.
SLICE_WORDS = 1 << 19
#: Edited items of each kind of edit that sampling is tried on, for each length.
TRIALS = 500
#: Walks that may be taken to reach the target recall.
MAX_WALKS = 128
#: Item lengths that differ by less than this share have the same walks.
BAND = 0.1
#: Words of embeddings that are held at a time.
EMBEDDED = 1 << 21
#: Pairs of a word pair in a text and an item with it that are looked at together.
SHARED_PAIRS = 1 << 20
_NOT_WORD = re.compile(r"[\W_]+")
# Ranges of letters that are written without spaces (Thai to
# Tibetan, Burmese, Khmer, kana, Han).
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_EACH = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+")
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")

MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("distance", T.IntegerType()),
    T.StructField("item_words", T.IntegerType()),
    T.StructField("start_word", T.LongType()),
    T.StructField("end_word", T.LongType()),
]))


def words(text: str) -> list[str]:
    """White-space separated words, lower-cased, without what is no letter or
    digit; empty ones are left out."""
    return [x for c in text.split() if (w := _NOT_WORD.sub("", c.lower())) for x in parts_of(w)]


def parts_of(word: str) -> list[str]:
    """A word, or the characters of one that is written without spaces."""
    return _EACH.findall(word) if _ANY_UNSPACED.search(word) else [word]


@dataclass
class Group:
    """Items of one length."""

    size: int
    edits: int
    words: np.ndarray  # item x position
    ids: list[list[int]]  # the item ids of each distinct item
    first: int = 0  # number of its first item among those of all groups
    walks: int = 0  # that find its items
    holders: tuple[np.ndarray, np.ndarray] | None = None  # where the items of each pair begin, items; only without sampling


class Searcher:
    """Finds passages close to items in batches of texts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, min_words: int, walks: int, tables: int, bits: int, seed: int, recall: float = 0.99):
        self.similarity, self.tables, self.bits = similarity, tables, bits
        self.vocabulary: dict[str, int] = {}
        by_text: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, text in items:
            w = words(text or "")
            if len(w) >= max(1, min_words):
                by_text[tuple(self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w)].append(item)
        n = self.width = len(self.vocabulary) + 1  # 0: a word of no item
        by_size: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for w in by_text:
            by_size[len(w)].append(w)
        alone = sorted(w[0] for w in by_size.pop(1, []))  # items of one word
        self.alone, self.alone_ids = np.array(alone, np.int64), [by_text[(w,)] for w in alone]
        pairs = {a * n + b for w in by_text for a, b in zip(w, w[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        # The groups of each pair, one after another.
        held = [np.unique(np.searchsorted(self.pairs, [a * n + b for w in found for a, b in zip(w, w[1:], strict=False)])) for _, found in sorted(by_size.items())]
        pair, group = np.concatenate([*held, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(held)), [len(x) for x in held])
        order = np.argsort(pair, kind="stable")
        self.member, self.member_at = group[order], np.searchsorted(pair[order], np.arange(len(self.pairs) + 1))
        rng = np.random.default_rng(seed)
        most = max(walks, MAX_WALKS)
        self.walks = rng.integers(1, 2**63, most, np.uint64) | np.uint64(1)
        self.mix = rng.integers(1, 2**63, (most, tables, bits), np.uint64) | np.uint64(1)
        self.spots = rng.random((most, tables, bits))  # sampled places, as shares of an embedding
        self.groups: list[Group] = []
        for size, found in sorted(by_size.items()):
            g = Group(size, int((1 - similarity) * size + 1e-9), np.array(found, np.int64), [by_text[w] for w in found])
            if g.edits and size - 1 - 2 * g.edits < 1:
                raise ValueError(f"similarity {similarity}: {g.edits} edits can leave an item of {size} words without any pair of its words")
            g.first = self.groups[-1].first + len(self.groups[-1].ids) if self.groups else 0
            self.groups.append(g)
        bands: list[list[Group]] = []
        for g in self.groups:
            if bands and g.size < bands[-1][0].size * (1 + BAND):
                bands[-1].append(g)
            else:
                bands.append([g])
        for band in bands:
            hardest = {g.size: g for g in (band[-1], max(band, key=lambda g: g.edits / g.size))}
            needed = [self.needed(g, walks, recall, seed) for g in hardest.values()] if recall < 1 else [0]
            for g in band:
                g.walks = max(needed) if min(needed) else 0
        self.index = self._index(bands)
        for g in self.groups:
            if not g.walks:
                at = np.searchsorted(self.pairs, g.words[:, :-1] * n + g.words[:, 1:])
                held = np.unique(at * len(g.words) + np.arange(len(g.words))[:, None])
                pair, item = np.divmod(held, len(g.words))
                g.holders = np.searchsorted(pair, np.arange(len(self.pairs) + 1)), item
        self.known = _Words(self.vocabulary)

    def _index(self, bands: list[list[Group]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each walk and table the sorted keys of the items, and the items.
        Items of a band are embedded together."""
        parts = []
        for band in bands:
            if band[0].walks:
                width = band[-1].size
                whole = np.concatenate([np.pad(g.words, ((0, 0), (0, width - g.size))) for g in band])
                sizes = np.repeat([g.size for g in band], [len(g.words) for g in band])
                items = band[0].first + np.arange(len(whole))
                for part in _rows(len(whole), width):
                    parts.append((band[0].walks, items[part], *self.coded(whole[part], sizes[part]), sizes[part]))
        out = []
        for w in range(max((x[0] for x in parts), default=0)):
            on = [x for x in parts if x[0] > w]
            item = np.concatenate([x[1] for x in on])
            tables = [np.concatenate(k) for k in zip(*(self.keys(w, *x[2:]) for x in on), strict=True)]
            order = [np.argsort(k, kind="stable") for k in tables]
            out.append([(k[o], item[o]) for k, o in zip(tables, order, strict=True)])
        return out

    def needed(self, group: Group, least: int, recall: float, seed: int) -> int:
        """Walks with which sampling finds items with as many edits as are
        allowed; 0 if ``MAX_WALKS`` are too few.

        Only the window where the edited item begins is looked at, and half of
        the misses that ``recall`` allows are taken for chance.
        """
        size, k, n = group.size, group.edits, TRIALS
        rng = np.random.default_rng((seed, size))
        item, edited = [], []
        for kind in ("delete", "insert", "substitute"):
            item.append(rng.integers(0, len(group.words), n))
            place = np.argsort(rng.random((n, size)), axis=1)[:, :k]
            w, other = group.words[item[-1]], rng.integers(0, self.width, (n, k))
            if kind == "substitute":
                np.put_along_axis(w, place, other, axis=1)
            elif kind == "delete":  # the text goes on with other words
                gone = np.zeros((n, size), bool)
                np.put_along_axis(gone, place, True, axis=1)
                w = np.hstack((np.take_along_axis(w, np.argsort(gone, axis=1, kind="stable"), axis=1)[:, : size - k], other))
            else:
                order = np.hstack((np.tile(np.arange(size), (n, 1)), place - 0.5))
                w = np.take_along_axis(np.hstack((w, other)), np.argsort(order, axis=1, kind="stable"), axis=1)[:, :size]
            edited.append(w)
        items, windows, kinds = np.concatenate(item), np.concatenate(edited), np.repeat(np.arange(3), n)
        for w in range(len(self.walks)):
            # What an earlier walk met needs no further one.
            met = np.zeros(len(items), bool)
            for part in _rows(len(items), 2 * size):
                both = np.concatenate((group.words[items[part]], windows[part]))
                sizes = np.full(len(both), size)
                for keys in self.keys(w, *self.coded(both, sizes), sizes):
                    met[part] |= keys[: len(both) // 2] == keys[len(both) // 2 :]
            items, windows, kinds = items[~met], windows[~met], kinds[~met]
            missed, most = np.bincount(kinds, minlength=3).max() / n, (1 - recall) / 2
            if w + 1 >= least and missed <= most:
                return w + 1
            # Misses fall by the same share with each walk at best.
            if w >= 7 and missed ** (len(self.walks) / (w + 1)) > most:
                return 0
        return 0

    @staticmethod
    def coded(windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows with their words numbered from 1, a 0 behind each, and the
        words of these numbers.  What lies behind the ``sizes`` is 0 as well."""
        kinds, code = np.unique(windows, return_inverse=True)
        padded = np.zeros((len(windows), windows.shape[1] + 1), np.int64)
        padded[:, :-1] = np.where(np.arange(windows.shape[1]) < sizes[:, None], code.reshape(windows.shape) + 1, 0)
        return padded, np.concatenate(([0], kinds + 1)).astype(np.uint64)

    def walk(self, w: int, padded: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """CGK embedding: step x window, of ``coded`` windows; 0 after their
        ends.  A step reads on with probability 1/2, so that 2 x size steps read
        a window through.  Whether it does is a bit of a hash of walk, step and
        word: no table of them is held."""
        n, width = padded.shape
        flat, at = padded.ravel(), np.arange(n) * width
        out = np.empty((2 * width - 2, n), np.int64)
        with np.errstate(over="ignore"):
            mixed = kinds * self.walks[w]
            for step in range(len(out)):
                if step % 32 == 0:  # a hash has the bits of 32 steps
                    h = mixed + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    moves = (h >> np.uint64(32)).astype(np.int64)
                    moves[0] = 0  # the end is not passed
                np.take(flat, at, out=out[step], mode="clip")
                at += (moves & 1)[out[step]]
                moves >>= 1
        return out

    def keys(self, w: int, padded: np.ndarray, kinds: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """The sampled places of the embeddings of a walk, hashed with the size:
        one key a table."""
        embedded, rows = self.walk(w, padded, kinds), np.arange(len(padded))
        with np.errstate(over="ignore"):
            for t in range(self.tables):
                k = sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                for spot, mix in zip(self.spots[w, t], self.mix[w, t], strict=True):
                    k += (kinds * mix)[embedded[(spot * 2 * sizes).astype(np.int64), rows]]
                yield k ^ (k >> np.uint64(29))

    def starts(self, pairs_at: np.ndarray, near: np.ndarray, ends: np.ndarray, group: Group) -> np.ndarray:
        """Where windows of a group begin that hold enough word pairs."""
        k = group.edits
        # The first pair that is left stands at most 2 k words after the start.
        some = np.unique((pairs_at[near][:, None] - np.arange(2 * k + 1)).ravel())
        some = some[some >= 0]
        return some[ends[some] - some >= group.size - k]

    def sampled(self, seq: np.ndarray, ends: np.ndarray, start: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items (of all groups) that share a key of some table.
        ``number``: the group of each window, in ascending order."""
        sizes, walks = (np.array([getattr(g, x) for g in self.groups])[number] for x in ("size", "walks"))
        rows, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        lo = 0
        while lo < len(start):
            hi = min(len(start), lo + 8_192)
            while hi - lo > 1 and (hi - lo) * 2 * sizes[hi - 1] > EMBEDDED:
                hi = lo + (hi - lo) // 2
            width = int(sizes[hi - 1])
            place = start[lo:hi, None] + np.arange(width)
            windows = np.where(place < ends[start[lo:hi]][:, None], seq[np.minimum(place, len(seq) - 1)], 0)
            padded, kinds = self.coded(windows, sizes[lo:hi])
            at = np.arange(lo, hi)
            for w in range(int(walks[lo:hi].max())):
                on = walks[at] > w
                if not on.all():
                    at, padded = at[on], padded[on]
                for (table, items), keys in zip(self.index[w], self.keys(w, padded, kinds, sizes[at]), strict=True):
                    lower = np.searchsorted(table, keys, side="left")
                    hit = np.flatnonzero(table[np.minimum(lower, len(table) - 1)] == keys)
                    if len(hit):
                        low = lower[hit]
                        n = np.searchsorted(table, keys[hit], side="right") - low
                        rows.append(np.repeat(at[hit], n))
                        which.append(items[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
            lo = hi
        return np.concatenate(rows), np.concatenate(which)

    def candidates(self, seq: np.ndarray, of_group: list[tuple[np.ndarray, np.ndarray]], begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[Group, np.ndarray, np.ndarray]]:
        """Each group with the starts of windows, and items, that share a key of
        some table, or enough pairs where no tables are.

        ``of_group``: where word pairs of each group's items stand, and which.
        ``begins`` and ``ends``: where the text of a word begins and ends.
        """
        start, number = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for g, (group, (pairs_at, kinds)) in enumerate(zip(self.groups, of_group, strict=True)):
            size, k = group.size, group.edits
            least = max(size - 1 - 2 * k, 1)  # pairs that k edits leave
            if len(pairs_at) < least:
                continue
            first = pairs_at[: len(pairs_at) - least + 1]
            last = pairs_at[least - 1 :]
            near = np.flatnonzero((last - first <= size + k - 2) & (begins[first] == begins[last]))
            if not group.walks:
                yield group, *self.sharing(pairs_at, kinds, near, begins, group, least)
            elif len(near):
                start.append(self.starts(pairs_at, near, ends, group))
                number.append(np.full(len(start[-1]), g))
        at, of = np.concatenate(start), np.concatenate(number)
        row, item = self.sampled(seq, ends, at, of)
        for g in np.unique(of[row]).tolist():
            group, mine = self.groups[g], of[row] == g
            begin, which = at[row[mine]], item[mine] - self.groups[g].first
            # Windows of one text and item that lie close together are verified as one.
            _, one = np.unique(np.stack((begins[begin], which, begin // (group.edits + 1))), axis=1, return_index=True)
            yield group, begin[one], which[one]

    def sharing(self, pairs_at: np.ndarray, kinds: np.ndarray, dense: np.ndarray, begins: np.ndarray, group: Group, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Where at least ``least`` pairs of one item begin to stand close
        enough together, and the item.

        ``dense``: numbers of the pairs with which that many of any items do.
        """
        k, reach = group.edits, group.size + group.edits - 2
        change = np.zeros(len(pairs_at) + 1, np.int64)
        change[dense] += 1
        np.subtract.at(change, np.searchsorted(pairs_at, pairs_at[dense] + reach, side="right"), 1)
        inside = np.cumsum(change[:-1]) > 0
        pairs_at, kinds = pairs_at[inside], kinds[inside]
        begin, holders = group.holders
        often = begin[kinds + 1] - begin[kinds]
        total = np.cumsum(often)
        rows, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        lo = 0
        while lo < len(pairs_at):
            upto = max(lo + 1, int(np.searchsorted(total, total[lo] - often[lo] + SHARED_PAIRS, side="right")))
            hi = int(np.searchsorted(pairs_at, pairs_at[upto - 1] + reach, side="right"))
            n = often[lo:hi]
            item = holders[np.repeat(begin[kinds[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            order = np.argsort(item, kind="stable")
            item, at = item[order], np.repeat(pairs_at[lo:hi], n)[order]
            m = max(len(at) - least + 1, 0)
            a, b = at[:m], at[least - 1 :]
            ok = (item[:m] == item[least - 1 :]) & (b - a <= reach) & (b >= a) & (begins[a] == begins[b]) & (a <= pairs_at[upto - 1])
            rows.append(a[ok])
            which.append(item[:m][ok])
            lo = upto
        start, item = np.concatenate(rows), np.concatenate(which)
        # Of pairs close together the first stands for all: its window holds theirs.
        _, one = np.unique(np.stack((begins[start], item, start // (k + 1))), axis=1, return_index=True)
        return start[one], item[one]

    def verify(self, seq: np.ndarray, begins: np.ndarray, ends: np.ndarray, group: Group, start: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edit distance of each item to any span near its windows, and
        the span (first word, word after the last).

        Spans of all windows that start at most ``edits`` words off are covered.
        """
        size, k = group.size, group.edits
        lo = np.maximum(start - 2 * k, begins[start])
        span = size + 5 * k
        place = lo[:, None] + np.arange(span)
        text = np.where(place < ends[start][:, None], seq[np.minimum(place, len(seq) - 1)], -1)
        one = np.int64(1) << 32  # cost above, first word below
        origin = np.arange(span + 1, dtype=np.int64)
        along = origin * one
        cost = np.tile(origin, (len(start), 1))
        for i in range(size):
            new = cost + one  # a word of the item that the text lacks
            np.minimum(new[:, 1:], cost[:, :-1] + (text != group.words[item, i][:, None]) * one, out=new[:, 1:])
            # words of the text that the item lacks: a running minimum
            cost = np.minimum.accumulate(new - along, axis=1) + along
        best = (cost >> 32).argmin(axis=1)
        got = cost[np.arange(len(start)), best]
        return got >> 32, lo + (got & 0xFFFFFFFF), lo + best

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text its items, each with its closest passage."""
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        lo = 0
        while lo < len(texts):
            hi, held, parts = lo, 0, []
            while hi < len(texts) and (hi == lo or held < SLICE_WORDS):
                parts.append(self.known.sequence(texts[hi]))
                held += len(parts[-1])
                hi += 1
            self._search(parts, lo, out)
            lo = hi
        return out

    def _search(self, parts: list[np.ndarray], base: int, out: list) -> None:
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        seq = np.concatenate(parts).astype(np.int64)
        if not len(seq):
            return
        last = np.cumsum(lens)
        owner = np.repeat(np.arange(len(parts)), lens)
        ends, begins = last[owner], (last - lens)[owner]
        both = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0) & (owner[:-1] == owner[1:]))
        key = seq[both] * self.width + seq[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        hit = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        pairs_at, kind = both[hit], at[hit]
        if len(self.alone):
            where = np.minimum(np.searchsorted(self.alone, seq), len(self.alone) - 1)
            found = np.flatnonzero(self.alone[where] == seq)
            _, one = np.unique(np.stack((owner[found], where[found])), axis=1, return_index=True)
            for k in found[one].tolist():
                first = k - int(begins[k])
                out[base + int(owner[k])] += [(x, 0, 1, first, first + 1) for x in self.alone_ids[where[k]]]
        if not self.groups:
            return
        # The pairs of each group: those of all groups, dealt out by one sort.
        often = self.member_at[kind + 1] - self.member_at[kind]
        which = self.member[np.repeat(self.member_at[kind] - np.cumsum(often) + often, often) + np.arange(often.sum())]
        order = np.argsort(which, kind="stable")
        of_pair = np.repeat(np.arange(len(kind)), often)[order]
        edge = np.searchsorted(which[order], np.arange(len(self.groups) + 1))
        parts_of_pair = [of_pair[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for group, start, item in self.candidates(seq, [(pairs_at[x], kind[x]) for x in parts_of_pair], begins, ends):
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for a in range(0, len(start), 2_048):
                s, i = start[a : a + 2_048], item[a : a + 2_048]
                for row, which, d, b, e in zip(owner[s].tolist(), i.tolist(), *(x.tolist() for x in self.verify(seq, begins, ends, group, s, i)), strict=True):
                    if d <= group.edits and (d, b, e) < best.get((row, which), (1 << 30,)):
                        best[row, which] = (d, b, e)
            for (row, which), (d, b, e) in best.items():
                first = int(last[row] - lens[row])
                out[base + row] += [(x, d, group.size, b - first, e - first) for x in group.ids[which]]


def _rows(n: int, size: int) -> Iterator[slice]:
    """Parts of n windows of a size, each of which may be embedded at once."""
    step = max(1, EMBEDDED // (2 * size))
    return (slice(a, a + step) for a in range(0, n, step))


class _Words(dict):
    """White-space separated chunk -> number of its word; -1: it has none, -2:
    it has several (``many``)."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.many: dict[str, list[int]] = {}

    def __missing__(self, chunk: str) -> int:
        w = chunk.lower()
        if not w.isalnum():
            w = _NOT_WORD.sub("", w)
        if w and not w.isascii() and _ANY_UNSPACED.search(w):
            self.many[chunk] = [self.vocabulary.get(x, 0) for x in parts_of(w)]
            n = -2
        else:
            n = self.vocabulary.get(w, 0) if w else -1
        self[chunk] = n
        return n

    def sequence(self, text: str | None) -> np.ndarray:
        """Word numbers of a text."""
        if not text:
            return np.empty(0, np.int32)
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.many.clear()
        parts = text.split()
        seq = np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))
        if len(seq) and seq.min() == -2:
            seq = np.fromiter((x for c, n in zip(parts, seq.tolist(), strict=True) for x in (self.many[c] if n == -2 else (n,))), np.int32)
        return seq[seq >= 0] if len(seq) and seq.min() < 0 else seq


def _slices(benchmark: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in slices of about ``limit`` bytes of text, by a hash; the
    driver holds one of them at a time."""
    items = benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == k)
        yield [(r["k"], r["t"]) for r in part.orderBy("k", "t").collect()]


def _searching(sent):
    """A UDF that searches for the items of a broadcast searcher."""
    tag = uuid.uuid4().hex

    @F.pandas_udf(MATCH)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = only(("decontam", tag), lambda: pickle.loads(sent.value))
        for batch in batches:
            yield pd.Series(searcher.search(batch.tolist()), dtype=object)

    return of


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", out: str = "matches",
         similarity: float = 0.8, min_words: int = 1, walks: int = 4, tables: int = 8, bits: int = 2, seed: int = 3, recall: float = 0.99) -> DataFrame:
    """Add ``out``: an array of the items found in each text, each with the
    edit distance in words and the closest passage (word numbers).

    ``recall`` is the share of passages with as many edits as are allowed that
    are to be found, ``walks`` the number of walks to begin with; a recall of 1
    samples nothing and finds all of them.  Items of fewer
    than ``min_words`` words are not searched for.  The index of each slice of
    items is built once and sent; a column of the name ``out`` is replaced.
    """
    spark, source = docs.sparkSession, fresh(docs, "_source")
    found = docs.withColumn(source, F.col(text))
    parts: list[str] = []
    for items in _slices(benchmark, item_key, item_text, MAX_ITEM_BYTES):
        index = pickle.dumps(Searcher(items, similarity, min_words, walks, tables, bits, seed, recall), 5)
        sent = broadcast_bytes(spark, index, len(index), MAX_INDEX_BYTES, "index of items")
        parts.append(fresh(found, "_matches"))
        found = found.withColumn(parts[-1], _searching(sent)(F.col(source)))
    whole = F.concat(*map(F.col, parts)) if len(parts) > 1 else F.col(parts[0])
    return found.withColumn(out, whole).drop(source, *parts)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per text and item found in it."""
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = find(slim, benchmark, "_text", out="_found", **options)
    one = found.filter(F.size("_found") > 0).select(F.col("_key").alias(key), F.explode("_found").alias("_m"))
    return one.select(key, "_m.*").withColumn("similarity", 1 - F.col("distance") / F.col("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    name = fresh(docs, "_found")
    return find(docs, benchmark, out=name, **options).filter(F.size(name) == 0).drop(name)
