"""Filter interaction audit: what each filter removes, in every order.

Every text gets a mask of the filters that it fails.  Filters A to D look at one
text; E fails texts that a smaller id holds too.  E is a fingerprint-routed RDD:
rows go to the partition of their text's xxhash, which keeps chains of the texts
with one hash (whole texts, so that collisions tell) and the smallest id of
each, and gives out the others' masks with E set.

A task first keeps such chains of its own rows: of copies within a task only the
one with the smallest id travels, so that a text that a third of all rows hold
comes to its partition once a task.  Chains of a task are bounded by
``HELD_BYTES``; then they are sent on and begun anew.

Masks of 32 kinds, with the labels of a row's id, are counted by part and merged
by ``combineByKey``.  Orders and steps follow from these counts: a text is
removed by the first filter of the order that its mask has.

A null text is an empty one.  A null id is no smaller than any other, and no id
is smaller than it; of rows with one text and the same smallest id none fails E.
Repeated rows count as often as they occur.  Several labels of one id: any that
is set counts.  A null part and an empty one are the part ''; an empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of text that a task keeps in chains before it sends them on.
HELD_BYTES = 64 << 20
#: Bytes of text that a partition of chains gets, about, and rows that a
#: partition of labelled counts gets at most.
CHAIN_BYTES, LABELLED_ROWS = 16 << 20, 200_000
#: Bytes of a text that are split into words at a time.
SLICE_BYTES = 8 << 20
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
KINDS = 1 << len(FILTERS)
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def mask_of(text: str) -> tuple[int, bytes]:
    """The filters A to D that a text fails, and its bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    n, distinct = count_words(raw)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    marked = len(raw.translate(None, _MARKS)) < len(raw)
    return (n < 100) | (100 * distinct < 80 * n) << 1 | (100 * upper > 10 * len(text)) << 2 | marked << 3, raw


def count_words(raw: bytes) -> tuple[int, int]:
    """Words and distinct words; ``bytes.split`` parts at the six ASCII spaces."""
    if len(raw) <= SLICE_BYTES:
        found = raw.split()
        return len(found), len(set(found))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = at + SLICE_BYTES
        while end < len(raw) and raw[end : end + 1].strip():
            end += 1
        found = raw[at:end].split()
        n += len(found)
        seen.update(found)
        at = end
    return n, len(seen)


# A holder is (id, mask, {part: rows}): all rows of one id with one text.  A
# chain is {text: its holder with the smallest id}.
Holder = tuple[int, int, dict[str, int]]
Counted = tuple[int | None, tuple[str, int, int]]


def _failed(holder: Holder) -> Iterator[Counted]:
    """What a holder counts for once a smaller id has turned up."""
    for part, n in holder[2].items():
        yield holder[0], (part, holder[1] | DUPLICATE, n)


def _meet(chain: dict[bytes, Holder], raw: bytes, new: Holder) -> Iterator[Counted]:
    """Let a chain keep the smaller one of two holders of a text; the other is
    given out as failed."""
    old = chain.setdefault(raw, new)
    if old is new:
        return
    if new[0] == old[0]:
        for part, n in new[2].items():
            old[2][part] = old[2].get(part, 0) + n
    elif new[0] < old[0]:
        chain[raw] = new
        yield from _failed(old)
    else:
        yield from _failed(new)


def route(key: object) -> int:
    """Partition number, before the modulo, of a fingerprint, an id or a part."""
    return key if isinstance(key, int) and key >= 0 else xxhash.xxh64_intdigest(repr(key).encode())


def masks(docs: RDD, parts: int) -> RDD:
    """(id, (part, mask, rows)) for rows (id, part, text), all filters judged."""

    def local(rows: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
        chains: dict[int, dict[bytes, Holder]] = {}
        nameless: dict[tuple[str, int], int] = {}
        held = 0
        for doc_id, part, text in rows:
            mask, raw = mask_of(text or "")
            part = part or ""
            if doc_id is None:
                nameless[part, mask] = nameless.get((part, mask), 0) + 1
                continue
            chain = chains.setdefault(xxhash.xxh64_intdigest(raw), {})
            held += 0 if raw in chain else len(raw) + 300
            for done in _meet(chain, raw, (doc_id, mask, {part: 1})):
                yield route(done[0]), (None, done)
            if held > HELD_BYTES:
                yield from sent(chains)
                chains, held = {}, 0
        yield from sent(chains)
        for (part, mask), n in nameless.items():
            yield route((part, mask)), (None, (None, (part, mask, n)))

    def sent(chains: dict[int, dict[bytes, Holder]]) -> Iterator[tuple[int, tuple]]:
        for fingerprint, chain in chains.items():
            for raw, holder in chain.items():
                yield fingerprint, (raw, holder)

    def met(rows: Iterator[tuple[int, tuple]]) -> Iterator[Counted]:
        chains: dict[int, dict[bytes, Holder]] = {}
        for fingerprint, (raw, found) in rows:
            if raw is None:
                yield found  # judged where it was read
            else:
                yield from _meet(chains.setdefault(fingerprint, {}), raw, found)
        for chain in chains.values():
            for doc_id, mask, rows_of in chain.values():
                for part, n in rows_of.items():
                    yield doc_id, (part, mask, n)

    return docs.mapPartitions(local).partitionBy(parts, route).mapPartitions(met)


def labelled(counted: RDD, labels: RDD, parts: int) -> RDD:
    """(part, (mask, rows, good rows, toxic rows)), labels (id, good, toxic)
    joined by id."""
    known = labels.map(lambda r: (r[0], (None, bool(r[1]), bool(r[2])))).filter(lambda r: r[0] is not None)

    def one(value: tuple) -> list:
        return add([False, False, {}], value)

    def add(state: list, value: tuple) -> list:
        if value[0] is None:
            state[0], state[1] = state[0] or value[1], state[1] or value[2]
        else:
            state[2][value[:2]] = state[2].get(value[:2], 0) + value[2]
        return state

    def merge(a: list, b: list) -> list:
        a[0], a[1] = a[0] or b[0], a[1] or b[1]
        for kind, n in b[2].items():
            a[2][kind] = a[2].get(kind, 0) + n
        return a

    def flat(row: tuple) -> Iterator[tuple]:
        doc_id, (good, toxic, rows) = row
        for (part, mask), n in rows.items():
            yield part, (mask, n, n if good and doc_id is not None else 0, n if toxic and doc_id is not None else 0)

    return counted.union(known).combineByKey(one, add, merge, parts, route).flatMap(flat)


def vectors(rows: RDD, parts: int) -> RDD:
    """(part, counts by mask: all rows, then good, then toxic ones)."""

    def add(total: list[int], row: tuple[int, int, int, int]) -> list[int]:
        for k in range(3):
            total[k * KINDS + row[0]] += row[k + 1]
        return total

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    return rows.combineByKey(lambda row: add([0] * (3 * KINDS), row), add, merge, parts, route)


def steps(part: str, counts: list[int]) -> Iterator[tuple]:
    """The rows of a part: every order, every step."""
    n, good, toxic = (counts[k * KINDS : (k + 1) * KINDS] for k in range(3))
    orders = list(itertools.permutations(range(len(FILTERS))))
    share = [sum(n[m] * (len(orders) // m.bit_count()) for m in range(KINDS) if m >> f & 1) for f in range(len(FILTERS))]
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            mine = 1 << f
            here = [m for m in range(KINDS) if m & mine and not m & before]
            gone = [m for m in range(KINDS) if m & mine and m & before]
            before |= mine
            kept = sum(n[m] for m in range(KINDS) if not m & before)
            removed, good_lost, toxic_lost = (sum(c[m] for m in here) for c in (n, good, toxic))
            yield part, "".join(FILTERS[k] for k in order), step, kept, removed, sum(n[m] for m in gone), n[mine], good_lost, toxic_lost, share[f]


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) for each part, order of filters and step.

    ``labels`` has (key, quality, toxic).  A filter's ``shapley`` is what it
    removes, summed over all orders.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long"), F.col(part).cast("string"), F.col(text)).rdd.map(tuple)
    known = labels.select(F.col(key).cast("long"), F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))).rdd.map(tuple)
    # Chains hold whole texts: their partitions follow the measured bytes.
    size = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("rows")).first()
    parts = parts_for((size["bytes"] or 0) + 300 * size["rows"], CHAIN_BYTES)
    counted = labelled(masks(rows, parts), known, parts_for(size["rows"], LABELLED_ROWS))
    return spark.createDataFrame(vectors(counted, 8).flatMap(lambda r: steps(*r)), _SCHEMA)
