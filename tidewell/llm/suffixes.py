"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` (100) bytes that covers it also starts earlier, in
a document with a smaller id or further ahead in the same one.

Which suffixes to sort: every window of 100 bytes is represented by the one of its
``GRAM``-byte grams with the least hash, its anchor. Equal windows have equal anchors at
the same offset, and about one position in thirty is an anchor. An anchor whose gram occurs
nowhere else cannot belong to a repeated window; the others are the suffixes to be sorted,
each up to where the windows that it represents end.

The sort: documents are dealt to slices. A slice's suffixes are sorted into runs, one for
each partition of the exchange; suffixes that agree in all their windows are sent once. A
run is front-coded: of each suffix only the length of the prefix it shares with the one
before, and the rest. Where a slice has the same windows again, the later ones are repeats whatever else there
is: their spans are known in the slice, joined up per document, and go back to it without passing through the windows'
partition. A partition merges its runs with a loser tree that knows how many bytes
each head shares with the last winner: the head that shares more wins without a look
at its bytes, and of equals only what lies beyond the shared bytes is compared. The merge
gives the order and the common prefixes of neighbours. A window with ``o`` bytes before
its anchor repeats another if their suffixes share ``100 - o`` bytes, which is a stretch of
the order, and the ``o`` bytes before the anchors agree; these are found by a hash and compared byte by byte.

A run for each slice and partition would be a square of the input. Beyond ``MANY_RUNS`` of them they are merged in two levels: a
slice bundles its runs for about the root of the number of partitions, and bundles of about the root of
the number of slices are merged, partition by partition, into one run each (again without what is known to repeat) before
the partitions merge these. The result is the same.

Where a gram occurs over ``HOT`` times, each of its windows is sent as a suffix of its own
to a partition that depends on the whole window, so that no task gathers a common line's
every context. Most such grams are found by a pass of its own, in which each task counts what is frequent in its part in
bounded memory and the counts are added up by gram. They are told to all slices (``COMMON`` of them at most, 8 bytes each) and their occurrences
are not exchanged at all. That pass chooses the way only: grams that it misses, or that are beyond the most frequent
``COMMON``, are counted by the exchange like all others, and the result is the same.

Defined cases: null and short texts lose nothing; null ids come last (with the largest possible id); of rows that agree in
id and text the later ones are copies; ids that agree with different texts are ordered by
the texts' hashes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

LENGTH = 100
GRAM = 40
SPAN = LENGTH - GRAM + 1  # grams in a window
HOT = 50_000
COMMON = 1 << 20  # frequent grams that are told to all slices; what a task holds of them
SELDOM = 4  # occurrences in a task from which on it reports a gram as frequent
SLICE_BYTES, PARTITION_BYTES = 8 << 20, 4 << 20
MANY_RUNS = 1 << 20
_PLACE = np.uint64((1 << 31) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LAST_ID = np.iinfo(np.int64).max

RUN = "part int, known boolean, size long, packed binary"
BUNDLE = "slices int, parts int, part array<int>, known array<boolean>, size array<long>, packed array<binary>"
SPANS = "slice int, doc_id long, text_key long, start long, end long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on."""
    with np.errstate(over="ignore"):
        hashed, size, power = (data.astype(np.uint64) + np.uint64(1)) * _MIX, 1, _BASE
        total, have = None, 0
        while size <= GRAM:  # strings of 1, 2, 4 ... bytes; GRAM is a sum of some of them
            if GRAM & size:
                if total is None:
                    total, have = hashed, size
                else:
                    n = len(data) - have - size + 1
                    total, have = hashed[:n] * _times(_BASE, have) + total[size : size + n], have + size
            n = len(hashed) - size
            hashed, size, power = hashed[:n] * power + hashed[size : size + n], size * 2, power * power
        total = total[: len(data) - GRAM + 1]
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return total ^ (total >> np.uint64(29))


def _times(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place on."""
    least, have = values, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - have : width - have + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each anchor's hash and place, first and last window it represents."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    hashes = gram_hashes(data)
    placed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
    at = (_least_of_each(placed, SPAN) & _PLACE).astype(np.int64)
    starts = np.arange(len(at))
    inside = np.zeros(len(data) + 1, np.int32)  # windows that cross the end of a text are none
    np.add.at(inside, np.maximum(ends - LENGTH + 1, np.concatenate(([0], ends[:-1]))), 1)
    np.add.at(inside, ends, -1)
    starts = starts[np.cumsum(inside[: len(at)]) == 0]
    if not len(starts):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    at = at[starts]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.append(cut[1:], len(at)) - 1
    return hashes[at[cut]], at[cut], starts[cut], starts[last]


#: Windows whose grams are hashed at a time; of longer texts a piece after the other.
PIECE = 1 << 20


def anchors_by_piece(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``anchors``, in bounded memory; an anchor whose windows lie in two pieces comes twice."""
    found = []
    for a in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        b = min(len(data), a + PIECE + LENGTH - 1)
        hashes, *places = anchors(data[a:b], ends[(ends > a) & (ends <= b)] - a)
        found.append((hashes, *(p + a for p in places)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _laid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts end to end, and where each ends."""
    each = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))


def _added(hashes: list[np.ndarray], counts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts added up by hash, the ``most`` largest of them."""
    hashes, counts = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    hashes, counts = hashes[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(hashes) > most:
        keep = np.argpartition(counts, -most)[-most:]
        hashes, counts = hashes[keep], counts[keep]
    return hashes, counts


def _frequent(most: int, least: int):
    """Count the grams of a part, holding ``most`` of them between batches; report those with ``least`` or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, new = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                found = anchors_by_piece(*_laid(batch.slice(k, 1000).column("text")))[0]
                some, n = np.unique(found, return_counts=True)
                hashes.append(some)
                counts.append(n.astype(np.int64))
                new += len(some)
                if new >= most:
                    summed = _added(hashes, counts, most)
                    hashes, counts, new = [summed[0]], [summed[1]], 0
        gram, n = _added(hashes, counts, most)
        keep = n >= least
        yield pa.RecordBatch.from_arrays([pa.array(gram[keep].view(np.int64)), pa.array(n[keep])], names=["gram", "n"])

    return count


def common_grams(dealt: DataFrame) -> np.ndarray:
    """Hashes, sorted, of the grams that are known to occur over ``HOT`` times: the ``COMMON`` most frequent, if more."""
    counts = dealt.select("text").mapInArrow(_frequent(COMMON, SELDOM), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > HOT).orderBy(F.desc("n"), "gram").limit(COMMON).select("gram").toArrow()
    return np.sort(found.column("gram").to_numpy().view(np.uint64))


def _is_in(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes are among the sorted ones."""
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)


def _count_grams(common: np.ndarray):
    """``(gram, slice, n)`` of the anchors in each batch, sent a megabyte or so of text at a time, without the common grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                data, ends = _laid(part.column("text"))
                hashes, at, _, _ = anchors_by_piece(data, ends)
                rest = ~_is_in(common, hashes)
                hashes, at = hashes[rest], at[rest]
                slices = part.column("slice").to_numpy(zero_copy_only=False)[np.searchsorted(ends, at, "right")]
                order = np.lexsort((slices, hashes))
                hashes, slices = hashes[order], slices[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), (hashes[1:] != hashes[:-1]) | (slices[1:] != slices[:-1]))))
                n = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(slices[first].astype(np.int32)), pa.array(n.astype(np.int32))], names=["gram", "slice", "n"])

    return count


def _recurring(hot: int):
    """``(slice, gram, hot)`` of the grams that occur twice or more in the partition."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("gram", pa.int64()), ("slice", pa.int32()), ("n", pa.int32())]))
        if not held.num_rows:
            return
        gram, slices, n = (held.column(c).to_numpy() for c in ("gram", "slice", "n"))
        order = np.argsort(gram, kind="stable")
        gram, slices, n = gram[order], slices[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(gram))))
        keep = total > 1
        yield pa.RecordBatch.from_arrays([pa.array(slices[keep]), pa.array(gram[keep]), pa.array(total[keep] > hot)], names=["slice", "gram", "hot"])

    return find


def _shared(rows: list[bytes]) -> np.ndarray:
    """How many bytes each string shares with the one before."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    width = int(sizes.max()) + 1
    grid = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(-1, width)
    out = np.zeros(len(rows), np.int64)
    differ = grid[1:] != grid[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width)
    out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def _bundles(parts: int, common: np.ndarray, width: int, slices: int):
    """A slice's runs, those for ``width`` partitions in a row; slices in groups of ``slices``."""
    sort = _runs(parts, common)

    def run(docs: pa.Table, grams: pa.Table) -> pa.Table:
        made = sort(docs, grams)
        by: dict[int, list[int]] = {}
        for k, part in enumerate(made.column("part").to_pylist()):
            by.setdefault(part // width, []).append(k)
        group = docs.column("slice")[0].as_py() // slices if docs.num_rows else 0
        names = [name for name, _ in _RUN]
        rows = [made.take(ks).to_pydict() for ks in by.values()]
        columns = {"slices": pa.array([group] * len(by), pa.int32()), "parts": pa.array(list(by), pa.int32())}
        return pa.table(columns | {name: pa.array([r[name] for r in rows], pa.list_(t)) for name, t in zip(names, (t for _, t in _RUN))})

    return run


def _runs(parts: int, common: np.ndarray):
    """Sort a slice's suffixes into front-coded runs, one for each partition of the exchange."""

    def sort(docs: pa.Table, grams: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows and (grams.num_rows or len(common)):
            docs = _first_of_each(docs)
            data, ends = _laid(docs.column("text"))
            hashes, at, first, last = anchors_by_piece(data, ends)
            known = np.append(grams.column("gram").to_numpy().view(np.uint64), common)
            order = np.argsort(known)
            known, hot = known[order], np.append(grams.column("hot").to_numpy(), np.ones(len(common), bool))[order]
            found = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            take = np.flatnonzero(known[found] == hashes)
            doc = np.searchsorted(ends, at[take], "right")
            begin = np.concatenate(([0], ends[:-1]))
            ids = [_LAST_ID if i is None else i for i in docs.column("doc_id").to_pylist()]
            keys = docs.column("text_key").to_pylist()
            raw = data.tobytes()
            items = []
            for h, p, a, b, d, o, is_hot in zip(hashes[take].tolist(), at[take].tolist(), first[take].tolist(), last[take].tolist(), doc.tolist(), begin[doc].tolist(), hot[found[take]].tolist()):
                if is_hot:
                    for s in range(a, b + 1):
                        window = raw[s : s + LENGTH]
                        part = int.from_bytes(hashlib.blake2b(window, digest_size=4).digest(), "little") % parts
                        items.append((part, window[p - s :], window[: p - s], p - s, ids[d], keys[d], p - o))
                else:
                    items.append((h % parts, raw[p : b + LENGTH], raw[a:p], p - b, ids[d], keys[d], p - o))
            items.sort()
            slice_no = docs.column("slice")[0].as_py()
            k, more = 0, []
            while k < len(items):
                part, kept = items[k][0], []
                while k < len(items) and items[k][0] == part:
                    one = items[k]
                    k += 1
                    kept.append(one)
                    while k < len(items) and items[k][:4] == one[:4]:  # the same windows, later
                        i, t, p = items[k][4:]
                        more.append((i, t, p - len(one[2]), p - one[3] + LENGTH))
                        k += 1
                rows = [x[1] for x in kept]
                owners = np.array([(x[4], x[5], x[6], x[3], len(x[2]), slice_no) for x in kept], np.int64)
                out.append((part, False, *_encoded(rows, _shared(rows).tolist(), [x[2] for x in kept], owners)))
            if more:
                out.append((slice_no % parts, True, *_packed([np.array([(slice_no, *x) for x in _joined(more)], np.int64).T.tobytes()])))
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table({name: pa.array(c, t) for (name, t), c in zip(_RUN, columns)})

    return sort


def _joined(spans: list[tuple]) -> list[tuple]:
    """Spans (id, key, start, end), those of a document that overlap or touch as one."""
    out: list[tuple] = []
    for i, t, a, b in sorted(spans):
        if out and out[-1][:2] == (i, t) and a <= out[-1][3]:
            out[-1] = (i, t, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((i, t, a, b))
    return out


def _first_of_each(docs: pa.Table) -> pa.Table:
    """Without the rows that agree with an earlier one in id and text."""
    seen, keep = set(), []
    for k, row in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("text_key").to_pylist())):
        if row not in seen:
            keep.append(k)
        seen.add(row)
    return docs if len(keep) == docs.num_rows else docs.take(keep)


_RUN = [("part", pa.int32()), ("known", pa.bool_()), ("size", pa.int64()), ("packed", pa.binary())]


def _packed(parts: list[bytes]) -> tuple[int, bytes]:
    """Byte strings as one, compressed, and its size before that."""
    whole = np.array([*map(len, parts)], np.int64).tobytes() + b"".join(parts)
    return len(whole), pa.compress(whole, "zstd", asbytes=True)


def _encoded(rows: list[bytes], shared: list[int], lefts: list[bytes], owners: np.ndarray) -> tuple[int, bytes]:
    """A run: its front-coded strings, what stands before each, and whose they are."""
    return _packed([bytes(shared), bytes(map(len, rows)), b"".join([r[n:] for r, n in zip(rows, shared)]), b"".join(lefts), owners.T.tobytes()])


def _unpacked(size: int, packed: bytes, count: int) -> list[bytes]:
    whole = pa.decompress(packed, size, "zstd", asbytes=True)
    ends = 8 * count + np.cumsum([0, *np.frombuffer(whole, np.int64, count)])
    return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class LoserTree:
    """Merges sorted runs of byte strings without comparing a shared prefix again.

    A run is ``(strings, shared)``: ``shared[i]`` bytes of ``strings[i]`` are those of
    ``strings[i - 1]``.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs

    def order(self) -> tuple[list[int], list[int]]:
        """The run of each string in merged order, and the bytes it shares with the string before it."""
        count = len(self.runs)
        leaves = 1 << max(0, count - 1).bit_length()
        heads: list[bytes | None] = [s[0] if s else None for s, _ in self.runs] + [None] * (leaves - count)
        known = [0 if h is not None else -1 for h in heads]  # bytes shared with the last winner; -1: at its end
        at = [0] * leaves
        strings, shared = [s for s, _ in self.runs], [n for _, n in self.runs]

        def play(a: int, b: int) -> tuple[int, int]:
            """Winner and loser; what the loser shares with the winner becomes known."""
            m, n = known[a], known[b]
            if m > n:
                return a, b
            if m < n:
                return b, a
            if m < 0:
                return a, b
            x, y = heads[a], heads[b]
            end = min(len(x), len(y))
            differ = int.from_bytes(x[m:end]) ^ int.from_bytes(y[m:end])
            common = end - (differ.bit_length() + 7) // 8
            first = x[common] < y[common] if common < end else len(x) <= len(y)
            a, b = (a, b) if first else (b, a)
            known[b] = common
            return a, b

        losers, winners = [0] * leaves, [0] * leaves + list(range(leaves))
        for node in range(leaves - 1, 0, -1):
            winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
        winner = winners[1]
        runs_out, shared_out = [], []
        while known[winner] >= 0:
            runs_out.append(winner)
            shared_out.append(known[winner])
            k = at[winner] = at[winner] + 1
            if k < len(strings[winner]):
                heads[winner], known[winner] = strings[winner][k], shared[winner][k]
            else:
                known[winner] = -1
            node = (leaves + winner) >> 1
            while node:
                other = losers[node]
                if known[winner] > known[other]:
                    pass
                elif known[winner] < known[other]:
                    losers[node], winner = winner, other
                else:
                    winner, losers[node] = play(winner, other)
                node >>= 1
        return runs_out, shared_out


def _decoded(sizes: bytes, shared: list[int], rest: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for size, n in zip(sizes, shared):
        before = before[:n] + rest[at : at + size - n]
        at += size - n
        out.append(before)
    return out


def _again_by_bytes(stretch: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which rows, the earliest first, have the stretch and the bytes of one before."""
    seen: set[tuple] = set()
    return np.array([(k in seen) or bool(seen.add(k)) for k in zip(stretch.tolist(), map(bytes, left))])


def repeated(shared: np.ndarray, lefts: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which windows of merged suffixes start earlier elsewhere: a row per suffix, a column per offset.

    ``shared`` and rows are in merged order; ``owners`` has id, key, place, and the least and the
    largest offset. ``lefts`` are the bytes before the anchors, nearest first.
    """
    rank = np.lexsort((owners[:, 2], owners[:, 1], owners[:, 0]))
    low, high = owners[rank, 3], owners[rank, 4]
    left = np.zeros(len(owners), np.uint64)
    out = np.zeros((len(owners), SPAN), bool)
    with np.errstate(over="ignore"):
        for o in range(SPAN):
            if o:
                left = left * _BASE + (lefts[:, o - 1].astype(np.uint64) + np.uint64(1)) * _MIX
            stretch = np.cumsum(shared < LENGTH - o).astype(np.uint64)
            key = ((stretch * np.uint64(0x94D049BB133111EB)) ^ (stretch << np.uint64(40))) + left
            has = np.flatnonzero((low <= o) & (o <= high))
            own = rank[has]
            _, first, which = np.unique(key[own], return_index=True, return_inverse=True)  # the first of each: the earliest
            again = np.ones(len(has), bool)
            again[first] = False
            later, earlier = own[again], own[first[which[again]]]
            if not ((stretch[later] == stretch[earlier]).all() and (lefts[later, :o] == lefts[earlier, :o]).all()):
                again = _again_by_bytes(stretch[own], lefts[own, :o])  # two hashes agreed by chance
            out[own[again], o] = True
    return out


def _run(size: int, packed: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray]:
    prefix, sizes, rest, left, owned = _unpacked(size, packed, 5)
    shared, owners = list(prefix), np.frombuffer(owned, np.int64).reshape(6, -1).T
    ends = np.cumsum(owners[:, 4]).tolist()
    return _decoded(sizes, shared, rest), shared, [left[a:b] for a, b in zip([0, *ends], ends)], owners


def _combined(runs: list[tuple]) -> tuple[tuple[int, bytes], list[tuple]]:
    """Runs merged into one, and the spans (slice, id, key, start, end) of the same windows that come later."""
    order, shared = LoserTree([(r[0], r[1]) for r in runs]).order()
    at, rows, prefix, lefts, owners, spans = [0] * len(runs), [], [], [], [], []
    same: dict[tuple, int] = {}
    for k, n in zip(order, shared):
        i = at[k]
        at[k] += 1
        string, left, own = runs[k][0][i], runs[k][2][i], tuple(runs[k][3][i].tolist())
        if not (rows and n == len(string) == len(rows[-1])):
            same = {}
        where = same.setdefault((left, own[3]), len(rows))
        if where < len(rows):
            first, later = sorted([owners[where], own])
            owners[where] = first
            spans.append((later[5], later[0], later[1], later[2] - later[4], later[2] - later[3] + LENGTH))
        else:
            rows.append(string)
            prefix.append(n)
            lefts.append(left)
            owners.append(own)
    return _encoded(rows, prefix, lefts, np.array(owners, np.int64)), spans


def _merge_bundles(bundles: pa.Table) -> pa.Table:
    """The runs of some slices for some partitions: one run for each partition."""
    by_part: dict[int, list] = {}
    out, more = [], []
    for each in zip(*(bundles.column(c).to_pylist() for c in ("part", "known", "size", "packed"))):
        for part, known, size, packed in zip(*each):
            if known:
                out.append((part, known, size, packed))
            else:
                by_part.setdefault(part, []).append((size, packed))
    for part, runs in by_part.items():
        run, spans = _combined([_run(*r) for r in runs])
        out.append((part, False, *run))
        more += spans
    if more:
        by_slice: dict[int, list] = {}
        for s, *span in more:
            by_slice.setdefault(s, []).append(tuple(span))
        joined = [(s, *span) for s, spans in by_slice.items() for span in _joined(spans)]
        out.append((out[0][0], True, *_packed([np.array(joined, np.int64).T.tobytes()])))
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.table({name: pa.array(c, t) for (name, t), c in zip(_RUN, columns)})


def _merge(runs: pa.Table) -> pa.Table:
    """Merge a partition's runs and report the spans of repeated windows."""
    lists, lefts, owners, spans = [], [], [], [np.zeros((0, 5), np.int64)]
    for known, size, packed in zip(runs.column("known").to_pylist(), runs.column("size").to_pylist(), runs.column("packed")):
        if known:
            spans.append(np.frombuffer(_unpacked(size, packed.as_py(), 1)[0], np.int64).reshape(5, -1).T)
            continue
        rows, shared, left, own = _run(size, packed.as_py())
        lists.append((rows, shared))
        owners.append(own)
        grid = np.zeros((len(own), SPAN), np.uint8)
        for k, bytes_before in enumerate(left):
            grid[k, : len(bytes_before)] = np.frombuffer(bytes_before, np.uint8)[::-1]
        lefts.append(grid)
    if lists:
        spans.append(_merged_spans(lists, lefts, owners))
    found = np.concatenate(spans)
    return pa.table({"slice": found[:, 0].astype(np.int32), "doc_id": found[:, 1], "text_key": found[:, 2], "start": found[:, 3], "end": found[:, 4]})


def _merged_spans(lists: list, lefts: list, owners: list) -> np.ndarray:
    """(slice, id, key, start, end) of the windows in the merged runs that start earlier elsewhere."""
    order, shared = LoserTree(lists).order()
    order, shared = np.array(order, np.int64), np.array(shared, np.int64)
    within = np.argsort(order, kind="stable")  # merged places of each run's strings, in the run's order
    place = np.empty(len(order), np.int64)
    place[within] = np.arange(len(order))  # rows lie run after run
    owned = np.concatenate(owners)
    # A left context holds the offsets up to its size; low and high are the offsets that the suffix represents.
    merged = owned[place]
    low, high = merged[:, 3], merged[:, 4]
    bounds = np.column_stack([merged[:, 0], merged[:, 1], merged[:, 2], low, high])
    alone = (shared < GRAM) & np.append(shared[1:] < GRAM, True)
    keep = np.flatnonzero(~alone)
    again = np.zeros((len(order), SPAN), bool)
    if len(keep):
        again[keep] = repeated(np.where(np.diff(keep, prepend=-2) == 1, shared[keep], 0), np.concatenate(lefts)[place[keep]], bounds[keep])
    edge = np.zeros((len(order), SPAN + 2), np.int8)
    edge[:, 1:-1] = again
    row, start = np.nonzero(np.diff(edge, axis=1) == 1)
    _, end = np.nonzero(np.diff(edge, axis=1) == -1)
    return np.column_stack([merged[row, 5], merged[row, 0], merged[row, 1], merged[row, 2] - end + 1, merged[row, 2] - start + LENGTH])


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """What is left of each of a slice's documents."""
    ids = [_LAST_ID if i is None else i for i in docs.column("doc_id").to_pylist()]
    where: dict[tuple, list] = {}
    for d, t, a, b in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "text_key", "start", "end"))):
        where.setdefault((d, t), []).append((a, b))
    seen: set[tuple] = set()
    out = []
    for true_id, d, t, text in zip(docs.column("doc_id").to_pylist(), ids, docs.column("text_key").to_pylist(), docs.column("text")):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        runs: list[list[int]] = []
        if (d, t) in seen:
            runs = [[0, len(data)]] if len(data) >= LENGTH else []
        else:
            for a, b in sorted(where.get((d, t), ())):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
        seen.add((d, t))
        left, at = hashlib.sha256(), 0
        for a, b in runs:
            left.update(data[at:a])
            at = b
        left.update(data[at:])
        out.append((true_id, len(data), sum(b - a for a, b in runs), len(runs), left.hexdigest()))
    columns = list(zip(*out)) if out else [[]] * 5
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, types)})


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents with key and slice, and their bytes in all."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, total // SLICE_BYTES)
    key = F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text", F.pmod(F.xxhash64("doc_id", key), F.lit(slices)).cast("int").alias("slice")), total


def repeated_spans(dealt: DataFrame, total: int) -> DataFrame:
    """``(slice, doc_id, text_key, start, end)``: spans in which every byte is to go; they may overlap."""
    parts = max(1, total // PARTITION_BYTES)
    common = common_grams(dealt)
    counts = dealt.select("text", "slice").mapInArrow(_count_grams(common), "gram long, slice int, n int")
    grams = counts.repartition(parts, "gram").mapInArrow(_recurring(HOT), "slice int, gram long, hot boolean")
    by_slice = dealt.groupBy("slice").cogroup(grams.groupBy("slice"))
    slices = max(1, total // SLICE_BYTES)
    if slices * parts <= MANY_RUNS:
        runs = by_slice.applyInArrow(_runs(parts, common), RUN)
    else:
        bundles = by_slice.applyInArrow(_bundles(parts, common, 1 + isqrt(parts), 1 + isqrt(slices)), BUNDLE)
        runs = bundles.groupBy("slices", "parts").applyInArrow(_merge_bundles, RUN)
    return runs.groupBy("part").applyInArrow(_merge, SPANS)


def without_repeats(docs: DataFrame) -> DataFrame:
    dealt, total = _dealt(docs)
    spans = repeated_spans(dealt, total)
    return dealt.groupBy("slice").cogroup(spans.groupBy("slice")).applyInArrow(_cut, RESULT)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
