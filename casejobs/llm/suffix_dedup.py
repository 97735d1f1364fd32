"""Suffix-array dedup: removes bytes covered by 50-byte strings that also start in a document with a smaller id.

A string of 50 bytes starts a suffix. Every 50-byte window has one anchor, the token of 24 bytes in it with the least
hash, so equal windows have equal anchors at equal places, and windows that share an anchor are handled together.
Documents are dealt into blocks; all exchanges below are between blocks and buckets, and blocks never move again:

1. Anchor hashes go to hash buckets; only anchors that occur in two documents or more stay (a filter, never a decision).
2. The suffixes at these anchors, cut where the last window of the anchor ends and followed by the text before the
   anchor that its windows reach, are range-partitioned by splitters sampled from all suffixes, and each bucket sorts
   them by multikey quicksort. Equal suffixes are neighbours, so a document learns whether a smaller one has the same
   suffix with all its windows. Different suffixes with the same leading token are neighbours too; their windows are
   sorted and compared in the bucket, unless the token goes on across a boundary splitter or has very many suffixes.
3. The windows of those stay open: as suffixes of 50 bytes they meet in buckets by a hash, which spreads the windows of
   one token, and are sorted there in the same way.

Blocks send each distinct suffix once with its least id, so a passage that a third of all documents share costs a bucket
one row per block. Decisions compare bytes, not hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import byte_view, mix, released

LENGTH = 50
TOKEN = 24
#: Text bytes of a block, about. There are as many buckets as blocks, so that both stay small.
BLOCK_BYTES = 6_000_000
#: Text bytes that are hashed at once, so that the arrays stay in the processor's caches.
CHUNK_BYTES = 200_000
#: Suffixes with one leading token that a bucket compares itself; and how many whose windows it sorts at once.
GROUP_LIMIT, SLICE = 50_000, 30_000
#: Documents (one for each bucket, if these are more), and suffixes of each, from which splitters are sampled, about.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 1024, 48

_SPAN = LENGTH - TOKEN + 1  # token places in a window
_LEFT = _SPAN - 1
_CONTEXT = 80  # 50 bytes from the anchor on, 26 before it, 2 unused, both lengths
_WINDOW = 56
_PLACE_BITS = 28
_codes = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_base = 0x9E3779B97F4A7C15
_power = {n: np.uint64(pow(_base, n, 2**64)) for n in (1, 2, 4, 8)}


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian words, and for each but the first in order whether it equals the one before.

    Multikey quicksort, with eight bytes as a character: rows that tie so far are sorted by the next word.
    """
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    same = first[1:] == first[:-1]
    for d in range(1, words.shape[1]):
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.concatenate([[0], np.cumsum(~same)])[at]
        rows = order[at]
        rows = rows[np.lexsort((words[rows, d], group))]
        order[at] = rows
        value = words[rows, d]
        equal = (value[1:] == value[:-1]) & (group[1:] == group[:-1])
        same = np.zeros(len(order) - 1, bool)
        same[at[1:][equal] - 1] = True
    return order, same


def _words(records: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(records).view(">u8").astype(np.uint64).reshape(len(records), records.shape[1] // 8)


@dataclass
class Anchors:
    """Anchors of a buffer: place, first and last window start, token hash and document of each."""

    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def _piece(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of a piece of at most 2**28 bytes."""
    n = len(raw)
    h = _codes[raw]
    h = h[:-1] * _power[1] + h[1:]
    h = h[:-2] * _power[2] + h[2:]
    h8 = h[:-4] * _power[4] + h[4:]
    h16 = h8[:-8] * _power[8] + h8[8:]
    h = mix(h16[: len(h8) - 16] * _power[8] + h8[16:])
    least = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: -(_SPAN - 16)], least[_SPAN - 16 :])
    ends = np.repeat(off[1:], np.diff(off))[: n - LENGTH + 1]
    window = np.flatnonzero(np.arange(n - LENGTH + 1) + LENGTH <= ends)
    at = (least[window] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.append(begin[1:], len(at)) - 1
    return at[begin], window[begin], window[end], h[at[begin]]


def find_anchors(raw: np.ndarray, off: np.ndarray) -> Anchors:
    """Anchors of all documents of a buffer, piece by piece; a long document is cut into pieces that overlap."""
    found = []
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK_BYTES, side="right")) - 1)
        low, high = int(off[row]), int(off[end])
        for start in range(low, high, CHUNK_BYTES) if end == row + 1 else (low,):
            stop = min(high, start + CHUNK_BYTES + LENGTH - 1) if end == row + 1 else high
            if stop - start >= LENGTH:
                p, a, b, key = _piece(raw[start:stop], np.clip(off[row : end + 1] - start, 0, stop - start))
                found.append((p + start, a + start, b + start, key))
        row = end
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    return Anchors(*columns, np.searchsorted(off, columns[1], side="right") - 1)


def _contexts(raw: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(place), _CONTEXT), np.uint8)
    for i in range(0, len(place), 50_000):
        p, a, b = (x[i : i + 50_000, None] for x in (place, low, high))
        for begin, stop, where, width in ((p, b + LENGTH, 0, LENGTH), (a, p, LENGTH, _LEFT)):
            at = begin + np.arange(width)
            out[i : i + 50_000, where : where + width] = np.where(at < stop, raw[np.minimum(at, len(raw) - 1)], 0)
    out[:, 78], out[:, 79] = high + LENGTH - place, place - low
    return out


def _windows(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.zeros((len(start), _WINDOW), np.uint8)
    for i in range(0, len(start), 50_000):
        out[i : i + 50_000, :LENGTH] = raw[start[i : i + 50_000, None] + np.arange(LENGTH)]
    return out


def _squeeze(a: np.ndarray, by_column: bool) -> bytes:
    data = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T if by_column else a).tobytes()
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unsqueeze(data: bytes, n: int, width: int, by_column: bool) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T) if by_column else flat.reshape(n, width)


class Distinct:
    """Distinct records of a block in order, with the least id of each; ``number`` is each input's distinct record."""

    def __init__(self, records: np.ndarray, ids: np.ndarray):
        self.n = 0
        self.number = np.zeros(len(records), np.int64)
        self.records, self.least, self.first = records[:0], ids[:0], self.number[:0]
        if len(records):
            order, same = multikey_sort(_words(records))
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            self.n, self.first = len(begin), order[begin]
            self.records, self.least = records[self.first], np.minimum.reduceat(ids[order], begin)
            self.number[order] = np.repeat(np.arange(self.n), np.diff(np.append(begin, len(order))))

    def cuts(self, splitters: np.ndarray) -> np.ndarray:
        """Where each bucket begins among the records, and the end."""
        if not len(splitters):
            return np.array([0, self.n])
        kind = f"S{self.records.shape[1]}"
        keys = np.ascontiguousarray(self.records).view(kind).ravel() if self.n else np.zeros(0, kind)
        return np.concatenate([[0], np.searchsorted(keys, splitters, side="left"), [self.n]])


    def by_hash(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the records by bucket, and where each bucket begins in it, and the end."""
        h = np.zeros(self.n, np.uint64)
        for word in _words(self.records).T if self.n else ():
            h = mix(h * np.uint64(_base) + word)
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_SENT = "bucket int, block bigint, n bigint, records binary, least binary"
_ANSWER = "block bigint, level int, bucket int, n bigint, one binary, two binary, masks binary"


def _sent(block: int, bucket: list[int], rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    n, records, least = zip(*rows) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "n": pa.array(n, pa.int64()), "records": pa.array(records, pa.binary()), "least": pa.array(least, pa.binary())})


def _answer(sent: pa.Table, level: int, one: np.ndarray, two: np.ndarray, masks: np.ndarray | None = None) -> pa.Table:
    cut = np.concatenate([[0], np.cumsum(sent.column("n").to_numpy())])
    bits = [[np.packbits(x[a:b]).tobytes() for a, b in zip(cut, cut[1:])] for x in (one, two)]
    return pa.table({"block": sent.column("block"), "level": pa.array([level] * len(sent), pa.int32()), "bucket": sent.column("bucket"), "n": sent.column("n"), "one": pa.array(bits[0], pa.binary()), "two": pa.array(bits[1], pa.binary()), "masks": pa.array([b"" if masks is None else _squeeze(masks[a:b], True) for a, b in zip(cut, cut[1:])], pa.binary())})


def _answers(table: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both bits and the masks of all of a block's records in a level, in order."""
    rows = sorted((r for r in table.to_pylist() if r["level"] == level), key=lambda r: r["bucket"])
    if not rows:
        return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.uint32)
    one, two = (np.concatenate([np.unpackbits(np.frombuffer(r[x], np.uint8), count=r["n"]) for r in rows]).astype(bool) for x in ("one", "two"))
    return one, two, np.concatenate([_unsqueeze(r["masks"], r["n"], 4, True).view(np.uint32).ravel() if r["masks"] else np.zeros(r["n"], np.uint32) for r in rows])


@dataclass
class Plan:
    """What all blocks and buckets know; its size does not grow with the documents."""

    buckets: int
    key_bits: int
    contexts: np.ndarray  # splitters


class Block:
    """A block of documents and what follows from the answers so far."""

    def __init__(self, table: pa.Table, plan: Plan):
        self.plan = plan
        self.number = table.column("block")[0].as_py()
        self.no_id = table.column("doc_id").is_null().to_numpy()
        self.ids = table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        self.raw, self.off = byte_view(table.column("text"))
        self.anchors = find_anchors(self.raw, self.off)
        self.anchor_ids = self.ids[self.anchors.doc]

    def keys(self) -> pa.Table:
        """Level 1: distinct token hashes, and whether two documents of the block have them."""
        key, begin, _ = self._distinct_keys()
        ids = self.anchor_ids[self._order]
        several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin) if len(begin) else np.zeros(0, bool)
        bucket = ((key >> np.uint64(32)) * np.uint64(self.plan.buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(self.plan.buckets + 1))
        short = key >> np.uint64(64 - self.plan.key_bits)
        rows, where = [], []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            a, z = cut[b], cut[b + 1]
            where.append(b)
            rows.append((int(z - a), _squeeze(np.diff(short[a:z], prepend=np.uint64(0)), True), np.packbits(several[a:z]).tobytes()))
        return _sent(self.number, where, rows)

    def _distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        short = np.uint64(64 - self.plan.key_bits)
        key = self.anchors.key >> short << short
        self._order = np.argsort(key)
        ordered = key[self._order]
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        number = np.zeros(len(key), np.int64)
        number[self._order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        return ordered[begin], begin, number

    def shared(self, answers: pa.Table) -> Distinct:
        """Level 2: suffixes at the anchors that occur in two documents or more."""
        stays = _answers(answers, 1)[0]
        number = self._distinct_keys()[2]
        self.at = np.flatnonzero(stays[number]) if len(number) else np.zeros(0, np.int64)
        a = self.anchors
        return Distinct(_contexts(self.raw, a.place[self.at], a.low[self.at], a.high[self.at]), self.anchor_ids[self.at])

    def open_windows(self, answers: pa.Table) -> tuple[Distinct, Distinct]:
        """Level 3: windows of suffixes that are first of their kind and that a bucket left open."""
        context = self.shared(answers)
        self.repeated, left_open, self.masks = _answers(answers, 2)
        self.opened = np.flatnonzero(left_open & ~self.repeated) if context.n else np.zeros(0, np.int64)
        first = self.at[context.first[self.opened]]
        low, size = self.anchors.low[first], self.anchors.high[first] - self.anchors.low[first] + 1
        self.begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        start = np.repeat(low - self.begin[:-1], size) + np.arange(self.begin[-1])
        self.window_ids = np.repeat(context.least[self.opened], size)
        return context, Distinct(_windows(self.raw, start), self.window_ids)

    def send(self, distinct: Distinct) -> pa.Table:
        """Level 2: each range of suffixes to its bucket."""
        return self._send(distinct, distinct.cuts(self.plan.contexts))

    def send_windows(self, distinct: Distinct) -> pa.Table:
        """Level 3: windows by their hash."""
        order, cut = distinct.by_hash(self.plan.buckets)
        distinct.records, distinct.least = distinct.records[order], distinct.least[order]
        return self._send(distinct, cut)

    def _send(self, distinct: Distinct, cut: np.ndarray) -> pa.Table:
        where = np.flatnonzero(np.diff(cut)).tolist()
        rows = [(int(cut[b + 1] - cut[b]), _squeeze(distinct.records[cut[b] : cut[b + 1]], False), _squeeze(distinct.least[cut[b] : cut[b + 1]], True)) for b in where]
        return _sent(self.number, where, rows)

    def result(self, answers: pa.Table) -> pa.Table:
        context, window = self.open_windows(answers)
        found = np.zeros(window.n, bool)
        found[window.by_hash(self.plan.buckets)[0]] = _answers(answers, 3)[0]
        removed = np.zeros(len(self.raw) + 1, np.int64)  # first as steps: +1 where removed windows begin, -1 after the last
        a = self.anchors
        if context.n:
            own = context.number
            later = self.anchor_ids[self.at] > context.least[own]
            whole = later | self.repeated[own]
            removed += np.bincount(a.low[self.at[whole]], minlength=len(removed)) - np.bincount(a.high[self.at[whole]] + 1, minlength=len(removed))
            some = np.flatnonzero(~whole & (self.masks[own] > 0))
            i, j = np.nonzero(self.masks[own[some], None] >> np.arange(_SPAN, dtype=np.uint32) & np.uint32(1))
            gone = a.low[self.at[some[i]]] + j
            removed += np.bincount(gone, minlength=len(removed)) - np.bincount(gone + 1, minlength=len(removed))
            if window.n:
                bad = (self.window_ids > window.least[window.number]) | found[window.number]
                slot = np.full(context.n, -1)
                slot[self.opened] = np.arange(len(self.opened))
                rest = np.flatnonzero(~whole & (slot[own] >= 0))
                k, low = slot[own[rest]], a.low[self.at[rest]]
                size = self.begin[k + 1] - self.begin[k]
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                gone = (np.repeat(low, size) + step)[bad[np.repeat(self.begin[k], size) + step]]
                removed += np.bincount(gone, minlength=len(removed)) - np.bincount(gone + 1, minlength=len(removed))
        starts = np.cumsum(np.cumsum(removed)[:-1] > 0)
        covered = starts.copy()
        covered[LENGTH:] -= starts[:-LENGTH]
        covered = covered > 0
        before = np.concatenate([[False], covered[:-1]]) if len(covered) else covered
        inner = self.off[:-1][self.off[:-1] < len(covered)]
        before[inner] = False
        total, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (covered, covered & ~before))
        kept = [hashlib.sha256(self.raw[x:y][~covered[x:y]].tobytes()).hexdigest() for x, y in zip(self.off, self.off[1:])]
        ids = pa.array(self.ids, mask=self.no_id)
        return pa.table({"doc_id": ids, "n_bytes": np.diff(self.off), "n_removed": np.diff(total[self.off]), "n_spans": np.diff(runs[self.off]), "kept_sha256": pa.array(kept, pa.string())})


def _match_keys(sent: pa.Table) -> pa.Table:
    rows = sent.to_pylist()
    keys = np.concatenate([np.cumsum(_unsqueeze(r["records"], r["n"], 8, True).view(np.uint64).ravel(), dtype=np.uint64) for r in rows])
    several = np.concatenate([np.unpackbits(np.frombuffer(r["least"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    tied = np.zeros(len(keys), bool)
    tied[1:] |= same
    tied[:-1] |= same
    several[order[tied]] = True
    return _answer(sent, 1, several, several)


def _received(sent: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sent.to_pylist()
    records = np.concatenate([_unsqueeze(r["records"], r["n"], width, False) for r in rows])
    return records, np.concatenate([_unsqueeze(r["least"], r["n"], 8, True).view(np.int64).ravel() for r in rows])


def _sort_windows(sent: pa.Table) -> pa.Table:
    """Sorts a bucket's windows: is there an equal one of a smaller id?"""
    records, least = _received(sent, _WINDOW)
    order, same = multikey_sort(_words(records))
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    repeated = np.zeros(len(order), bool)
    repeated[order] = np.repeat(np.minimum.reduceat(least[order], begin), np.diff(np.append(begin, len(order)))) < least[order]
    return _answer(sent, 3, repeated, repeated)


def _sort_contexts(sent: pa.Table, splitters: np.ndarray) -> pa.Table:
    """Sorts a bucket's suffixes: has a smaller id an equal one; which single windows does a smaller id have; are they open?"""
    records, ids = _received(sent, _CONTEXT)
    words = _words(records)
    order, same = multikey_sort(words)
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(begin, len(order)))
    least = np.minimum.reduceat(ids[order], begin)  # of each distinct suffix
    repeated = np.zeros(len(order), bool)
    repeated[order] = np.repeat(least, size) < ids[order]

    first = order[begin]
    token = words[first][:, : TOKEN // 8]
    group_begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]).any(axis=1)]))
    kinds = np.diff(np.append(group_begin, len(first)))
    beyond = kinds > GROUP_LIMIT
    bucket = sent.column("bucket")[0].as_py()
    for edge in splitters[max(0, bucket - 1) : bucket + 1]:  # a token at a boundary may go on beyond it
        beyond |= (token[group_begin] == _words(np.frombuffer(edge.ljust(_CONTEXT, b"\0"), np.uint8)[None])[0, : TOKEN // 8]).all(axis=1)
    mask = np.zeros(len(first), np.uint32)
    here = np.flatnonzero(np.repeat((kinds > 1) & ~beyond, kinds))
    group = np.repeat(np.arange(len(kinds)), kinds)[here]
    at = 0
    while at < len(here):
        end = min(len(here), at + SLICE)
        end = end if end == len(here) else int(np.searchsorted(group, group[end], side="left"))
        end = end if end > at else int(np.searchsorted(group, group[at], side="right"))
        part = here[at:end]
        mask[part] = _window_masks(records[first[part]], least[part])
        at = end
    out, masks = np.zeros(len(order), bool), np.zeros(len(order), np.uint32)
    out[order] = np.repeat(np.repeat(beyond, kinds), size)
    masks[order] = np.repeat(mask, size)
    return _answer(sent, 2, repeated, out, masks)


def _window_masks(records: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each suffix, a bit for each of its windows that also stands in a suffix of a smaller id."""
    right, left = records[:, 78].astype(np.int64), records[:, 79].astype(np.int64)
    canvas = np.zeros((len(records), _LEFT + LENGTH), np.uint8)
    at = np.arange(_LEFT) - (_LEFT - left[:, None])
    canvas[:, :_LEFT] = np.where(at >= 0, np.take_along_axis(records, LENGTH + np.maximum(at, 0), axis=1), 0)
    canvas[:, _LEFT:] = records[:, :LENGTH]
    count = left + right - LENGTH + 1
    owner = np.repeat(np.arange(len(records)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    windows = np.zeros((len(owner), _WINDOW), np.uint8)
    start = owner * canvas.shape[1] + _LEFT - left[owner] + place
    windows[:, :LENGTH] = canvas.ravel()[start[:, None] + np.arange(LENGTH)]
    order, same = multikey_sort(_words(windows))
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    low = np.empty(len(order), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(least[owner[order]], begin), np.diff(np.append(begin, len(order))))
    bits = np.where(low < least[owner], np.uint32(1) << place.astype(np.uint32), np.uint32(0)).astype(np.uint32)
    return np.bitwise_or.reduceat(bits, np.cumsum(count) - count)


def _splitters(docs: DataFrame, n_docs: int, buckets: int) -> np.ndarray:
    """Splitters for suffixes at anchors, from those of documents that a hash of the text picks.

    Blocks send equal suffixes once, so the sample counts them once, too; only the sampled suffixes reach the driver.
    """

    @released
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                raw, off = byte_view(batch.column(0).slice(row, 1))
                a = find_anchors(raw, off)
                some = np.linspace(0, len(a.place) - 1, min(len(a.place), SAMPLE_SUFFIXES)).astype(np.int64)
                records = [x.tobytes() for x in _contexts(raw, a.place[some], a.low[some], a.high[some])]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["context"])

    if buckets < 2:
        return np.zeros(0, f"S{_CONTEXT}")
    share = min(1.0, max(SAMPLE_DOCS, buckets) / max(1, n_docs))
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(29)), F.lit(1 << 31)) < F.lit(round(share * (1 << 31)))).select(F.coalesce("text", F.lit("")).alias("text"))
    got = some.mapInArrow(sample, "context binary").distinct().toPandas()
    records = np.sort(np.array([bytes(x) for x in got["context"]], dtype=f"S{_CONTEXT}"))
    at = np.linspace(0, len(records), buckets + 1).astype(np.int64)[1:-1]
    return np.unique(records[at]) if len(records) else records


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans and kept_sha256.

    Texts count as UTF-8 bytes, null as empty; texts below 50 bytes lose nothing. Strings are judged on the input, and
    matches never cross documents. Rows with the same id never remove each other's bytes; a row without an id counts as
    larger than all ids below 2^63 - 1, and rows without an id never remove each other's bytes. Other columns are left
    out; an empty table gives no rows.
    """
    total, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = buckets = max(1, -(-total // BLOCK_BYTES))
    plan = docs.sparkSession.sparkContext.broadcast(Plan(buckets, min(64, int(total).bit_length() + 12), _splitters(docs, n_docs, buckets)))

    # rows of one id need not meet, since decisions compare ids and not blocks, so a frequent id is spread by its texts
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    dealt = docs.select(block, F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def keys(table: pa.Table) -> pa.Table:
        return Block(table, plan.value).keys()

    def shared(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(table, plan.value)
        return own.send(own.shared(answers))

    def windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(table, plan.value)
        return own.send_windows(own.open_windows(answers)[1])

    def result(table: pa.Table, answers: pa.Table) -> pa.Table:
        return Block(table, plan.value).result(answers)

    def sort_contexts(sent: pa.Table) -> pa.Table:
        return _sort_contexts(sent, plan.value.contexts)

    def sort_windows(sent: pa.Table) -> pa.Table:
        return _sort_windows(sent)

    by_block = dealt.groupBy("block")
    first = by_block.applyInArrow(keys, _SENT).groupBy("bucket").applyInArrow(_match_keys, _ANSWER)
    second = by_block.cogroup(first.groupBy("block")).applyInArrow(shared, _SENT).groupBy("bucket").applyInArrow(sort_contexts, _ANSWER)
    both = first.unionByName(second)
    third = by_block.cogroup(both.groupBy("block")).applyInArrow(windows, _SENT).groupBy("bucket").applyInArrow(sort_windows, _ANSWER)
    everything = both.unionByName(third)
    return by_block.cogroup(everything.groupBy("block")).applyInArrow(result, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
