"""Repeated byte strings by suffix order and longest previous factors.

Windows that may repeat are found by content-chosen spots (see ``windows``). Their stretches of
text are put into suffix order; in it, the previous and the next entry with a smaller position
give the longest factor that starts earlier, and a factor of at least ``width`` bytes marks both
places. A task orders the stretches it holds; windows without an earlier match there are named by
their content and meet those of other tasks under that name, where the order by name and position
gives the earlier match in the same way.

Defined results: a null text is empty; a text shorter than ``width`` loses nothing; matches never
cross documents; overlapping copies inside one document count. Rows that repeat doc_id and text are
one document and all get its result; rows that share only the doc_id are different documents.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointgrid.llm.arrow_text import NO_ID, ints, mixed, slices, utf8
from pointgrid.llm.windows import SLICE, Names, Runs, covered, keyed, none, ranges_of, repeated

DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
GRAM = 100
#: So many neighbouring windows are compared in one task where they have one spot.
TOGETHER = 32


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours."""
    n = len(v) - w + 1
    full = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, v.dtype)
    full[: len(v)] = v
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def chosen_spots(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window, its spot's place, and the name of the piece there.

    Each window's spot is the least hashed piece of GRAM bytes in it, leftmost on a tie.
    """
    gram = min(GRAM, max(1, width // 4))
    long = np.flatnonzero(np.diff(at) >= width)
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    i = np.arange(len(data) - gram + 1)
    piece = Names(data)(i, i + gram)
    bits = np.uint64(len(data).bit_length())
    place = (piece >> bits << bits) | i.astype(np.uint64)
    spot = (sliding_least(place, width - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    edge[at[long]] += 1
    edge[at[long + 1] - width + 1] -= 1
    window = np.flatnonzero(np.cumsum(edge[:-1]))
    return window, spot[window], piece[spot[window]]


def spots(width: int):
    def find(data: np.ndarray, at: np.ndarray) -> Runs:
        window, spot, piece = chosen_spots(data, at, width)
        if not len(window):
            return none()
        head = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (np.diff(window) > 1)])
        start, last = window[head], window[np.r_[head[1:], len(window)] - 1]
        doc = np.searchsorted(at, start, "right") - 1
        return Runs(doc, start - at[doc], last - start, piece[head], Names(data)(start, last + width), np.zeros(len(start), bool))

    return find


def suffix_order(data: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``width`` bytes, then of position, and the rank of each position.

    ``end`` is the end of each position's stretch; no suffix goes beyond it. Ranks of doubled length
    come from two ranks of the length before; equal ranks mean equal bytes. Positions whose rank is
    already theirs alone are not ranked again.
    """
    n = len(data)
    rank = data.astype(np.int64) + 1
    length = 1
    live = np.arange(n)
    while length < width and len(live):
        step = min(length, width - length)
        other = live + step
        inside = other < end[live]
        second = np.zeros(len(live), np.int64)
        second[inside] = rank[other[inside]] + 1
        first = rank[live]
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        change = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        group = np.cumsum(change) - 1
        sizes = np.bincount(group)
        # A rank is the number of suffixes before its group: those before the old group and those of it before.
        new_first = np.r_[True, a[1:] != a[:-1]]
        base = np.maximum.accumulate(np.where(new_first, np.arange(len(a)), 0))
        head = np.maximum.accumulate(np.where(change, np.arange(len(a)), 0))
        if length == 1:
            before = np.r_[0, np.cumsum(np.bincount(a, minlength=int(a.max()) + 1))[:-1]][a]
        else:
            before = a
        rank = rank.copy()
        rank[live[order]] = before + head - base
        live = np.sort(live[order][sizes[group] > 1])
        length += step
    return np.lexsort((np.arange(n), rank)), rank


def previous_factors(order: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions with an earlier match of the ordered length, and positions matched by a later one.

    Among suffixes of one rank the order is that of positions, so the previous smaller position is the
    entry before, and the next smaller position lies outside the rank.
    """
    same = rank[order][1:] == rank[order][:-1]
    return order[1:][same], order[:-1][same]


def single(width: int):
    def find(data: np.ndarray, at: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray):
        empty = np.zeros(0, np.int64)
        if not len(row):
            return none(), empty, empty
        start, end = at[row] + first, at[row] + last + width
        order = np.lexsort((end, start))
        start, end = start[order], end[order]
        window = np.zeros(len(data) + 1, np.int64)
        np.add.at(window, start, 1)
        np.add.at(window, end - width + 1, -1)
        window = np.cumsum(window[:-1]) > 0
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        inside = np.flatnonzero(np.cumsum(inside[:-1]))
        # Stretches of one document that touch are one; the end of each position's stretch bounds its suffix.
        doc = np.searchsorted(at, inside, "right") - 1
        tail = np.flatnonzero(np.r_[(np.diff(inside) > 1) | (np.diff(doc) > 0), True]) + 1
        stop = tail[np.searchsorted(tail, np.arange(len(inside)), "right")]
        order, rank = suffix_order(data[inside], stop, width)
        rank = np.where(window[inside], rank, -1 - np.arange(len(inside)))
        order = order[window[inside][order]]
        later, earlier = previous_factors(order, rank)
        matched = np.unique(np.r_[later, earlier])
        several = np.zeros(len(inside), bool)
        several[matched] = True
        fresh = window[inside].copy()
        fresh[later] = False
        fresh = np.flatnonzero(fresh)
        place = inside[fresh]
        name = Names(data)(place, place + width)
        # Equal windows have their spot at the same distance, so neighbours can be dealt together by both.
        windows, spot, piece = chosen_spots(data, at, width)
        own = np.searchsorted(windows, place)
        dealt = mixed(piece[own] + ((spot[own] - place) // TOGETHER).astype(np.uint64))
        runs = Runs(doc[fresh], place - at[doc[fresh]], np.zeros(len(fresh), np.int64), dealt, name, several[fresh])
        return runs, doc[later], inside[later] - at[doc[later]]

    return find


def repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """id, key, runs: the byte ranges of every document that occur elsewhere, of documents that have any."""
    return repeated(docs, width, True, spots(width), single(width))


def cleaned(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, kept (remaining bytes), spans (start, end of each removed run) of every document."""

    def run(batches):
        for ids, data, at, gone in _marked(batches):
            kept, spans = [], []
            for a, z in zip(at, at[1:], strict=False):
                kept.append(data[a:z][~gone[a:z]].tobytes())
                edge = np.flatnonzero(np.diff(np.r_[False, gone[a:z], False].astype(np.int8)))
                spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.binary()), spans], ["doc_id", "kept", "spans"])

    return _joined(docs, width).mapInArrow(run, "doc_id long, kept binary, spans array<struct<start: long, end: long>>")


def digests(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches):
        for ids, data, at, gone in _marked(batches):
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            inner = at[:-1][at[:-1] < len(gone)]
            begin[inner] = gone[inner]
            total = lambda x: np.diff(np.r_[0, np.cumsum(x)][at])
            kept = np.r_[0, np.cumsum(~gone)][at]
            rest = data[~gone]
            sha = [hashlib.sha256(rest[a:z]).hexdigest() for a, z in zip(kept, kept[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(at)), pa.array(total(gone)), pa.array(total(begin)), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _joined(docs, width).mapInArrow(run, DIGESTS)


def _joined(docs: DataFrame, width: int) -> DataFrame:
    return keyed(docs).join(repeats(docs, width), ["id", "key"], "left").select("id", "text", "runs")


def _marked(batches):
    for b in batches:
        ids = ints(b.column(0))
        ids = pa.array(ids, mask=ids == NO_ID)
        data, at = utf8(b.column(1))
        row, start, end = ranges_of(b.column(2))
        for a, z in slices(at, SLICE):
            mine = (row >= a) & (row < z)
            first = at[a : z + 1] - at[a]
            yield ids[a:z], data[at[a] : at[z]], first, covered(int(first[-1]), first, row[mine] - a, start[mine], end[mine])
