"""Long repeats of words by recompression.

Every document starts as the names of its words. A round first names each maximal run of one
symbol, then names pairs: a hash of the symbol sorts it left or right, and a left symbol followed
by a right one becomes one symbol. Names are hashes of content, the same in every task, so equal
passages get equal symbols everywhere but near their ends. Each symbol carries the words that its
making depends on. A window of ``width`` words picks the least of the symbols of the highest level
whose words it holds completely; equal windows pick equal symbols, wherever they stand. Shared
symbols reveal repeats, and the windows around them are verified (see ``windows``).

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none; a text with fewer
words than ``width`` loses nothing. "Earlier" is smaller doc_id (null first), then for rows that
share a doc_id the smaller hash of the text, then earlier start. Rows that repeat doc_id and text are
one document and all get its result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrid.llm.arrow_text import NO_ID, ints, mixed, replaced, slices, unused, utf8, words
from pointgrid.llm.windows import SLICE, Names, Runs, covered, keyed, none, ranges_of, repeated

DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"
ROUNDS = 2


@dataclass
class Symbols:
    """Symbols of one level: name, document, and the first and last word (exclusive) they depend on."""

    name: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray


def round_of(x: Symbols, first: np.ndarray, number: int) -> Symbols:
    """Name runs, then pairs. What touches the edge of a document depends on a word beyond it."""
    before_doc, after_doc = first[:-1] - 1, first[1:] + 1
    n = len(x.name)
    new = np.ones(n, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1])
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], n] - 1
    size = (tail - head + 1).astype(np.uint64)
    name = np.where(size > 1, mixed(x.name[head] + size * np.uint64(0x8CB92BA72F3D8DD7)), x.name[head])
    doc = x.doc[head]
    x = Symbols(name, doc, _left(x.low, head, x.doc, before_doc), _right(x.high, tail, x.doc, after_doc))

    n = len(x.name)
    right = mixed(x.name + np.uint64(number * 2 + 1)) >> np.uint64(63) == 1
    pair = np.zeros(n, bool)
    pair[:-1] = ~right[:-1] & right[1:] & (x.doc[1:] == x.doc[:-1])
    second = np.r_[False, pair[:-1]]
    i = np.arange(n)
    low = np.where(right & ~second, _left(x.low, i, x.doc, before_doc), x.low)
    high = np.where(~right & ~pair, _right(x.high, i, x.doc, after_doc), x.high)
    at = np.flatnonzero(~second)
    follow = np.minimum(at + 1, n - 1)
    name = np.where(pair[at], mixed(x.name[at] * np.uint64(0xC2B2AE3D27D4EB4F) ^ mixed(x.name[follow])), x.name[at])
    return Symbols(name, x.doc[at], low[at], np.where(pair[at], x.high[follow], high[at]))


def _left(low: np.ndarray, at: np.ndarray, doc: np.ndarray, edge: np.ndarray) -> np.ndarray:
    prior = np.maximum(at - 1, 0)
    return np.where((at > 0) & (doc[prior] == doc[at]), low[prior], edge[doc[at]])


def _right(high: np.ndarray, at: np.ndarray, doc: np.ndarray, edge: np.ndarray) -> np.ndarray:
    follow = np.minimum(at + 1, len(doc) - 1)
    return np.where((at + 1 < len(doc)) & (doc[follow] == doc[at]), high[follow], edge[doc[at]])


def word_names(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of every word, and where the words of each document begin."""
    start, end, first = words(data, at)
    return Names(data)(start, end), first


def windows_of(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of every window."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc], doc


def least_between(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the least value (leftmost on a tie) in each non-empty range [low, high)."""
    best = [np.arange(len(v))]
    while 2 ** len(best) <= int((high - low).max(initial=1)):
        a, half = best[-1], 2 ** (len(best) - 1)
        b = a[half:]
        a = a[: len(b)]
        best.append(np.where(v[b] < v[a], b, a))
    k = np.log2(np.maximum(high - low, 1)).astype(np.int64)
    found = low.copy()
    for level, b in enumerate(best):
        mine = np.flatnonzero(k == level)
        x, y = b[low[mine]], b[high[mine] - 2**level]
        found[mine] = np.where(v[y] < v[x], y, x)
    return found


def spots(width: int, rounds: int = ROUNDS):
    def find(data: np.ndarray, at: np.ndarray) -> Runs:
        own, first = word_names(data, at)
        window, doc = windows_of(first, width)
        if not len(window):
            return none()
        names = Names(own)
        i = np.arange(len(own))
        levels = [Symbols(own, np.searchsorted(first, i, "right") - 1, i, i + 1)]
        for number in range(rounds):
            levels.append(round_of(levels[-1], first, number))
        left = np.arange(len(window))
        place, spot = np.zeros(len(window), np.int64), np.zeros(len(window), np.uint64)
        for level in range(rounds, -1, -1):
            x = levels[level]
            w = window[left]
            low = np.searchsorted(x.low, w)
            high = np.searchsorted(x.high, w + width, "right")
            has = high > low
            low, high, w = low[has], high[has], w[has]
            # The name of a symbol here is that of all words it depends on.
            edge = np.clip(x.low, 0, len(own)), np.clip(x.high, 0, len(own))
            called = names(*edge) + np.uint64(level)
            chosen = least_between(mixed(called), low, high)
            place[left[has]] = chosen * (rounds + 1) + level
            spot[left[has]] = called[chosen]
            left = left[~has]
        head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
        start, last = window[head], window[np.r_[head[1:], len(window)] - 1]
        return Runs(doc[head], start - first[doc[head]], last - start, spot[head], names(start, last + width), np.zeros(len(head), bool))

    return find


def single(width: int):
    def find(data: np.ndarray, at: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray):
        empty = np.zeros(0, np.int64)
        if not len(row):
            return none(), empty, empty
        own, first = word_names(data, at)
        counts = high - low + 1
        doc = np.repeat(row, counts)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        place = first[doc] + start
        name = Names(own)(place, place + width)
        return Runs(doc, start, np.zeros(len(doc), np.int64), mixed(name), name, np.zeros(len(doc), bool)), empty, empty

    return find


def repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """id, key, runs: the word ranges of every document that start earlier elsewhere, of documents that have any."""
    return repeated(docs, width, False, spots(width), single(width))


def _kept(texts: pa.Array, runs: pa.Array):
    """First row, numbers of words, numbers removed and kept words of the documents, slice by slice."""
    data, at = utf8(texts)
    row, start, end = ranges_of(runs)
    for a, z in slices(at, SLICE):
        d, o = data[at[a] : at[z]], at[a : z + 1] - at[a]
        begin, stop, first = words(d, o)
        mine = (row >= a) & (row < z)
        gone = covered(len(begin), first, row[mine] - a, start[mine], end[mine])
        kept = np.flatnonzero(~gone)
        # The bytes of every kept word and one more, which becomes a space; the last one of a document is left out.
        lengths = stop[kept] - begin[kept] + 1
        total = np.r_[0, np.cumsum(lengths)]
        source = np.arange(total[-1]) - np.repeat(total[:-1], lengths) + np.repeat(begin[kept], lengths)
        text = np.append(d, np.uint8(32))[source]
        text[total[1:] - 1] = 32
        edge = total[np.searchsorted(kept, first)]
        removed = np.diff(np.r_[0, np.cumsum(gone)][first])
        yield a, np.diff(first), removed, [text[x : max(x, y - 1)].tobytes() for x, y in zip(edge, edge[1:], strict=False)]


def digests(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def run(batches):
        for b in batches:
            ids = ints(b.column(0))
            ids = pa.array(ids, mask=ids == NO_ID)
            for a, n, removed, texts in _kept(b.column(1), b.column(2)):
                sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([ids[a : a + len(n)], pa.array(n), pa.array(removed), sha], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = keyed(docs).join(repeats(docs, width), ["id", "key"], "left")
    return joined.select("id", "text", "runs").mapInArrow(run, DIGESTS)


def cleaned(docs: DataFrame, width: int = 20) -> DataFrame:
    """The documents, with all their columns; where words are removed, text is the kept words joined by one space."""
    own_id, own_key, gone = unused(docs.columns, "_id", "_key", "_gone")
    found = repeats(docs, width).toDF(own_id, own_key, gone)
    own = docs.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    own = own.withColumn(own_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = own.join(found, [own_id, own_key], "left").select(*docs.columns, gone)

    def run(batches):
        for b in batches:
            texts, runs = b.column("text"), b.column(gone)
            changed: list[bytes] = []
            for _, _, _, some in _kept(texts, runs):
                changed += some
            changed = pa.array(changed, pa.binary()).cast(texts.type)
            touched = runs.is_valid()
            b = b.select(range(b.num_columns - 1))
            yield replaced(b, "text", pc.if_else(touched, changed, texts))

    return joined.mapInArrow(run, docs.schema)
