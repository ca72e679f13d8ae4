"""Windows of fixed length that occur more than once in a corpus, and what is left without them.

A window is ``width`` consecutive units (bytes or words) of one document. The work is done in
two rounds over a table of spots:

1. Every window picks a spot in its document by its own content alone, so equal windows pick
   equal spots. Neighbouring windows mostly pick the same one; together they form a run. A run
   is known by its spot's name and by the name of its whole content. Runs of equal content are
   settled at once; a spot name with one run in the corpus has no repeated window.
2. Where one spot name has runs of different content, one run of each content is opened and
   its windows are compared one by one.

In both rounds each task first settles what it can among its own rows, so that it sends every
name once however often the task holds it; names are dealt over the tasks by hash. Answers go
back to the documents they concern. Nothing is kept per corpus.

Documents are known by doc_id and a hash of the text. Rows that repeat both are one document.
Names are 64-bit hashes of exact content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrid.llm.arrow_text import NO_ID, ints, mixed, slices, utf8
from pointgrid.stages import cut

SLICE = 1 << 20
FLUSH = 500_000
REMOVED, OPEN = 1, 2
SENT = "part int, id long, key long, runs binary, spot binary, name binary, start binary, extra binary, several binary, ids binary, keys binary, counts binary"
ANSWERS = "id long, key long, kind int, runs binary"
_FIELDS = [f.split()[0] for f in SENT.split(", ")]
_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = 1 << (n + 1).bit_length()
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b % 2**64, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64)))
        return cls.up, cls.down


class Names:
    """Names of all stretches of a sequence of values."""

    def __init__(self, values: np.ndarray):
        up, self.down = Powers.of(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(h ^ ((end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


@dataclass
class Runs:
    """Runs of windows: document (row of the slice), first window, further windows, spot name, content name.

    ``several`` marks content that is already known to occur elsewhere.
    """

    doc: np.ndarray
    start: np.ndarray
    extra: np.ndarray
    spot: np.ndarray
    name: np.ndarray
    several: np.ndarray

    def take(self, at: np.ndarray) -> Runs:
        return Runs(*(x[at] for x in (self.doc, self.start, self.extra, self.spot, self.name, self.several)))

    @staticmethod
    def join(parts: list[Runs]) -> Runs:
        return Runs(*(np.concatenate(x) for x in zip(*((p.doc, p.start, p.extra, p.spot, p.name, p.several) for p in parts), strict=True)))


def none() -> Runs:
    z = np.zeros(0, np.int64)
    return Runs(z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(bool))


#: From the bytes and offsets of a slice, its runs of windows.
Find = Callable[[np.ndarray, np.ndarray], Runs]
#: From the bytes, offsets and opened stretches (row, first window, last window) of a slice, its single
#: windows, and the (row, window) of those that were settled on the way.
Single = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[Runs, np.ndarray, np.ndarray]]


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of counts[i] items each, from the items behind one another."""
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    size = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at * size), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def per_document(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ranges of each document as one binary value; touching ranges become one."""
    order = np.lexsort((start, keys, ids))
    ids, keys, start, end = (x[order] for x in (ids, keys, start, end))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    first = new.copy()
    first[1:] |= start[1:] > end[:-1]
    at = np.flatnonzero(first)
    # Ranges of one kind from one round start and end in the same order, so the last one of a row ends last.
    start, end = start[at], end[np.r_[at[1:], len(end)] - 1] if len(at) else end
    of = np.cumsum(new) - 1
    pairs = np.stack([start, end], axis=1).astype(np.uint32)
    docs = np.flatnonzero(new)
    return ids[docs], keys[docs], binaries(pairs, np.bincount(of[at], minlength=len(docs)))


def groups(name: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by name and then by the further columns, without rows equal in all; the group of each, and whether it is the first there."""
    order = np.lexsort((*then[::-1], name))
    same = np.zeros(len(order), bool)
    change = np.ones(len(order), bool)
    change[1:] = name[order][1:] != name[order][:-1]
    if len(order):
        same[1:] = ~change[1:] & np.all([x[order][1:] == x[order][:-1] for x in then], axis=0)
    order, change = order[~same], change[~same]
    return order, np.cumsum(change) - 1, change


class Sender:
    """Collects runs of a task, settles those that meet in it, and deals the others by spot name.

    ``named``: the spot names go along.
    """

    def __init__(self, width: int, parts: int, every: bool, named: bool):
        self.width, self.parts, self.every, self.named = width, parts, every, named
        self.held: list[Runs] = []
        self.ids: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.gone: list[tuple[np.ndarray, np.ndarray]] = []
        self.docs = self.size = 0

    def add(self, ids: np.ndarray, keys: np.ndarray, runs: Runs, doc: np.ndarray | None = None, start: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        runs.doc = runs.doc + self.docs
        if doc is not None and len(doc):
            self.gone.append((doc + self.docs, start))
        self.held.append(runs)
        self.ids.append(ids)
        self.keys.append(keys)
        self.docs += len(ids)
        self.size += len(runs.start)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        runs, ids, keys = Runs.join(self.held), np.concatenate(self.ids), np.concatenate(self.keys)
        gone = self.gone
        self.held, self.ids, self.keys, self.gone, self.docs, self.size = [], [], [], [], 0, 0
        order = np.lexsort((keys, ids))
        new = np.ones(len(order), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        of_rank = order[np.flatnonzero(new)]
        ids, keys = ids[of_rank], keys[of_rank]
        runs.doc = rank[runs.doc]
        at, group, first = groups(runs.name, runs.doc, runs.start)
        runs = runs.take(at)
        lone = np.bincount(group, minlength=1)[group] == 1 if len(at) else np.zeros(0, bool)
        several = np.zeros(int(group[-1]) + 1 if len(at) else 0, bool)
        np.logical_or.at(several, group, runs.several)
        settled = (~lone | runs.several) if self.every else ~first
        done = runs.take(np.flatnonzero(settled))
        doc, start, end = done.doc, done.start, done.start + done.extra + self.width
        if gone:
            more, at_unit = rank[np.concatenate([g[0] for g in gone])], np.concatenate([g[1] for g in gone])
            doc, start, end = np.r_[doc, more], np.r_[start, at_unit], np.r_[end, at_unit + self.width]
        if len(doc):
            i, k, ranges = per_document(ids[doc], keys[doc], start, end)
            yield _sent(len(i), part=pa.array((i ^ k) % self.parts, pa.int32()), id=pa.array(i), key=pa.array(k), runs=ranges)
        runs.several = ~lone | several[group] if len(at) else runs.several
        if not len(runs.start):  # every held text is shorter than a window
            return
        runs = runs.take(np.flatnonzero(first))
        runs = runs.take(np.lexsort((runs.start, runs.doc)))
        part = (runs.spot % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        runs, part = runs.take(order), part[order]
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, z in zip(heads, np.r_[heads[1:], len(part)], strict=True):
            r = runs.take(np.arange(a, z))
            head = np.flatnonzero(np.r_[True, r.doc[1:] != r.doc[:-1]])
            columns = {
                "spot": r.spot if self.named else r.spot[:0], "name": r.name, "start": np.diff(r.start, prepend=0).astype(np.int32), "extra": r.extra.astype(np.uint16), "several": np.packbits(r.several),
                "ids": ids[r.doc[head]], "keys": keys[r.doc[head]], "counts": np.diff(np.r_[head, z - a]).astype(np.uint32),
            }
            yield _sent(1, part=pa.array([int(part[a])], pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()})


def _sent(n: int, **given: pa.Array) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "id": pa.int64(), "key": pa.int64()}
    return pa.RecordBatch.from_arrays([given[f] if f in given else pa.nulls(n, kinds.get(f, pa.binary())) for f in _FIELDS], _FIELDS)


def _settle(width: int, every: bool, opens: bool):
    """Settle the runs dealt to one task and answer their documents."""

    def run(batches):
        got: dict[str, list[np.ndarray]] = {f: [] for f in ("spot", "name", "start", "extra", "several", "id", "key")}
        for b in batches:
            col = {f: b.column(i) for i, f in enumerate(_FIELDS)}
            answered = col["runs"].is_valid()
            own = b.filter(answered)
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array(np.full(own.num_rows, REMOVED, np.int32)), own.column(3)], ["id", "key", "kind", "runs"])
            for row in b.filter(col["name"].is_valid()).to_pylist():
                name = np.frombuffer(row["name"], np.uint64)
                counts = np.frombuffer(row["counts"], np.uint32)
                got["spot"].append(np.frombuffer(row["spot"], np.uint64) if opens else name)
                got["name"].append(name)
                got["start"].append(np.cumsum(np.frombuffer(row["start"], np.int32), dtype=np.int64))
                got["extra"].append(np.frombuffer(row["extra"], np.uint16))
                got["several"].append(np.unpackbits(np.frombuffer(row["several"], np.uint8))[: len(name)].astype(bool))
                got["id"].append(np.repeat(np.frombuffer(row["ids"], np.int64), counts))
                got["key"].append(np.repeat(np.frombuffer(row["keys"], np.int64), counts))
        if not got["spot"]:
            return
        spot, name, start, extra, several, ids, keys = (np.concatenate(got.pop(f)) for f in ("spot", "name", "start", "extra", "several", "id", "key"))
        at, group, first = groups(name, ids, keys, start)
        spot, start, extra, several, ids, keys = (x[at] for x in (spot, start, extra.astype(np.int64), several, ids, keys))
        known = np.zeros(int(group[-1]) + 1, bool)
        np.logical_or.at(known, group, several)
        repeated = (known | (np.bincount(group) > 1))[group]
        settled = repeated & ~several if every else ~first
        i, k, ranges = per_document(ids[settled], keys[settled], start[settled], start[settled] + extra[settled] + width)
        yield _answer(i, k, REMOVED, ranges)
        if opens:
            _, where, kinds = np.unique(spot[first], return_inverse=True, return_counts=True)
            wanted = kinds > 1
            if every:  # a spot whose runs all repeat has nothing left to compare
                wanted &= np.bincount(where, weights=~repeated[first], minlength=len(kinds)) > 0
            at = np.flatnonzero(first)[wanted[where]]
            if len(at):
                i, k, ranges = per_document(ids[at], keys[at], start[at], start[at] + extra[at] + 1)
                yield _answer(i, k, OPEN, ranges)

    return run


def _answer(ids: np.ndarray, keys: np.ndarray, kind: int, ranges: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(np.full(len(ids), kind, np.int32)), ranges], ["id", "key", "kind", "runs"])


def keyed(docs: DataFrame) -> DataFrame:
    """id, key, text: the identity of every document beside its text; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def ranges_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of all ranges in a column of lists of binary values."""
    lists = lists.fill_null([]) if lists.null_count else lists
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    sizes = np.array([len(x) for x in flat.to_pylist()], np.int64) // 8 if len(flat) else np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(flat.to_pylist()), np.uint32).reshape(-1, 2).astype(np.int64)
    return np.repeat(np.repeat(np.arange(len(lists)), counts), sizes), raw[:, 0], raw[:, 1]


def repeated(docs: DataFrame, width: int, every: bool, find: Find, single: Single) -> DataFrame:
    """id, key, runs (list of binary ranges of units): what repeated windows cover.

    ``every``: all places of a repeated window count; otherwise all but the earliest
    (smallest id, then key, then place).
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs)

    def send(batches):
        out = Sender(width, parts, every, True)
        for b in batches:
            ids, keys = ints(b.column(0)), ints(b.column(1))
            data, at = utf8(b.column(2))
            for a, z in slices(at, SLICE):
                yield from out.add(ids[a:z], keys[a:z], find(data[at[a] : at[z]], at[a : z + 1] - at[a]))
        yield from out.flush()

    def send_single(batches):
        out = Sender(width, parts, every, False)
        for b in batches:
            ids, keys = ints(b.column(0)), ints(b.column(1))
            data, at = utf8(b.column(2))
            row, start, end = ranges_of(b.column(3))
            for a, z in slices(at, SLICE):
                # A document that is repeated here is looked at once.
                _, once = np.unique(np.stack([ids[a:z], keys[a:z]], axis=1), axis=0, return_index=True)
                mine = (row >= a) & (row < z)
                mine[mine] = np.isin(row[mine] - a, once)
                runs, doc, unit = single(data[at[a] : at[z]], at[a : z + 1] - at[a], row[mine] - a, start[mine], end[mine] - 1)
                yield from out.add(ids[a:z], keys[a:z], runs, doc, unit)
        yield from out.flush()

    def dealt(sent: DataFrame, opens: bool) -> DataFrame:
        return cut(sent.repartition(parts // 2, "part").mapInArrow(_settle(width, every, opens), ANSWERS), "answers")

    first = dealt(texts.mapInArrow(send, SENT), True)
    gathered = F.collect_list("runs").alias("runs")
    opened = first.where(F.col("kind") == OPEN).groupBy("id", "key").agg(gathered)
    again = dealt(texts.join(opened, ["id", "key"]).select("id", "key", "text", "runs").mapInArrow(send_single, SENT), False)
    return first.where(F.col("kind") == REMOVED).unionByName(again).groupBy("id", "key").agg(gathered)


def covered(n: int, first: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units (documents begin at ``first``) lie in one of the ranges."""
    step = np.bincount(first[row] + start, minlength=n + 1) - np.bincount(first[row] + end, minlength=n + 1)
    return np.cumsum(step[:n]) > 0
