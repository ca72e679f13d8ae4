"""Byte-level BPE by forced boundaries.

Bytes a, b that never stand next to one another inside any token of the vocabulary can
never be merged into one token, so the text is cut between them. The fragments between
such cuts are encoded on their own and their ids are put behind one another. The cuts that
the tokenizer's own word pattern makes are boundaries of the same kind.

Nulls count as empty texts; an empty text has no ids. Texts of any length are encoded whole.
Rows that repeat a doc_id are encoded one by one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The word pattern of the byte-level vocabulary and its white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Words and fragments whose ids a worker remembers; beyond it the older half of the words, and the
#: fragments not used for longest, are forgotten.
REMEMBERED, FRAGMENTS = 120_000, 300_000
#: The same for a worker that other stages have used and that keeps their memory.
FEW_REMEMBERED, FEW_FRAGMENTS = 20_000, 50_000

IDS = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder and decoder for one vocabulary file with merges."""

    def __init__(self, path: str, remembered: int = REMEMBERED, fragments: int = FRAGMENTS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(of[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(self.ids[raw(a)], self.ids[raw(b)]): (n, self.ids[raw(a + b)]) for n, (a, b) in enumerate(pairs)}
        self.inside = np.zeros((256, 256), bool)
        for t in self.ids:
            for a, b in zip(t, t[1:], strict=False):
                self.inside[a, b] = True
        self.joined = [[bool(x) for x in row] for row in self.inside]
        self.word = regex.compile(WORD)
        self.unit = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
        self.is_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_before: dict[str, tuple[int, ...]] = {}
        self.remembered, self.fragment = remembered, lru_cache(fragments)(self._fragment)
        self.listed = [b"%d" % i for i in range(len(self.tokens))]

    def fragments(self, raw: bytes) -> Iterator[bytes]:
        first = 0
        for i in range(1, len(raw)):
            if not self.joined[raw[i - 1]][raw[i]]:
                yield raw[first:i]
                first = i
        if first < len(raw):
            yield raw[first:]

    def _fragment(self, raw: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        if raw in self.ids and len(raw) == 1:
            return (self.ids[raw],)
        parts = [self.ids[raw[i : i + 1]] for i in range(len(raw))]
        if len(parts) > 64:
            return tuple(self._long(parts))
        rank, none = self.rank, (len(self.rank), -1)
        steps = [rank.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while steps and (best := min(steps)) is not none:
            i = steps.index(best)
            parts[i : i + 2] = [best[1]]
            del steps[i]
            if i < len(steps):
                steps[i] = rank.get((parts[i], parts[i + 1]), none)
            if i:
                steps[i - 1] = rank.get((parts[i - 1], parts[i]), none)
        return tuple(parts)

    def _long(self, parts: list[int]) -> list[int]:
        """The same merges over a linked list and a heap, for long fragments."""
        from heapq import heapify, heappop, heappush

        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        heap = [(r[0], i, parts[i], parts[i + 1], r[1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((parts[x], parts[y]))):
                    heappush(heap, (r[0], x, parts[x], parts[y], r[1]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a run of non-spaces or of spaces that the memory does not hold now."""
        ids = self.known_before.get(unit)
        if ids is None:
            ids = tuple(i for w in self.word.findall(unit) for f in self.fragments(w.encode()) for i in self.fragment(f))
        if len(unit) <= 64:
            if len(self.known) >= self.remembered:
                self.known_before, self.known = self.known, {}
            self.known[unit] = ids
        return ids

    def _plain(self, text: str, ids: list[int]) -> None:
        known, unseen = self.known.get, self._unit
        for unit in self.unit.findall(text):
            ids += known(unit) or unseen(unit)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if self.is_special is None:
            self._plain(text, ids)
            return ids
        first = 0
        for m in self.is_special.finditer(text):
            self._plain(text[first : m.start()], ids)
            ids.append(self.special[m[0]])
            first = m.end()
        self._plain(text[first:] if first else text, ids)
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str, remembered: int = REMEMBERED, fragments: int = FRAGMENTS) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path, remembered, fragments)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every text: doc_id, ids."""

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "text").mapInArrow(run, IDS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Text of every row of ids: doc_id, text."""

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            texts = [bpe.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; return the number of ids and the digests of ids and decoded text."""

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            for chunk in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                counts, of_ids, of_text = [], [], []
                for text in chunk.column(1).to_pylist():
                    ids = bpe.encode(text or "")
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(b",".join(map(bpe.listed.__getitem__, ids))).hexdigest())
                    back = bpe.decode_bytes(ids)
                    try:
                        back.decode("utf-8")
                    except UnicodeDecodeError:
                        back = back.decode("utf-8", "replace").encode()
                    of_text.append(hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "text").mapInArrow(run, DIGESTS)


def encoded_corpus(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of every row, and whether the ids decode to the text."""

    def run(batches):
        bpe = tokenizer(path, FEW_REMEMBERED, FEW_FRAGMENTS)
        for b in batches:
            for chunk in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                texts = [t or "" for t in chunk.column(2).to_pylist()]
                ids = [bpe.encode(t) for t in texts]
                same = [bpe.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), chunk.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)],
                    ["doc_id", "source", "n_tokens", "ids", "decodes"],
                )

    rows = docs.selectExpr("CAST(doc_id AS long) doc_id", "source", "text")
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, decodes boolean")
