"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (BPE of pieces, which puts a space
before the text itself) the text. Each token covers a range of the bytes of space + text. Per Arrow batch two
``merge_asof`` calls, keyed by document, give every token start the token of the other side that covers it; the
union of both directions holds every overlap of two tokens once. Overlaps that end together are links; the ends
they share cut both sequences into groups.

A link joins two ids of which one's bytes end with the other's, so the id pairs that can be linked are listed
from the two vocabularies alone (``Tokenizers.pairs``, 324,300 for the given ones). That bounds the table of
corpus-wide counts: each task counts into an array of that length, Spark sums the tasks' counts, and the sums
go to the executors as one array.

Defined results: texts that are null or empty, or whose joined token bytes differ from space + text on one side,
have no tokens, groups or links. Strings of special tokens inside a text are plain text. Texts of any length
are aligned whole; rows that repeat a doc_id are aligned one by one, and each of them counts. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrid.llm.arrow_text import slices, utf8
from pointgrid.llm.bpe import WORD, byte_letters
from pointgrid.llm.windows import binaries
from pointgrid.stages import cut

SLICE = 1 << 20
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, code int, n long"
GROUPS = "doc_id long, a array<int>, b array<int>, groups array<struct<a_end: int, b_end: int, byte_end: long>>"
OVERLAPS = "doc_id long, a_at long, b_at long, a_id int, b_id int, start long, end long, linked boolean"
BEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizers:
    """Both tokenizers, the bytes of their entries, and the id pairs that can be linked."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        model = Tokenizer.from_file(path_a).model
        special = {t.content for t in Tokenizer.from_file(path_a).get_added_tokens_decoder().values()}
        plain = {t: i for t, i in vocabulary.items() if t not in special}
        # An entry that its own merges rebuild can be merged by rank alone, in whatever way it is split: two parts that
        # stand side by side when its rank is due are what the merges have left of the entry's bytes on their own.
        if any([x.id for x in model.tokenize(t)] != [i] for t, i in plain.items()):
            raise ValueError(f"{path_a}: an entry is not rebuilt by its merges")
        of = {c: b for b, c in enumerate(byte_letters())}
        raw = {bytes(of[c] for c in t): i for t, i in plain.items()}
        self._a = tiktoken.Encoding("a", pat_str=WORD, mergeable_ranks=raw, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in raw.items():
            self.bytes_a[i] = t
        pieces = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.pairs = self._pairs()
        listed = lambda x, end: np.array([b"%d%s" % (i, end) for i in range(len(x))], object)
        self.text_a = listed(self.bytes_a, b","), listed(self.bytes_a, b"|")
        self.text_b = listed(self.bytes_b, b","), listed(self.bytes_b, b";"), listed(self.bytes_b, b"")

    def _pairs(self) -> np.ndarray:
        """Sorted keys a * |B| + b of all pairs in which one entry's bytes end with the other's."""
        same: dict[bytes, list[int]] = {}
        for i, t in enumerate(self.bytes_b):
            same.setdefault(t, []).append(i)
        own: dict[bytes, list[int]] = {}
        for i, t in enumerate(self.bytes_a):
            own.setdefault(t, []).append(i)
        n = len(self.bytes_b)
        found = {a * n + b for a, t in enumerate(self.bytes_a) for k in range(len(t)) for b in same.get(t[k:], ())}
        found |= {a * n + b for b, t in enumerate(self.bytes_b) for k in range(len(t)) for a in own.get(t[k:], ())}
        return np.array(sorted(found), np.int64)

    def ids_of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two ids of a place in ``pairs``."""
        return np.divmod(self.pairs[code], len(self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; two empty lists where a side's bytes are not space + text."""
        a = [self._a.encode_ordinary(" " + t) if t else [] for t in texts]
        b = self._b.encode(texts, num_threads=1)
        for i, t in enumerate(texts):
            # Side A is made of the bytes themselves, which its merges only join.
            if not t or b"".join(map(self.bytes_b.__getitem__, b[i])) != b" " + t.encode():
                a[i] = b[i] = []
        return a, b


@lru_cache(1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


@dataclass
class Side:
    """Tokens of one side of some documents: document, id, and the byte range in all documents behind one another."""

    doc: np.ndarray
    id: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1 offsets of the documents' tokens

    @staticmethod
    def of(ids: list[list[int]], size: np.ndarray) -> Side:
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.array(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
        end = np.cumsum(size[flat])
        return Side(np.repeat(np.arange(len(ids)), counts), flat, end - size[flat], end, np.r_[0, np.cumsum(counts)])


def overlaps_of(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs of tokens of one document that have a byte in common."""
    left = pd.DataFrame({"doc": a.doc, "start": a.start, "a": np.arange(len(a.id))}, copy=False)
    right = pd.DataFrame({"doc": b.doc, "start": b.start, "b": np.arange(len(b.id))}, copy=False)
    # Both sides of a document begin at its first byte, so every start has a cover.
    cover_b = pd.merge_asof(left, right, on="start", by="doc")["b"].to_numpy(np.int64)
    cover_a = pd.merge_asof(right, left, on="start", by="doc")["a"].to_numpy(np.int64)
    # Where two tokens start together, both directions find the pair.
    more = np.flatnonzero(a.start[cover_a] < b.start)
    return np.r_[left["a"].to_numpy(), cover_a[more]], np.r_[cover_b, more]


def links_of(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the overlapping pairs that end together, in the order of the text."""
    i, j = overlaps_of(a, b)
    together = a.end[i] == b.end[j]
    i, j = i[together], j[together]
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def group_texts(tok: Tokenizers, a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every document, from the links that end its groups."""
    last_a, last_b = np.zeros(len(a.id), bool), np.zeros(len(b.id), bool)
    last_a[i] = last_b[j] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_b, through_a = np.r_[0, j + 1], i + 1
    out = np.empty(len(a.id) + len(b.id), object)
    out[np.arange(len(a.id)) + before_b[group_a]] = np.where(last_a, tok.text_a[1][a.id], tok.text_a[0][a.id])
    text = np.where(last_b, tok.text_b[1][b.id], tok.text_b[0][b.id])
    ends = b.first[1:][np.diff(b.first) > 0] - 1
    text[ends] = tok.text_b[2][b.id[ends]]
    out[np.arange(len(b.id)) + through_a[group_b]] = text
    flat, at = out.tolist(), (a.first + b.first).tolist()
    return [b"".join(flat[x:y]) for x, y in zip(at, at[1:], strict=False)]


def _sides(tok: Tokenizers, b: pa.RecordBatch) -> Iterator[tuple[pa.Array, Side, Side]]:
    """doc_ids and both sides, some documents at a time; columns of the batch: doc_id, text."""
    _, at = utf8(b.column(1))
    for x, y in slices(at, SLICE):
        texts = [t or "" for t in b.column(1).slice(x, y - x).to_pylist()]
        ids_a, ids_b = tok.encode(texts)
        yield b.column(0).slice(x, y - x), Side.of(ids_a, tok.size_a), Side.of(ids_b, tok.size_b)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS long) doc_id", "text")


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Both id sequences of every text, and its groups: tokens of each side through a group, and its last byte + 1."""

    def run(batches):
        tok = tokenizers(path_a, path_b)
        for batch in batches:
            for doc_id, a, b in _sides(tok, batch):
                i, j = links_of(a, b)
                doc = a.doc[i]
                at = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(doc_id)))]
                first_byte = np.r_[0, a.end][a.first[:-1]]
                struct = pa.StructArray.from_arrays(
                    [pa.array((i + 1 - a.first[doc]).astype(np.int32)), pa.array((j + 1 - b.first[doc]).astype(np.int32)), pa.array(a.end[i] - first_byte[doc])],
                    ["a_end", "b_end", "byte_end"],
                )
                lists = lambda first, values: pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, lists(a.first, pa.array(a.id, pa.int32())), lists(b.first, pa.array(b.id, pa.int32())), lists(at, struct)],
                    ["doc_id", "a", "b", "groups"],
                )

    return _rows(docs).mapInArrow(run, GROUPS)


def overlaps(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every pair of tokens with a byte in common: places and ids of both, the common bytes, whether they end together."""

    def run(batches):
        tok = tokenizers(path_a, path_b)
        for batch in batches:
            for doc_id, a, b in _sides(tok, batch):
                i, j = overlaps_of(a, b)
                doc = a.doc[i]
                first_byte = np.r_[0, a.end][a.first[:-1]][doc]
                columns = [
                    doc_id.take(pa.array(doc)), pa.array(i - a.first[doc]), pa.array(j - b.first[doc]), pa.array(a.id[i], pa.int32()), pa.array(b.id[j], pa.int32()),
                    pa.array(np.maximum(a.start[i], b.start[j]) - first_byte), pa.array(np.minimum(a.end[i], b.end[j]) - first_byte), pa.array(a.end[i] == b.end[j]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_at", "b_at", "a_id", "b_id", "start", "end", "linked"])

    return _rows(docs).mapInArrow(run, OVERLAPS)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Two kinds of rows, stored: each document's figures and links (as places in ``pairs``); per task the count of each pair.

    Rows of documents have no ``code``, rows of counts nothing but ``code`` and ``n``.
    """

    def run(batches):
        tok = tokenizers(path_a, path_b)
        counted = np.zeros(len(tok.pairs), np.int64)
        for batch in batches:
            for doc_id, a, b in _sides(tok, batch):
                i, j = links_of(a, b)
                code = np.searchsorted(tok.pairs, a.id[i] * len(tok.bytes_b) + b.id[j])
                counted += np.bincount(code, minlength=len(counted))
                of = np.bincount(a.doc[i], minlength=len(doc_id))
                texts = group_texts(tok, a, b, i, j)
                many = pa.array(of)  # a group for each end that two tokens share
                columns = [
                    doc_id, pa.array(np.diff(a.first)), pa.array(np.diff(b.first)), many, many,
                    pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts]), binaries(code.astype(np.int32), of),
                    pa.nulls(len(doc_id), pa.int32()), pa.nulls(len(doc_id), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ALIGNED.split(", ")])
        code = np.flatnonzero(counted)
        none = lambda kind: pa.nulls(len(code), kind)
        long = pa.int64()
        columns = [none(long), none(long), none(long), none(long), none(long), none(pa.string()), none(pa.binary()), pa.array(code, pa.int32()), pa.array(counted[code])]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ALIGNED.split(", ")])

    return cut(_rows(docs).mapInArrow(run, ALIGNED), "aligned")


def pair_counts(stored: DataFrame) -> DataFrame:
    """code, n: how many links of the corpus hold each pair of ids; at most one row for each of ``pairs``."""
    return stored.where("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n"))


def id_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a_id, b_id, n, best: linked pairs of ids, and whether no other a_id is linked with the b_id more often."""

    def named(batches):
        tok = tokenizers(path_a, path_b)
        for b in batches:
            ids = tok.ids_of(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in ids), b.column(1)], ["a_id", "b_id", "n"])

    counts = cut(pair_counts(aligned(docs, path_a, path_b)).mapInArrow(named, "a_id int, b_id int, n long"), "pairs")
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").selectExpr("a_id", "b_id", "n", "n = most best")


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document the number of tokens, groups and links, how many links are their B id's best, the sum of their counts, and the groups' digest."""
    stored = aligned(docs, path_a, path_b)
    tok = tokenizers(path_a, path_b)
    counts = np.zeros(len(tok.pairs), np.int64)
    sums = pair_counts(stored).toArrow()
    counts[sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    _, b = tok.ids_of(np.arange(len(counts)))
    most = np.zeros(len(tok.bytes_b), np.int64)
    np.maximum.at(most, b, counts)
    tables = docs.sparkSession.sparkContext.broadcast((counts, counts == most[b]))

    def run(batches):
        count, best = tables.value
        for batch in batches:
            data, at = utf8(batch.column(5).cast(pa.large_binary()).view(pa.large_string()))
            code, at = data.view(np.int32), at // 4
            summed = [np.r_[0, np.cumsum(x[code].astype(np.int64))] for x in (best, count)]
            new = [pa.array(s[at[1:]] - s[at[:-1]]) for s in summed]
            columns = [*(batch.column(k) for k in range(5)), *new, batch.column(6)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BEST.split(", ")])

    rows = stored.where("code IS NULL").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "links", "groups_sha256")
    return rows.mapInArrow(run, BEST)
