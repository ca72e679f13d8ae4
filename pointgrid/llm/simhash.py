"""Near-duplicates by SimHash fingerprints over a byte-position inverted index.

A 64-bit fingerprint has 8 bytes. If two fingerprints differ in at most 4 bits, at least
8 - 4 of their bytes agree in place. The index lists every fingerprint under positions with
the bytes found there: sets of three positions, chosen so that any four positions contain one
of the sets. Inside a list the shared positional bytes of each pair are tallied, pairs that
reach the guaranteed number are retained, and their bits are compared.

Defined results: a null text counts as empty and an empty text has fingerprint zero, linked
like any other. Rows that repeat a doc_id each have their own fingerprint; all of them stand
for that doc_id. A null doc_id never names a component unless it has no other. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointgrid.llm.arrow_text import unused
from pointgrid.llm.blocks import dealt, roots, runs
from pointgrid.llm.components import components
from pointgrid.stages import cut

BYTES = 8


def position_sets() -> list[tuple[int, ...]]:
    """Sets of three of the 8 positions such that any four positions hold one of them.

    The positions form three groups in a ring; a set lies inside one group, or has two
    positions in a group and one in the next.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    sets = [c for g in groups for c in combinations(g, 3)]
    for g, following in zip(groups, groups[1:] + groups[:1], strict=True):
        sets += [(*two, one) for two in combinations(g, 2) for one in following]
    return sets


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash over XXH64 (seed 42) of word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(b" ".join(words), 42)
    shifted = [words[i:] for i in range(shingle)]
    hashes = np.array([h(b" ".join(s), 42) for s in zip(*shifted, strict=False)], ">u8")
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, key (hash of the text), fingerprint (its 64 bits as a long) of every whole text."""

    def run(batches):
        for b in batches:
            bits = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bits.view(np.int64))], ["doc_id", "key", "fingerprint"])

    own = docs.selectExpr("CAST(doc_id AS long) doc_id", "text", "xxhash64(coalesce(text, '')) AS key")
    return own.mapInArrow(run, "doc_id long, key long, fingerprint long")


def links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """u, v: links that connect the same fingerprints as all pairs within ``max_bits`` do.

    ``prints`` has distinct values in ``fingerprint``. Each block of a list returns a spanning
    forest of its own links instead of every pair.
    """
    if not 0 <= max_bits <= BYTES - 4:
        raise ValueError("max_bits must leave four bytes in common")
    masks = [sum(0xFF << 8 * p for p in s) for s in position_sets()]
    keys = F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)) for m in masks))
    listed = prints.select("fingerprint", F.posexplode(keys).alias("place", "bytes"))
    block = ["place", "bytes", "_i", "_j"]

    def run(batches):
        for t in runs(batches, block):
            x = t.column("fingerprint").to_numpy().view(np.uint64)
            differ = x[:, None] ^ x[None, :]
            shared = (differ.view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(axis=2, dtype=np.uint8)
            near = (shared >= BYTES - max_bits) & (np.bitwise_count(differ) <= max_bits)
            root = roots(near)
            at = np.flatnonzero(root != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)), pa.array(x[root[at]].view(np.int64))], ["u", "v"])

    return dealt(listed, ["place", "bytes"], "fingerprint").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable by links) of every row."""
    return grouped(docs, max_bits, shingle).select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """The documents, with all their columns, that stay when one of each component does."""
    return keep_first(docs, grouped(docs, max_bits, shingle))


def keep_first(docs: DataFrame, of: DataFrame) -> DataFrame:
    """One document of each root; ``of`` has doc_id, key (hash of the text) and root of every row.

    It is the one with the smallest doc_id (null last), of several rows with it the one with the smallest
    hash of its text; of rows that repeat both one stays.
    """
    text_key, number = unused(docs.columns, "_key", "_n")
    null = F.col("doc_id").isNull()
    first = F.min(F.struct(null.alias("no_id"), "doc_id", "key")).alias("first")
    kept = cut(of.groupBy("root").agg(first).select("first.doc_id", "first.key"), "kept")
    own = docs.withColumn(text_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = own["doc_id"].eqNullSafe(kept["doc_id"]) & (own[text_key] == kept["key"])
    order = W.partitionBy("doc_id", text_key).orderBy(F.lit(0))
    left = own.join(kept, same, "left_semi").withColumn(number, F.row_number().over(order))
    return left.where(F.col(number) == 1).select(*docs.columns)


def grouped(docs: DataFrame, max_bits: int, shingle: int) -> DataFrame:
    """doc_id, key (hash of the text), fingerprint, root (fingerprint that stands for the component), component_id."""
    marked = cut(fingerprints(docs, shingle), "prints")
    prints = cut(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "prints")
    of = cut(components(links(prints.select("fingerprint"), max_bits)), "groups")
    rooted = prints.join(of, prints.fingerprint == of.node, "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = cut(rooted, "rooted")
    named = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    final = cut(rooted.join(named, "root").select("fingerprint", "root", "component_id"), "named")
    return marked.join(final, "fingerprint").select("doc_id", "key", "fingerprint", "root", "component_id")
