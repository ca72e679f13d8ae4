"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector is in its list if it points close enough to it. Directions are
a structured random product code: a random rotation, then the two halves of the space each with
their own random codewords, so that C codewords a half give C * C directions. The scores of all
directions are sums of two scores, and the directions that exceed a vector's cap are decoded from
its best codewords of both halves. The cap of a vector is set by its own scores: it holds ``caps``
directions. Vectors that share a filter meet and are verified in double precision.

The number of codewords follows the number of vectors, so the lists stay short, and narrower lists
need more of them per vector: 40 up to 100,000 vectors and 25 more for each factor of ten beyond
(``caps_for``). At cosine 0.93 in 64 dimensions two vectors then share no filter at most about four times in
ten thousand pairs (measured with the codes of 1e4 to 1e8 vectors), at 0.98 next to never; a pair
that shares none is not found.

Defined results: vectors link only if their labels are equal and not null and they have the same
number of components. A vector that is null, empty or zero, or holds a null or non-finite component,
links with nothing and is its own component. Equal vectors are compared once and counted as often as
they occur. Rows that repeat a vec_id are vectors of their own; a null vec_id never names a component
unless it has no other. Columns other than vec_id, label and embedding are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrid.llm.blocks import dealt, roots, runs
from pointgrid.llm.components import components
from pointgrid.stages import cut

CAPS = 40
SEED = 17


def codewords(n: int) -> int:
    """Codewords of either half for n vectors: some 4 n directions."""
    return max(16, ceil(2 * sqrt(n)))


def caps_for(n: int) -> int:
    """Filters per vector, so that pairs at the threshold keep sharing one as the lists get narrower."""
    return CAPS + max(0, ceil(25 * log10(max(n, 1) / 1e5)))


@lru_cache(8)
def code(dims: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation to an even number of dimensions, and the unit codewords of both halves."""
    rng = np.random.default_rng([SEED, dims, words])
    half = (dims + 1) // 2
    rotation = np.linalg.qr(rng.standard_normal((2 * half, 2 * half)))[0][:dims]
    halves = rng.standard_normal((2, words, half))
    halves /= np.linalg.norm(halves, axis=2, keepdims=True)
    return rotation, halves[0], halves[1]


def decoded(x: np.ndarray, words: int, caps: int = CAPS) -> np.ndarray:
    """The ``caps`` best directions of every unit vector, as sorted numbers below words**2."""
    rotation, one, two = code(x.shape[1], words)
    y = x @ rotation
    half = y.shape[1] // 2
    best = min(caps, words)
    out = np.empty((len(x), min(caps, best * best)), np.int64)
    for i in range(0, len(x), 512):
        a, b = y[i : i + 512, :half] @ one.T, y[i : i + 512, half:] @ two.T
        # The best sums use only the best codewords of either half.
        top_a, top_b = (np.argpartition(-s, best - 1, axis=1)[:, :best] for s in (a, b))
        rows = np.arange(len(a))[:, None]
        sums = (a[rows, top_a][:, :, None] + b[rows, top_b][:, None, :]).reshape(len(a), -1)
        top = np.argpartition(-sums, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[i : i + 512] = np.sort(top_a[rows, top // best] * words + top_b[rows, top % best], axis=1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of equal length, in double precision and of length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _filters(words: int, caps: int, kind: type = np.int64):
    def run(batches):
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = b.take(pa.array(np.flatnonzero(sizes == size)))
                found = decoded(_matrix(part.column(1)), words, caps)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel(), pa.from_numpy_dtype(kind)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "caps"])

    return run


def _verify(least: float, block: list[str]):
    """Links of each block: how many links each vector has, and a spanning forest."""

    def run(batches):
        for t in runs(batches, block):
            x = _matrix(t.column("embedding").combine_chunks())
            node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
            own = t.column("_own").to_numpy()
            cosine = x @ x.T
            linked = cosine >= least
            np.fill_diagonal(linked, False)
            across = t.column("_i")[0] != t.column("_j")[0]
            linked &= own[:, None] != own[None, :] if across else own[:, None] == own[None, :]
            if not linked.any():
                continue
            root = roots(linked)
            at = np.flatnonzero(root != np.arange(len(node)))
            yield _links(node[at], node[root[at]], np.zeros(len(at), np.int64))
            # A pair counts in the first list that both are in.
            here = t.column("cap")[0].as_py()
            lists = t.column("caps").combine_chunks()
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy())
            prior = flat < here
            if prior.any():
                _, place = np.unique(flat[prior], return_inverse=True)
                held = np.zeros((len(node), int(place.max()) + 1), np.float32)
                held[row[prior], place] = 1
                linked &= held @ held.T == 0
            n = linked @ copies
            at = np.flatnonzero(n)
            yield _links(node[at], node[at], n[at])

    return run


def _links(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n.astype(np.int64))], ["u", "v", "n"])


def near_duplicates(vectors: DataFrame, least: float = 0.93, caps: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. ``caps`` filters per vector, by default ``caps_for``."""
    sound = (
        F.col("label").isNotNull()
        & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    named = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding",
        F.when(sound, F.xxhash64("label", "embedding")).alias("node"),
    )
    rows = named.select("vec_id", "node")
    nodes = cut(
        named.where("node IS NOT NULL").groupBy("label", "embedding", "node")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id")),
        "vectors",
    )
    n = nodes.count()
    words = codewords(n)
    # Numbers of directions outgrow 32 bits beyond half a thousand million vectors.
    kind, sql = (np.int32, "int") if words * words < 2**31 else (np.int64, "long")
    found_caps = _filters(words, caps_for(n) if caps is None else caps, kind)
    listed = cut(nodes.select("node", "embedding").mapInArrow(found_caps, f"node long, caps array<{sql}>"), "caps")
    # Vectors meet by numbers first; only those in a list with others are sent with their components.
    members = nodes.join(listed, "node").select("label", "node", "embedding", "copies", "caps", F.explode("caps").alias("cap"))
    members = members.withColumn("_size", F.size("embedding"))
    keys = ["label", "_size", "cap"]
    found = cut(
        dealt(members, keys, "node", 512).mapInArrow(_verify(least, [*keys, "_i", "_j"]), "u long, v long, n long"), "found"
    )
    counts = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    of = cut(components(found.where("n = 0")), "groups")
    joined = nodes.join(of, "node", "left").join(counts, "node", "left").select(
        "node", "copies", "first_id", F.coalesce("root", "node").alias("root"), F.coalesce("others", F.lit(0)).alias("others")
    )
    joined = cut(joined, "joined")
    named_by = cut(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    final = joined.join(named_by, "root").select("node", (F.col("others") + F.col("copies") - 1).alias("n_links"), "component_id")
    final = cut(final, "final")
    return rows.join(final, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
