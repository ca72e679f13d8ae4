"""Text quality by a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes. Each byte has a learned embedding; beside it stand marks of whether the byte
equals the one some places before, which show repetition. First filters look at pieces of WIDTH bytes every
STRIDE bytes; their outputs are averaged over chunks of CHUNK pieces that overlap by half and together cover
the whole text; second filters look at the chunks; the greatest and the mean output of each over all chunks
are combined into one probability. Texts are padded with zero bytes to a full chunk.

Learning takes a bounded sample of the labelled documents with their whole texts to the driver: by least hash
of doc_id, MOST_ROWS documents at most and as many of them as have MOST_BYTES bytes in all, none of them longer than
MOST_TEXT bytes. It takes STEPS steps of BATCH documents each, going through the sample again and again; a
batch is worked off in slices of at most MOST_TEXT bytes, whose gradients add up.
Scoring always uses whole texts, a slice of documents at a time; a text longer than a slice is scored in one piece,
in memory in proportion to it.

Defined results: a null text scores like an empty one; the score is a number for every text. Labels are those
of rows whose doc_id has one; of several labels of a doc_id the least counts, and of several texts of a doc_id the
shortest (the least of these) is learned. A null doc_id is held out. With no
labels, or labels of one kind only, every score is the share of label 1 (1 if there are none). Rows that repeat
a doc_id are scored one by one. Columns other than doc_id, text and quality are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointgrid.llm.arrow_text import slices, utf8
from pointgrid.llm.language import held_out
from pointgrid.stages import cut

EMBED, WIDTH, STRIDE, FIRST, CHUNK, SECOND = 6, 16, 8, 32, 24, 24
LAGS = np.arange(2, 22)
MOST_ROWS, MOST_BYTES, MOST_TEXT, STEPS, BATCH = 4000, 1 << 24, 1 << 18, 1500, 32
ACCEPT = 0.3
SLICE = 1 << 18
SEED = 5
RESULT = "doc_id long, score double"


def start_weights() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    into = WIDTH * EMBED + len(LAGS)
    draw = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
    return {
        "bytes": rng.standard_normal((256, EMBED)).astype(np.float32), "first": draw(into, FIRST), "first_0": np.zeros(FIRST, np.float32),
        "second": draw(FIRST, SECOND), "second_0": np.zeros(SECOND, np.float32), "out": draw(2 * SECOND, 1)[:, 0] * 0.3, "out_0": np.zeros(1, np.float32),
    }


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces, marks of repetition, and n + 1 offsets of the documents' half chunks.

    Every text is padded to whole half chunks (STRIDE * CHUNK / 2 bytes), two at least, with more zeros
    than the longest lag, so that no mark reaches into the text before.
    """
    half = STRIDE * CHUNK // 2
    halves = np.maximum(2, -(-(np.diff(at) + LAGS[-1]) // half))
    first = np.r_[0, np.cumsum(halves)]
    padded = np.zeros(first[-1] * half + WIDTH, np.uint8)
    target = np.arange(len(data)) + np.repeat(first[:-1] * half - at[:-1], np.diff(at))
    padded[target] = data
    windows = np.lib.stride_tricks.as_strided(padded, (first[-1] * half // STRIDE, WIDTH), (STRIDE, 1)).copy()
    # The last piece of a text sees nothing of the next one.
    last = first[1:] * (CHUNK // 2) - 1
    windows[last, STRIDE:] = 0
    marks = np.empty((len(windows), len(LAGS)), np.float32)
    for i, lag in enumerate(LAGS):
        same = np.zeros(len(padded), np.uint8)
        same[lag:] = (padded[lag:] == padded[:-lag]) & (padded[lag:] != 0)
        by = same[: len(windows) * STRIDE].reshape(-1, STRIDE).sum(axis=1, dtype=np.uint8)
        marks[:, i] = by
        by[first[:-1] * (CHUNK // 2)] = 0
        marks[:-1, i] += by[1:]
    return windows, marks / WIDTH - 0.15, first


def forward(w: dict[str, np.ndarray], windows: np.ndarray, marks: np.ndarray, first: np.ndarray, keep: bool = False):
    """Log-odds of every document, and what learning needs."""
    x = np.concatenate([w["bytes"][windows].reshape(len(windows), -1), marks], axis=1)
    one = np.maximum(x @ w["first"] + w["first_0"], 0)
    half = one.reshape(-1, CHUNK // 2, FIRST).mean(axis=1)
    # A chunk is two neighbouring halves of one document.
    begins = np.ones(len(half), bool)
    begins[first[1:] - 1] = False
    left = np.flatnonzero(begins)
    chunk = (half[left] + half[left + 1]) / 2
    two = np.maximum(chunk @ w["second"] + w["second_0"], 0)
    own = np.r_[0, np.cumsum(np.diff(first) - 1)]
    top, mean = np.maximum.reduceat(two, own[:-1]), np.add.reduceat(two, own[:-1]) / np.diff(own)[:, None]
    odds = np.concatenate([top, mean], axis=1) @ w["out"] + w["out_0"]
    return (odds, (x, one, left, chunk, two, own, top, mean)) if keep else odds


def backward(w: dict[str, np.ndarray], windows: np.ndarray, first: np.ndarray, held: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the loss; ``slope`` is its derivative by the log-odds."""
    x, one, left, chunk, two, own, top, mean = held
    doc = np.repeat(np.arange(len(slope)), np.diff(own))
    g = {"out": np.concatenate([top, mean], axis=1).T @ slope, "out_0": slope.sum(keepdims=True)}
    d_top, d_mean = slope[:, None] * w["out"][:SECOND], slope[:, None] * w["out"][SECOND:]
    d_two = (d_mean / np.diff(own)[:, None])[doc]
    d_two += np.where(two == top[doc], d_top[doc], 0)
    d_two *= two > 0
    g["second"], g["second_0"] = chunk.T @ d_two, d_two.sum(axis=0)
    d_chunk = d_two @ w["second"].T / 2
    d_half = np.zeros((first[-1], FIRST), np.float32)
    d_half[left] += d_chunk
    d_half[left + 1] += d_chunk
    d_one = np.repeat(d_half / (CHUNK // 2), CHUNK // 2, axis=0) * (one > 0)
    g["first"], g["first_0"] = x.T @ d_one, d_one.sum(axis=0)
    d_x = (d_one @ w["first"][: WIDTH * EMBED].T).reshape(-1, EMBED)
    flat = windows.reshape(-1)
    g["bytes"] = np.stack([np.bincount(flat, weights=d_x[:, e], minlength=256) for e in range(EMBED)], axis=1)
    return g


def gradient(w: dict[str, np.ndarray], texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted loss over whole texts, a slice of them at a time."""
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    total = {}
    for a, z in slices(at, MOST_TEXT):
        data = np.frombuffer(b"".join(texts[a:z]), np.uint8)
        windows, marks, first = pieces(data, at[a : z + 1] - at[a])
        odds, held = forward(w, windows, marks, first, True)
        slope = ((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[a:z]) * weight[a:z]).astype(np.float32)
        for k, v in backward(w, windows, first, held, slope).items():
            total[k] = total[k] + v if k in total else v
    return total


def fit(texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Adam over small batches; both labels weigh the same in the loss."""
    w = start_weights()
    rng = np.random.default_rng(SEED)
    slow, fast = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    weight = 0.5 / share[labels]
    step = 0
    while step < STEPS:
        order = rng.permutation(len(texts))
        for i in range(0, len(texts), BATCH):
            some = order[i : i + BATCH]
            g = gradient(w, [texts[j] for j in some], labels[some], weight[some] / len(some))
            step += 1
            rate = 4e-3 * min(1, step / 50) * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * min(1, step / STEPS))))
            for k in w:
                d = g[k].astype(np.float32) + 1e-5 * w[k]
                slow[k] = 0.9 * slow[k] + 0.1 * d
                fast[k] = 0.999 * fast[k] + 0.001 * d * d
                w[k] = w[k] - (rate * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | float:
    """Weights from the labelled documents given, or the share of label 1 where there is nothing to tell apart."""
    of = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_size", F.octet_length("text")).where(F.col("_size") <= MOST_TEXT)
    # The window sees MOST_ROWS rows at most, without their texts.
    sizes = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("_size").alias("_size"))
    sum_to = F.sum("_size").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))
    fits = cut(sizes.withColumn("_sum", sum_to).where(F.col("_sum") <= MOST_BYTES).drop("_sum"), "sample")
    sample = (
        own.join(F.broadcast(fits), ["doc_id", "_size"]).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
        .orderBy("doc_id").toArrow()
    )
    kinds = sample.column("quality").to_numpy().astype(np.int64)
    if not len(kinds) or kinds.min() == kinds.max():
        return float(kinds.mean()) if len(kinds) else 1.0
    return fit([t.encode() for t in sample.column("text").to_pylist()], kinds)


def probabilities(w: dict[str, np.ndarray] | float, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    if isinstance(w, float):
        return np.full(len(at) - 1, w)
    return 1 / (1 + np.exp(-np.clip(forward(w, *pieces(data, at)).astype(np.float64), -30, 30)))


def scored(docs: DataFrame, w: dict[str, np.ndarray] | float) -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            for a, z in slices(at, SLICE):
                score = probabilities(shared.value, data[at[a] : at[z]], at[a : z + 1] - at[a])
                yield pa.RecordBatch.from_arrays([b.column(0)[a:z], pa.array(score)], ["doc_id", "score"])

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "text").mapInArrow(run, RESULT)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the labels of documents that are not held out."""
    w = train(docs, labels.where(~held_out()))
    return scored(docs, w).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The documents, with all their columns, whose score is ``least`` or more."""
    w = train(docs, labels.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            for a, z in slices(at, SLICE):
                score = probabilities(shared.value, data[at[a] : at[z]], at[a : z + 1] - at[a])
                yield b[a:z].filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
