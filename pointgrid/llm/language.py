"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams (n = 1, 2, 3) of every learned document per language: each task adds
up a table of counts, Spark adds the tables. The matrix of smoothed log-probabilities, languages times
BUCKETS, is broadcast; its size does not depend on the corpus, and more than MOST_LANGUAGES languages are
refused. A batch is scored in numpy: the rows of the matrix at the hashes of all n-grams are added up per
document.

Defined results: texts are lower-cased and used whole; a null text or one without any letter is ``und``
with score 0. The score is the probability of the predicted language among the learned ones; of equally
probable languages the first by name wins. Without any document to learn from every text is ``und``.
Rows that repeat a doc_id are predicted one by one, a null doc_id counts as held out. Columns other than
doc_id, text and lang are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrid.llm.arrow_text import slices, utf8

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MOST_LANGUAGES = 256
SMOOTHING = 0.5
UNKNOWN = "und"
SLICE = 1 << 20
RESULT = "doc_id long, lang_pred string, score double"


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts behind one another, and n + 1 offsets."""
    lowered = [t.lower() for t in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=at[1:])
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32), at


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram at every place that has one."""
    h = np.full(len(points) - n + 1, n, np.uint32)
    for k in range(n):
        h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def inside(at: np.ndarray, total: int, n: int) -> np.ndarray:
    """Document of the n-gram at every place, -1 where it would cross into the next document."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: max(0, total - n + 1)]
    cross = np.zeros(len(doc), bool)
    for k in range(1, n):
        edge = at[1:-1] - k
        cross[edge[(edge >= 0) & (edge < len(doc))]] = True
    # Texts shorter than n are crossed by what begins further before them.
    return np.where(cross | (np.arange(len(doc)) + n > at[doc + 1]), -1, doc)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (a row per bucket, and one of zeros) from text and lang of all given rows."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    languages = sorted(r[0] for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    number = {x: i for i, x in enumerate(languages)}

    def count(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            of = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            _, sizes = utf8(b.column(1))
            for a, z in slices(sizes, SLICE):
                points, at = characters(b.column(1)[a:z].to_pylist())
                for n in ORDERS:
                    if len(points) < n:
                        continue
                    doc = inside(at, len(points), n)
                    ok = doc >= 0
                    cell = of[a:z][doc[ok]] * BUCKETS + grams(points, n)[ok]
                    counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
        language, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(language.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[language, bucket])],
            ["language", "bucket", "n"],
        )

    counted = labelled.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    table[counted.column("bucket").to_numpy(), counted.column("language").to_numpy()] += counted.column("n").to_numpy()
    return languages, np.vstack([np.log(table / table.sum(axis=0)), np.zeros((1, len(languages)))]).astype(np.float32)


def scores(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of every text in every language by the matrix of ``train``, and whether it has a letter."""
    points, at = characters(texts)
    total = np.zeros((len(texts), table.shape[1]))
    has_letter = np.zeros(len(texts), bool)
    if not len(points):
        return total, has_letter
    some = np.flatnonzero(np.diff(at) > 0)
    has_letter[some] = np.add.reduceat(letters()[points], at[some]) > 0
    for n in ORDERS:
        if len(points) < n:
            continue
        doc = inside(at, len(points), n)
        gram = grams(points, n)
        gram[doc < 0] = BUCKETS
        rows = table[gram]
        # Sums in pieces of one document; places that cross documents hold zeros.
        start = some[at[some] < len(gram)]
        total[start] += np.add.reduceat(rows, at[start], axis=0, dtype=np.float64)
    return total, has_letter


def predicted(docs: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = np.array([*languages, UNKNOWN], object)

    def run(batches):
        for b in batches:
            _, sizes = utf8(b.column(1))
            for a, z in slices(sizes, SLICE):
                total, has_letter = scores([t or "" for t in b.column(1)[a:z].to_pylist()], shared.value)
                best, score = np.full(len(total), len(languages)), np.zeros(len(total))
                if languages:
                    share = np.exp(total - total.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    best = np.where(has_letter, share.argmax(axis=1), len(languages))
                    score = np.where(has_letter, share.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0)[a:z], pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "text").mapInArrow(run, RESULT)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    model = train(docs.where(~held_out()))
    return predicted(docs, *model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
