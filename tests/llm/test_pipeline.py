"""Every stage of the corpus pipeline on what the stage before it kept, against brute force."""

from collections import Counter

import pytest
from test_dedup import brute_components, brute_words
from test_near_copies import brute_links
from test_text import library  # noqa: F401

import __spark_entry__ as entry
import corpus_pipeline
from pointgrid.llm import bpe, mixing, quality
from pointgrid.stages import cut

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = [spark.read.parquet(f"{D}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut(stage(spark, docs[-1], D), "test"))
    return docs


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(kept):
    assert all(d.columns == kept[0].columns for d in kept[:-1])


def test_rejected_go(spark, kept):
    judged = quality.judged(kept[0], spark.read.parquet(f"{D}/labels.parquet")).where("predicted = 1")
    assert sorted(r.doc_id for r in judged.select("doc_id").collect()) == sorted(d for d, _ in texts(kept[1]))


def test_one_of_each_group_stays(kept):
    """Of every group linked by 5-word runs with a Jaccard similarity of 0.8 the smallest doc_id stays."""
    rows = texts(kept[1])
    links = [(rows[i][0], rows[j][0]) for i, j in brute_links([t for _, t in rows])]
    assert sorted(d for d, _ in texts(kept[2])) == sorted(set(brute_components(links, [d for d, _ in rows]).values()))


def test_repeats_are_cut(spark, kept):
    before = texts(kept[2])
    want = brute_words(spark, before, 20)
    after = dict(texts(kept[3]))
    assert sum(v[1] for v in want.values()) > 0
    for d, t in before:
        n, gone, _ = want[d, t]
        assert len(after[d].split()) == n - gone
        assert gone or after[d] == t
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())


def test_mix_follows_the_plan(kept):
    plan = {r.doc_id: r.copies for r in mixing.planned(kept[3]).collect()}
    assert Counter(d for d, _ in texts(kept[4])) == +Counter(plan)


def test_ids_are_the_library_s(kept, library):  # noqa: F811
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts(kept[4])}
    rows = kept[5].collect()
    assert len(rows) == kept[4].count()
    assert all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) and r.decodes for r in rows)


def test_run_is_the_stages(spark, kept):
    run = entry.queries()["pipeline"](spark, D)
    key = lambda df: Counter((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(run) == key(kept[5])
    assert bpe.IDS and corpus_pipeline.ORACLE_SQL is None
