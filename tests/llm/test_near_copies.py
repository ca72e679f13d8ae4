"""Near copies of the corpus pipeline against all pairs."""

import random

import pytest
from conftest import prose
from test_dedup import brute_components

import corpus_pipeline
from pointgrid.llm import near_copies, simhash


def brute_sets(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return sets


def brute_links(texts):
    sets = brute_sets(texts)
    same = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return [(i, j) for j in range(len(sets)) for i in range(j) if same(sets[i], sets[j])]


def stays(spark, docs):
    return sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect())


def check(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(set(brute_components(brute_links(texts), range(len(texts))).values()))
    assert stays(spark, docs) == want


def edited(rng, text, times):
    words = text.split()
    for at in rng.sample(range(len(words)), times):
        words[at] = "edit" + str(rng.random())
    return " ".join(words)


def test_edited_copies_go(spark):
    """Copies that differ in more than 4 bits of a SimHash but are near, and others that are not near."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (60, 120, 200, 400, 900)]
    texts = base + [edited(rng, t, max(1, len(t.split()) * k // 100)) for t in base for k in (1, 2, 4, 9)]
    texts += [None, "", " ", "one two", "One  two", "one three"]
    far = [(i, j) for i, j in brute_links(texts) if (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 4]
    assert far
    check(spark, texts)


def test_hot_group(spark):
    """One large group whose members are near a few others only, and all of one list."""
    rng = random.Random(6)
    base = prose(rng, 300)
    texts = [base]
    for i in range(150):
        texts.append(edited(rng, texts[rng.randrange(len(texts))], rng.choice([1, 3, 6])))
    check(spark, texts)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    links = [(rows[i].doc_id, rows[j].doc_id) for i, j in brute_links([r.text for r in rows])]
    assert stays(spark, docs) == sorted(set(brute_components(links, [r.doc_id for r in rows]).values()))


def test_empty(hard, empty):
    assert near_copies.one_of_each(empty).count() == 0
    assert near_copies.one_of_each(hard).columns == hard.columns


@pytest.mark.parametrize("size", [20, 1 << 19])
def test_group_of_texts_half_alike(spark, monkeypatch, size):
    """Many texts that share lists but are mostly not near: no pair is written, every link is found, in blocks of any weight."""
    monkeypatch.setattr(near_copies, "SHINGLES", size * 200)
    rng = random.Random(9)
    base = prose(rng, 260)
    texts = [base] + [edited(rng, base, rng.choice([5, 9, 12])) for _ in range(120)]
    check(spark, texts + [prose(rng, 30) for _ in range(20)] + texts[:3])


def test_forest_and_filter(spark):
    """A block names fewer pairs than it has rows; the bitmap holds every wanted key."""
    rng = random.Random(4)
    base = prose(rng, 200)
    docs = spark.createDataFrame([(i, edited(rng, base, 6)) for i in range(60)], "doc_id long, text string")
    prints = near_copies.marked(docs).selectExpr("node", "key", "size", "print", "node AS root")
    members = near_copies.listed(prints.select("node", "print")).join(prints, "node")
    forest = near_copies.candidates(members, best=False)
    rows = {(r.place, r.bytes): r["count"] for r in members.groupBy("place", "bytes").count().collect()}
    assert 0 < forest.count() <= sum(rows.values()) - len(rows)
    keep = near_copies.only_near(prints.where("pmod(key, 2) = 0"))
    texts = docs.selectExpr("xxhash64(text) AS key", "text")
    kept = {r.key for r in texts.mapInArrow(keep, "key long, text string").collect()}
    assert kept == {r.key for r in prints.collect() if r.key % 2 == 0}
    assert near_copies.only_near(prints.where("false")) is not None
