"""Classifiers, tokens, mixing, preferences and fingerprints against brute force, round trips and held-out labels."""

import random
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from pointgrid.llm import bpe, language, mixing, preferences, quality, spotsigs
from pointgrid.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_matches_library(library):
    ours = bpe.ForcedBoundaryBpe(vocabulary())
    rng = random.Random(4)
    letters = " \t\n\r\x0b\x1c\x1f\x85\xa0 　'sdtaéß漢字12½²!?.<|🙂​́᠎﻿"
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 300, " " * 200, "-=" * 150, "漢" * 90]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids, repr(t)
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert ours.decode(ours.encode("é")[:1]) == library.decode(ours.encode("é")[:1], skip_special_tokens=False)


def test_bpe_forced_cuts():
    """No token of the vocabulary holds a pair of bytes that is cut."""
    ours = bpe.ForcedBoundaryBpe(vocabulary())
    assert 0 < ours.inside.sum() < 65536
    assert all(list(ours.fragments(t)) == [t] for t in ours.ids)


def test_bpe_memory_is_bounded_as_asked():
    """A worker that remembers few words gives the same ids and holds no more than asked."""
    few, many = bpe.ForcedBoundaryBpe(vocabulary(), 50, 80), bpe.ForcedBoundaryBpe(vocabulary())
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(30))
        assert few.encode(text) == many.encode(text)
        assert max(len(few.known), len(few.known_before), few.fragment.cache_info().currsize) <= 80
    assert bpe.FEW_REMEMBERED < bpe.REMEMBERED and bpe.FEW_FRAGMENTS < bpe.FRAGMENTS


def test_bpe_hard(hard, hard_rows, empty, library):
    path = vocabulary()
    rows = bpe.encode(hard, path).collect()
    want = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in hard_rows]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(hard, path), path).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((d, t or "") for d, t in hard_rows), key=str)
    assert bpe.round_trip_digests(hard, path).count() == len(hard_rows)
    assert all(r.decodes for r in bpe.encoded_corpus(hard, path).select("decodes").collect())
    assert bpe.round_trip_digests(empty, path).count() == 0


def test_language_hard(spark, hard, hard_rows, empty):
    rows = language.identified(hard).collect()
    assert len(rows) == len(hard_rows)
    assert all(0 <= r.score <= 1 for r in rows)
    blank = {d for d, t in hard_rows if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == blank
    assert language.identified(empty).count() == 0
    assert {r.lang_pred for r in language.identified(hard.selectExpr("doc_id", "text", "CAST(NULL AS string) lang")).collect()} == {"und"}


def test_language_counts(spark):
    """Trained log-probabilities equal counts made one by one."""
    rows = [(1, "ab c", "x"), (2, "", "x"), (3, "Ba", "y"), (4, None, "y"), (5, "q", "y")]
    names, table = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["x", "y"]
    for i, texts in enumerate((["ab c", ""], ["ba", "q"])):
        counts = np.full(language.BUCKETS, language.SMOOTHING)
        for t in texts:
            points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            for n in language.ORDERS:
                for k in range(len(points) - n + 1):
                    counts[language.grams(points[k : k + n], n)[0]] += 1
        assert np.allclose(table[:-1, i], np.log(counts / counts.sum()), atol=1e-5)
    total, letter = language.scores(["ab c", "", "q", "7"], table)
    assert list(letter) == [True, False, True, False]
    want = sum(table[language.grams(np.frombuffer("q".encode("utf-32-le"), np.uint32), 1)[0]])
    assert np.isclose(total[2].sum(), want) and not total[1].any()


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = entry.queries()["op7_naive_bayes"](spark, d).where("held_out").select("doc_id", "lang_pred")
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    assert rows.join(truth, "doc_id").selectExpr("avg(int(lang = lang_pred))").first()[0] > 0.98


def test_quality_gradient():
    """Slopes of the network equal differences."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 5, 300, 700)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    w = {k: v.astype(np.float64) for k, v in quality.start_weights().items()}
    windows, marks, first = quality.pieces(data, at)
    slope = np.array([0.3, -1.0, 0.5, 0.7])
    _, held = quality.forward(w, windows, marks.astype(np.float64), first, True)
    g = quality.backward(w, windows, first, held, slope)
    for k, at_ in (("bytes", (98, 2)), ("first", (7, 3)), ("first_0", (4,)), ("second", (5, 6)), ("second_0", (2,)), ("out", (30,)), ("out_0", (0,))):
        diff = []
        for e in (1e-5, -1e-5):
            v = w | {k: w[k].copy()}
            v[k][at_] += e
            diff.append(quality.forward(v, windows, marks.astype(np.float64), first) @ slope)
        assert np.isclose((diff[0] - diff[1]) / 2e-5, g[k][at_], rtol=1e-3, atol=1e-4), k


def test_quality_batches_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (0, 700, 5000, 1, 2600, 900)]
    labels, weight = np.array([0, 1, 1, 0, 1, 0]), rng.random(6)
    w = quality.start_weights()
    whole = quality.gradient(w, texts, labels, weight)
    monkeypatch.setattr(quality, "MOST_TEXT", 1500)
    parts = quality.gradient(w, texts, labels, weight)
    assert all(np.allclose(whole[k], parts[k], rtol=1e-3, atol=1e-5) for k in whole)


def test_quality_sample_of_whole_texts(spark, monkeypatch):
    """Whole texts up to the bound on all bytes, one per document, none over the bound on one text."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, kinds: seen.append(texts))
    monkeypatch.setattr(quality, "MOST_TEXT", 900)
    rows = [(i, f"{i} " + "x" * (30 * i)) for i in range(40)] + [(3, "three, longer than the other text of it" * 9), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality.train(docs, labels)
    short = {t.encode() for d, t in rows[:40] if len(t) <= 900}
    assert set(seen[0]) == short and len(seen[0]) == len(short)
    monkeypatch.setattr(quality, "MOST_BYTES", 5000)
    quality.train(docs, labels)
    assert set(seen[1]) < short and 4000 < sum(map(len, seen[1])) <= 5000


def test_quality_slices_agree():
    """A text scores the same alone and among others; a text longer than a chunk counts to its end."""
    w = quality.start_weights()
    texts = [b"", b"x", b"ab " * 400, b"ab " * 400 + b"!!! ### " * 20]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    together = quality.probabilities(w, data, at)
    alone = [quality.probabilities(w, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5) and together[2] != together[3]


def test_quality_hard(spark, hard, hard_rows, empty, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 5)
    labels = spark.createDataFrame([(d, i % 2, 0) for i, (d, _) in enumerate(hard_rows)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.judged(hard, labels).collect()
    assert len(rows) == len(hard_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.ACCEPT) for r in rows)
    kept = quality.accepted(hard, labels)
    assert kept.columns == hard.columns and kept.count() == sum(r.predicted for r in rows)
    assert {r.score for r in quality.judged(hard, labels.where("false")).collect()} == {1.0}
    assert quality.judged(empty, labels).count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    known = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = quality.judged(known, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality").toPandas()
    assert (rows[rows.quality == 1].predicted == 1).mean() > 0.98
    assert (rows[rows.quality == 0].predicted == 0).mean() > 0.85


def test_mixing_hard(spark, hard, hard_rows, empty):
    rows = mixing.planned(hard).collect()
    assert len(rows) == len(hard_rows)
    sizes = {r.doc_id: r.size for r in rows}
    assert sizes[103] == 0 and sizes[105] == 0 and sizes[106] == 2
    assert all(r.taken <= 3 * r.size and abs(r.copies - r.rate) < 1 for r in rows)
    out = mixing.emitted(hard)
    assert out.columns == hard.columns
    times = Counter()
    for r in rows:
        times[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == +times
    assert mixing.planned(empty).count() == 0 and mixing.emitted(empty).count() == 0


def test_mixing_keeps_clashing_columns(spark):
    kinds = "doc_id long, text string, source string, _source int, _rate string, _copies int, _copy int, _n int, rank int"
    rows = [(i, "w " * (i % 7), "ab"[i % 2], 1, "r", 2, 3, 4, 5) for i in range(40)]
    docs = spark.createDataFrame(rows, kinds)
    out = mixing.emitted(docs)
    assert out.columns == docs.columns
    plan = {r.doc_id: r.copies for r in mixing.planned(docs).collect()}
    assert Counter(map(tuple, out.collect())) == Counter({r: plan[r[0]] for r in rows if plan[r[0]]})


def test_mixing_targets(spark):
    rows = [("a", 10), ("b", 1), ("c", 1000), (None, 5), ("é", 0), ("Z", 400)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = ["Z", "a", "b", "c", "é", None]
    size = dict(rows)
    total, left = sum(size.values()), dict(zip(order, [1, 2, 3, 1, 2, 3], strict=True))
    want, rest = {}, sum(size.values())
    while True:
        over = [s for s in left if rest * left[s] / sum(left.values()) >= 3 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
        rest = total - sum(want.values())
        left = {s: v for s, v in left.items() if s not in want}
    want |= {s: rest * v / sum(left.values()) for s, v in left.items()}
    assert got == pytest.approx(want)


def test_preferences_hard(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "a"), (1, "rejected", 1, "assistant", "b"),
        (1, "chosen", 2, "user", "x"), (1, "rejected", 2, "user", "x"), (2, "chosen", None, None, None), (2, "rejected", None, None, None),
        (2, "chosen", 0, "user", "t"), (2, "chosen", 0, "user", "t"), (2, "rejected", 0, "user", "t"), (3, "chosen", 0, "assistant", ""),
        (4, "chosen", 5, "assistant", "same"), (4, "rejected", 5, "assistant", "same"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS part", "3 AS chosen")
    got = sorted(((r.pair_id, r.part, r.turn, r.role, r.text, r.n, r.in_loss) for r in preferences.formatted(df).collect()), key=str)
    want = [
        (1, "prompt", 0, "user", "hi", 1, False), (1, "chosen", 1, "assistant", "a", 1, True), (1, "rejected", 1, "assistant", "b", 1, True),
        (1, "chosen", 2, "user", "x", 1, False), (1, "rejected", 2, "user", "x", 1, False), (2, "prompt", None, "", "", 1, False),
        (2, "chosen", 0, "user", "t", 2, False), (2, "rejected", 0, "user", "t", 1, False), (3, "chosen", 0, "assistant", "", 1, True),
        (4, "prompt", 5, "assistant", "same", 1, False),
    ]
    assert got == sorted(want, key=str)
    whole = {r.pair_id: r for r in preferences.assembled(preferences.formatted(df)).collect()}
    assert whole[1].prompt == "<|user|>\nhi\n" and whole[1].chosen == "<|assistant|>\na\n<|user|>\nx\n"
    assert [whole[1].chosen[s.start : s.end] for s in whole[1].chosen_loss] == ["a\n"]
    assert whole[4].chosen == "" and whole[4].prompt == "<|assistant|>\nsame\n"
    assert preferences.formatted(df.where("false")).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preferences.formatted(preferences.with_swapped_replies(empty)).count() == 0


def test_spotsigs_hard(hard, hard_rows, empty):
    rows = spotsigs.beside_edited(hard).collect()
    assert len(rows) == len(hard_rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    order = sorted(((d is not None, d or 0, t or "") for d, t in hard_rows))
    import hashlib

    want = []
    for (has, d, t), (_, _, nxt) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((d if has else None, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == sorted(want, key=str)
    assert spotsigs.beside_edited(empty).count() == 0


def test_spotsigs_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = sorted({(r.fingerprint, tuple(r.signatures)) for r in spotsigs.fingerprints(docs).collect()})
    want = set()
    for i, (a, x) in enumerate(prints):
        for b, y in prints[i + 1 :]:
            both = len(set(x) & set(y))
            if both / (len(x) + len(y) - both) >= 0.6:
                want.add((a, b))
    assert want and {(r.a, r.b) for r in spotsigs.similar(docs, 0.6).collect()} == want


@pytest.mark.parametrize("key", ["op2_cap_filters", "op5_preferences", "op6_mixing", "op9_spotsigs"])
def test_matches_sql_at_next_scale(spark, key):
    d = "/root/testdata/sf0.01"
    assert compare(spark, connect(d), d, entry.queries()[key], entry.oracle_sql()[key]) is None
