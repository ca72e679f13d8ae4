"""Dedup operators against brute force."""

import hashlib
import random

import numpy as np
import pytest

from pointgrid.llm import cap_filters, components, recompression, simhash, suffix_dedup, windows

W_WORDS, W_BYTES = 8, 60


def identities(rows):
    """Distinct documents: doc_id and text, a null text being empty."""
    return {(d, t or "") for d, t in rows}


def brute_words(spark, rows, width):
    """Words removed by (doc_id, text), with the order that the operator states."""
    docs = list(identities(rows))
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in docs], "t string").distinct().selectExpr("t", "xxhash64(t) h").collect()}
    docs.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    seen, out = set(), {}
    for d, t in docs:
        words = t.encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d, t] = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, width):
    docs = [(d, t, t.encode()) for d, t in identities(rows)]
    seen = {}
    for _, _, b in docs:
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out = {}
    for d, t, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def expected(rows, found):
    return sorted(((d, *found[d, t or ""]) for d, t in rows), key=str)


def test_words_hard(spark, hard, hard_rows, empty):
    got = sorted((tuple(r) for r in recompression.digests(hard, W_WORDS).collect()), key=str)
    assert got == expected(hard_rows, brute_words(spark, hard_rows, W_WORDS))
    assert recompression.digests(empty, W_WORDS).count() == 0


def test_words_cleaned_keeps_columns(spark, hard, hard_rows):
    found = brute_words(spark, hard_rows, W_WORDS)
    got = recompression.cleaned(hard, W_WORDS)
    assert got.columns == hard.columns
    for r in got.collect():
        if r.text is not None and hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() in {v[2] for v in found.values()}:
            continue
        assert r.text in (None, "", " \t\n ")


def test_bytes_hard(hard, hard_rows, empty):
    got = sorted((tuple(r) for r in suffix_dedup.digests(hard, W_BYTES).collect()), key=str)
    assert got == expected(hard_rows, brute_bytes(hard_rows, W_BYTES))
    assert suffix_dedup.digests(empty, W_BYTES).count() == 0


def test_bytes_spans(hard, hard_rows):
    found = brute_bytes(hard_rows, W_BYTES)
    got = [
        (r.doc_id, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in suffix_dedup.cleaned(hard, W_BYTES).collect()
    ]
    assert sorted(got, key=str) == sorted(((d, *found[d, t or ""][1:]) for d, t in hard_rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for d in range(50):
        if rows and rng.random() < 0.3:
            t = rng.choice(rows)[1]
            a = rng.randint(0, len(t))
            t = t[a : a + rng.randint(0, 200)] + rng.choice(rows)[1][: rng.randint(0, 80)]
        else:
            t = "".join(rng.choice("abcde"[: rng.choice([1, 2, 5])] + " ") for _ in range(rng.randint(0, 150)))
        rows.append((d * 3 - 5, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in recompression.digests(docs, 4).collect()), key=str)
    assert got == expected(rows, brute_words(spark, rows, 4))
    got = sorted((tuple(r) for r in suffix_dedup.digests(docs, 12).collect()), key=str)
    assert got == expected(rows, brute_bytes(rows, 12))


def test_recompression_rounds_agree(spark, hard, hard_rows, monkeypatch):
    """More rounds give other spots and the same result."""
    want = sorted((tuple(r) for r in recompression.digests(hard, W_WORDS).collect()), key=str)
    monkeypatch.setattr(recompression.spots, "__defaults__", (3,))
    assert sorted((tuple(r) for r in recompression.digests(hard, W_WORDS).collect()), key=str) == want


def test_suffix_order():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    end = np.where(np.arange(400) < 150, 150, 400)
    for width in (1, 3, 20):
        order, rank = suffix_dedup.suffix_order(data, end, width)
        piece = [bytes(data[i : min(i + width, end[i])]) for i in range(400)]
        assert list(order) == sorted(range(400), key=lambda i: (piece[i], i))
        assert all((rank[i] == rank[j]) == (piece[i] == piece[j]) for i in range(0, 400, 7) for j in range(400))


def brute_components(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            m = min(label[u], label[v])
            changed |= label[u] != m or label[v] != m
            label[u] = label[v] = m
    return label


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    want = brute_components(links, {n for pair in links for n in pair})
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    assert {r.node: r.root for r in components.components(df).collect()} == want
    assert components.components(df.where("false")).count() == 0


def test_positions_cover():
    sets = simhash.position_sets()
    assert len(sets) == 20
    assert all(any(set(s) <= set(four) for s in sets) for four in simhash.combinations(range(8), 4))


def slow_fingerprint(spark, text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 4]).decode() for i in range(max(1, len(words) - 3))] if words else []
    if not shingles:
        return 0
    h = [r[0] % 2**64 for r in spark.createDataFrame([(s,) for s in shingles], "s string").selectExpr("xxhash64(s)").collect()]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_hard(spark, hard, hard_rows, empty):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == len(hard_rows)
    texts = {t or "" for _, t in hard_rows}
    prints = {t: simhash.fingerprint(t) for t in texts}
    short = [t for t in texts if len(t) < 1000]
    assert all(prints[t] == slow_fingerprint(spark, t) for t in short)
    values = set(prints.values())
    links = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    of = brute_components(links, values)
    least = {}
    for d, t in hard_rows:
        if d is not None:
            root = of[prints[t or ""]]
            least[root] = min(least.get(root, d), d)
    want = sorted(((d, prints[t or ""], least.get(of[prints[t or ""]])) for d, t in hard_rows), key=str)
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in rows), key=str) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(hard)
    assert kept.columns == hard.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted((least.get(r) for r in set(of.values())), key=str)
    assert simhash.one_of_each(empty).count() == 0


def vectors_brute(rows, least=0.93):
    ok = [r for r in rows if r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    links = {}
    label = {r[3]: r[0] for r in rows}
    pairs = []
    for a in ok:
        for b in ok:
            if a[3] < b[3] and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], np.float64), np.array(b[2], np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    pairs.append((a[3], b[3]))
                    for i in (a[3], b[3]):
                        links[i] = links.get(i, 0) + 1
    changed = True
    while changed:
        changed = False
        for u, v in pairs:
            m = min(label[u], label[v])
            changed |= label[u] != m or label[v] != m
            label[u] = label[v] = m
    return sorted((r[0], links.get(r[3], 0), label[r[3]], r[0] == label[r[3]]) for r in rows)


@pytest.mark.parametrize("dims", [1, 5, 64])
def test_vectors(spark, dims):
    rng = np.random.default_rng(dims)
    rows = []
    for i in range(160):
        if i % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][2])
            v = base + rng.standard_normal(dims) * 0.05 * np.linalg.norm(base) / np.sqrt(dims)
        else:
            v = rng.standard_normal(dims)
        rows.append((i, int(i % 2), [float(np.float32(x)) for x in v]))
    rows += [(200 + i, 1, rows[4][2]) for i in range(5)] + [(300, None, rows[4][2]), (301, 1, None), (302, 1, [0.0] * dims), (303, 1, [float("nan")] * dims), (304, 1, [None] * dims), (305, 1, []), (306, 1, [1.0] * (dims + 1))]
    numbered = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS node", "2 AS copies", "3 AS cap").repartition(3)
    got = sorted(tuple(r) for r in cap_filters.near_duplicates(df).collect())
    assert got == vectors_brute(numbered)
    assert cap_filters.near_duplicates(df.where("false")).count() == 0


def test_hot_vectors_are_split(spark, monkeypatch):
    """Blocks smaller than the group give the same links."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    rows = [(i, 1, [float(np.float32(x)) for x in base + rng.standard_normal(16) * 0.12]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    real = cap_filters.dealt
    monkeypatch.setattr(cap_filters, "dealt", lambda m, k, c, size: real(m, k, c, 20))
    assert sorted(tuple(r) for r in cap_filters.near_duplicates(df).collect()) == vectors_brute([(*r, i) for i, r in enumerate(rows)])


@pytest.mark.parametrize("n", [10**4, 10**6, 10**7, 10**8])
def test_cap_recall(n):
    """Pairs at the threshold share a filter nearly always, with the code of any number of vectors."""
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((2000, 64)))
    z = rng.standard_normal((2000, 64))
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    a, b = (cap_filters.decoded(v, cap_filters.codewords(n), cap_filters.caps_for(n)) for v in (x, 0.93 * x + np.sqrt(1 - 0.93**2) * z))
    missed = sum(not set(p) & set(q) for p, q in zip(a.tolist(), b.tolist(), strict=True))
    assert missed <= 4


def test_vectors_without_or_with_repeated_ids(spark):
    """A null vec_id names no component that has another; rows that repeat a vec_id are vectors of their own."""
    one, other = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(None, 1, one), (4, 1, one), (4, 1, one), (7, 1, [1.0, 0.01, 0.0, 0.0]), (None, 1, other), (4, 2, other)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted((tuple(r) for r in cap_filters.near_duplicates(df).collect()), key=str)
    want = [(None, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (7, 3, 4, False), (None, 0, None, True), (4, 0, 4, True)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("flush", [1, 500_000])
def test_tasks_of_short_texts(spark, hard_rows, monkeypatch, flush):
    """A task that holds only texts shorter than a window sends nothing and loses no row."""
    monkeypatch.setattr(windows, "FLUSH", flush)
    short = [(1000 + i, t) for i, t in enumerate(["one two", "", None, "a b c", "one two", " \n "] * 4)]
    plain = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    for docs, rows in ((plain(short).coalesce(1), short), (plain(short).coalesce(1).union(plain(hard_rows).repartition(2)), short + hard_rows)):
        got = sorted((tuple(r) for r in recompression.digests(docs, W_WORDS).collect()), key=str)
        assert got == expected(rows, brute_words(spark, rows, W_WORDS))
        got = sorted((tuple(r) for r in suffix_dedup.digests(docs, W_BYTES).collect()), key=str)
        assert got == expected(rows, brute_bytes(rows, W_BYTES))
        kept = recompression.cleaned(docs, W_WORDS)
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows), key=str)
