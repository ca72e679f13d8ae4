"""The Merkle manifest against a recursive build."""

import hashlib
import random
import zlib

import pytest

from pointgrid.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    n_chars = None if row[3] is None else row[3] + more
    values = [row[0], row[1], row[2], n_chars, row[4]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    """Root and, for each leaf, its steps (left, sibling)."""
    steps = [[] for _ in hashes]
    level = [(x, [i]) for i, x in enumerate(hashes)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), 2):
            pair = level[k : k + 2]
            for j, (_, under) in enumerate(pair):
                for i in under:
                    steps[i].append((j == 1, pair[1 - j][0]) if len(pair) == 2 else (False, None))
            above.append((h(*(x for x, _ in pair)), [i for _, u in pair for i in u]))
        level = above
    return level[0][0], steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {g: tree([leaf(r) for r in groups[g]]) for g in order if groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) is None}
    root, over = tree([found[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for r, own in zip(groups[g], found[g][1], strict=True):
            path = own + over[k]
            acc = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for left, sibling in path:
                acc = h(sibling, acc) if left else h(acc, sibling or "")
            out.append((r[0], leaf(r), found[g][0], root, h(*(s for _, s in path if s)), acc, acc == root))
    return sorted(out, key=str)


KINDS = "doc_id long, source string, lang string, n_chars long, text string, tree string, lo int, hash int, level int, path string, tampered string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, "p", "x") for r in rows], KINDS).repartition(3)


@pytest.mark.parametrize("band", [1, 3, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_against_brute(spark, monkeypatch, band, n):
    if band != 8 and n in (1, 2):
        return
    monkeypatch.setattr(manifest, "BAND", band)
    rng = random.Random(n)
    rows = [(rng.choice([None, rng.randint(-20, 400)]) if rng.random() < 0.1 else i, rng.choice([None, "", "s1"]), rng.choice([None, "", "en", "en", "en", "en", "é", "-", "="]), rng.choice([None, 0, 2**63 - 1, i]), rng.choice([None, "", "é" * 5, f"text {i}"])) for i in range(n)]
    rows += rows[:5]
    got = sorted((tuple(r) for r in manifest.verified(frame(spark, rows)).collect()), key=str)
    assert got == (brute(rows) if rows else [])


def test_hard(spark, hard, hard_rows):
    rows = [tuple(r) for r in hard.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in manifest.verified(hard).collect()), key=str) == brute(rows)


def test_every_change_is_seen(spark):
    """Exactly the tampered rows fail, and a lone leaf is its own root."""
    rows = [(i, "s", "en", i, "t") for i in range(100)]
    got = {r.doc_id: r.verified for r in manifest.verified(frame(spark, rows)).collect()}
    assert {d for d, ok in got.items() if not ok} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0}
    one = manifest.verified(frame(spark, rows[1:2])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h("")


def test_intervals(spark):
    """Every node covers what its children cover, and no block has more children than a band allows."""
    m = manifest.manifest(frame(spark, [(i, "s", "en" if i % 3 else None, i, "t") for i in range(700)]))
    nodes = [tuple(r) for r in m.nodes.select("tree", "level", "lo", "hi", "n").collect()]
    at = {x[:3]: x[3] for x in nodes}
    for t, level, lo, hi, n in nodes:
        assert hi == min(lo + 2**level, n)
        if level:
            half = lo + 2 ** (level - 1)
            assert at[t, level - 1, lo] == min(half, n) and (half >= n or at[t, level - 1, half] == hi)
