"""Token alignment against a plain double walk over both token sequences."""

import hashlib
from collections import Counter

import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pointgrid.llm import alignment
from pointgrid.llm.bpe import byte_letters

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> is <s>plain</s> <0x41>", "a▁b", "▁", "café 中文 \U0001f600\U0001f600", " two  spaces ", "\n", "\x00 nul", "é combining", "<unk>", "line\r\nend\t"]


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = {c: x for x, c in enumerate(byte_letters())}

    def tokens(text):
        """(id, bytes) of both sides, or nothing where a side's bytes differ."""
        if not text:
            return [], []
        left = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])

    return tokens


def ranges(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(sides, rows):
    """What the query returns, by comparing ends of ranges."""
    found = []
    for d, t in rows:
        a, b = map(ranges, sides(t))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        links = [(i, j) for i, _, e in a for j, _, f in b if e == f] if len(a) < 300 else [(i, dict((f, j) for j, _, f in b)[e]) for i, _, e in a if e in set(ends)]
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, _, f in a if low < f <= e) + "|" + ",".join(str(j) for j, _, f in b if low < f <= e))
            low = e
        found.append((d, len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(x for *_, links, _ in found for x in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((d, n, m, g, len(x), sum(count[i, j] == best[j] for i, j in x), sum(count[y] for y in x), sha) for d, n, m, g, x, sha in found), key=str), count, best


@pytest.fixture(scope="module")
def rows(hard_rows):
    short = [(d, t if t is None or len(t) < 4000 else t[:4000]) for d, t in hard_rows]
    return short + [(500 + i, t) for i, t in enumerate(ODD)]


def test_digests(spark, sides, rows, hard):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, code int, n string").repartition(3)
    want, _, _ = brute(sides, rows)
    assert sorted((tuple(r) for r in alignment.digests(docs, A, B).collect()), key=str) == want
    assert sum(r[1] == 0 for r in want) >= 5
    assert alignment.digests(docs.where("false"), A, B).count() == 0


def test_long_texts(hard, hard_rows):
    """Whole texts are aligned: the last group ends with the last byte."""
    rows = alignment.groups(hard, A, B).collect()
    assert sorted((r.doc_id, r.groups[-1].byte_end if r.groups else 0) for r in rows if r.doc_id) == sorted((d, len((" " + t).encode()) if t else 0) for d, t in hard_rows if d)
    assert all(not r.groups or (r.groups[-1].a_end, r.groups[-1].b_end) == (len(r.a), len(r.b)) for r in rows)


def test_groups_and_overlaps(spark, sides, rows):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(2)
    got = {}
    for r in alignment.overlaps(docs, A, B).collect():
        got.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    for r in alignment.groups(docs, A, B).collect():
        a, b = map(ranges, sides(rows[r.doc_id][1]))
        assert r.a == [x[0] for x in a] and r.b == [x[0] for x in b]
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        assert [g.byte_end for g in r.groups] == ends
        assert all(a[g.a_end - 1][2] == b[g.b_end - 1][2] == g.byte_end for g in r.groups)
        want = {(i, j, x[0], y[0], max(x[1], y[1]), min(x[2], y[2]), x[2] == y[2]) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]} if len(a) < 500 else None
        assert want is None or got.get(r.doc_id, set()) == want


def test_id_pairs(spark, sides, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, count, best = brute(sides, rows)
    got = {(r.a_id, r.b_id): (r.n, r.best) for r in alignment.id_pairs(docs, A, B).collect()}
    assert got == {p: (n, n == best[p[1]]) for p, n in count.items()}


def test_small_slices(spark, sides, rows, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in alignment.digests(docs, A, B).collect()), key=str) == brute(sides, rows)[0]


def test_ids_are_the_library_s():
    """Merging by rank gives the ids of the tokenizer file, around every assigned plane-0 letter block."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}2  {chr(c)}{chr(c)}\n{chr(c)}!" for c in range(1, 0x3000, 7) if not 0xD800 <= c < 0xE000] + ODD
    tok = alignment.tokenizers(A, B)
    assert [tok._a.encode_ordinary(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
