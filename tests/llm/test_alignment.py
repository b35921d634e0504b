"""Alignment of two tokenizers against a plain version that encodes whole texts and compares all tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marginalia.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a", "  lead", "trail  ", "trail\n", "a  b", "a\n\n b", "a \n b", "a\n b", "\nx\ny", "tab\tx y\t z", "a b c", "x y z", "a▁b c", "<|endoftext|> <s> </s> <0x0A>", "it's we'll DON'T 12345 ...!!",
    "\x00a \x1c b\x1f c", "́ é é", "日本語 テキスト 😀 👩‍👩‍👧", "a\r\nb\r\n", "﻿x", "of the of the of the", "z" * 3000, " ".join(["thhaedre"] * 500), "a\n" * 300, "\t", "　x　", "x   y", "'s 's", "a 's",
]


def plain(texts):
    """Rows as align() gives them, by encoding whole texts and looking at every pair of tokens."""
    a_of, b_of = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printing)}
    docs, counts = [], Counter()
    for t in texts:
        want = (" " + t).encode() if t else b""
        a = a_of.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_of.encode(t) if t else []
        ab = [bytes(letter[c] for c in a_of.id_to_token(i)) for i in a]
        bb = [bytes([i - b_of.piece_to_id("<0x00>")]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(ab) != want or b"".join(bb) != want:
            docs.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in own]).tolist() for own in (ab, bb)]
        begins = [[0, *e[:-1]] for e in ends]
        links, k = [], 0
        for i in range(len(a)):
            while ends[1][k] <= begins[0][i]:
                k += 1
            j = k
            while j < len(b) and begins[1][j] < ends[0][i]:
                links.append((i, j))
                j += 1
        both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for e in both:
            x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        docs.append((a, b, groups, pairs))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(len(a), len(b), len(g), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, p in docs]


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("letters", [50, alignment.BLOCK_LETTERS])
def test_odd_texts(spark, letters):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_a string").coalesce(1)
    assert (alignment.aligned(df.selectExpr("doc_id AS id", "text"), A, B, letters).count() > 5) == (letters == 50)
    assert rows(alignment.align(df, A, B, block_letters=letters)) == dict(enumerate(plain(ODD)))


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = rows(queries.QUERIES["op11_token_alignment"](spark, d))
    assert got == dict(zip(texts, plain(texts.values()), strict=True))
    assert all(n_links == n_a + n_b - n_groups for n_a, n_b, n_groups, n_links, *_ in got.values())


def test_vocabularies_that_do_not_cut(monkeypatch):
    """Where a piece could cross a chunk's end, whole texts are encoded, with the same result."""
    one, two = alignment.Aligner(A, B), alignment.Aligner(A, B)
    two.cuts = False
    monkeypatch.setattr(alignment, "CALL_LETTERS", 20)
    for t in ODD[1:]:
        keys = [one.chunks(t), two.chunks(t)]
        assert len(keys[1]) <= 1
        first, second = one.learn(keys[0]), two.learn(keys[1])
        if second and not second[0][5]:
            assert ";".join(r[3] for r in first) == second[0][3] and b"".join(r[4] for r in first) == second[0][4]


def test_components_of_any_graph():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, m = rng.integers(1, 40, 2)
        a, b = rng.integers(0, n, 30), rng.integers(0, m, 30)
        own = list(range(n + m))
        for x, y in zip(a, b + n, strict=True):
            p, q = own[x], own[y]
            own = [min(p, q) if r in (p, q) else r for r in own]
        assert alignment.components(a, b, n, m).tolist() == own


def test_null_and_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "n_a string, text string")
    out = alignment.align(df, A, B, id_col="n_a")
    assert out.columns[:2] == ["n_a", "_n_a"] and sorted((r["n_a"] or "", r["_n_a"]) for r in out.collect()) == [("", 2), ("1", 2), ("1", 2), ("2", 0)]
    assert alignment.align(df.limit(0), A, B, id_col="n_a").collect() == []
