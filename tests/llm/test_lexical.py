"""Ranked search against scores computed document by document."""

import math
import random
import re
from collections import Counter

import pytest

from marginalia.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, most):
    """(item, rank, id, score) for docs and items as lists of (id, text)."""
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:most], 1)]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("window", "terms"), [(7, 6), (8192, 200_000)])
def test_equals_plain_scores(spark, monkeypatch, window, terms):
    """In windows and blocks of queries that are cut several times, and in whole ones."""
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)
    random.seed(2)
    pool = ["the", "of", "Äpfel", "x1", "naïve", "日本", "rare", "hit", "B_c", "d-e", "K"] + [f"w{i}" for i in range(30)]
    text = lambda: random.choice([" ", "\n", ", "]).join(random.choices(pool, [40, 30] + [3] * (len(pool) - 2), k=random.randrange(0, 40)))
    docs = [(i * 7 % 211, text()) for i in range(150)]
    # ties, repeated rows and ids, null ids and texts, texts without terms, a very long text
    docs += [(500 + i, "rare hit") for i in range(6)] + [(3, "rare hit"), (3, "rare hit"), (None, "rare hit"), (None, "naïve"), (600, None), (601, ""), (602, "... --- \x7f"), (-5, "rare " * 50_000 + "hit"), (603, "ǅ K É é")]
    items = [(1, "Rare HIT, rare!"), (2, text()), (3, "the of"), (4, "no such term at all"), (5, None), (6, "äpfel Äpfel"), (None, "naïve 日本"), (7, "hit"), (7, "w1 w2"), (8, ""), (9, "k")]
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, score string, rank int").repartition(3)
    b = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, df int")
    got = lexical.search(d, b, 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["rank"].dataType.simpleString() == "int"
    want = plain(docs, items, 5)
    assert rows(got) == sorted(want, key=repr) and {r[0] for r in want} >= {1, 2, 6, 7, None}


def test_clashing_names_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "rank long, body string")
    b = spark.createDataFrame([(1, "a")], "rank long, body string")
    out = lexical.search(d, b, 5, "rank", "body", "rank", "body")
    assert out.columns == ["rank", "_rank", "__rank", "score"] and out.count() == 1
    for x, y in ((d.limit(0), b), (d, b.limit(0))):
        assert lexical.search(x, y, 5, "rank", "body", "rank", "body").collect() == []


def test_a_term_of_all_documents_scores_nothing(spark):
    """Its weight is 0, and no document stands in the result for it."""
    d = spark.createDataFrame([(i, "all") for i in range(1200)], "doc_id long, text string")
    assert lexical.search(d, spark.createDataFrame([(1, "all")], "item_id long, text string")).collect() == []
