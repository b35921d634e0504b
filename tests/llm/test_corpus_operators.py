"""Search, mixing, sharding, url classes, repeats and near-duplicates against brute force on small inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import ann, minhash, mixing, sharding, suffix, urls
from marginalia.llm.common import components

DOCS = "doc_id long, text string"


def words(n, seed, of=500):
    random.seed(seed)
    return [f"w{random.randrange(of)}" for _ in range(n)]


# Search ---------------------------------------------------------------------------------------------------------------------


def exact(rows, queries, k):
    out = set()
    for q, v in queries:
        best = sorted(((-float(np.dot(np.array(v, float), np.array(x, float))), i) for i, x in rows if i != q))[:k]
        out |= {(q, n, i) for n, (_, i) in enumerate(best, 1)}
    return out


def test_search(spark):
    random_ = np.random.default_rng(4)
    x = random_.normal(size=(900, 16)) * random_.uniform(0.5, 2, (900, 1))
    x[300:500] = x[300]  # one vector in very many rows
    rows = [(i, [float(a) for a in np.float32(v)]) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] * 16), (None, rows[0][1]), (7, rows[7][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    found = ann.search(table, table.where("vec_id % 20 = 0"), k=10, again=300)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()}
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert len(got) == len(want) and len(got & want) / len(want) > 0.99
    # the hot vector's own queries, ties by id
    assert {(n, i) for q, n, i in got if q == 320} == {(n, i) for q, n, i in want if q == 320}
    assert ann.recall(found, table, 10) >= 0.9
    assert ann.search(table.where("false"), table, k=3).count() == 0
    few = ann.search(table.where("vec_id < 3"), table.where("vec_id < 3"), k=20)
    assert few.count() == 6


def test_search_among_rows_that_share_their_codes(spark):
    random_ = np.random.default_rng(5)
    tight = random_.normal(size=(2, 16))[np.arange(2400) % 2] + 1e-3 * random_.normal(size=(2400, 16))
    tight[2000:] = random_.normal(size=(400, 16)) * np.exp(random_.normal(size=(400, 1)))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(tight)]
    for scale in (1.0, 1e120):
        scaled = [(i, [a * scale for a in v]) for i, v in rows]
        table = spark.createDataFrame(scaled, "vec_id long, embedding array<double>")
        found = ann.search(table, table.where("vec_id % 40 = 0"), k=10)
        got = {(r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()}
        assert got == exact(scaled, [r for r in scaled if r[0] % 40 == 0], 10)


def test_anisotropic_codes_lower_the_loss():
    x = np.random.default_rng(1).normal(size=(500, 16))
    q = ann.train(x, 4)

    def loss(codes):
        gap = x - np.concatenate([q.books[s][codes[:, s]] for s in range(4)], 1)
        return ((gap**2).sum(1) + (q.eta - 1) * ((gap * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2).sum()

    assert q.eta > 0 and loss(q.encode(x, 2)) <= loss(q.encode(x, 0))
    codes = q.encode(x)
    approx = ann.scan(x[:5], codes, q)
    want = x[:5] @ np.concatenate([q.books[s][codes[:, s]] for s in range(4)], 1).T
    assert np.allclose(approx, want, atol=1e-4)


# Mixing ---------------------------------------------------------------------------------------------------------------------


def test_raking_meets_the_marginals(spark):
    rows = [(i, "x " * (10 + i % 7), "src0" if i % 3 else f"src{i % 5}", "en" if i % 4 else "fr") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"src0": 1, "src1": 1, "src2": 1, "src3": 1, "src4": 1}, "lang": {"en": 0.6, "fr": 0.4}}
    out = mixing.mix(docs, budget=0.05, targets=targets).toPandas()
    weight = out["probability"] * out["tokens"]
    total = weight.sum()
    assert total == pytest.approx(0.05 * out["tokens"].sum(), rel=1e-3)
    for s in targets["source"]:
        assert weight[out["source"] == s].sum() / total == pytest.approx(0.2, rel=1e-3)
    assert weight[out["lang"] == "fr"].sum() / total == pytest.approx(0.4, rel=1e-3)
    assert abs(out["kept"].sum() - out["probability"].sum()) < 4 * math.sqrt(out["probability"].sum())


def test_raking_meets_budget_and_marginals_with_rare_values(spark):
    random.seed(11)
    topics = ["licence of a license", "mail a@b", "### mark", "prose"]
    rows = [(i, random.choices(topics, [1, 2, 3, 94])[0] + " x" * (5 + i % 11), f"src{min(i % 17, 5)}", random.choices(["en", "de", "fr", "es"], [70, 15, 10, 5])[0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(docs).withColumn("topic", mixing.topic_of(F.col("text"))).toPandas()
    weight, total = out["probability"] * out["tokens"], out["tokens"].sum()
    assert weight.sum() == pytest.approx(0.5 * total, rel=1e-3)
    for d in ("source", "lang", "topic"):
        held = out.groupby(d)["tokens"].sum() / (0.5 * total)
        aims, full = held * 0, set()
        while True:  # what is full stays so, the others share the rest
            left = [v for v in held.index if v not in full]
            root = np.sqrt(held[left])
            aims[left] = root / root.sum() * (1 - held[list(full)].sum())
            over = [v for v in left if aims[v] > held[v]]
            aims[over] = held[over]
            full |= set(over)
            if not over:
                break
        got = weight.groupby(out[d]).sum() / (0.5 * total)
        assert dict(got) == pytest.approx(dict(aims), abs=2e-3)


def test_raking_to_values_that_hold_too_little(spark):
    df = spark.createDataFrame([("a", "x", 10), ("a", "y", 10), ("b", "x", 40), ("b", "y", 40)], "s string, l string, tokens long")
    got = {(r["s"], r["l"]): r["share"] for r in mixing.rake(df, ["s", "l"], {"s": {"a": 1.0}}, 0.5, 0.5).collect()}
    assert got == pytest.approx({("a", "x"): 0.2, ("a", "y"): 0.2, ("b", "x"): 0.0, ("b", "y"): 0.0})


def plain_rake(cells, dims, aims, most, steps):
    w = {c: n for c, n in cells.items()}
    for _ in range(steps):
        for d in range(dims):
            have = defaultdict(float)
            for c, x in w.items():
                have[c[d]] += x
            w = {c: min(x * aims[d][c[d]] / have[c[d]], most[c]) if have[c[d]] > 0 else 0.0 for c, x in w.items()}
    return w


@pytest.mark.parametrize("most", [mixing.CELLS_IN_ONE_TASK, 0])
def test_raking_equals_a_plain_loop(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "CELLS_IN_ONE_TASK", most)
    cells = {("a", "x"): 50, ("a", "y"): 10, ("b", "x"): 5, ("b", "y"): 35}
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "s string, l string, tokens long")
    got = {(r["s"], r["l"]): r["share"] for r in mixing.rake(df, ["s", "l"], {"s": {"a": 1.0, "b": 3.0}, "l": {"x": 1.0, "y": 1.0}}, 0.5, 0.3).collect()}
    want = plain_rake({c: n / 100 for c, n in cells.items()}, 2, [{"a": 0.25, "b": 0.75}, {"x": 0.5, "y": 0.5}], {c: n / 100 / 0.3 for c, n in cells.items()}, 32)
    assert got == pytest.approx(want, rel=1e-4)


def test_raking_says_what_it_cannot_meet(spark):
    df = spark.createDataFrame([("a", "x", 50), ("b", "y", 50)], "s string, l string, tokens long")
    with pytest.warns(UserWarning, match="settled"):
        mixing.rake(df, ["s", "l"], {"s": {"a": 0.9, None: 0.1}, "l": {"x": 0.1, "y": 0.9}}, 0.5, 0.1, batches=1)


def test_topics(spark):
    texts = ["plain prose", "a License", "mail a@b or c@d, license", "*** $$$ @", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.topic_of(F.col("text"))).collect()]
    assert got == ["prose", "licence", "contact", "markup", "prose", "prose"]
    assert spark.createDataFrame([("one two two",)], "text string").select(mixing.topic_of(F.col("text"), {"b": ["one"], "a": ["two"]}, "none")).first()[0] == "a"


def test_mixing_query_meets_its_targets(spark):
    got = mixing.op6(spark, "/root/testdata/sf0.01").toPandas()
    weight, total = got["probability"] * got["tokens"], 0.5 * got["tokens"].sum()
    assert weight.sum() == pytest.approx(total, rel=1e-3)
    for d in ("lang", "topic"):
        wanted, held = mixing.TARGETS[d], got.groupby(d)["tokens"].sum() / total
        level, full = 0.0, set()
        for _ in held:
            level = (1 - held[list(full)].sum()) / sum(wanted[v] for v in held.index if v not in full)
            full |= {v for v in held.index if wanted[v] * level >= held[v]}
        assert dict(weight.groupby(got[d]).sum() / total) == pytest.approx({v: min(held[v], level * wanted[v]) for v in held.index}, abs=3e-3)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, 5.0), (None, "", "s", None, 1.0), (3, "a b", "s", "en", 2.0), (3, "a b", "s", "en", 2.0)], "doc_id long, text string, source string, lang string, probability double")
    out = mixing.mix(docs, budget=1.0)
    assert out.columns == ["doc_id", "text", "source", "lang", "probability", "tokens", "_probability", "kept"]
    rows = out.collect()
    assert len(rows) == 4 and len({r["kept"] for r in rows if r["doc_id"] == 3}) == 1
    assert mixing.mix(docs.where("false").drop("probability")).count() == 0


# Sharding -------------------------------------------------------------------------------------------------------------------


def test_shards(spark):
    random.seed(6)
    rows = [(i, "x" * random.randint(0, 400)) for i in range(3000)] + [(10_000 + i, "hot text " * 20) for i in range(1500)] + [(None, None), (1, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("own"))
    out = sharding.shard_documents(docs, 8, rows_a_task=300)
    assert out.columns == ["doc_id", "text", "shard", "_shard", "slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["_shard"]] += len((r["text"] or "").encode()) + 16
        slots[r["_shard"]].append(r["slot"])
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 0.02 * mean + 2 * 416
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # equal texts that fit stay together
    where = defaultdict(set)
    for r in got:
        where[r["text"]].add(r["_shard"])
    assert sum(len(s) > 1 for t, s in where.items() if t and t[0] == "x") <= 8
    assert sharding.shard_documents(docs.where("false"), 8).count() == 0


def test_shards_query(spark):
    d = "/root/testdata/sf0.001"
    got = sharding.op7(spark, d).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)


# Url classes ----------------------------------------------------------------------------------------------------------------

RULES = [("block", "bad.org", "/"), ("allow", "good.com", "/"), ("block", "good.com", "/x/")]


def link(to):
    return f'<html><head><link href="{to}" rel="canonical"></head>'


def test_decisions_reach_aliases(spark):
    pages = [
        (1, "http://a.net/1", link("http://bad.org/1")), (2, "http://b.net/2", '<meta http-equiv="refresh" content="0; url=http://a.net/1">'), (3, "http://bad.org/1", ""),
        (4, "http://c.net/3", link("/4#frag")), (5, "http://c.net/4", link("http://Good.com/x")), (6, "http://d.net/", link("//good.com/x")), (7, "http://d.net/5", "rel=canonical without a tag"),
        (8, "http://good.com/x/1", link("http://good.com/x")), (9, None, None), (10, "no scheme", link("http://bad.org/2")), (11, "http://e.net/1", link("http://f.net/1")), (11, "http://e.net/1", link("http://f.net/1")),
        (12, "http://sub.BAD.org?q", None), (13, "http://notbad.org/", None),
    ]
    extra = spark.createDataFrame([("http://f.net/1", "http://bad.org/9"), ("http://g.net/1", None)], "a string, b string")
    out = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("own")), RULES, extra)
    assert out.columns[3:] == ["host", "_host", "path", "rule", "verdict", "alias_verdict"]
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert out.count() == len(pages)
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "block", 12: "allow", 13: "allow"}


def test_allow_goes_before_block_in_a_class(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", link("http://bad.org/")), (2, "http://a.net/", link("http://good.com/")), (3, "http://bad.org/", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block"}
    assert urls.judge_urls(pages.where("false"), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, []).collect()} == {"allow"}


PAGES = [
    ("http://a.net/x/1", link("../2")), ("http://a.net/2", link("http://bad.org/1")), ("http://a.net/x/3", link("#top")), ("http://a.net/x/4", link("mailto:me@bad.org")), ("http://a.net/x/5", link("javascript:go()")),
    ("http://a.net/x/6", "<!-- " + link("http://bad.org/6") + " -->"), ("http://a.net/x/7", '<link rel="canonical" data-href="http://bad.org/7" href="http://good.com/7">'), ("http://a.net/x/8?a=1", link("?a=1&amp;b=2")),
    ("http://a.net/x/8?a=1&b=2", link("//BAD.org")), ("http://a.net", link("y/./z/..")), ("http://a.net/y/", '<META content="5; URL=/x/../x/9" http-equiv=refresh>'), ("http://a.net/x/9", link("http://bad.org/9")),
    ("http://a.net/x/10", "<a title='rel=canonical' href='http://bad.org'>" + "long " * 50_000), ("http://a.net/es/1", link("http://good.com/")), (None, link("http://bad.org")), ("http://a.net/x/1", None),
]


def test_links_are_resolved(spark):
    got = {(r["a"], r["b"]) for r in urls.alias_edges(spark.createDataFrame(PAGES, "url string, html string")).collect()}
    a = "http://a.net"
    assert got == {
        (f"{a}/x/1", f"{a}/2"), (f"{a}/2", "http://bad.org/1"), (f"{a}/x/7", "http://good.com/7"), (f"{a}/x/8?a=1", f"{a}/x/8?a=1&b=2"), (f"{a}/x/8?a=1&b=2", "http://bad.org"), (a, f"{a}/y/"), (f"{a}/y/", f"{a}/x/9"), (f"{a}/x/9", "http://bad.org/9"),
        (f"{a}/es/1", "http://good.com/"),
    }


def test_the_sql_of_url_classes(spark, tmp_path):
    import duckdb

    from marginalia.llm import queries

    pages = [(i, u.replace("bad.org", "bad.net/fr").replace("good.com", "www.example.com/en") if u else u, h.replace("bad.org", "bad.net/fr").replace("good.com", "www.example.com/en") if h else h) for i, (u, h) in enumerate(PAGES)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    out = urls.op8(spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=str)
    want = sorted(db.sql(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLES['op8_redirect_classes']})").fetchall(), key=str)
    assert got == want and {g[-1] for g in got} == {None, "allow", "block"}


def _components(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (5, 5), (None, 3)], "a long, b long")).collect()}
    assert got == _components(edges)


@pytest.mark.parametrize("n", [120, 5000])
def test_components_of_shuffled_chains_and_bands(spark, n):
    names = random.Random(n).sample(range(10 * n), n)
    third = n // 3
    edges = list(zip(names[:third], names[1:third])) + [(names[third + i], names[third + i + k]) for i in range(third - 4) for k in range(1, 5)] + [(names[2 * third], x) for x in names[2 * third + 1 :]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _components(edges)


def test_a_long_chain_of_redirects(spark):
    names = [f"http://h{i}.net/p" for i in random.Random(3).sample(range(10_000), 200)]
    pages = [(i, a, f'<meta http-equiv="refresh" content="0; url={b}">') for i, (a, b) in enumerate(zip(names, [*names[1:], "http://bad.org/"]))]
    assert {r["verdict"] for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()} == {"block"}


# Repeats --------------------------------------------------------------------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=80), st.integers(1, 6))
def test_suffix_array_and_prefixes(values, times):
    s = np.array(values * times + [0], np.uint8)
    data = s.tobytes()
    want = sorted(range(len(s)), key=lambda i: data[i:])
    order = suffix.sorted_suffixes(s)
    assert order.tolist() == want
    prefix = suffix.common_prefixes(s, order)
    for a, b in zip(want, want[1:]):
        n = 0
        while a + n < len(s) and b + n < len(s) and data[a + n] == data[b + n]:
            n += 1
        assert prefix[b] == n


def test_recursion_and_doubling_agree(monkeypatch):
    random_ = np.random.default_rng(3)
    s = np.append(np.tile(random_.integers(1, 5, 700), 3), 0).astype(np.uint8)
    whole = suffix.sorted_suffixes(s)
    monkeypatch.setattr(suffix, "MOST_SYMBOLS", 0)
    assert suffix.sorted_suffixes(s).tolist() == whole.tolist()


def plain_repeats(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows():
    shared = " ".join(words(60, 9))
    texts = [" ".join(words(120, i)) for i in range(30)]
    texts += [t[:50] + shared + t[50:] for t in texts[:8]] + [shared[10:230], shared[30:], "é" * 150 + shared, "ab" * 700, "a" * 900, "", None, texts[3], texts[3]]
    texts += [t.replace("w3", "w4", 2) for t in texts[10:16]] + [texts[20] + " " + texts[20][:260]]
    return [(i if i % 9 else None if i == 9 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("most", [suffix.MOST_CLASSES, 1])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_CLASSES", most)
    rows = repeat_rows()
    docs = spark.createDataFrame(rows + [rows[4]], DOCS)
    texts = [(t or "").encode() for _, t in rows + [rows[4]]]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(docs).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows + [rows[4]], plain_repeats(texts, 200), strict=True))
    assert suffix.remove_repeats(docs.where("false")).count() == 0


def test_repeats_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(suffix, "TILE", 1000)
    texts = [(t or "").encode() for _, t in repeat_rows()]
    found = defaultdict(list)
    for lot in suffix._tiles(texts, 200):
        part, first, starts, name, *_ = suffix.contexts_of([t for _, _, t in lot], 200)
        for p, f, n, h in zip(part, first, starts, name, strict=True):
            i, base, _ = lot[p]
            found[i].append((base + f, n, h))
            t = texts[i]
            for k in (0, n - 1):  # a window's name follows from its bytes alone
                again = suffix.contexts_of([t[base + f + k : base + f + k + 200]], 200)
                assert again[3][0] == h
    for i, t in enumerate(texts):
        spots = sorted(s for f, n, _ in found[i] for s in range(f, f + n))
        assert spots == list(range(max(len(t) - 199, 0)))


# Near-duplicates ------------------------------------------------------------------------------------------------------------


def plain_groups(rows, percent):
    sets = []
    for _, t in rows:
        w = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            r = find(i)
            least[r] = d if least[r] is None else min(least[r], d)
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    random.seed(8)
    rows = []
    for i in range(60):
        base = words(random.choice([30, 120, 400]), 100 + i)
        for k in range(random.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(k * len(base) // 60):
                copy[random.randrange(len(copy))] = "edit%d" % random.randrange(10**6)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    hot = words(200, 1)
    for k in range(150):  # one large group of near copies
        copy = list(hot)
        copy[random.randrange(200)] = f"v{k}"
        rows.append((5000 + k, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, " \n "), (9003, "one two"), (9004, "ONE\tTwo"), (9005, "one two three"), (None, rows[0][1]), (9006, rows[5][1].upper()), (4, rows[1][1]), (4, rows[1][1]), (None, "lonely text of no one else here")]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, percent).collect())
    assert got == Counter(plain_groups(rows, percent))
    kept = minhash.keep_first(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), percent)
    assert kept.columns == docs.columns and kept.where("doc_id between 5000 and 5200").count() == 1
    assert minhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_a_region_is_met_as_a_whole(spark, percent):
    random.seed(9)
    base = [f"w{k}" for k in range(1000)]
    rows = [(1, " ".join(base))]
    for k in range(300):  # each near the original alone
        copy = list(base)
        for at in random.sample(range(5, 990, 7), 14):
            copy[at] = f"e{k}-{at}"
        rows.append((2 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, percent).collect())
    assert got == Counter(plain_groups(rows, percent))
    assert {c for _, _, c in got} == {1}


def test_groups_do_not_depend_on_partitions(spark):
    random.seed(10)
    rows = []
    for i in range(20):
        base = words(60, 300 + i)
        for k in range(2):
            rows.append((len(rows), " ".join([*base[:57], *[f"x{k}{j}" for j in range(3 * k)], *base[57 + 3 * k :]])))
    docs, parts = spark.createDataFrame(rows, DOCS), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 80).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == Counter(plain_groups(rows, 80))


@pytest.mark.parametrize("block", [3, 256])
def test_blocks_join_what_windows_left_apart(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    monkeypatch.setattr(minhash, "candidates", lambda rows, share: rows.select(F.col("class_key").alias("a"), F.col("class_key").alias("b"), F.lit(1).alias("hits")).where("false"))
    rows = [(i, " ".join([f"w{k}" for k in range(60)][: 60 - i % 7] + [f"c{i % 3}"] * (i % 5))) for i in range(40)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 80).collect())
    assert got == Counter(plain_groups(rows, 80))
