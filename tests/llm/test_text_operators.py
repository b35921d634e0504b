"""Quality rules, toxicity, pseudonyms and packing against plain versions on small inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import packing, pii, quality, toxicity
from marginalia.llm.words import Cache

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality --------------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n#é  \t", max_size=80))
def test_counts(text):
    cache = Cache(None)
    cache.make = lambda _: len(cache)
    assert quality.counts_of(text.encode(), cache)[:5] == plain_counts(text)


def test_repeated_words_beyond_small_numbers():
    ids = np.array([1 << 22, 5, 6, 1 << 22, 5, 6, 7])
    assert quality.repeated_words(ids) == 6


def test_forest_tells_odd_rows():
    random_ = np.random.default_rng(1)
    x = random_.normal(0, 1, (600, 4))
    odd = random_.normal(9, 1, (30, 4))
    box = np.stack([np.minimum(x.min(0), odd.min(0)), np.maximum(x.max(0), odd.max(0))])
    forest = quality.grow(x, box)
    assert forest.score(odd).min() > np.quantile(forest.score(x), 0.99)
    # path lengths as defined: a tree walked by hand
    for row in x[:3]:
        node = 0
        while forest.feature[0][node] >= 0:
            node = forest.child[0][node] + (row[forest.feature[0][node]] >= forest.threshold[0][node])
        one = quality.Forest(forest.feature[:1], forest.threshold[:1], forest.child[:1], forest.path[:1], forest.usual)
        assert one.score(row[None])[0] == pytest.approx(2 ** (-forest.path[0][node] / forest.usual))


def documents(spark, n=300):
    random.seed(3)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(n):
        words = random.choices(vocabulary, k=random.randint(60, 120))
        rows.append((i, " ".join(w + "$$$" if i % 10 == 0 else w for w in words)))
    return rows


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    rows = documents(spark)
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "a b"), (None, "x " * 99)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i, _ in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(docs, quality.fit(docs, labels), ["doc_id"]).collect()}
    assert [i for i, _ in rows if got[i]["kept"] != (i % 10 != 0)] == []
    assert got[900]["n_words"] == 0 and got[900]["base_failed"] and not got[901]["kept"] and got[None]["base_failed"]
    for i, text in rows[:20]:
        assert [got[i][c] for c in quality.BASE] == plain_counts(text)


def test_quality_without_rows_labels_or_free_names(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(none, labels)
    assert quality.judge(none, model, ["doc_id"]).count() == 0
    odd = spark.createDataFrame([(1, "a " * 20 + " ".join(map(str, range(60))), 5, True)], "doc_id long, text string, n_words int, kept boolean")
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.judge(odd, model, ["doc_id", "n_words"]).columns[:3] == ["doc_id", "n_words", "_n_words"]


def plain_threshold(scores, good, lost):
    best, cut = 0.0, math.inf
    for c in sorted(set(scores)):
        caught, wrong = (sum(s > c for s, g in zip(scores, good) if g == kind) / sum(g == kind for g in good) for kind in (False, True))
        if wrong <= lost and caught - wrong > best:
            best, cut = caught - wrong, c
    return cut


def test_threshold_equals_a_plain_search():
    random_ = np.random.default_rng(8)
    for lost in (0.0, 0.02, 0.3):
        good = random_.random(300) < 0.7
        scores = np.round(random_.normal(np.where(good, 0.4, 0.55), 0.08), 2)
        cut, want = quality.calibrate(scores, good, lost), plain_threshold(scores.tolist(), good.tolist(), lost)
        assert [s > cut for s in scores] == [s > want for s in scores]
    assert quality.calibrate(scores, np.ones(300, bool), 0.1) == math.inf


def test_quality_takes_the_worse_of_two_labels(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(60 + i % 9)) + " #$%" * (40 * (i % 5 == 0))) for i in range(200)], DOCS)
    labels = [(i, int(i % 5 != 0)) for i in range(200)]
    one = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    two = quality.fit(docs, spark.createDataFrame(labels + [(i, 1) for i in range(200)], "doc_id long, quality int"))
    assert one.threshold == two.threshold


# Toxicity -------------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    random.seed(5)
    rows, toxic = [], {}
    for i in range(1600):
        words = random.choices(["w%d" % k for k in range(200)], k=40)
        toxic[i] = i % 8 == 0
        rows.append((i, " ".join(words + random.sample(["vile", "Nasty,", "rotten", "foul"], 2) * toxic[i])))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (None, "vile foul")], DOCS)
    labels = spark.createDataFrame([(i, int(toxic[i])) for i in range(0, 1600, 1) if i % 3] + [(7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in toxic if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 300 and [i for i in held if bool(got[i]["predicted"]) != toxic[i]] == []
    assert got[9000]["score"] == got[9001]["score"] and 0 <= got[9000]["score"] < 0.3 and got[None]["predicted"] == 1


def test_toxicity_reads_no_held_out_label(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} vile") for i in range(60)], DOCS)
    base = [(i, i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    more = base + [(i, 1) for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    one, two = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (base, more))
    assert one == two


def test_toxicity_without_positives(spark):
    none = spark.createDataFrame([], DOCS)
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none, model, ["doc_id"]).count() == 0
    assert 0 <= model.score(b"anything at all") < 0.6


def plain_risk(w, x, positive, prior):
    """Both parts of the risk, document by document."""
    loss = lambda z, sign: math.log1p(math.exp(-sign * z))
    z = [w @ row for row in x]
    n, m = positive.sum(), (~positive).sum()
    first = prior * sum(loss(v, 1) for v, p in zip(z, positive) if p) / n
    return first, sum(loss(v, -1) for v, p in zip(z, positive) if not p) / m - prior * sum(loss(v, -1) for v, p in zip(z, positive) if p) / n


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_risk_and_its_step_equal_plain_ones(prior):
    random_ = np.random.default_rng(6)
    x, positive = random_.normal(size=(40, 3)), np.arange(40) < 15
    x[positive] += 1.5
    w = np.array([0.8, 0.7, 0.9])
    first, rest = plain_risk(w, x, positive, prior)
    got, grad = toxicity.risk(x @ w, positive, prior)
    assert got == pytest.approx(rest) and (rest < 0) == (prior == 0.9)
    for k in range(3):
        up, down = (plain_risk(w + e * np.eye(3)[k], x, positive, prior) for e in (1e-5, -1e-5))
        slope = (sum(up) - sum(down)) / 2e-5 if rest >= 0 else -(up[1] - down[1]) / 2e-5
        assert x[:, k] @ grad == pytest.approx(slope, rel=1e-4)


def test_toxicity_of_several_labels_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} " + "vile " * (i % 2) + "long " * (20_000 * (i == 3)), 0.0) for i in range(80)], "doc_id long, text string, score double")
    labels = [(i, i % 2) for i in range(80)]
    one = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    two = toxicity.fit(docs, spark.createDataFrame([(i, 0) for i in range(80)] + labels, "doc_id long, toxic int"))
    assert one == two
    assert toxicity.score(docs, one, ["doc_id", "score"]).columns == ["doc_id", "score", "_score", "predicted"]


def test_non_negative_risk_falls():
    random_ = np.random.default_rng(2)
    rows = [np.unique(random_.integers(0, 50, 10)) for _ in range(400)]
    positive = np.arange(400) < 80
    rows = [np.append(r, 60) if p else r for r, p in zip(rows, positive, strict=True)] + [np.append(r, 60) for r in rows[:20]]
    positive = np.append(positive, np.zeros(20, bool))
    model = toxicity.train(rows, positive, 0.1)
    assert model.weights[60] > 1 and max((abs(w) for f, w in model.weights.items() if f != 60), default=0) < model.weights[60]


# Pseudonyms -----------------------------------------------------------------------------------------------------------------

KEY = b"test key"
VALUES = ["4041894974608795", "4041 8949 7460 8795", "+1 (988) 555-2485", "+1 (017) 555-7713", "212-555-0123", "70.123.182.155", "2024-02-29", "29/02/2024", "12/31/2024", "02-29-2000", "123-45-6789", "DE89 3704 0044 0532 0130 00", "bosbt.42@mail8.example.com"]


@pytest.mark.parametrize("value", VALUES)
def test_pseudonym_keeps_format_and_can_be_undone(value):
    text = f"Call {value}, then {value}; end."
    new, kinds = pii.pseudonyms(text, KEY)
    assert len(kinds) == 2 and value not in new and len(new) == len(text)
    first, second = new[5 : 5 + len(value)], new[12 + len(value) : 12 + 2 * len(value)]
    assert first == second and re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", first)) == re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", value))
    assert pii.pseudonyms(new, KEY, back=True)[0] == text
    assert pii.pseudonyms(text, b"other")[0] != new
    assert len(pii.pseudonyms(new, KEY)[1]) == 2  # what validated the value validates its pseudonym


@pytest.mark.parametrize("text", ["4041894974608796", "2023-02-29", "300.1.1.1", "000-12-3456", "13/32/2024", "31/04/2024", "02/30/2024", "version 1.2.3.4.5", "abc 12345", "a@b", "GB00 1234 5678 9012"])
def test_invalid_values_stay(text):
    assert pii.pseudonyms(text, KEY) == (text, [])


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 5000), st.data())
def test_permutation(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = pii.permute(x, size, KEY, b"k")
    assert 0 <= y < size and pii.permute(y, size, KEY, b"k", back=True) == x


def plain_permutation(x, size, key, kind):
    """The network written out: two halves of a square, a keyed hash of one added to the other, again while outside the set."""
    side = next(n for n in range(1, size + 1) if n * n >= size)
    while True:
        a, b = x // side, x % side
        for i in range(10 if size >= 10**9 else 18 if size >= 10**6 else 36):
            number = int(hashlib.blake2b(kind + b"|" + str(size).encode() + b"|" + str(i).encode() + b"|" + str(b).encode(), key=key, digest_size=16).hexdigest(), 16)
            a, b = b, (a + number) % side
        x = a * side + b
        if x < size:
            return x


@pytest.mark.parametrize("size", [2, 30, 997, 73_049])
def test_permutation_equals_a_plain_one(size):
    assert all(pii.permute(x, size, KEY, b"k") == plain_permutation(x, size, KEY, b"k") for x in range(0, size, max(1, size // 60)))


def test_dates_that_only_read_month_first():
    days = [d for d in range(date(1999, 1, 1).toordinal(), date(2001, 1, 1).toordinal()) if date.fromordinal(d).day > 12]
    new = [pii.pseudonyms(f"{date.fromordinal(d):%m/%d/%Y}", KEY)[0] for d in days]
    assert len(set(new)) == len(days) and all(int(x[3:5]) > 12 for x in new)
    assert [pii.pseudonyms(x, KEY, back=True)[0] for x in new] == [f"{date.fromordinal(d):%m/%d/%Y}" for d in days]


def test_permutation_is_one_to_one():
    assert sorted(pii.permute(x, 997, KEY, b"k") for x in range(997)) == list(range(997))


def test_pseudonymise_table(spark):
    long = "word " * 200_000 + "4041894974608795"
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "at 70.123.182.155", "c"), (4, "at 70.123.182.155", "d"), (5, long, "e")], "doc_id long, text string, found string")
    got = pii.pseudonymise(docs, KEY).collect()
    by = {r["found"]: r for r in got}
    assert got[0].asDict().keys() == {"doc_id", "text", "found", "kinds"} and by["a"]["text"] is None and by["b"]["text"] == ""
    assert by["c"]["text"] == by["d"]["text"] != "at 70.123.182.155" and by["c"]["kinds"] == ["ip"] and by["e"]["text"][:-16] == long[:-16]
    back = {r["found"]: r["text"] for r in pii.pseudonymise(pii.pseudonymise(docs, KEY, kinds_col=None), KEY, back=True).collect()}
    assert back["e"] == long and back["c"] == "at 70.123.182.155"
    assert pii.pseudonymise(docs.where("false"), KEY).count() == 0
    assert pii.pseudonymise(docs, KEY, kinds_col="FOUND").columns == ["doc_id", "text", "found", "_FOUND"]
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, b"")


# Packing --------------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 4), max_size=6), st.integers(1, 60))
def test_fill_is_the_best_subset(counts, capacity):
    totals = {0}
    for length, n in counts.items():
        totals = {t + length * k for t in totals for k in range(n + 1) if t + length * k <= capacity}
    own = packing.fill(counts, capacity)
    assert all(0 < m <= counts[k] for k, m in own.items())
    assert sum(k * m for k, m in own.items()) == max(totals)


def test_plan_uses_every_length_once():
    random.seed(1)
    counts = Counter(random.randint(1, 500) for _ in range(5000))
    done = packing.plan(counts, 512)
    used = Counter()
    for own, times in done:
        assert sum(k * m for k, m in own.items()) <= 512
        for k, m in own.items():
            used[k] += m * times
    assert used == counts
    assert sum(t for _, t in done) <= sum(k * n for k, n in counts.items()) / 512 * 1.01 + 1


def test_pack(spark):
    from tokenizers import Tokenizer

    random.seed(2)
    texts = [" ".join(random.choices(["Été", "don't", "naïve", "x1y2", "…", "the", "<|endoftext|>", "é"], k=random.choice([0, 3, 50, 700]))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, ""), (5, texts[5]), (None, "a  b\n\tc d")]
    docs = spark.createDataFrame(rows, DOCS)
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(docs, packing.vocabulary(), capacity=256).collect()
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), 256):
            want[i, at, len(ids[at : at + 256]), np.array(ids[at : at + 256], "<u4").tobytes(), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == want
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    tokens = sum(r["length"] for r in got)
    assert len(windows) <= tokens / 256 * 1.02 + 1
    assert packing.pack(docs.where("false"), packing.vocabulary()).count() == 0
    light = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.pack_digest(docs, 256).collect()}
    assert light == {(r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"]))) for r in got}


def test_threshold_counts_all_labelled_rows(spark):
    """Bad rows that are few among very many labelled ones move the range and the threshold; none is left to chance."""
    usual = np.array([[200, 1000, 5, 0, 10, 10, 20, 30, 120]]) + np.random.default_rng(2).integers(0, 9, (30_000, 9))
    odd = [[200, 1000, 900, 8, 90, 10, 900, 900, 20]] * 3
    rows = [(i, *map(int, c)) for i, c in enumerate([*usual.tolist(), *odd])]
    counted = spark.createDataFrame(rows, ", ".join(["doc_id long", *[f"{c} long" for c in quality.COUNTS]]))
    model = quality.fitted(counted, counted.selectExpr("doc_id", "if(doc_id < 30000, 1, 0) AS quality"))
    score = model.forest.score(quality.features(np.array([*usual[:500].tolist(), *odd])))
    assert (score[-3:] > model.threshold).all() and (score[:-3] <= model.threshold).mean() > 0.98
