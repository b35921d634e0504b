"""Similarity and text functions: values worked out by hand or by definition, and laws."""

import json

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import fuzzy, replies, text
from marginalia.schemas import REPLIES, struct

ASCII = st.text(alphabet="abc de", max_size=14)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(ASCII, ASCII)
def test_ratio_laws(a, b):
    assert fuzzy.lcs(a, b) == plain_lcs(a, b)
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a) and 0 <= fuzzy.ratio(a, b) <= 100
    assert fuzzy.ratio(a, a) == fuzzy.partial_ratio(a, a) == 100
    if a and b and len(a) != len(b):
        short, long = sorted((a, b), key=len)
        n, m = len(short), len(long)
        windows = [long[i : i + n] for i in range(m - n + 1)] + [long[:i] for i in range(1, n)] + [long[m - i :] for i in range(1, n)]
        assert fuzzy.partial_ratio(a, b) == pytest.approx(max(fuzzy.ratio(short, w) for w in windows))


def test_known_values():
    assert fuzzy.ratio("kitten", "sitting") == pytest.approx(61.5385, abs=1e-4) and fuzzy.ratio("", "") == 100
    assert fuzzy.partial_ratio("4 results, p. 6", "4 results") == 100
    assert fuzzy.token_sort_ratio("learned cache replacement", "something else entirely") == pytest.approx(41.6667, abs=1e-4)
    assert fuzzy.token_set_ratio("a b", "b a c") == 100 and fuzzy.token_set_ratio("", "a") == 0


def one(spark, col, value=""):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("y")).first()["y"]


def test_similar_agrees_with_the_kernel(spark):
    pairs = [("a" * i + "b" * j, "a" * j + "b" * i) for i in range(0, 12, 2) for j in range(0, 12, 3)] + [("abcdefghij" * 5, "abcdefghix" * 5), ("", ""), ("x", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.similar(F.col("a"), F.col("b")).alias("s"))
    assert all(r["s"] == (fuzzy.ratio(r["a"], r["b"]) >= 88) for r in df.collect())


def test_pair_and_title_scores(spark):
    s = lambda *v: [x[2] for x in fuzzy.scored_blocks([[v[0]], [v[1]], [v[2]]], [[v[3]], [v[4]], [v[5]]], 1.0)]
    assert s("same words", "p. 1", "x y", "words same", "p. 1", "x y") == [100]
    assert s("alpha", "", "beta", "gamma", "", "delta") == []
    assert s("", "", "same thing", "", "", "same thing") == [pytest.approx(0.65 * 100 + 0.35 * 50)]
    t = lambda a, b, y, z: one(spark, fuzzy.score_match(F.lit(a), F.lit(b), F.lit(y), F.lit(z)))
    assert t("A Title: of things", "a title of THINGS", "2018", "2003") == 75 and t("A", "A", "2018", "2019a") == 100 and t("", "A", None, None) == 0


SENTENCES = [
    ("We follow Smith et al. (2018) here. It works! Why? (See below.) done", ["We follow Smith et al. (2018) here.", "It works!", "Why?", "(See below.) done"]),
    ("Belady, L. A study.\nNext line.", ["Belady, L. A study.", "Next line."]), ("  \n ", []), ("e.g. The case. vs. Others", ["e.g. The case. vs. Others"]),
]


@pytest.mark.parametrize(("given_", "want"), SENTENCES)
def test_sentences(spark, given_, want):
    assert one(spark, text.sentences(F.col("x")), given_) == want


def test_text_functions(spark):
    f = lambda col, v: one(spark, col(F.col("x")), v)
    assert f(text.normalise, "ﬁne “quotes” – a\t b ") == 'fine "quotes" - a b'
    assert f(lambda x: text.join_lines(F.split(x, "\n")), "co-\noperate\nA-\nB") == "cooperate\nA-\nB"
    assert f(text.citation_numbers, "3, 5-7; 9-2, 1-90,x") == [3, 5, 6, 7]
    assert f(text.slug, "--A b/c.pdf..") == "A-b-c.pdf" and f(text.slug, "///") == "paper"
    assert f(text.safe_filename, "../../etc/pa$ss wd") == "pass wd.pdf" and f(text.safe_filename, "x.PDF") == "x.PDF"
    assert f(text.safe_url, "HTTPS://a") and not f(text.safe_url, "javascript:x")
    assert f(text.year_of, "in 1987a") == 1987 and f(text.year_of, "1787") is None
    assert f(text.strip_tags, "<p>a &amp; b</p>") == "a & b"
    assert f(lambda x: text.clip(x, 5), "abcdefgh") == "ab..." and f(text.cell, "a |\n b") == "a \\| b"
    assert f(text.language, "en-GB") == "en" and f(text.language, "fr_FR") == "fr" and f(text.dictionary_name, "en-gb") == "en_GB"
    assert f(text.token_of, "'Belady's") == "Belady" and f(lambda x: text.checkable(x, x), "LRU") is False and f(lambda x: text.checkable(x, x), "key-value")
    assert f(lambda x: text.checkable(x, x), "GPT4x") is False and f(text.without_markup, r"\alpha $x$ www.a.b 10.1000/ab c").split() == ["c"]
    assert f(text.error_class, "Context Window exceeds schema") == "context"


REPLY = '{"section": "S", "findings": [{"severity": "major", "category": "grammar"}]}'


@pytest.mark.parametrize("reply", [REPLY, f"```json\n{REPLY}\n```", f"Sure:\n```\n{REPLY}\n```", f"<think>{{no}}</think>{REPLY}", f"Here {REPLY} and {{braces}}"])
def test_replies_are_recovered(reply):
    found, wrong = replies.parse(reply, struct(REPLIES["pass1"]))
    assert wrong == "" and json.loads(found)["findings"][0] == {"severity": "major", "category": "grammar", "location": "", "quote": "", "description": "", "correction": ""}


@pytest.mark.parametrize(("reply", "part"), [("", "empty"), ("no json", "invalid"), ("[1]", "expected a JSON object"), ('{"section": 5}', "section"), ('{"findings": [{"severity": "bogus"}]}', "one of"), ('{"findings": {}}', "a list")])
def test_bad_replies_are_named(reply, part):
    found, wrong = replies.parse(reply, struct(REPLIES["pass1"]))
    assert found is None and part in wrong


def test_strict_schema():
    schema = replies.response_format("pass3")["json_schema"]["schema"]
    assert schema["additionalProperties"] is False and set(schema["required"]) == set(schema["properties"])
    assert "retracted" in schema["properties"]["references"]["items"]["properties"]["status"]["enum"]


def test_registered_in_sql(spark):
    fuzzy.register(spark)
    assert spark.sql("SELECT ratio('ab', 'ab') AS r").first()["r"] == 100


WIDE = st.text(alphabet="abc é\U0001f600", max_size=150)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WIDE, WIDE), min_size=1, max_size=6))
def test_many_pairs_at_once(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert fuzzy.lcs_many(a, b).tolist() == [plain_lcs(x, y) for x, y in pairs]
    assert fuzzy.ratios(a, b).tolist() == pytest.approx([fuzzy.ratio(x, y) for x, y in pairs])
    assert fuzzy.token_set_ratios(a, b).tolist() == pytest.approx([fuzzy.token_set_ratio(x, y) for x, y in pairs])


def test_partial_ratio_looks_at_every_stretch():
    rng = random.Random(1)
    text = lambda most: "".join(rng.choices("abcd é", k=rng.randrange(0, most)))
    best = lambda a, b: max(fuzzy.ratio(a, b[max(s, 0) : s + len(a)]) for s in range(1 - len(a), len(b)))
    for _ in range(300):
        a, b = sorted((text(140), text(200)), key=len)
        want = (100.0 if not b else 0.0) if not a else max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)
        assert fuzzy.partial_ratio(a, b) == pytest.approx(want) == fuzzy.partial_ratio(b, a)


def test_partial_ratio_of_long_texts_in_lots(monkeypatch):
    monkeypatch.setattr(fuzzy, "LANES", 100)
    text = "ab cd " * 300 + "needle of threads" + " ef gh" * 300
    assert fuzzy.partial_ratio("needle at threads", text) == pytest.approx(200 * 15 / 34)


def test_common_subsequences_of_pairs_of_places():
    random_ = np.random.default_rng(3)
    a = ["", "ab", *["".join(random_.choice(list("abcñ "), n)) for n in (5, 63, 64, 65, 128, 200)]]
    b = ["a", "", *["".join(random_.choice(list("abcd "), n)) for n in (3, 64, 130, 250)]]
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    assert fuzzy.lcs_pairs(a, b, i, j).tolist() == [fuzzy.lcs(a[x], b[y]) for x, y in zip(i, j, strict=True)]


def test_no_strings_are_built_for_pairs_that_bounds_settle(monkeypatch):
    """Pairs without common words, and short ones whose words in order are unlike, are never compared pair by pair."""
    random_ = np.random.default_rng(4)
    side = lambda k: [f"{random_.integers(16**12):012x}{random_.integers(16**12):012x}" + k for _ in range(60)]
    left, right = [side(" the"), ["p. 1"] * 60, side("")], [side(" the"), ["p. 1"] * 60, side("")]
    right[0][7], right[2][7] = left[0][3], left[2][3]
    seen, many = [], fuzzy.token_set_ratios
    monkeypatch.setattr(fuzzy, "token_set_ratios", lambda a, b: seen.extend(a) or many(a, b))
    assert fuzzy.scored_blocks(left, right, 70.0) == [(3, 7, 100.0)] and len(seen) < 100


def test_strip_takes_all_white_space_and_looks_at_the_ends_alone(spark):
    marks = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(m, f"{m}a {m} b\n{m}{m}") for m in marks] + [("", " \n\u2003"), ("", "")], "m string, t string")
    plain = F.regexp_replace("t", r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    got = rows.select("m", text.strip(F.col("t")).alias("a"), plain.alias("b"))
    assert rows.where(F.col("m").rlike(f"^{text.WS}\\z") != F.col("m").rlike(r"^[\s\x1c-\x1f\x85\p{Z}]\z")).count() == 0
    assert got.where("NOT a <=> b").count() == 0 and got.where("a <> ''").where(~F.col("a").contains(F.col("m"))).count() == 0
    assert "regexp_replace" not in rows.select(text.strip(F.col("t")))._jdf.queryExecution().toString()


def test_tokens_and_sentences_equal_their_patterns(spark):
    draw = random.Random(5)
    rows = [("".join(draw.choice("aBs.,'\u2019-( \n\u2003!$\\[") for _ in range(draw.randrange(40))),) for _ in range(3000)]
    rows += [("See Fig.\u2003A et al. The $x$ \\cmd http://a.b www.c 10.1234/x \n\n B.",)]
    df = spark.createDataFrame(rows, "t string")
    ws = r"[\s\x1c-\x1f\x85\p{Z}]"
    raw = F.transform(F.filter(F.split("t", f"{ws}+"), lambda c: c != ""), lambda c: F.regexp_replace(c, r"^[.,;:()\[\]{}\"]+|[.,;:()\[\]{}\"]+$", ""))
    token = lambda c: F.regexp_replace(F.regexp_replace(c, r"^['\u2019-]+|['\u2019-]+$", ""), r"['\u2019]s$", "")
    bare = F.regexp_replace(F.regexp_replace("t", r"\\[A-Za-z]+|\$[^$]*\$", " "), r"https?://\S+|www\.\S+|\b10\.\d{4,9}/\S+", " ")
    flat = F.regexp_replace(F.regexp_replace("t", rf"{ws}*\n{ws}*", " "), f"^{ws}+|{ws}+$", "")
    last = lambda p: F.regexp_extract(F.regexp_replace(p, f"{ws}+$", ""), r"([A-Za-z.]+)\.$", 1)
    goes_on = lambda p: last(p).rlike("^[A-Z]$") | F.regexp_replace(F.lower(last(p)), r"\.+$", "").isin(text.ABBREVIATIONS)
    marked = F.array_join(F.transform(F.split(flat, rf"(?<=[.!?]){ws}+(?=[A-Z\[(])"), lambda p: F.concat(p, F.when(goes_on(p), " ").otherwise("\x01"))), "")
    said = F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.regexp_replace(x, f"^{ws}+|{ws}+$", "")), lambda x: x != "")
    t = F.col("t")
    pairs = [(text.raw_tokens(t), raw), (F.transform(text.raw_tokens(t), text.token_of), F.transform(raw, token)), (text.without_markup(t), bare), (text.sentences(t), said)]
    assert [df.where(~a.eqNullSafe(b)).count() for a, b in pairs] == [0, 0, 0, 0]
