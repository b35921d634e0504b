"""Sections, captions, references, spelling, findings and calibration on small papers."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import fuzzy, json_text
from marginalia.functions import replies as replies_
from marginalia.operators import calibrate, captions, findings, model_calls, payloads, references, report, sections, spelling
from marginalia.plans import catalogue
from marginalia.schemas import BIB_RECORDS, FINDINGS, REPLIES, struct
from marginalia.sources import clients, config, files
from marginalia.streaming import jobs

PAPER = """A Study of Caches
Abstract
We report a hit rate of 31.4% over 240 traces, which is a long enough sentence to count as a body.
1 Introduction
Caches matter (Belady et al., 1966). See [1, 2-3] and the data set. This allready helps, allready.
Table 1. Mean latency by policy
LRU 3 ms
2 Related Work
Others did so [2]. As Table 1 shows, it is so.
Figure 1: Trend over the years
3.1 lower case title
References
[1] Belady, L. (1966). A study of replacement algorithms for a computer. Systems Journal.
[2] Mattson, R. (1970). Evaluation techniques for storage hierarchies. doi:10.1000/ab.12.
[3] Denning, P. (1968). The working set model for program behavior. CACM."""


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("p", i, t, 1 + i // 6) for i, t in enumerate(PAPER.split("\n"))], "paper_id string, line_no int, text string, page int").cache()


@pytest.fixture(scope="module")
def found(lines):
    return sections.sections(lines).cache()


def test_reviewable_sections_count_line_breaks_at_their_ends(spark):
    texts = ["x" * 200, "\n" + "x" * 200, "x" * 200 + "\t", " \u00a0" + "x" * 200 + " ", "x" * 201]
    rows = spark.createDataFrame([(str(i), "other", t) for i, t in enumerate(texts)], "paper_id string, kind string, text string")
    want = duckdb.sql("SELECT i FROM (SELECT unnest($t) AS t, unnest(range(5)) AS i) WHERE length(trim(t)) > 200", params={"t": texts}).fetchall()
    assert {int(r["paper_id"]) for r in sections.reviewable(rows).collect()} == {i for (i,) in want} == {1, 2, 4}


def test_sections(found):
    rows = sorted(found.collect(), key=lambda r: r["section_idx"])
    assert [(r["label"], r["kind"]) for r in rows] == [("Front matter", "other"), ("Abstract", "abstract"), ("1 Introduction", "introduction"), ("2 Related Work", "background"), ("References", "references")]
    assert rows[0]["text"] == "A Study of Caches" and rows[3]["text"].endswith("3.1 lower case title")


def test_few_headings_and_running_heads(spark):
    few = spark.createDataFrame([("q", i, t, 1) for i, t in enumerate(["Abstract", "x", "1 One", "y"])], "paper_id string, line_no int, text string, page int")
    assert [r["title"] for r in sections.sections(few).collect()] == ["Full text"]
    many = spark.createDataFrame([("q", i, t, 1) for i, t in enumerate(["Results", "x"] * 3 + ["1 A", "x", "2 B", "x", "3 C", "x", "4 D"])], "paper_id string, line_no int, text string, page int")
    assert [r["title"] for r in sections.headings(many).orderBy("line_no").collect()] == ["A", "B", "C"]


@pytest.mark.parametrize(("line", "want"), [("1. Intro", ("1", "Intro")), ("IV. Results", ("IV", "Results")), ("Appendix A. More", ("Appendix A", "More")), ("2 small", None), ("References", ("", "References")), ("References:", None), ("Just text", None), ("3 Ends here.", None)])
def test_heading(spark, line, want):
    h = spark.createDataFrame([(line,)], "t string").select(sections.heading(F.col("t")).alias("h")).first()["h"]
    assert (None if h is None else (h["number"], h["title"])) == want


def test_resplit(spark, lines, found):
    wanted = spark.createDataFrame([("p", 1, "", "abstract"), ("p", 2, "2", "Related work"), ("p", 3, "", "References"), ("p", 4, "", "None such")], "paper_id string, ord int, number string, title string")
    new = sections.resplit(lines, wanted)
    assert [r["title"] for r in new.orderBy("section_idx").collect()] == ["Front matter", "abstract", "Related work", "References"]
    assert sections.accept_resplit(found, new).count() == 5 and sections.first_of_kinds(found, ["results", "background"]).first()["label"] == "2 Related Work"


def test_resplit_of_many_papers_equals_a_plain_search(spark):
    draw, rows, wanted, want = random.Random(3), [], [], set()
    for p in range(60):
        own = [draw.choice(["A", "B", "C", "1 A", "text"]) for _ in range(draw.randrange(4, 14))]
        titles = [(i, draw.choice(["", "1"]), draw.choice("ABC")) for i in range(draw.randrange(1, 6))]
        rows += [(f"p{p}", i, t, 1) for i, t in enumerate(own)]
        wanted += [(f"p{p}", *t) for t in titles]
        used, at, hits = set(), -1, []
        for _, number, title in titles:
            free = [i for i, t in enumerate(own) if t in (title, f"{number} {title}".strip()) and i not in used]
            if free:
                at = next((i for i in free if i > at), free[0])
                used.add(at)
                hits.append((at, number, title))
        if len(hits) >= 3:
            want |= {(f"p{p}", number, title, sum(h[0] < n for h in hits)) for n, number, title in hits}
            want |= {(f"p{p}", "", "Front matter", -1)} if min(used) else set()
    got = sections.resplit(spark.createDataFrame(rows, "paper_id string, line_no int, text string, page int"), spark.createDataFrame(wanted, "paper_id string, ord int, number string, title string"))
    front = F.expr("CASE WHEN title = 'Front matter' THEN -1 ELSE section_idx - max(CASE WHEN title = 'Front matter' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id) END")
    assert {tuple(r) for r in got.select("paper_id", "number", "title", front).collect()} == want and len(want) > 50
    # papers are not handed to Python one by one
    assert "InPandas" not in got._jdf.queryExecution().toString() and "InPandas" not in sections.accept_resplit(got, got)._jdf.queryExecution().toString()


def test_tokens_of_a_section_are_counted_where_it_lies(spark, found):
    none, known = spark.createDataFrame([], "paper_id string, word string"), spark.createDataFrame([("caches",)], "word string")
    plan = spelling.candidates(found, none, known)._jdf.queryExecution().toString()
    # neither sentences nor tokens are made twice, and no count needs a sort
    assert "SortAggregate" not in plan and "regexp_replace(text" not in plan
    texts = spark.createDataFrame([("p", "a b")], "paper_id string, text string").repartition("paper_id")
    ran = spelling.word_counts(texts, "paper_id")._jdf.queryExecution()
    assert ran.executedPlan().toString().count("Exchange hashpartitioning") == 1 and "size(transform" not in ran.optimizedPlan().toString()
    allow, lexicon = spark.createDataFrame([("p", "zork-caches")], "paper_id string, word string"), spark.createDataFrame([("caches",), ("caches",)], "word string")
    words = spark.createDataFrame([("p", w, "", 1) for w in ("zork-caches", "zork-mem", "caches-caches", "mem", "caches", "et")], "paper_id string, word string, language string, n int")
    assert sorted(r["word"] for r in spelling.unknown(words, allow, lexicon.withColumn("language", F.lit(""))).collect()) == ["mem", "zork-mem"]


def test_captions(lines, found):
    got = captions.with_mentions(captions.captions(lines), captions.mentions(lines, found))
    assert {(r["id"], r["referenced_in_text"]) for r in got.collect()} == {("Table 1", True), ("Figure 1", False)}
    assert "LRU 3 ms" in captions.table_windows(lines, captions.captions(lines)).first()["text"]
    assert [r["id"] for r in captions.in_order(got).orderBy("nth").collect()] == ["Figure 1", "Table 1"]


def test_references(found):
    refs = references.references(found)
    rows = {r["ref_index"]: r for r in refs.collect()}
    assert rows[2]["doi"] == "10.1000/ab.12" and rows[1]["year"] == "1966" and rows[1]["title"].startswith("A study") and rows[3]["authors"] == ["Denning"]
    cited = {r["ref_index"]: [c["quote"] for c in r["citing_sentences"]] for r in references.citing_sentences(refs, found).collect()}
    assert len(cited[1]) == 2 and cited[2] == ["See [1, 2-3] and the data set.", "Others did so [2]."] and len(cited[3]) == 1


def test_entries_without_numbers(spark):
    block = "Belady, L. (1966). A study\nof caches.\nMattson, R. (1970). More."
    got = spark.createDataFrame([(block,), ("",)], "b string").select(references.entries(F.col("b")).alias("e")).collect()
    assert got[0]["e"] == ["Belady, L. (1966). A study of caches.", "Mattson, R. (1970). More."] and got[1]["e"] == []


def test_records(spark):
    item = {"DOI": "10.1/x", "title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[2001, 3]]}, "container-title": ["bioRxiv"], "type": "journal-article", "abstract": "<p>x</p>", "update-to": [{"type": "retraction", "label": "Retraction"}]}
    r = spark.createDataFrame([(json.dumps(item),), ("{}",)], "j string").select(references.crossref_record(F.parse_json("j")).alias("r")).collect()
    one, none = r[0]["r"], r[1]["r"]
    assert (one["url"], one["authors"], one["year"], one["is_retracted"], one["is_preprint"], one["abstract"]) == ("https://doi.org/10.1/x", ["A B", "C"], "2001", True, True, "x")
    assert none["title"] == "" and not none["is_retracted"]
    o = spark.createDataFrame([('{"id": "u", "title": "T", "publication_year": 1999, "is_retracted": true, "authorships": [{"author": {"display_name": "X"}}], "type": "preprint"}',)], "j string").select(references.openalex_record(F.parse_json("j")).alias("r")).first()["r"]
    assert (o["year"], o["is_retracted"], o["authors"], o["is_preprint"]) == ("1999", True, ["X"], True)


def test_spelling(spark, found):
    allow = spelling.allowlist(spark.createDataFrame([("p", PAPER)], "paper_id string, text string"), references.references(found))
    known = "caches matter see and the data set this helps others did shows report hit rate over traces which long enough sentence count body study lower case title mean latency policy ms trend over years table figure for are was has not key value".split()
    lexicon = spark.createDataFrame([(w,) for w in set(known)], "word string")
    got = {r["token"]: r["occurrences"] for r in spelling.candidates(found, allow, lexicon).collect()}
    assert got["allready"] == 2 and "Belady" not in got and "LRU" not in got
    s = spelling.suggestions(spark.createDataFrame([("teh",), ("xqz",)], "word string"), spark.createDataFrame([("the", 9), ("ten", 5)], "word string, frequency int"))
    assert [tuple(r) for r in s.collect()] == [("teh", "the")]


def finding(ord_, severity="minor", category="spelling", location="p. 1", quote="q", source="pass1", **more):
    row = {"paper_id": "p", "ord": ord_, "severity": severity, "category": category, "location": location, "quote": quote, "description": f"d{ord_}", "correction": "", "source_pass": source, "verdict": "", "url": "", "stability": "single_run"} | more
    return row


def table(spark, *rows, schema=FINDINGS):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


def test_dedupe(spark):
    long = "the quick brown fox jumps over the lazy dog near the river"
    rows = [finding(1, quote=long), finding(2, "major", quote=long + "."), finding(3, quote=long, location="p. 2"), finding(4, quote=long, source="pass2"), finding(5, quote=""), finding(6, quote="", description="other"), finding(7, quote="wholly unlike")]
    df = table(spark, *rows).repartition(3)
    assert sorted(r["ord"] for r in findings.dedupe(df).collect()) == [2, 3, 4, 5, 7]
    assert sorted(r["ord"] for r in findings.dedupe_exact(df).collect()) == [1, 2, 3, 4, 5, 7]


def test_merge_runs(spark):
    schema = FINDINGS + ", run_no int"
    rows = [finding(1, quote="the same words here", run_no=0), finding(1, quote="the same words here!", run_no=1), finding(2, quote="only once", run_no=0), finding(3, quote="only once", run_no=0)]
    got = {r["ord"]: r["stability"] for r in findings.merge_runs(table(spark, *rows, schema=schema), 2).collect()}
    assert got == {1: "stable", 2: "unstable"}
    assert {r["stability"] for r in findings.merge_runs(table(spark, *rows, schema=schema), 1).collect()} == {"single_run"}


def test_covered(spark):
    c = lambda needles, hay: spark.createDataFrame([(needles, hay)], "n array<string>, h string").select(findings.covered(F.col("n"), F.col("h")).alias("c")).first()["c"]
    assert c(["24", ""], "a 240 b") and not c([" "], "x") and not c(["24", "9"], "240") and c(["a needle of more than twenty five characters"], "here is a needle of more than twenty-five characters indeed")
    assert not c(["a needle of more than twenty five characters", "zz"], "nothing alike")


def test_covered_by_any_long_needle(spark):
    needles = [f"{w} has nothing to do with this finding at all" for w in ("alpha", "beta", "gamma", "delta")] + ["a needle of more than twenty five characters"]
    rows = [(needles, "here is a needle of more than twenty-five characters indeed"), (needles, "nothing alike"), (None, "x"), ([], None)]
    got = spark.createDataFrame(rows, "n array<string>, h string").select(findings.covered(F.col("n"), F.col("h")).alias("c")).collect()
    assert [r["c"] for r in got][:2] == [True, False]


def test_calibration(spark):
    schema = FINDINGS
    truth = table(spark, finding(1, "major", quote="quote one is here", description="same"), finding(2, "minor", quote="quote two is there", description="else"))
    predicted = table(spark, finding(7, "minor", quote="quote one is here", description="same"), finding(8, quote="unrelated words entirely", description="nothing", category="claims"))
    m = calibrate.match(truth, predicted)
    assert [(r["t"], r["p"]) for r in m.collect()] == [(1, 7)]
    rows = calibrate.tagged(truth, predicted, m)
    by = {(r["dimension"], r["value"]): (r["tp"], r["fp"], r["fn"]) for r in calibrate.by_dimension(rows).collect()}
    assert by[("overall", "")] == (1, 1, 1) and by[("severity", "major")] == (1, 0, 0) and by[("category", "claims")] == (0, 1, 0)
    paper = calibrate.by_paper(rows).first()
    assert paper["precision"] == paper["recall"] == 0.5 and paper["severity_agreement"] == 0.0
    ok, failed = calibrate.without_failed(rows, spark.createDataFrame([("p", "timeout")], "paper_id string, error string"))
    assert ok.count() == 0 and failed.count() == 1 and schema


def test_all_findings_are_matched_as_by_brute_force(spark):
    import random

    random.seed(4)
    said = "the mean of every measure in table grows over time and falls when noise is added to long runs".split()
    text = lambda: " ".join(random.choices(said, k=9))
    shared = [text() for _ in range(12)]
    make = lambda first: table(spark, *[finding(first + i, quote=random.choice(shared), description=random.choice(shared), location=f"Section {i % 3}") for i in range(40)])
    truth, predicted = make(1), make(1001)
    rows = [(r.asDict(), q.asDict()) for r in truth.collect() for q in predicted.collect()]
    clean = lambda x: " ".join(x.split()).lower()
    scored = []
    for a, b in rows:
        quote, said_same = (fuzzy.token_set_ratio(clean(a[k]), clean(b[k])) for k in ("quote", "description"))
        score = 0.0 if quote < 55 and said_same < 70 else 0.6 * quote + 0.15 * fuzzy.partial_ratio(a["location"].lower(), b["location"].lower()) + 0.25 * said_same
        if score >= 70:
            scored.append((-score, a["ord"], b["ord"]))
    used, want = set(), set()
    for _, t, p in sorted(scored):
        if t not in used and p not in used:
            used |= {t, p}
            want.add((t, p))
    assert {(r["t"], r["p"]) for r in calibrate.match(truth, predicted).collect()} == want and len(want) > 20


def test_greedy_matches_reads_all_findings(spark):
    got = catalogue.QUERIES["greedy_matches"](spark, "/root/testdata/sf0.001").toPandas()
    assert (got["p"] % 10 != 1).any() and (got["t"] % 10 != 1).any()


def plain_matches(rows):
    """(paper, t, p) of rows of (paper, t, p, score), the best first, ties by t, then p."""
    used, out = set(), set()
    for paper, t, p, _ in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (paper, "t", t) not in used and (paper, "p", p) not in used:
            used |= {(paper, "t", t), (paper, "p", p)}
            out.add((paper, t, p))
    return out


@pytest.mark.parametrize("last", [0, 100_000])
def test_rounds_and_last_step_agree(spark, monkeypatch, last):
    monkeypatch.setattr(calibrate, "LAST_PAIRS", last)
    random.seed(8)
    rows = [("p", t, p, 90.0 - abs(t - p) // 3) for t in range(8) for p in range(8)]
    rows += [("q", t, p, 70.0 + random.randrange(30)) for t in range(40) for p in random.sample(range(40), 5)]
    scored = spark.createDataFrame(rows, "paper_id string, t bigint, p bigint, score double")
    assert {tuple(r)[:3] for r in calibrate.assign(scored).collect()} == plain_matches(rows)


def test_a_falling_chain_settles_in_few_rounds(spark, monkeypatch):
    """Each pair waits for the one before: t0-p0 is better than p0-t1, that than t1-p1, and so on. A side chain is longer by one."""
    monkeypatch.setattr(calibrate, "LAST_PAIRS", 0)
    n = 10_000
    rows = [("p", i, i, 100.0 - 2 * i / 1e4) for i in range(n)] + [("p", i + 1, i, 100.0 - (2 * i + 1) / 1e4) for i in range(n)]
    stored, rounds = calibrate.stored, []

    def counted(df, tag):
        rounds.append(tag)
        return stored(df, tag)

    monkeypatch.setattr(calibrate, "stored", counted)
    got = {tuple(r)[:3] for r in calibrate.assign(spark.createDataFrame(rows, "paper_id string, t bigint, p bigint, score double")).collect()}
    assert got == plain_matches(rows) and len(got) == n
    assert rounds.count("matches") <= 4 and rounds.count("chain") <= 3 * 17


@pytest.mark.parametrize("last", [0, 100_000])
def test_members_of_equal_texts_are_counted_off(spark, monkeypatch, last):
    """Copies of a text are matched as many as there are, without a row for each pair; with ties between texts as one by one."""
    monkeypatch.setattr(calibrate, "LAST_PAIRS", last)
    random.seed(3)
    said = ["the mean falls over time", "the mean falls", "noise is added to long runs", "noise is added to very long runs", "a b c"]
    make = lambda first, n: table(spark, *[finding(first + i, quote=random.choice(said), description="same", location="p. 1") for i in random.sample(range(1000), n)])
    truth, predicted = (make(1, 60), make(2001, 50)) if last else (make(1, 16), make(2001, 12))
    clean = lambda r: (r["quote"], r["location"], r["description"])
    rows = []
    for a in truth.collect():
        for b in predicted.collect():
            (q, w, e), (q2, w2, e2) = clean(a), clean(b)
            score = 0.6 * fuzzy.token_set_ratio(q, q2) + 0.15 * fuzzy.partial_ratio(w, w2) + 0.25 * fuzzy.token_set_ratio(e, e2)
            if score >= 70 and (fuzzy.token_set_ratio(q, q2) >= 55 or fuzzy.token_set_ratio(e, e2) >= 70):
                rows.append(("p", a["ord"], b["ord"], score))
    got = calibrate.match(truth, predicted).collect()
    assert {tuple(r)[:3] for r in got} == plain_matches(rows) and len(got) > 8
    many = table(spark, *[finding(i, quote="one text", description="same") for i in range(3000)])
    assert calibrate.match(many, many.withColumn("ord", F.col("ord") + 5000)).where("p = t + 5000").count() == 3000


def test_bounds_are_never_below_the_score():
    random.seed(6)
    word = lambda: "".join(random.choices("abcdé", k=random.randrange(1, 6)))
    pool = [word() for _ in range(30)]
    text = lambda: " ".join(random.choices(pool, k=random.randrange(0, 9)))
    a, b = [text() for _ in range(40)], [text() for _ in range(50)]
    most = fuzzy._bounds(a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert most[i, j] >= fuzzy.token_set_ratio(x, y) - 1e-6
    places = ["", "p. 1", "p. 12", "section 2"]
    left, right = ([x, [random.choice(places) for _ in x], [text() for _ in x]] for x in (a, b))
    want = {}
    for i in range(len(a)):
        for j in range(len(b)):
            (q, w, e), (q2, w2, e2) = ([side[k][n] for k in range(3)] for side, n in ((left, i), (right, j)))
            quote, said = fuzzy.token_set_ratio(q, q2), fuzzy.token_set_ratio(e, e2)
            place = fuzzy.partial_ratio(w, w2) if w and w2 else 50.0
            score = 0.65 * said + 0.35 * place if not q or not q2 else 0.0 if quote < 55 and said < 70 else 0.6 * quote + 0.15 * place + 0.25 * said
            if score >= 70:
                want[i, j] = score
    assert {(i, j): pytest.approx(s) for i, j, s in fuzzy.scored_blocks(left, right, 70.0)} == want and len(want) > 20


def test_greedy_takes_the_best_first(spark):
    scored = spark.createDataFrame([("p", 1, 1, 80.0), ("p", 1, 2, 90.0), ("p", 2, 2, 85.0), ("p", 2, 3, 85.0), ("p", 3, 3, 85.0)], "paper_id string, t bigint, p bigint, score double")
    assert {(r["t"], r["p"]) for r in calibrate.assign(scored).collect()} == {(1, 2), (2, 3)}


class Scripted:
    """Answers from a list; an exception in it is raised."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def chat(self, messages, *, model, response_format):
        self.asked.append((messages, response_format))
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return model_calls.Reply(r, usage={"tokens": 2})


@pytest.mark.parametrize(
    ("replies", "mode", "attempts", "ok"),
    [
        (['{"section": "a"}'], "json_schema", 1, True),
        (["bad", '{"section": "a"}'], "json_schema+repair", 2, True),
        ([model_calls.ModelError("response_format unsupported"), '{"section": "a"}'], "json_object", 2, True),
        ([model_calls.ModelError("maximum context reached, schema")], "context_exceeded", 1, False),
        ([model_calls.ModelError("connection refused")], "failed", 1, False),
        (["bad"] * 6, "failed", 6, False),
    ],
)
def test_exchange(replies, mode, attempts, ok):
    client = Scripted(*replies)
    out = model_calls.exchange(client, "pass1", "m", "s", "u")
    assert (out.attempts, out.json is not None) == (attempts, ok) and (out.mode == mode or not ok and out.mode.startswith(mode.split("+")[0]) or len(replies) == 6)


INVENTORY = f"paper_id string, reply {REPLIES['pass0']}"


def test_requests_and_calls(spark, found, lines):
    none = spark.createDataFrame([], INVENTORY)
    s = found.withColumn("text", F.repeat("text", 5))
    words = spark.createDataFrame([("p", 2, "allready", "s", "l", 2, "already")], "paper_id string, section_idx int, token string, sentence string, location string, occurrences bigint, suggestion string")
    caps = captions.with_mentions(captions.captions(lines), captions.mentions(lines, found))
    req = payloads.pass1(s, caps, words, none)
    rows = {r["label"]: r for r in req.collect()}
    assert '"checker_suggestion": "already"' in rows["pass1:1 Introduction"]["payload"] and "References" not in " ".join(rows)

    class Fixed:  # local, so that it travels to the workers by value
        def chat(self, messages, *, model, response_format):
            if response_format is None:
                return model_calls.Reply("# Report", usage={"tokens": 1})
            return model_calls.Reply('{"section": "' + messages[1]["content"].split()[0] + model + '"}', usage={"tokens": 2})

    out = model_calls.run(req, Fixed, {"default": "m", "pass1": "n"}, "s", {"pass1_mechanical": "Check."}).collect()
    assert len(out) == len(rows) and all(r["ok"] and r["usage"] == {"tokens": 2} and '"Check.n"' in r["json"] for r in out)
    kept, open_ = model_calls.answered(req, spark.createDataFrame([(out[0]["request_hash"], "{}")], "request_hash string, json string"))
    assert kept.count() == 1 and open_.count() == len(rows) - 1
    twice = payloads.repeated(req, 2)
    assert twice.count() == 2 * len(rows) and {r["request_hash"] for r in req.collect()} == {r["request_hash"] for r in twice.where("attempt = 1").collect()} and twice.select("request_hash").distinct().count() == 2 * len(rows)
    papers = spark.createDataFrame([("p", PAPER * 3, 3, {"title": 'A "b"'})], "paper_id string, text string, page_count int, metadata map<string,string>")
    refs = references.citing_sentences(references.references(found), found)
    short = payloads.pass0(papers, found, caps, refs, 2000).first()["payload"]
    assert short.startswith("NOTE") and "... [TRUNCATED" in short
    whole = payloads.pass0(papers, found, caps, refs).first()["payload"]
    hints = json.loads(whole.split("===\n")[1].split("\nThese hints")[0])
    assert "=== FULL PAPER TEXT" in whole and hints["pdf_metadata"] == {"title": 'A "b"'} and hints["detected_reference_count"] == refs.count() == len(hints["detected_bibliography"]) and hints["detected_captions"][0]["id"].startswith(("Figure", "Table"))
    assert "Related Work" in payloads.pass4_claims(papers, found, none).first()["payload"]
    two = payloads.pass2(papers, found, captions.table_windows(lines, captions.captions(lines)), none).first()["payload"]
    assert "31.4%" in two and "LRU 3 ms" in two
    empty = spark.createDataFrame([], f"paper_id string, ref_index int, {BIB_RECORDS}")
    batch = payloads.pass3(references.batches(references.with_records(refs, empty), 2))
    entries = json.loads(batch.where("batch = 0").first()["payload"].split("===\n")[1].split("\n\nThe `lookup")[0])
    assert batch.count() == 2 and entries[0]["lookup_result"] == {"found": False} and entries[0]["citing_sentences"] and set(entries[0]["parsed"]) == {"title", "year", "authors", "doi"}
    assert payloads.pass3_missing(found, False).first()["payload"].startswith("search_tool_available: False\n\n=== 1 Introduction (pages ")
    report_ = payloads.synthesis(findings.ordered(spark.createDataFrame([], FINDINGS)), spark.createDataFrame([], "paper_id string, ref_index int, line string"), papers.select("paper_id", F.lit(None).cast(struct(payloads.OUTPUTS)).alias("outputs")))
    assert "- No bibliography entries were checked." in report_.first()["payload"]
    text = model_calls.run(report_, Fixed, "m").first()
    assert text["text"] == "# Report" and text["json"] is None and text["ok"] and text["mode"] == "text"


def test_replies_are_asked_once(spark, tmp_path):
    """A run that ends between two waves asks only what is open, and what failed, when it goes on."""
    asked = []

    def outcome(requests, fails):
        rows = requests.collect()
        asked.extend(r["label"] for r in rows)
        return spark.createDataFrame([(r["request_hash"], r["stage"], r["label"], None if r["label"] in fails else "{}", None, "m", "json", r["label"] not in fails, 1, 0.0, {}, "") for r in rows], model_calls.RESULT)

    rows = spark.createDataFrame([(f"p{i}", f"l{i % 6}", "payload") for i in range(12)], "paper_id string, label string, payload string")
    req = rows.select(*payloads.request("pass1", F.col("label"), F.col("payload")))
    waves = []

    def broken(own):
        waves.append(1)
        if len(waves) == 2:
            raise RuntimeError("the run was ended")
        return outcome(own, {"l3"})

    with pytest.raises(RuntimeError):
        model_calls.Replies(spark, str(tmp_path), broken, wave=2).ask(req)
    first = list(asked)
    assert 0 < len(first) < 6
    done = model_calls.Replies(spark, str(tmp_path), lambda own: outcome(own, set()), wave=2).ask(req)
    assert done.count() == 12 and sorted(asked) == sorted(["l0", "l1", "l2", "l3", "l4", "l5"] + ["l3"] * ("l3" in first)) and done.where("ok").count() == 12
    assert model_calls.Replies(spark, str(tmp_path), lambda own: outcome(own, set())).ask(req).count() == 12 and len(asked) == 6 + ("l3" in first)


@pytest.mark.parametrize("value", [{}, {"limitations": ["a\u00e9\n\"b\""], "language": "en", "figures": [{"id": "x", "caption": "", "referenced_in_text": True}, {}], "key_numbers": [{"value": "1", "locations": ["p. 1", "p. 2"]}]}])
def test_json_text_is_what_python_writes(spark, value):
    kind = struct(REPLIES["pass0"])
    full = replies_.filled(value, kind)
    df = spark.createDataFrame([(json.dumps(full),)], "j string").select(F.from_json("j", kind).alias("x"))
    assert df.select(json_text.as_json(df.schema, "x")).first()[0] == json.dumps(full, ensure_ascii=False, indent=1)
    assert df.select(json_text.as_json(df.schema, "x", 50)).first()[0] == json.dumps(full, ensure_ascii=False, indent=1)[:50] + "\n... [TRUNCATED]"
    maps = spark.createDataFrame([({"a": [1, None], "b": []},), ({},), (None,)], "m map<string,array<int>>")
    assert [r[0] for r in maps.select(json_text.as_json(maps.schema, "m")).collect()] == [json.dumps(m, indent=1) for m in ({"a": [1, None], "b": []}, {}, {})]


def test_search_and_degradation(spark):
    claims = spark.createDataFrame([("p", i, f"c{i}", "l", "" if i % 2 else f"q{i}") for i in range(30)], "paper_id string, ord bigint, claim_quote string, location string, search_query string")

    def transport(method, address, ask, head):
        if ask["q"] == "q2":
            raise OSError("down")
        return {"web": {"results": [{"title": "t", "url": "u", "description": "x" * 900}] * 7}}

    make = lambda: clients.web_search("brave", transport, {"BRAVE_API_KEY": "k"})
    results = clients.search_all(claims.selectExpr("search_query AS query"), make)
    got = {r["ord"]: r for r in payloads.searched_claims(claims, results).collect()}
    assert len(got) == 25 and got[2]["results"] is None and len(got[4]["results"]) == 5 and len(got[4]["results"][0]["snippet"]) == 800 and got[1]["query"] == "c1"
    assert clients.web_search("brave", transport, {}).available is False and clients.no_results(spark).count() == 0 and clients.no_records(spark).count() == 0
    assert payloads.without_search(claims).where("verdict = 'could_not_verify'").count() == 30


def test_reports(spark):
    f = table(spark, finding(1, "critical", description="Worst | of all"), finding(2, stability="unstable"))
    checks = spark.createDataFrame([("p", 1, "Raw", "not_found", "", "", "yes", "Nothing.")], "paper_id string, ref_index int, raw string, status string, found_at string, mismatch_details string, supports_claim string, notes string")
    items = spark.createDataFrame([("p", 1, "Pass 4: 1 external claims could not be verified.")], "paper_id string, place bigint, line string")
    papers = spark.createDataFrame([("p",), ("q",)], "paper_id string")
    reports = report.fallback_report(papers, f, checks, items, spark.createDataFrame([("p", 1, "- Passes run: pass1")], "paper_id string, place bigint, line string"), spark.createDataFrame([("p", "en-GB")], "paper_id string, language string"))
    reports = {r["paper_id"]: r["report"] for r in reports.collect()}
    assert "No critical or major findings. 0 findings in total, all minor." in reports["q"] and "| - | - | No findings were reported. | - |" in reports["q"] and "Pass 0: unknown" in reports["q"]
    text = reports["p"]
    assert "- Language variant reported by Pass 0: en-GB" in text
    for part in ("1 critical and 0 major findings were reported. The most serious: Worst | of all", "| minor (unstable) |", "Worst \\| of all", "- [1] NOT FOUND - Raw Nothing.", "- Confirmed typos: 2", "Pass 4: 1", "- Passes run: pass1"):
        assert part in text


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    assert [r["stem"] for r in files.papers(spark, str(tmp_path)).collect()] == ["a"]
    got = files.lines_of(files.papers(spark, str(tmp_path)), lambda c: [("x" * 150, 1, 10.0, False, 0.0, 0.0), (" ", 1, 10.0, False, 0.0, 0.0), ("y" * 60, 2, 12.0, True, 0.0, 0.0)])
    assert got.count() == 2 and files.body_size(got).first()["body_size"] == 10.0
    assert files.lines_of(files.papers(spark, str(tmp_path)), lambda c: [("short", 1, 10.0, False, 0.0, 0.0)]).count() == 0
    names = spark.createDataFrame([("/d/a.pdf",), ("/d/a.findings.json",), ("/d/a.review.json",), ("/d/c.pdf",)], "path string")
    assert [r["review"] for r in files.truth_pairs(names).collect()] == ["/d/a.review.json"]
    truth = files.truth_findings(spark.createDataFrame([("p", '{"findings": [{"quote": "q", "pass": "pass2"}]}'), ("r", '[{"severity": "minor"}]')], "paper_id string, text string"))
    assert {(r["paper_id"], r["severity"], r["source_pass"]) for r in truth.collect()} == {("p", "major", "pass2"), ("r", "minor", "")}
    review = lambda t: files.truth_findings(spark.createDataFrame([("p", t)], "paper_id string, text string")).collect()
    assert review('{"x": 1}') == []  # findings may be absent
    for bad, told in (("5", "no findings in the review of p"), ('{"findings": 5}', "no findings in the review of p"), ("[5]", "entry 1 of the review of p is no object"), ('[{"severity": "grave"}]', "severity 'grave'")):
        with pytest.raises(Exception, match=told):
            review(bad)
    (tmp_path / "log").mkdir()
    (tmp_path / "log/runs.jsonl").write_text('{"run_id": "1", "paper": "a b", "started_at": "2024"}\n\nbroken\n{"run_id": "2", "paper": "a b", "started_at": "2025"}\n')
    runs = files.run_log(spark, str(tmp_path / "log"))
    h = files.history(runs, spark.createDataFrame([("a-b", "1")], "paper_slug string, run_id string"), 5).collect()
    assert [(r["run_id"], r["available"]) for r in h] == [("2", False), ("1", True)]
    files.write_template(spark, str(tmp_path / "t"), "x")
    with pytest.raises(Exception, match="already exists"):
        files.write_template(spark, str(tmp_path / "t"), "x")
    out = table(spark, finding(1)).withColumns({"pass": F.col("source_pass"), "paper_slug": F.lit("s"), "run_id": F.lit("r")})
    files.write_findings(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('seed = 1\n[models]\ndefault = "m"\npass3 = "n"\n[providers.x]\nbase_url = "u"\napi_key_env = "K"\n[limits]\npass3_batch_size = 4\n')
    c = config.load(str(path), {"MARGINALIA_SEED": "5"}, provider_name="x", temperature=None)
    assert (c.seed, c.pass3_batch_size, c.provider.key({"K": "v"}), c.model_for("pass3"), c.model_for("pass1")) == (5, 4, "v", "n", "m")
    with pytest.raises(config.ConfigError):
        c.provider.key({})
    with pytest.raises(config.ConfigError):
        config.load(None, {}, bogus=1)
    assert config.passes("3,pass1") == ["pass1", "pass3"]
    with pytest.raises(config.ConfigError):
        config.passes("pass9")
    (tmp_path / ".env").write_text("A=1\n# no\nB='2'\n")
    assert config.dotenv(tmp_path / "none", tmp_path / ".env", env={"A": "0"}) == {"A": "0", "B": "2"}


def test_job_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"job_id": "j", "offset": i, "status": s, "message": s, "ts": f"2024-01-01T00:00:0{i}Z"} for i, s in enumerate(["queued", "running", "done"])] + [{"job_id": "k", "offset": 0, "status": "queued", "message": "", "ts": "2024-01-02T00:00:00Z"}]
    (tmp_path / "in/e.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):  # a second run finds nothing new
        jobs.follow(jobs.read_events(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "c")).awaitTermination(60)
    assert {(r["job_id"], r["status"], r["event_count"], r["finished"]) for r in jobs.latest(spark, str(tmp_path / "state")).collect()} == {("j", "done", 3, True), ("k", "queued", 1, False)}
    # a stream of one job goes on where it was, from any offset
    batches = []
    progress = lambda start, name: jobs.progress(spark, str(tmp_path / "in"), "j", start).writeStream.foreachBatch(lambda b, n: batches.append([r["offset"] for r in b.collect()])).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="0 seconds").start()
    for start, name, want in ((1, "p1", [1, 2]), (0, "p2", [0, 1, 2]), (0, "p2", [])):
        batches.clear()
        stream = progress(start, name)
        stream.processAllAvailable()
        stream.stop()
        assert sum(batches, []) == want
    assert [r["offset"] for r in spark.read.format("job_progress").option("path", str(tmp_path / "in")).option("job", "j").option("from", "2").load().collect()] == [2]
    events = spark.read.schema("job_id string, offset bigint, status string, message string, ts timestamp").json(str(tmp_path / "in"))
    assert [r["job_id"] for r in jobs.addressable(events, 1).collect()] == ["k"] and jobs.since(events, 1).count() == 2
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/r.json").write_text('{"run_id": "1", "paper": "p"}')
    batch = spark.read.schema("run_id string").json(str(tmp_path / "runs"))
    for _ in range(2):  # a batch that is played again takes its own place
        batch.write.mode("overwrite").json(str(tmp_path / "log/batch=000000000"))
    for _ in range(2):  # a second run of the stream appends nothing twice
        jobs.append_run_log(spark, str(tmp_path / "runs"), str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def plain_leaders(quotes):
    kept, out = [], []
    for q in quotes:
        hit = next((k for k in kept if k == q or k and q and fuzzy.ratio(k, q) >= 88), None)
        kept += [] if hit is not None else [q]
        out.append(q if hit is None else hit)
    return out


@pytest.mark.parametrize("head", [2, 1024])
def test_leaders_of_large_blocks(spark, monkeypatch, head):
    monkeypatch.setattr(findings, "HEAD", head)
    monkeypatch.setattr(findings, "MOST_HEAD", 2 * head)
    rng = random.Random(4)
    quotes = ["", "a b"]
    for _ in range(12):
        base = [rng.choice("abcdefgh ") for _ in range(40)]
        for _ in range(rng.choice([1, 3, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 4, 6])):
                own[rng.randrange(40)] = rng.choice("xyz")
            quotes.append(" ".join("".join(own).split()))
    rng.shuffle(quotes)
    rows = spark.createDataFrame([("p", i, "minor", "c", "l", q, "pass1", i % 3) for i, q in enumerate(quotes)], "paper_id string, ord bigint, severity string, category string, location string, quote string, source_pass string, run_no int")
    rows = rows.withColumns({c: F.lit("") for c in ("description", "correction", "verdict", "url")}).withColumn("stability", F.lit("single_run"))
    kept = [i for i, (q, k) in enumerate(zip(quotes, plain_leaders(quotes))) if q == k and quotes.index(q) == i]
    assert sorted(r["ord"] for r in findings.dedupe(rows.drop("run_no")).collect()) == kept
    order = sorted(range(len(quotes)), key=lambda i: (i % 3, i))
    led = plain_leaders([quotes[i] for i in order])
    seen, first = {}, {}
    for i, k in zip(order, led):
        seen.setdefault(k, set()).add(i % 3)
        first.setdefault(k, i)
    assert {(r["ord"], r["stability"]) for r in findings.merge_runs(rows, 3).collect()} == {(first[k], "stable" if len(seen[k]) == 3 else "unstable") for k in seen}


def test_dedupe_reads_whole_quotes(spark):
    """Quotes alike at the beginning alone are two issues; quotes alike but for the beginning are one."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshr", k=5)) for _ in range(n))
    head, body = prose(30), prose(300)
    quotes = [head + " " + prose(300), head + " " + prose(300), prose(20) + " " + body, prose(20) + " " + body]
    assert len({q[:120] for q in quotes}) == 3
    got = findings.dedupe(table(spark, *[finding(i, quote=q) for i, q in enumerate(quotes)])).collect()
    assert sorted(r["ord"] for r in got) == [0, 1, 2]


def test_dedupe_of_whole_documents(spark):
    d = "/root/testdata/sf0.001"
    want, kept = set(), {}
    rank = {"critical": 1, "major": 2, "minor": 3}
    for r in sorted(catalogue.view(spark, d, catalogue.FINDING).collect(), key=lambda r: (rank[r["severity"]], r["ord"])):
        block = kept.setdefault((r["paper_id"], r["source_pass"], r["category"], r["location"]), [])
        q = " ".join(r["quote"].split()).lower()
        if not any(k == q or k and q and fuzzy.ratio(k, q) >= 88 for k in block):
            block.append(q)
            want.add(r["ord"])
    got = [r["ord"] for r in catalogue.QUERIES["findings_dedupe_fuzzy"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want


def test_classes_of_letters_lose_no_pair(monkeypatch):
    rng, texts = random.Random(7), []
    for n in (0, 3, 50, 400, 2500):
        for _ in range(4):
            base = rng.choices("aaabbcdefgh  ißü\U0001F600", k=n)
            for share in (0, 0.05, 0.11, 0.118, 0.125):
                own = list(base)
                for _ in range(int(n * share)):
                    own[rng.randrange(n)] = rng.choice("xyzabc\ud800")
                texts.append("".join(own))
    i, j = np.triu_indices(len(texts), 1)
    want = {(x, y) for x, y in zip(i.tolist(), j.tolist()) if texts[x] and texts[y] and abs(len(texts[x]) - len(texts[y])) < 400 and fuzzy.ratio(texts[x], texts[y]) >= 88}
    for side_by_side in (1, 10**9):
        monkeypatch.setattr(fuzzy, "SIDE_BY_SIDE", side_by_side)
        known = fuzzy.Texts(texts)
        left = list(zip(*(x.tolist() for x in known.open(i, j, 88.0))))
        assert want <= set(left) and {(x, y) for x, y in left if texts[x] and texts[y] and known.reaches(x, y, 88.0)} == want and len(left) < len(i) // 4


def test_job_registry_keeps_legal_steps_and_recent_jobs(spark, tmp_path):
    """Illegal steps are rejected, replayed events change nothing, the oldest jobs give way, and a silent running job fails."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda s: f"2024-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"
    event = lambda registry, job, offset, status, s: {"registry": registry, "job_id": job, "offset": offset, "status": status, "message": "", "ts": at(s)}
    lots = [
        [event("a", "j1", 0, "queued", 0), event("a", "j1", 1, "running", 1), event("a", "j1", 2, "running", 2), event("a", "j1", 3, "done", 3), event("a", "j1", 4, "running", 4), event("a", "j2", 0, "running", 5), event("b", "j1", 0, "queued", 1)],
        [event("a", "j1", 1, "running", 1), event("a", "j3", 0, "queued", 6), event("a", "j4", 0, "queued", 7), event("a", "j4", 1, "running", 8), event("a", "j4", 3, "done", 9)],
        [event("b", "j9", 0, "queued", 4000)],
        [event("b", "j8", 0, "queued", 8000)],
    ]
    (tmp_path / "in").mkdir()
    got = []
    for n, lot in enumerate(lots):
        (tmp_path / f"in/{n}.json").write_text("\n".join(map(json.dumps, lot)))
        events = spark.readStream.schema("registry string, " + jobs.PROGRESS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        stream = jobs.registered(events, kept=2, idle_s=3600, delay="10 seconds").writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        stream.processAllAvailable()
        stream.stop()
    outcome = {(r[0], r[1], r[2], r[5]) for r in got}
    assert {("a", "j1", 3, "accepted"), ("a", "j1", 4, "rejected"), ("a", "j2", 0, "rejected"), ("a", "j1", 1, "repeated"), ("a", "j4", 1, "accepted"), ("a", "j4", 3, "rejected"), ("b", "j1", 0, "accepted")} <= outcome
    assert [r[1] for r in got if r[5] == "evicted"] == ["j1", "j1"] and [(r[1], r[3]) for r in got if r[5] == "expired"] == [("j4", "failed")]
    assert len([r for r in got if r[5] == "accepted"]) == 4 + 1 + 3 + 2
