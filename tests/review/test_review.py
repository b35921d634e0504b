"""A whole review with a client that answers from a script: stages, artefacts, a run that goes on, and what no tool can check."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import affixes
from marginalia.operators import model_calls
from marginalia.plans import review
from marginalia.schemas import BIB_RECORDS, SEARCH_RESULTS
from marginalia.sources import files

BODY = "The store keeps ninety percent of all keys in memory and it writes the rest to a log on disk, which is read again when the process begins anew. "
PAPER = f"""A Study of Stores
Abstract
We report a hit rate of 31.4% over 240 traces. {BODY * 2}
1 Introduction
Stores matter (Belady et al., 1966). {BODY} It is known that stores fail. See [1, 2]. This allready helps. {BODY}
Table 1. Mean latency by policy
LRU 3 ms
2 Results
The hit rate was 27.2% [2]. As Table 1 shows, it is so. {BODY * 2}
Figure 1: Trend over the years
References
[1] Belady, L. (1966). A study of replacement algorithms for a computer. Systems Journal.
[2] Mattson, R. (1970). Evaluation techniques for storage hierarchies. doi:10.1000/ab.12.
[3] Denning, P. (1968). The working set model for program behavior. CACM."""
SECTIONS = [{"number": "", "title": "Abstract"}, {"number": "1", "title": "Introduction"}, {"number": "2", "title": "Results"}, {"number": "", "title": "References"}]


def said(stage, payload):
    if stage == "pass0":
        return {"language": "en-GB", "title": "A Study", "sections": SECTIONS, "research_questions_or_hypotheses": ["do stores fail?"], "limitations": ["read in parts"]}
    if stage == "pass1":
        title = payload.split("title: ")[1].split("\n")[0]
        return {"section": "", "findings": [{"severity": "minor", "category": "grammar", "quote": "it writes", "description": f"in {title}"}], "spellcheck_triage": [{"token": "allready", "classification": "typo", "correction": "already"}] if "allready" in payload.split("SPELLCHECKER")[1] else []}
    if stage == "pass2":
        return {"number_checks": [{"quantity": "hit rate", "values": ["31.4%", "27.2%"], "locations": ["Abstract", "2 Results"], "verdict": "verified_incorrect"}, {"quantity": "traces", "verdict": "could_not_verify"}]}
    if stage == "pass3:refs":
        entries = json.loads(payload.split("===\n")[1].split("\n\nThe `lookup")[0])
        return {"references": [{"index": e["index"], "status": "verified", "supports_claim": "weaker" if e["index"] == 1 else "yes", "notes": "Seen."} for e in entries]}
    if stage == "pass3:missing":
        return {"missing_citations": [{"quote": "It is known that stores fail.", "location": "1", "why_needed": "A fact."}, {"quote": "Shown in [1].", "location": "1"}]}
    if stage == "pass4:claims":
        return {"claims": [{"claim_quote": f"claim {i}", "location": "p. 1", "search_query": f"q{i}"} for i in range(27)], "main_result_query": "stores"}
    assert stage == "pass4:verify"
    return {"fact_checks": [{"claim_quote": "claim 0", "source_url": "https://u.org/q0", "source_says": "no", "verdict": "verified_incorrect"}, {"claim_quote": "claim 1", "source_url": "https://made.up/", "source_says": "no", "verdict": "verified_incorrect"}], "missing_engagement": [{"work": "W", "url": "https://u.org/stores"}, {"work": "V", "url": "https://made.up/"}]}


class Bench:
    """Means of a review over two papers, and what was asked."""

    def __init__(self, spark, path, silent=(), **more):
        self.spark, self.asked, self.silent = spark, [], silent
        texts = {"a": PAPER, "b": PAPER.replace("240", "480")}
        rows = [(p, i, t, 1 + i // 6) for p, text in texts.items() for i, t in enumerate(text.split("\n"))]
        self.lines = spark.createDataFrame(rows, "paper_id string, line_no int, text string, page int")
        self.papers = spark.createDataFrame([(p, t, 3, {"title": p}) for p, t in texts.items()], "paper_id string, text string, page_count int, metadata map<string,string>")
        lexicon = spark.createDataFrame([(w, 5, "en") for w in sorted({w.strip(".,()%").lower() for w in PAPER.split()} - {"allready"} | {"already"}) if w], "word string, frequency int, language string")
        self.means = review.Means(ask=self.ask, replies=str(path), lexicon=lexicon, **more)

    def ask(self, requests):
        rows = requests.collect()
        self.asked += [(r["stage"], r["label"], r["attempt"]) for r in rows]
        out = []
        for r in rows:
            text = None if r["stage"] != "synthesis" else "# Review report\nby the model"
            body = None if r["stage"] in ("synthesis", *self.silent) else json.dumps(json.loads(model_calls.parse(json.dumps(said(r["stage"], r["payload"])), model_calls.struct(model_calls.REPLIES[review.payloads.STAGES[r["stage"]][3]]))[0]))
            ok = (body or text) is not None and r["stage"] not in self.silent
            out.append((r["request_hash"], r["stage"], r["label"], body, text if ok else None, "m", "json_schema", ok, 1, 1.0, {"tokens": 3}, "" if ok else "down"))
        return self.spark.createDataFrame(out, model_calls.RESULT)

    def run(self):
        return review.review(self.spark, self.lines, self.papers, self.means)


def lookup(found):
    """Finds all but the third reference, and the second as retracted."""

    def records(refs):
        names = ["paper_id", "ref_index", *[c.split()[0] for c in BIB_RECORDS.split(", ")]]
        r = refs.withColumns({"found": F.lit(found) & (F.col("ref_index") < 3), "url": F.concat(F.lit("https://r.org/"), F.col("ref_index").cast("string")), "venue": F.lit(""), "type": F.lit("article"), "is_retracted": F.lit(found) & (F.col("ref_index") == 2), "retraction_notes": F.lit("Withdrawn"), "is_preprint": F.lit(False), "abstract": F.lit("On stores."), "match_score": F.lit(98.0), "source": F.lit("stub")})
        return r.select(names)

    return records


def search(queries):
    return queries.select("query", F.lit(1).alias("rank"), F.col("query").alias("title"), F.concat(F.lit("https://u.org/"), "query").alias("url"), F.lit("said").alias("snippet")).select([c.split()[0] for c in SEARCH_RESULTS.split(", ")])


def by_paper(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.where("paper_id = 'a'").collect()}


def test_review(spark, tmp_path):
    bench = Bench(spark, tmp_path / "replies", lookup=lookup(True), search=search)
    got = bench.run()
    labels = [x for x in bench.asked if x[0] == "pass1"]
    assert {x[1] for x in labels} == {"pass1:Abstract", "pass1:1 Introduction", "pass1:2 Results"}
    # the papers differ in their abstracts; what is equal in both is asked once
    assert len(labels) == 4
    issues = by_paper(got.findings, "source_pass", "category", "severity", "location", "quote")
    assert ("pass1", "grammar", "minor", "2 Results", "it writes") in issues and ("pass1", "spelling", "minor", "1 Introduction", "allready") in issues
    assert ("pass2", "numbers", "major", "Abstract; 2 Results", "31.4% vs 27.2%") in issues
    assert {(s, q[:7]) for p, c, s, _, q in issues if c == "reference"} == {("minor", "Belady,"), ("critical", "Mattson"), ("major", "Denning")}
    assert ("pass3", "citation", "major", "1", "It is known that stores fail.") in issues and ("pass4", "external_fact", "major", "", "claim 0") in issues and ("pass4", "missing_engagement", "minor", "", "W") in issues
    assert not any(q in ("claim 1", "V", "Shown in [1].") for *_, q in issues)
    assert by_paper(got.checks, "ref_index", "status", "found_at") == {(1, "verified", "https://r.org/1"), (2, "retracted", "https://r.org/2"), (3, "not_found", "")}
    notes = {r[0] for r in by_paper(got.limitations, "limitation")}
    assert {"read in parts", "2 extracted claims beyond the first 25 were not searched and remain unchecked.", "1 reported missing citations were discarded because the quoted sentence already carries a citation marker."} <= notes
    assert by_paper(got.reports, "report", "by_model") == {("# Review report\nby the model", True)}
    outputs = {p: json.loads(j) for p, j in by_paper(got.outputs, "source_pass", "json")}
    assert set(outputs) == {"pass0", "pass1", "pass2", "pass3", "pass4"} and len(outputs["pass1"]) == 3 and outputs["pass3"]["references"][0]["citing_sentences"] and outputs["pass4"]["search_tool_available"]
    # once more, as after a stop: nothing is asked again, and what is read from the kept replies comes out the same
    n = len(bench.asked)
    bench.means = dataclasses.replace(bench.means, passes=("pass0", "pass2"))
    again = bench.run()
    assert len(bench.asked) == n and by_paper(again.findings, "quote", "description") == by_paper(got.findings.where("source_pass = 'pass2'"), "quote", "description")


def test_repeats_mark_stability(spark, tmp_path):
    bench = Bench(spark, tmp_path, repeats=2, passes=("pass0", "pass1", "pass2"))
    got = bench.run()
    assert {r[0] for r in by_paper(got.findings, "stability")} == {"stable"}
    assert {a for s, _, a in bench.asked if s == "pass2"} == {1, 2}
    outputs = {p: json.loads(j) for p, j in by_paper(got.outputs, "source_pass", "json")}
    assert [len(x) for x in outputs["pass1"]["runs"]] == [3, 3] and len(outputs["pass2"]["runs"]) == 2
    (text, by_model), = by_paper(got.reports, "report", "by_model")
    assert not by_model and "## 2. Findings" in text and "Pass 2 number check: traces" in text and "Language variant reported by Pass 0: en-GB" in text


def test_without_tools_nothing_is_verified(spark, tmp_path):
    got = Bench(spark, tmp_path, passes=("pass0", "pass3", "pass4")).run()
    assert {r[0] for r in by_paper(got.checks, "status")} == {"could_not_verify"} and all(r[0].startswith("no_search_tool") for r in by_paper(got.checks, "notes"))
    outputs = {p: json.loads(j) for p, j in by_paper(got.outputs, "source_pass", "json")}
    assert not outputs["pass3"]["search_tool_available"] and not outputs["pass4"]["search_tool_available"] and any(r["citing_sentences"] for r in outputs["pass3"]["references"])
    assert {c["verdict"] for c in outputs["pass4"]["fact_checks"]} == {"could_not_verify"} and outputs["pass4"]["fact_checks"][0]["source_url"] == ""
    assert sum("no_search_tool" in x for x in outputs["pass3"]["limitations"] + outputs["pass4"]["limitations"]) == 2


@pytest.mark.parametrize("silent", [("pass3:refs", "pass4:claims"), ("pass0", "pass4:verify", "synthesis")])
def test_failed_calls(spark, tmp_path, silent):
    got = Bench(spark, tmp_path, silent, lookup=lookup(False), search=search).run()
    notes = {r[0] for r in by_paper(got.limitations, "limitation")}
    if "pass0" in silent:
        assert "pass0" not in {r[0] for r in by_paper(got.outputs, "source_pass")} and got.findings.count()
    if "pass3:refs" in silent:
        assert "References 1-3: the model call failed; entries were marked could_not_verify." in notes and review.NO_CLAIMS in notes
        assert by_paper(got.checks, "status", "found_at") == {("could_not_verify", "")}
    else:
        # a lookup that finds nothing is evidence
        assert {r[0] for r in by_paper(got.checks, "status")} == {"not_found"}
    if "synthesis" in silent:
        assert review.NO_VERIFY in notes
        (text, by_model), = by_paper(got.reports, "report", "by_model")
        assert not by_model and f"- pass4 limitation: {review.NO_VERIFY}" in text and "27 external claims could not be verified" in text


def test_commands(spark, tmp_path, monkeypatch, capsys):
    """extract, review and init-review over tables and folders; a client that refuses leaves the report of the rules."""
    from marginalia.plans import cli

    bench = Bench(spark, tmp_path / "none")
    bench.lines.where("paper_id = 'a'").write.parquet(f"{tmp_path}/lines")
    bench.means.lexicon.write.parquet(f"{tmp_path}/lexicon")
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts/pass2_consistency.md").write_text("Compare.\n\nAll values.\n")
    (tmp_path / "prompts/whole.md").write_text("all of them")
    (tmp_path / "prompts/VERSION").write_text("1.2\n")
    assert [(r["name"], r["text"]) for r in files.prompts(spark, f"{tmp_path}/prompts", ("whole",)).collect()] == [("pass2_consistency", "Compare.\n\nAll values.")]
    assert files.prompt_version(spark, f"{tmp_path}/prompts").first()["version"] == "1.2"

    class Refuses:  # local, so that it travels to the workers by value
        def chat(self, messages, *, model, response_format):
            raise ConnectionError(messages[1]["content"].split("\n")[0])

    monkeypatch.setattr(cli, "_named", lambda place: Refuses)
    cli.main(["extract", f"{tmp_path}/lines", f"{tmp_path}/lexicon", f"{tmp_path}/extracted"])
    found = json.loads(spark.read.json(f"{tmp_path}/extracted").first()["json"])
    assert len(found["references"]) == 3 and any(c["token"] == "allready" for own in found["candidates"].values() for c in own)
    cli.main(["review", f"{tmp_path}/lines", f"{tmp_path}/lexicon", f"{tmp_path}/out", "--client", "x:y", "--only", "pass2", "--prompts", f"{tmp_path}/prompts"])
    assert "- Passes run: pass2" in spark.read.json(f"{tmp_path}/out/reports").first()["report"]
    assert spark.read.parquet(f"{tmp_path}/out/replies").first()["error"] == "ConnectionError: Compare."
    cli.main(["init-review", "a.pdf", f"{tmp_path}/template"])
    assert json.loads(spark.read.text(f"{tmp_path}/template").first()[0])["paper"] == "a.pdf"
    spark.createDataFrame([(0, "text-embedding", ""), (1, "chat", "llm")], "ord int, id string, type string").write.json(f"{tmp_path}/models")
    cli.main(["models", f"{tmp_path}/models"])
    assert "|chat" in capsys.readouterr().out


def test_dictionaries_with_affixes(spark, tmp_path):
    (tmp_path / "x.aff").write_text("SET UTF-8\nPFX A Y 1\nPFX A   0     re         .\n\nSFX B Y 2\nSFX B   y     ied        [^aeiou]y\nSFX B   0     ed/X       [^ey]\nSFX C N 1\nSFX C 0 ly .\n")
    (tmp_path / "x.dic").write_text("5\nhello\ntry/B\nWork/AB po:verb\nquick/CA\ny/B\n")
    got = {r["word"] for r in affixes.lexicon(spark, f"{tmp_path}/x.aff", f"{tmp_path}/x.dic").collect()}
    assert got == {"hello", "try", "tried", "work", "rework", "worked", "reworked", "quick", "quickly", "requick", "y"}


def test_waves_read_their_own_requests_alone(spark, tmp_path):
    asked, plans = [], []

    def ask(requests):
        plans.append(requests._jdf.queryExecution().toString())
        asked.append([r["request_hash"] for r in requests.collect()])
        none = {c.split()[0]: c.split()[1] for c in model_calls.RESULT.split(", ")}
        rows = requests.withColumns({"json": F.lit("{}"), "ok": F.lit(True), "attempts": F.lit(1)})
        return rows.select(*[rows[c] if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    requests = spark.createDataFrame([(f"h{i % 40}", "pass0", "", f"p{i % 40}") for i in range(50)], "request_hash string, stage string, label string, payload string")
    got = model_calls.Replies(spark, str(tmp_path / "replies"), ask, wave=10).ask(requests)
    assert got.count() == 50 and sorted(sum(asked, [])) == sorted(f"h{i}" for i in range(40)) and len(asked) == 4
    assert all("PartitionFilters: [isnotnull(_wave" in p for p in plans)
