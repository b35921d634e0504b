"""A review from lines to reports, of all papers at once: a graph of stages in which each asks a model for all papers together.

Every stage builds its requests as a table, replies are kept by request hash, and what follows is read from the kept replies. So a
run that was ended goes on where it was, and a stage that is run again asks for nothing that is known."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import captions, findings, model_calls, payloads, references, report, sections, spelling
from marginalia.schemas import FINDINGS, REPLIES, struct
from marginalia.storage import stored

PASSES = ("pass0", "pass1", "pass2", "pass3", "pass4", "synthesis")


@dataclass(frozen=True)
class Means:
    """What a review may use. ask: requests to their outcomes (RESULT of model_calls), as model_calls.run() gives them. replies: the
    folder in which these are kept. lookup: references to records(paper_id, ref_index, and the columns of BIB_RECORDS), a row for
    each that was looked up; None where no lookup is there. search: queries(query) to results, or None. lexicon(word, frequency), and
    language where it holds several."""

    ask: Callable[[DataFrame], DataFrame]
    replies: str
    lexicon: DataFrame
    lookup: Callable[[DataFrame], DataFrame] | None = None
    search: Callable[[DataFrame], DataFrame] | None = None
    repeats: int = 1
    passes: tuple[str, ...] = PASSES
    batch: int = 10
    limits: dict[str, int] = field(default_factory=dict)

    def limit(self, name: str) -> int:
        return self.limits.get(name, payloads.LIMITS[name])


@dataclass(frozen=True)
class Review:
    """What a review leaves: tables with paper_id. outputs(paper_id, source_pass, json) are the passes' outputs as they are kept."""

    sections: DataFrame
    captions: DataFrame
    references: DataFrame
    candidates: DataFrame
    findings: DataFrame
    checks: DataFrame
    outputs: DataFrame
    limitations: DataFrame
    reports: DataFrame
    calls: DataFrame


def cited(lines: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """Captions and references of papers whose sections are found."""
    caps = stored(captions.with_mentions(captions.captions(lines), captions.mentions(lines, found)), "captions")
    return {"sections": found, "captions": caps, "references": stored(references.citing_sentences(references.references(found), found), "references")}


def extracted(lines: DataFrame, papers: DataFrame, found: DataFrame, lexicon: DataFrame, languages: DataFrame | None = None) -> dict[str, DataFrame]:
    """What can be read out of papers whose sections are found."""
    parts = cited(lines, found)
    words = spelling.candidates(found, spelling.allowlist(papers, parts["references"]), lexicon, languages=languages)
    return parts | {"tables": stored(captions.table_windows(lines, parts["captions"]), "tables"), "candidates": stored(words, "candidates")}


def _typed(replies: DataFrame, schema: str) -> DataFrame:
    """Replies that came out well, with reply as the schema's struct."""
    return replies.where("json is not null").withColumn("reply", F.from_json("json", REPLIES[schema]))


def _notes(df: DataFrame, source: str, column: str = "limitation") -> DataFrame:
    return df.select("paper_id", F.lit(source).alias("source_pass"), F.lit(1_000_000).cast("bigint").alias("entry"), F.array(column).alias("limitations"))


def _none(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


#: What stands for a run without a lookup, and for papers that can't be checked.
NO_LOOKUP = "No reference lookup tool was available (reason: no_search_tool). A human should search each entry's title and DOI, confirm authors, year and venue, and check Retraction Watch and the publisher page for retraction notices."
NO_BIBLIOGRAPHY = "No bibliography could be extracted from the PDF; reference verification was skipped."
NO_INTRODUCTION = "Introduction/background sections were not identified, so missing citations were not checked."
NO_MISSING = "The missing-citation check failed to produce valid output."
NO_SEARCH = "No web-search tool was available (reason: no_search_tool). A human should run the suggested query for each claim above and confirm it against an authoritative source."
NO_CLAIMS = "Claim extraction failed; no external fact-checking was done."
NO_VERIFY = "The verification call failed; claims were carried through unverified."


def _mechanical(means: Means, replies: model_calls.Replies, parts: dict[str, DataFrame], inventories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of pass 1 and its replies(paper_id, attempt, entry, reply). A reply without a section's name takes the section's."""
    asked = payloads.pass1(parts["sections"], parts["captions"], parts["candidates"], inventories, means.limit("section"))
    own = _typed(replies.ask(payloads.repeated(asked, means.repeats)), "pass1")
    names = parts["sections"].select("paper_id", "section_idx", F.col("label").alias("_section"))
    own = own.join(names, ["paper_id", "section_idx"]).withColumn("reply", F.col("reply").withField("section", F.when(F.col("reply.section") == "", F.col("_section")).otherwise(F.col("reply.section"))))
    own = stored(own.select("paper_id", "attempt", F.col("section_idx").cast("bigint").alias("entry"), "reply"), "pass1")
    return _runs(own, findings.from_pass1, means.repeats), own


def _runs(own: DataFrame, rule: Callable[[DataFrame], DataFrame], repeats: int) -> DataFrame:
    """Findings of each attempt by a rule, merged over attempts."""
    runs = [rule(own.where(F.col("attempt") == n)).withColumn("run_no", F.lit(n - 1)) for n in range(1, repeats + 1)]
    both = functools.reduce(DataFrame.unionByName, runs)
    return stored(findings.merge_runs(both.drop("run_no") if repeats == 1 else both, repeats), "merged")


def _verified_references(means: Means, replies: model_calls.Replies, parts: dict[str, DataFrame], papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checks, missing citations, notes) of pass 3. Where no lookup is there, references stay unverified and nothing is asked of
    them; batches whose call failed do as well."""
    refs, found = parts["references"], parts["sections"]
    cited = refs.select("paper_id", F.col("ord").alias("place"), "ref_index", "citing_sentences")
    notes = [_notes(papers.join(refs, "paper_id", "left_anti").select("paper_id", F.lit(NO_BIBLIOGRAPHY).alias("limitation")), "pass3")]
    if means.lookup is None:
        checks = references.unverified(refs)
        notes.append(_notes(refs.select("paper_id").distinct().withColumn("limitation", F.lit(NO_LOOKUP)), "pass3"))
    else:
        records = stored(means.lookup(refs), "records")
        batched = stored(references.batches(references.with_records(refs, records), means.batch), "batches")
        answers = replies.ask(payloads.pass3(batched))
        told = _typed(answers, "pass3")
        # what was said of a number counts in the batch that was asked for it
        said = told.select("paper_id", "batch", F.posexplode("reply.references").alias("ord", "c")).select("paper_id", "batch", "ord", F.col("c.index").alias("ref_index"), *[F.col(f"c.{n}").alias(n) for n in ("status", "found_at", "mismatch_details", "supports_claim", "notes")])
        asked = batched.select("paper_id", "batch", F.explode("refs").alias("r")).select("paper_id", "batch", F.col("r.ref_index").alias("ref_index"))
        said = said.join(asked.distinct(), ["paper_id", "batch", "ref_index"])
        lost = answers.where("json is null").select("paper_id", "batch", "label")
        silent = asked.join(lost.select("paper_id", "batch"), ["paper_id", "batch"], "left_semi").select("paper_id", "ref_index").distinct()
        # a batch without an answer is could_not_verify without an address, whatever its records say
        checks = references.reconcile(refs, records.join(silent, ["paper_id", "ref_index"], "left_anti"), said)
        notes.append(_notes(lost.select("paper_id", F.concat(F.lit("References "), F.substring_index("label", " ", -1), F.lit(": the model call failed; entries were marked could_not_verify.")).alias("limitation")), "pass3"))
        notes.append(told.select("paper_id", F.lit("pass3").alias("source_pass"), F.col("batch").cast("bigint").alias("entry"), "reply.limitations"))
    location = F.coalesce(F.get(F.col("citing_sentences"), 0)["location"], F.lit(""))
    checks = stored(checks.join(cited, ["paper_id", "ref_index"]).select(*[c for c in checks.columns if c != "place"], F.col("place").alias("ord"), "citing_sentences", location.alias("location")), "checks")
    answers = replies.ask(payloads.pass3_missing(found, means.lookup is not None, means.limit("section")))
    told = _typed(answers, "pass3")
    missing = told.select("paper_id", F.posexplode("reply.missing_citations").alias("ord", "m")).select("paper_id", F.col("ord").cast("bigint").alias("ord"), "m.*")
    kept, dropped = references.missing_citations(missing)
    notes.append(_notes(papers.join(answers, "paper_id", "left_anti").select("paper_id", F.lit(NO_INTRODUCTION).alias("limitation")), "pass3"))
    notes.append(_notes(answers.where("json is null").select("paper_id", F.lit(NO_MISSING).alias("limitation")), "pass3"))
    notes.append(told.select("paper_id", F.lit("pass3").alias("source_pass"), F.lit(500_000).cast("bigint").alias("entry"), "reply.limitations"))
    notes.append(_notes(dropped.where("dropped > 0").select("paper_id", F.concat(F.col("dropped").cast("string"), F.lit(" reported missing citations were discarded because the quoted sentence already carries a citation marker.")).alias("limitation")), "pass3"))
    return checks, stored(kept, "missing"), functools.reduce(DataFrame.unionByName, notes)


def _facts(means: Means, replies: model_calls.Replies, parts: dict[str, DataFrame], papers: DataFrame, inventories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fact checks, engagement, notes) of pass 4: claims are extracted, searched and verified; addresses that no search gave go."""
    spark = papers.sparkSession
    answers = replies.ask(payloads.pass4_claims(papers, parts["sections"], inventories, means.limit("section")))
    told = _typed(answers, "pass4_claims")
    claims = stored(told.select("paper_id", F.posexplode("reply.claims").alias("ord", "c")).select("paper_id", F.col("ord").cast("bigint").alias("ord"), "c.*"), "claims")
    main = told.select("paper_id", "reply.main_result_query")
    none = "paper_id string, ord bigint, work string, url string, why_relevant string"
    notes = [_notes(answers.where("json is null").select("paper_id", F.lit(NO_CLAIMS).alias("limitation")), "pass4")]
    if means.search is None:
        notes.append(_notes(told.select("paper_id", F.lit(NO_SEARCH).alias("limitation")), "pass4"))
        related = F.concat(F.lit('Related-work coverage was not checked. A human should search "'), "main_result_query", F.lit('" for work the paper does not engage with.'))
        notes.append(_notes(main.where("main_result_query <> ''").select("paper_id", related.alias("limitation")), "pass4").withColumn("entry", F.col("entry") + 1))
        return stored(payloads.without_search(claims), "facts"), _none(spark, none), functools.reduce(DataFrame.unionByName, notes)
    results = stored(means.search(payloads.wanted_searches(claims, main)), "results")
    searched = stored(payloads.searched_claims(claims, results), "searched")
    verified = replies.ask(payloads.pass4_verify(searched, main, results))
    said = _typed(verified, "pass4")
    lost = verified.where("json is null").select("paper_id")
    facts = said.select("paper_id", F.posexplode("reply.fact_checks").alias("ord", "c")).select("paper_id", F.col("ord").cast("bigint").alias("ord"), "c.*")
    facts = facts.unionByName(payloads.without_search(claims.join(lost, "paper_id", "left_semi")).select(facts.columns))
    engagement = said.select("paper_id", F.posexplode("reply.missing_engagement").alias("ord", "c")).select("paper_id", F.col("ord").cast("bigint").alias("ord"), "c.*")
    urls = searched.select("paper_id", F.explode("results.url").alias("url")).unionByName(main.join(results, F.col("main_result_query") == F.col("query")).where("rank <= 5").select("paper_id", "url"))
    facts, engagement = findings.keep_supplied_urls(facts, engagement, urls)
    notes += [_notes(lost.withColumn("limitation", F.lit(NO_VERIFY)), "pass4"), said.select("paper_id", F.lit("pass4").alias("source_pass"), F.lit(0).cast("bigint").alias("entry"), "reply.limitations")]
    notes.append(_notes(payloads.dropped_claims(claims).join(lost, "paper_id", "left_anti"), "pass4"))
    return stored(facts, "facts"), stored(engagement, "engagement"), functools.reduce(DataFrame.unionByName, notes)


def _gathered(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    rows = df.groupBy("paper_id").agg(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col(value).alias("x"))).alias("l"))
    first = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    return rows.select("paper_id", F.transform(F.array_sort("l", first), lambda r: r["x"]).alias(name))


def _outputs(papers: DataFrame, means: Means, inventories: DataFrame, one: DataFrame | None, two: DataFrame | None, three: tuple | None, four: tuple | None) -> DataFrame:
    """(paper_id, outputs): all that the passes gave, as payloads.OUTPUTS or REPEATED says."""
    kind = payloads.OUTPUTS if means.repeats == 1 else payloads.REPEATED
    all_ = papers.select("paper_id").join(inventories.select("paper_id", F.col("reply").alias("pass0")), "paper_id", "left")
    runs = lambda df: _gathered(_gathered(df.withColumn("paper_id", F.struct("paper_id", "attempt")), ["entry"], "reply", "r").select("paper_id.paper_id", "paper_id.attempt", "r"), ["attempt"], "r", "runs")
    if one is not None:
        own = runs(one)
        own = own.select("paper_id", (F.element_at("runs", 1) if means.repeats == 1 else F.struct("runs")).alias("pass1"))
        all_ = all_.join(own, "paper_id", "left")
    if two is not None:
        own = runs(two).withColumn("runs", F.flatten("runs"))
        all_ = all_.join(own.select("paper_id", (F.element_at("runs", 1) if means.repeats == 1 else F.struct("runs")).alias("pass2")), "paper_id", "left")
    if three is not None:
        checks, missing, notes = three
        refs = checks.select("paper_id", "ord", F.struct(F.col("ref_index").alias("index"), "raw", "status", "found_at", "mismatch_details", "citing_sentences", "supports_claim", "notes").alias("x"))
        lacking = missing.select("paper_id", "ord", F.struct("quote", "location", "why_needed").alias("x"))
        all_ = all_.join(_gathered(refs.withColumn("i", F.col("x.index")), ["i", "ord"], "x", "r3"), "paper_id", "left").join(_gathered(lacking, ["ord"], "x", "m3"), "paper_id", "left").join(_limits(notes, "l3"), "paper_id", "left")
        all_ = all_.withColumn("pass3", F.struct("l3", F.lit(means.lookup is not None), "r3", "m3").cast(REPLIES["pass3"])).drop("l3", "r3", "m3")
    if four is not None:
        facts, engagement, notes = four
        said = facts.select("paper_id", "ord", F.struct("claim_quote", "location", "source_url", "source_says", "verdict").alias("x"))
        more = engagement.select("paper_id", "ord", F.struct("work", "url", "why_relevant").alias("x"))
        all_ = all_.join(_gathered(said, ["ord"], "x", "f4"), "paper_id", "left").join(_gathered(more, ["ord"], "x", "e4"), "paper_id", "left").join(_limits(notes, "l4"), "paper_id", "left")
        all_ = all_.withColumn("pass4", F.struct("l4", F.lit(means.search is not None), "f4", "e4").cast(REPLIES["pass4"])).drop("l4", "f4", "e4")
    for name in PASSES[:-1]:
        if name not in all_.columns:
            all_ = all_.withColumn(name, F.lit(None))
    return stored(all_.select("paper_id", F.struct(*PASSES[:-1]).cast(struct(kind)).alias("outputs")), "outputs")


def _limits(notes: DataFrame, name: str) -> DataFrame:
    return _gathered(notes.select("paper_id", "entry", F.posexplode("limitations").alias("pos", "l")), ["entry", "pos", "l"], "l", name)


def review(spark: SparkSession, lines: DataFrame, papers: DataFrame, means: Means) -> Review:
    """lines as in LINES and papers(paper_id, text, page_count, metadata map) to all that a review gives.

    Pass 0 takes inventory, and sections are split anew where it anchors as many; pass 1 checks each section and pass 2 what agrees
    within the paper, both `repeats` times; pass 3 verifies references, pass 4 facts. Findings are merged, and a model writes the
    report, or the rules do where it gives none. Passes that are not among means.passes are left out with what they give."""
    replies = model_calls.Replies(spark, means.replies, means.ask)
    found = stored(sections.sections(lines), "sections")
    inventories = _none(spark, f"paper_id string, reply {REPLIES['pass0']}")
    if "pass0" not in means.passes:
        parts = extracted(lines, papers, found, means.lexicon)
    else:
        # words and tables wait for the sections that pass 0 may split anew
        parts = cited(lines, found)
        asked = replies.ask(payloads.pass0(papers, found, parts["captions"], parts["references"], means.limit("pass0")))
        inventories = stored(_typed(asked, "pass0").select("paper_id", "reply"), "inventories")
        wanted = inventories.select("paper_id", F.posexplode("reply.sections").alias("ord", "s")).select("paper_id", "ord", "s.number", "s.title")
        found = stored(sections.accept_resplit(found, sections.resplit(lines, wanted)), "sections")
        parts = extracted(lines, papers, found, means.lexicon, inventories.select("paper_id", F.col("reply.language").alias("language")))
    given: list[DataFrame] = []
    one = two = three = four = None
    notes = [inventories.select("paper_id", F.lit("pass0").alias("source_pass"), F.lit(0).cast("bigint").alias("entry"), "reply.limitations")]
    if "pass1" in means.passes:
        out, one = _mechanical(means, replies, parts, inventories)
        given.append(out)
        notes.append(one.select("paper_id", F.lit("pass1").alias("source_pass"), (F.col("attempt") * 100_000 + F.col("entry")).cast("bigint").alias("entry"), "reply.limitations"))
    if "pass2" in means.passes:
        asked = payloads.pass2(papers, found, parts["tables"], inventories, means.limit("section"))
        two = _typed(replies.ask(payloads.repeated(asked, means.repeats)), "pass2").select("paper_id", "attempt", F.lit(0).cast("bigint").alias("entry"), "reply")
        two = stored(two, "pass2")
        given.append(_runs(two, findings.from_pass2, means.repeats))
        notes.append(two.select("paper_id", F.lit("pass2").alias("source_pass"), F.col("attempt").cast("bigint").alias("entry"), "reply.limitations"))
    if "pass3" in means.passes:
        three = _verified_references(means, replies, parts, papers)
        given.append(findings.from_pass3(three[0], three[1]))
        notes.append(three[2])
    if "pass4" in means.passes:
        four = _facts(means, replies, parts, papers, inventories)
        given.append(findings.from_pass4(four[0], four[1]))
        notes.append(four[2])
    issues = _none(spark, FINDINGS)
    if given:
        issues = stored(findings.dedupe(findings.union_passes(*given)), "findings")
    outputs = _outputs(papers, means, inventories, one, two, three, four)
    checks = three[0] if three else _none(spark, "paper_id string, ref_index int, raw string, status string, found_at string, mismatch_details string, supports_claim string, notes string, ord bigint")
    limits = stored(findings.limitations(functools.reduce(DataFrame.unionByName, notes)), "limitations")
    reports = _reports(means, replies, papers, issues, checks, outputs, limits, two, four)
    flat = outputs.select("paper_id", F.explode(F.create_map(*[x for n in PASSES[:-1] for x in (F.lit(n), F.to_json(F.col(f"outputs.{n}")))])).alias("source_pass", "json")).where("json is not null")
    return Review(found, parts["captions"], parts["references"], parts["candidates"], issues, checks, flat, limits, reports, replies.kept())


def _reports(means: Means, replies: model_calls.Replies, papers: DataFrame, issues: DataFrame, checks: DataFrame, outputs: DataFrame, limits: DataFrame, two: DataFrame | None, four: tuple | None) -> DataFrame:
    """(paper_id, report, by_model): the model's report, or else the one that the rules write."""
    spark = papers.sparkSession
    numbers = _none(spark, "paper_id string, ord bigint, quantity string, verdict string")
    if two is not None:
        numbers = two.select("paper_id", "attempt", F.posexplode("reply.number_checks").alias("pos", "n")).select("paper_id", (F.col("attempt") * 1_000_000 + F.col("pos")).cast("bigint").alias("ord"), "n.quantity", "n.verdict")
    facts = four[0] if four else _none(spark, "paper_id string, verdict string")
    ran = F.concat(F.lit("- Passes run: "), F.lit(", ".join(p for p in PASSES if p in means.passes) or "none"))
    available = means.lookup is not None or means.search is not None
    coverage = papers.select("paper_id", F.posexplode(F.array(ran, F.lit(f"- Search tool available: {available}"))).alias("place", "line")).withColumn("place", F.col("place").cast("bigint"))
    told = limits.select("paper_id", (F.col("place") + 10).alias("place"), F.concat(F.lit("- "), "source_pass", F.lit(" limitation: "), "limitation").alias("line"))
    language = outputs.select("paper_id", F.coalesce("outputs.pass0.language", F.lit("unknown")).alias("language"))
    own = report.fallback_report(papers, issues, checks, report.unverifiable(numbers, checks, facts), coverage.unionByName(told), language)
    if "synthesis" not in means.passes:
        return stored(own.withColumn("by_model", F.lit(False)), "reports")
    said = replies.ask(payloads.synthesis(findings.ordered(issues), report.audit_lines(checks), outputs)).select("paper_id", F.col("text").alias("said"))
    best = F.trim(F.coalesce("said", F.lit(""))) != ""
    return stored(own.join(said, "paper_id", "left").select("paper_id", F.when(best, F.col("said")).otherwise(F.col("report")).alias("report"), best.alias("by_model")), "reports")
