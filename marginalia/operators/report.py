"""Report lines, audits and tables for export, as ordered rows or one text for each paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import cell, collapse
from marginalia.operators.findings import ordered

#: Columns of exported files.
EXPORT = ["pass", "severity", "category", "location", "quote", "description", "correction", "verdict", "url", "stability"]
PAPER_EXPORT = ["paper", "run_id", "truth_findings", "model_findings", "matched", "missed", "spurious", "precision", "recall", "f1", "severity_agreement", "error"]
#: How a reference's status is shown.
AUDIT = {"verified": "verified", "metadata_mismatch": "metadata mismatch", "not_found": "not found", "retracted": "RETRACTED", "could_not_verify": "could not verify"}
MARKS = {"verified": "OK", "metadata_mismatch": "MISMATCH", "not_found": "NOT FOUND", "retracted": "RETRACTED", "could_not_verify": "UNVERIFIED"}


def export(found: DataFrame) -> DataFrame:
    """paper_id and the columns of a findings file."""
    return found.withColumn("pass", F.col("source_pass")).withColumns({"quote": collapse(F.col("quote")), "description": collapse(F.col("description"))}).select("paper_id", *EXPORT)


def paper_export(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Scores of papers and their runs(paper_id, run_id, error) in the columns of a calibration file."""
    r3 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 3).alias(c)
    n = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    all_ = runs.join(scores, "paper_id", "left")
    return all_.select(F.col("paper_id").alias("paper"), "run_id", n(F.col("tp") + F.col("fn"), "truth_findings"), n(F.col("tp") + F.col("fp"), "model_findings"), n(F.col("tp"), "matched"), n(F.col("fn"), "missed"), n(F.col("fp"), "spurious"), r3("precision"), r3("recall"), r3("f1"), r3("severity_agreement"), F.coalesce("error", F.lit("")).alias("error"))


def verdict_lines(found: DataFrame) -> DataFrame:
    """(paper_id, line): how many serious findings there are, and the first of them in order."""
    first = lambda s: F.min_by(F.when(F.col("severity") == s, F.col("description")), F.when(F.col("severity") == s, F.col("ord")))
    n = lambda s: F.count_if(F.col("severity") == s)
    a = found.groupBy("paper_id").agg(n("critical").alias("c"), n("major").alias("m"), F.count(F.lit(1)).alias("n"), first("critical").alias("fc"), first("major").alias("fm"))
    line = F.when(F.col("c") > 0, F.format_string("%d critical and %d major findings were reported. The most serious: %s", "c", "m", "fc"))
    line = line.when(F.col("m") > 0, F.format_string("No critical findings. %d major findings were reported. The most serious: %s", "m", "fm"))
    return a.select("paper_id", line.otherwise(F.format_string("No critical or major findings. %d findings in total, all minor.", "n")).alias("line"))


def _shown(names: dict[str, str], default: str):
    return F.coalesce(*[F.when(F.col("status") == k, v) for k, v in names.items()], F.lit(default))


def audit_lines(checks: DataFrame) -> DataFrame:
    """(paper_id, ref_index, line): one line for each reference, in words; details unless it is verified."""
    detail = F.when(F.coalesce("mismatch_details", F.lit("")) == "", F.coalesce("notes", F.lit(""))).otherwise(F.col("mismatch_details"))
    line = F.concat(F.lit("- ["), F.col("ref_index").cast("string"), F.lit("] "), _shown(AUDIT, "unknown"), F.lit(": "), F.substring("raw", 1, 160))
    line = F.concat(line, F.when(F.coalesce("found_at", F.lit("")) != "", F.concat(F.lit(" ("), "found_at", F.lit(")"))).otherwise(""))
    return checks.select("paper_id", "ref_index", F.concat(line, F.when((detail != "") & (F.col("status") != "verified"), F.concat(F.lit(" - "), F.substring(detail, 1, 200))).otherwise("")).alias("line"))


def unverifiable(numbers: DataFrame, checks: DataFrame, facts: DataFrame) -> DataFrame:
    """(paper_id, place, line): number checks one by one, references and claims as counts, where nothing could be verified."""
    open_ = lambda c="verdict": F.col(c) == "could_not_verify"
    a = numbers.where(open_()).select("paper_id", F.lit(1).alias("part"), "ord", F.concat(F.lit("Pass 2 number check: "), "quantity").alias("line"))
    b = checks.where(open_("status")).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).select("paper_id", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.format_string("Pass 3: %d bibliography entries could not be verified; search each title and DOI by hand.", "n").alias("line"))
    c = facts.where(open_()).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).select("paper_id", F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.format_string("Pass 4: %d external claims could not be verified.", "n").alias("line"))
    both = a.unionByName(b).unionByName(c)
    return both.select("paper_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("part", "ord")).cast("bigint").alias("place"), "line")


def _joined(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    return rows.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias(name))


def fallback_report(papers: DataFrame, found: DataFrame, checks: DataFrame, open_items: DataFrame, coverage: DataFrame, languages: DataFrame) -> DataFrame:
    """(paper_id, report): for each of papers(paper_id) the Markdown report built from data alone. coverage(paper_id, place, line) is
    the last part; languages(paper_id, language) is what pass 0 reported."""
    placed = ordered(found).withColumn("ord", F.col("place"))
    sev = F.concat("severity", F.when(F.col("stability") == "unstable", " (unstable)").otherwise(""))
    table = placed.select("paper_id", "place", F.concat(F.lit("| "), sev, F.lit(" | "), cell(F.col("location")), F.lit(" | "), cell(F.col("description")), F.lit(" | "), F.when(F.col("url") != "", F.col("url")).otherwise(cell(F.col("quote"))), F.lit(" |")).alias("line"))
    detail = F.when(F.coalesce("mismatch_details", F.lit("")) == "", F.coalesce("notes", F.lit(""))).otherwise(F.col("mismatch_details"))
    refs = checks.select("paper_id", "ref_index", F.rtrim(F.concat(F.lit("- ["), F.col("ref_index").cast("string"), F.lit("] "), _shown(MARKS, "?"), F.lit(" - "), F.substring("raw", 1, 180), F.lit(" "), detail)).alias("line"))
    words = found.groupBy("paper_id").agg(F.count_if(F.col("category") == "spelling").alias("typos"), F.count_if(F.col("category") == "language").alias("lang"))
    parts = papers.select("paper_id").join(verdict_lines(placed).withColumnRenamed("line", "verdict"), "paper_id", "left").join(_joined(table, ["place"], "table"), "paper_id", "left").join(_joined(refs, ["ref_index"], "refs"), "paper_id", "left").join(words, "paper_id", "left")
    items = open_items.select("paper_id", "place", F.concat(F.lit("- "), "line").alias("line"))
    parts = parts.join(_joined(items, ["place"], "open"), "paper_id", "left").join(_joined(coverage, ["place"], "coverage"), "paper_id", "left").join(languages.select("paper_id", "language"), "paper_id", "left")
    head = "# Review report\n\n> The synthesis call did not return a report. This is the deterministic fallback, built from the pass outputs.\n\n## 1. Verdict\n\n"
    count = lambda name: F.coalesce(name, F.lit(0)).cast("string")
    text = F.concat(
        F.lit(head), F.coalesce("verdict", F.lit("No critical or major findings. 0 findings in total, all minor.")), F.lit("\n\n## 2. Findings\n\n| Severity | Location | Description | Evidence |\n| --- | --- | --- | --- |\n"), F.coalesce("table", F.lit("| - | - | No findings were reported. | - |")),
        F.lit("\n\n## 3. Reference audit\n\n"), F.coalesce("refs", F.lit("- No bibliography entries were checked.")),
        F.lit("\n\n## 4. Spelling and language\n\n- Confirmed typos: "), count("typos"), F.lit("\n- Language and consistency findings: "), count("lang"), F.lit("\n- Language variant reported by Pass 0: "), F.coalesce("language", F.lit("unknown")),
        F.lit("\n\n## 5. Unverifiable items\n\n"), F.coalesce("open", F.lit("- None recorded.")), F.lit("\n\n## 6. Pass coverage\n\n"), F.coalesce("coverage", F.lit("- Passes run: none")),
    )
    return parts.select("paper_id", text.alias("report"))


def calibration_report(overall: DataFrame, listed: DataFrame, most: int = 60) -> DataFrame:
    """(place, line): a Markdown table of scores by dimension, then at most `most` missed or spurious findings of each kind.
    overall: dimension, value, tp, fp, fn, precision, recall, f1; listed: tag, paper_id, ord, description."""
    score = overall.select(F.lit(1).alias("part"), F.when(F.col("dimension") == "overall", 0).when(F.col("dimension") == "severity", 1).otherwise(2).alias("a"), (-F.col("tp")).cast("bigint").alias("b"), "value", F.concat(F.lit("| "), F.concat_ws(" | ", "dimension", "value", *[F.col(c).cast("string") for c in ("tp", "fp", "fn")], *[F.format_number(c, 3) for c in ("precision", "recall", "f1")]), F.lit(" |")).alias("line"))
    nth = F.row_number().over(Window.partitionBy("tag").orderBy("paper_id", "ord"))
    rest = listed.withColumn("nth", nth).where(F.col("nth") <= most).select(F.lit(2).alias("part"), F.when(F.col("tag") == "fn", 0).otherwise(1).alias("a"), F.col("nth").cast("bigint").alias("b"), F.col("paper_id").alias("value"), F.concat(F.lit("- "), "tag", F.lit(" "), "paper_id", F.lit(": "), cell(F.col("description"))).alias("line"))
    return score.unionByName(rest).orderBy("part", "a", "b", "value").select("part", "a", "b", "line")
