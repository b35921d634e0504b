"""Files that reviews read and write: papers, human findings, run logs, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import normalise, short_hash, slug, strip
from marginalia.schemas import LINES, RUNS, SEVERITIES

UPLOAD_BYTES = 64 * 1024 * 1024
LEAST_TEXT = 200
TRUTH_SUFFIXES = (".review.json", ".findings.json")


def papers(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, length, sha256, content) of PDF files within the size limit that begin as PDF files do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    ok = files.where((F.col("length") <= UPLOAD_BYTES) & (F.substring("content", 1, 4) == F.lit(b"%PDF")))
    return ok.select("path", stem(F.col("path")).alias("stem"), "length", F.sha2("content", 256).alias("sha256"), "content")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.pdf|\.review\.json|\.findings\.json)?$", 1)


def lines_of(files: DataFrame, parse: Callable[[bytes], list[tuple[str, int, float, bool, float, float]]]) -> DataFrame:
    """Lines of papers, by a parser of PDF content that returns (text, page, size, bold, x0, y0) in order. Any library may be
    behind it; none is needed here. Papers with less than 200 characters of text give no line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, content in zip(b["stem"], b["content"], strict=True):
                found = [x for x in parse(content) if x[0].strip()]
                if sum(len(x[0]) for x in found) >= LEAST_TEXT:
                    yield pd.DataFrame([(key, i, *x) for i, x in enumerate(found)], columns=[c.split()[0] for c in LINES.split(", ")])

    return files.select("stem", "content").mapInPandas(run, LINES)


def lines_of_spans(spans: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """Lines from spans(paper_id, page, block, line, span, text, size, flags, x0, y0), x0 and y0 being the line's: the texts of a line's
    spans joined and normalised, the largest size, bold by the largest flags. Lines without text are left out and do not count in
    line_no, and so are papers with less than `least` characters, which textless() lists."""
    key = ["paper_id", "page", "block", "line"]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "")
    rows = spans.groupBy(*key).agg(joined.alias("text"), F.round(F.max("size"), 2).alias("size"), F.coalesce(F.max("flags"), F.lit(0)).alias("flags"), F.round(F.min("x0"), 1).alias("x0"), F.round(F.min("y0"), 1).alias("y0"))
    rows = rows.withColumn("text", normalise(F.col("text"))).where("text <> ''")
    total = F.sum(F.length("text")).over(Window.partitionBy("paper_id"))
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy("page", "block", "line")) - 1
    rows = rows.withColumns({"total": total, "line_no": nth}).where(F.col("total") >= least)
    return rows.select("paper_id", F.col("line_no").cast("int").alias("line_no"), "text", F.col("page").cast("int").alias("page"), F.col("size").cast("double").alias("size"), (F.col("flags").bitwiseAND(F.lit(16)) > 0).alias("bold"), F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"))


def textless(papers_: DataFrame, lines: DataFrame) -> DataFrame:
    """(paper_id, error) of papers(paper_id) that gave no line."""
    return papers_.join(lines, "paper_id", "left_anti").select("paper_id", F.lit("almost no extractable text: probably a scan, which needs character recognition first").alias("error"))


def body_size(lines: DataFrame) -> DataFrame:
    """(paper_id, body_size): the median of type sizes, each as often as its line has characters; 10 for a paper without any."""
    return lines.groupBy("paper_id").agg(F.coalesce(F.percentile("size", 0.5, F.length("text").cast("int")), F.lit(10.0)).alias("body_size"))


def truth_pairs(files: DataFrame) -> DataFrame:
    """(stem, pdf, review) of files(path): each paper with its human review, .review.json before .findings.json."""
    pdf = files.where(F.col("path").endswith(".pdf")).select(stem(F.col("path")).alias("stem"), F.col("path").alias("pdf"))
    rank = F.coalesce(*[F.when(F.col("path").endswith(s), i) for i, s in enumerate(TRUTH_SUFFIXES)])
    reviews = files.withColumn("rank", rank).where("rank is not null").groupBy(stem(F.col("path")).alias("stem")).agg(F.min_by("path", "rank").alias("review"))
    return pdf.join(reviews, "stem")


def truth_findings(texts: DataFrame) -> DataFrame:
    """Findings of reviews(paper_id, text): a JSON object, whose findings may be absent, or a bare list. A text that is neither,
    findings that are no list, an entry that is no object, or a severity that is none of the three ends the query with an error
    that names the paper. Severity defaults to major, and 'pass' goes before 'source_pass'."""
    v = F.try_parse_json("text")
    bare, whole = F.schema_of_variant(v).startswith("ARRAY"), F.schema_of_variant(v).startswith("OBJECT")
    inner = F.try_variant_get(v, "$.findings", "variant")
    none = F.array().cast("array<variant>")
    items = F.when(bare, F.try_variant_get(v, "$", "array<variant>")).when(whole & inner.isNull(), none).when(whole, F.try_variant_get(v, "$.findings", "array<variant>"))
    checked = F.coalesce(items, F.raise_error(F.concat(F.lit("no findings in the review of "), "paper_id")).cast("array<variant>"))
    rows = texts.select("paper_id", F.posexplode(checked).alias("pos", "x"))
    text = lambda path, default="": F.coalesce(F.try_variant_get("x", path, "string"), F.lit(default))
    told = F.when(F.schema_of_variant("x").startswith("OBJECT"), text("$.severity", "major")).otherwise(F.raise_error(F.format_string("entry %d of the review of %s is no object", F.col("pos") + 1, "paper_id")).cast("string"))
    severity = F.when(told.isin(*SEVERITIES), told).otherwise(F.raise_error(F.format_string("entry %d of the review of %s has the severity '%s', which is none of critical, major, minor", F.col("pos") + 1, "paper_id", told)).cast("string"))
    source = F.coalesce(F.try_variant_get("x", "$.pass", "string"), F.try_variant_get("x", "$.source_pass", "string"), F.lit(""))
    return rows.select("paper_id", F.col("pos").cast("bigint").alias("ord"), severity.alias("severity"), strip(text("$.category")).alias("category"), *[text(f"$.{c}").alias(c) for c in ("location", "quote", "description", "correction")], source.alias("source_pass"), F.lit("").alias("verdict"), text("$.url").alias("url"), F.lit("single_run").alias("stability"))


def truth_notes(texts: DataFrame) -> DataFrame:
    """(paper_id, notes) of reviews(paper_id, text); empty where a review has none or is a bare list."""
    return texts.select("paper_id", F.coalesce(F.try_variant_get(F.try_parse_json("text"), "$.notes", "string"), F.lit("")).alias("notes"))


#: An example of a human review.
TEMPLATE = '{"paper": "%s", "notes": "", "findings": [{"severity": "major", "category": "numbers", "location": "Abstract", "quote": "verbatim text", "description": "what is wrong", "correction": ""}, {"severity": "minor", "category": "spelling", "location": "", "quote": "", "description": "", "correction": ""}]}'


def write_template(spark: SparkSession, path: str, paper: str) -> None:
    """An example review to fill in; an error if path exists."""
    spark.createDataFrame([(TEMPLATE % paper,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a log of JSON lines, with line, which sorts them as they stand there: by file, then by place in it. Blank and
    broken lines are skipped."""
    rows = spark.read.schema(RUNS).option("mode", "DROPMALFORMED").json(path).withColumn("line", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")))
    return rows.where("run_id is not null").withColumn("slug", slug(F.col("paper")))


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def history(runs: DataFrame, stored_runs: DataFrame, limit: int) -> DataFrame:
    """The runs that stand last in the log (line) first, each with whether stored_runs(paper_slug, run_id) holds its results."""
    have = stored_runs.select(F.col("paper_slug").alias("slug"), "run_id").distinct().withColumn("available", F.lit(True))
    return runs.join(have, ["slug", "run_id"], "left").fillna(False, ["available"]).orderBy(F.desc("line")).limit(limit)


def flattened(outputs: DataFrame) -> DataFrame:
    """(paper_id, source_pass, place, json) of stored outputs(paper_id, source_pass, json): an object alone, a list, or an object
    with the list 'runs', each of which may hold the others. place is the way down as an array. What is neither an object nor a
    list is left out."""
    left = outputs.select("paper_id", "source_pass", F.array().cast("array<int>").alias("place"), F.try_parse_json("json").alias("v"))
    done = None
    while True:
        listed, kind = F.try_variant_get("v", "$.runs", "array<variant>"), F.schema_of_variant("v")
        inner = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(kind.startswith("OBJECT"), listed)
        step = left.withColumn("inner", inner)
        plain = step.where(F.col("inner").isNull() & kind.startswith("OBJECT")).select("paper_id", "source_pass", "place", F.to_json("v").alias("json"))
        done = plain if done is None else done.unionByName(plain)
        # each turn goes one level down, of which stored outputs have three or four
        left = step.where("inner is not null").select("paper_id", "source_pass", "place", F.posexplode("inner").alias("pos", "v")).select("paper_id", "source_pass", F.concat("place", F.array("pos")).alias("place"), "v")
        if left.isEmpty():
            return done


def latest_runs(found: DataFrame, pointers: DataFrame) -> DataFrame:
    """(paper_slug, run_id): the run that pointers names, if its results are there, else the last by name."""
    p = pointers.select("paper_slug", F.col("run_id").alias("named")).dropDuplicates(["paper_slug"])
    first = Window.partitionBy("paper_slug").orderBy(F.coalesce(F.col("run_id") == F.col("named"), F.lit(False)).desc(), F.desc("run_id"))
    return found.select("paper_slug", "run_id").distinct().join(p, "paper_slug", "left").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("paper_slug", "run_id")


def write_findings(found: DataFrame, path: str) -> None:
    """Findings as CSV below paper and run."""
    from marginalia.operators.report import EXPORT

    found.select("paper_slug", "run_id", *EXPORT).write.mode("overwrite").option("header", True).partitionBy("paper_slug", "run_id").csv(path)


def write_artefacts(rows: DataFrame, path: str) -> None:
    """Pass outputs, extraction and findings as JSON below paper and run."""
    rows.write.mode("overwrite").partitionBy("paper_slug", "run_id").json(path)


def extraction(papers_: DataFrame, sections: DataFrame, captions: DataFrame, refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(paper_id, json): what was read out of each paper. Candidates hang on section labels; of equal labels the last stays."""
    nest = lambda df, name, *cols: df.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    words = candidates.groupBy("paper_id", "section_idx").agg(F.array_sort(F.collect_list(F.struct("token", "sentence", "location", "occurrences"))).alias("w"))
    labels = sections.join(words, ["paper_id", "section_idx"], "left").groupBy("paper_id", "label").agg(F.max_by("w", "section_idx").alias("w")).where("w is not null")
    maps = labels.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("candidates"))
    all_ = papers_.select("paper_id", "page_count")
    for part in (nest(sections, "sections", "section_idx", "number", "title", "kind", "start_page", "end_page"), nest(captions, "captions", "id", "caption", "page", "referenced_in_text"), nest(refs, "references", "ref_index", "raw", "doi", "title", "year", "authors"), maps):
        all_ = all_.join(part, "paper_id", "left")
    return all_.select("paper_id", F.to_json(F.struct("page_count", "sections", "captions", "references", "candidates")).alias("json"))


def prompts(spark: SparkSession, path: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """(name, text, hash) of the Markdown files of a folder but those named in leave_out; the hash has 16 digits."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    rows = files.select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("name"), strip(F.col("value")).alias("text"), short_hash(F.col("value")).alias("hash"))
    return rows.where(~F.col("name").isin(*leave_out)) if leave_out else rows


def prompt_version(spark: SparkSession, path: str) -> DataFrame:
    """(version): what the file VERSION of a folder of prompts says, or unknown."""
    found = spark.read.option("pathGlobFilter", "VERSION").text(path, wholetext=True).select(strip(F.col("value")).alias("version"))
    return found.agg(F.coalesce(F.first("version"), F.lit("unknown")).alias("version"))
