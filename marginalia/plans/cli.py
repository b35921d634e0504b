"""Thin commands over the operators: extract, review, calibrate, history, query, models, init-review, config-show."""

from __future__ import annotations

import argparse
import functools
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import join_lines
from marginalia.operators import calibrate, model_calls, report, sections
from marginalia.plans import review
from marginalia.sources import config, files
from marginalia.storage import stored


def _session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Sections, captions and references of a table of lines, as JSON below the output folder."""
    lines, papers = _papers(spark, args.lines)
    found = stored(sections.sections(lines), "sections")
    parts = review.extracted(lines, papers, found, spark.read.parquet(args.lexicon))
    files.extraction(papers, found, parts["captions"], parts["references"], parts["candidates"]).write.mode("overwrite").json(args.out)


def _papers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines, and papers(paper_id, text, page_count, metadata) made from them."""
    lines = spark.read.parquet(path)
    text = join_lines(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]))
    return lines, lines.groupBy("paper_id").agg(text.alias("text"), F.max("page").alias("page_count")).withColumn("metadata", F.lit(None).cast("map<string,string>"))


def _named(place: str):
    """What 'package.module:name' stands for."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def review_(spark: SparkSession, args: argparse.Namespace) -> None:
    """A whole review of a table of lines, below the output folder. --client names a function without arguments that makes a model
    client; --prompts is a folder of prompts. A run that was ended goes on with the replies that are kept there."""
    lines, papers = _papers(spark, args.lines)
    settings = config.load(args.config)
    texts = {r["name"]: r["text"] for r in files.prompts(spark, args.prompts).collect()} if args.prompts else {}
    models = dict(settings.models) or {"default": "default"}
    ask = functools.partial(model_calls.run, make_client=_named(args.client), model=models if "default" in models else models | {"default": next(iter(models.values()))}, system=texts.get("system", ""), prompts=texts)
    passes = (*config.passes(args.only), *([] if args.only else ["synthesis"]))
    got = review.review(spark, lines, papers, review.Means(ask=ask, replies=f"{args.out}/replies", lexicon=spark.read.parquet(args.lexicon), repeats=args.repeats, passes=passes, batch=settings.pass3_batch_size))
    report.export(got.findings).write.mode("overwrite").option("header", True).csv(f"{args.out}/findings")
    for name in ("outputs", "reports", "limitations", "checks"):
        getattr(got, name).write.mode("overwrite").json(f"{args.out}/{name}")


def models(spark: SparkSession, args: argparse.Namespace) -> None:
    """The models of a table(ord, id, type), and the one that is taken where none is named."""
    found = spark.read.json(args.models)
    found.orderBy("ord").show(args.limit, False)
    model_calls.pick_model(found).show(1, False)


def init_review(spark: SparkSession, args: argparse.Namespace) -> None:
    """An example of a human review, to be filled in."""
    files.write_template(spark, args.out, args.paper)


def calibrate_(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scores of a table of findings against a folder of human reviews, and a report."""
    texts = spark.read.text(args.reviews, wholetext=True).select(files.stem(F.col("_metadata.file_path")).alias("paper_id"), F.col("value").alias("text"))
    truth, predicted = files.truth_findings(texts), spark.read.parquet(args.findings)
    matches = stored(calibrate.match(truth, predicted), "matches")
    rows = stored(calibrate.tagged(truth, predicted, matches), "tagged")
    calibrate.by_paper(rows).write.mode("overwrite").option("header", True).csv(f"{args.out}/papers")
    overall = calibrate.by_dimension(rows)
    report.calibration_report(overall, calibrate.listed(truth, predicted, matches)).select("line").coalesce(1).write.mode("overwrite").text(f"{args.out}/report")


def history(spark: SparkSession, args: argparse.Namespace) -> None:
    none = spark.createDataFrame([], "paper_slug string, run_id string")
    files.history(files.run_log(spark, args.log), none, args.limit).show(args.limit, False)


def query(spark: SparkSession, args: argparse.Namespace) -> None:
    from marginalia.plans import catalogue

    catalogue.QUERIES[args.name](spark, args.tables).show(args.limit, False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    parser.add_argument("--config", help="settings in TOML")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, function, options in (
        ("extract", extract, ["lines", "lexicon", "out"]), ("calibrate", calibrate_, ["findings", "reviews", "out"]), ("history", history, ["log"]), ("query", query, ["name", "tables"]),
        ("review", review_, ["lines", "lexicon", "out"]), ("models", models, ["models"]), ("init-review", init_review, ["paper", "out"]),
    ):
        command = commands.add_parser(name, help=function.__doc__)
        for option in options:
            command.add_argument(option)
        command.add_argument("--limit", type=int, default=20)
        if name == "review":
            command.add_argument("--client", required=True)
            command.add_argument("--prompts")
            command.add_argument("--only")
            command.add_argument("--repeats", type=int, default=1)
        command.set_defaults(run=function)
    show = commands.add_parser("config-show")
    show.set_defaults(run=None)
    args = parser.parse_args(argv)
    settings = config.load(args.config)
    if args.run is None:
        print(settings)
        return
    args.run(_session(f"marginalia {args.command}"), args)


if __name__ == "__main__":
    main()
