"""Iterative proportional fitting: token weights raked to marginals of source, language and topic, then a calibrated sample.

The corpus is summed to a table of cells (source, language, topic). Raking scales the cells' token weights to one marginal
after the other until all agree. A cell can't give more tokens than it has, so a share is bounded by the cell's tokens over the
wanted tokens; so are the marginals, and what one value can't give is spread over those that have tokens to spare. Every document
is then kept with its cell's probability; the draw is a hash of its id, so that a run can be repeated."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import free_name
from marginalia.storage import freed, stored

#: Cells up to this number are raked in one task without exchanges; of more, sums by value are taken with partial aggregation and
#: joined. The count is taken first.
CELLS_IN_ONE_TASK = 100_000

#: Topics that the registered query tells apart, by marks whose finds are counted. A corpus with topics of its own passes them.
TOPICS = {"licence": ["icense", "icence", "opyright", "arranty"], "contact": ["@", "-555-"], "markup": ["$$$", "###", "***", "&&&", "%%%"]}
#: Token weights that the registered query and the pipeline rake to; None: of each value that is not listed. Sources are not
#: listed: they aim at their tokens to the power 0.5.
TARGETS = {"lang": {"en": 0.50, "de": 0.20, "fr": 0.18, "es": 0.12, None: 0.01}, "topic": {"prose": 0.80, "contact": 0.08, "markup": 0.08, "licence": 0.04}}


def topic_of(text: Column, topics: dict[str, list[str]] = TOPICS, rest: str = "prose") -> Column:
    """The topic whose marks a text holds most often, the first of several; rest where it holds none. A null text holds none."""
    text = F.coalesce(text, F.lit(""))
    found = lambda mark: ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark.encode())).cast("long")
    # replacing by bytes costs less than matching a pattern; a word is found in all its cases by leaving out its first letter
    count = {name: sum((found(m) for m in marks[1:]), found(marks[0])) for name, marks in topics.items()}
    most = F.greatest(*count.values(), F.lit(0))
    out = F.when(most == 0, rest)
    for name, n in count.items():
        out = out.when(n == most, name)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _level(values: DataFrame, reach: float) -> float:
    """The level at which the least of _cap and level * _v sums to reach over all values, found by sums alone: each turn sets
    aside the values that the last level fills, and their number grows until it stays."""
    level, full = 0.0, -1
    while True:
        filled = F.col("_cap") <= F.lit(level) * F.col("_v")
        got = values.agg(F.sum(F.when(filled, F.col("_cap"))).alias("given"), F.sum(F.when(~filled, F.col("_v"))).alias("open"), F.count(F.when(filled, 1)).alias("full")).first()
        if got["full"] == full or not got["open"]:
            return level
        full = got["full"]
        level = max(level, (reach - (got["given"] or 0.0)) / got["open"])


def rake(cells: DataFrame, dims: list[str], targets: dict[str, dict[str | None, float]] | None, temperature: float, budget: float, steps: int = 4, batches: int = 8, tolerance: float = 1e-6) -> DataFrame:
    """cells(dims, tokens) with share, the wanted part of the sample's tokens, and aim_<dim>, the wanted part of its value.

    targets: for a dimension, weights of its values; values that are absent get that of None, or none, and a dimension that is
    absent aims at its tokens to the power of temperature. budget: wanted tokens over all tokens. Aims are at most what a value holds and sum
    to 1, or to the least of what a dimension's wanted values hold. Raking ends once a round of steps sweeps moves no share by
    tolerance, or after `batches` rounds, of which a warning tells: aims that cells can't meet together are then left unmet."""
    cells = stored(cells, "cells")
    small = cells.limit(CELLS_IN_ONE_TASK + 1).count() <= CELLS_IN_ONE_TASK
    together = lambda df: df.coalesce(1) if small else df  # noqa: E731  windows over one partition need no exchange
    weight = {d: F.coalesce(*[F.when(F.col(d) == k, float(x)) for k, x in wanted.items() if k is not None], F.lit(float(wanted.get(None, 0.0)))) for d in dims if (wanted := (targets or {}).get(d))}
    held = cells.agg(F.sum("tokens").alias("n"), *[F.sum(F.when(w > 0, F.col("tokens"))).alias(d) for d, w in weight.items()]).first().asDict()
    whole = max(held["n"] or 0, 1) * float(budget)
    reach = min(1.0, *[(held[k] or 0) / whole for k in ("n", *weight)])
    w = together(cells).withColumns({"share": F.col("tokens") / F.lit(float(max(held["n"] or 0, 1))), "most": F.col("tokens") / F.lit(whole)})
    aims = []
    for d in dims:
        # the values that hold too little for their weight give all, the others what the level gives them
        values = together(cells).groupBy(F.col(d).alias("_of")).agg(F.sum("tokens").alias("_held"))
        value = weight.get(d, F.pow(F.col("_held").cast("double"), float(temperature)))
        values = stored(values.withColumn(d, F.col("_of")).withColumns({"_v": value, "_cap": F.col("_held") / F.lit(whole)}).where("_v > 0").select("_of", "_v", "_cap"), "values")
        even = F.lit(_level(values, reach)) * F.col("_v")
        values = values.select("_of", F.least("_cap", even).alias(f"aim_{d}"), (even >= F.col("_cap") * (1 - 1e-9)).alias(f"_all_{d}"))
        w = w.join(values, w[d].eqNullSafe(values["_of"]), "left").drop("_of").fillna(0.0, [f"aim_{d}"]).fillna(False, [f"_all_{d}"])
        aims.append(f"aim_{d}")
    # the cells of a value that must give all it holds give all they hold
    fixed = F.lit(False)
    for d in dims:
        fixed = fixed | F.col(f"_all_{d}")
    for a in aims:
        fixed = fixed & (F.col(a) > 0)
    w = w.withColumns({"fixed": fixed, "share": F.when(fixed, F.col("most")).otherwise(F.col("share"))}).drop(*[f"_all_{d}" for d in dims])
    state = stored(w, "rake")
    for _ in range(batches):
        w, passed = together(state).withColumn("old", F.col("share")), []
        for d in dims * steps:
            have, sure = (F.coalesce(F.sum(F.when(x, F.col("share"))).over(Window.partitionBy(d)) if small else F.col(name), F.lit(0.0)) for x, name in ((~F.col("fixed"), "_have"), (F.col("fixed"), "_sure")))
            if not small:
                sums = w.groupBy(F.col(d).alias("_of")).agg(*[F.sum(F.when(x, F.col("share"))).alias(name) for x, name in ((~F.col("fixed"), "_have"), (F.col("fixed"), "_sure"))])
                w = w.join(sums, F.col(d).eqNullSafe(F.col("_of")))
            by = F.greatest(F.col(f"aim_{d}") - sure, F.lit(0.0)) / have
            w = w.withColumn("share", F.when(F.col("fixed"), F.col("share")).when(have > 0, F.least(F.col("share") * by, F.col("most"))).otherwise(0.0))
            if not small:
                w = stored(w.drop("_of", "_have", "_sure"), "rake")  # the next sums read it twice
                passed.append(w)
        before, state = state, stored(w, "rake")
        freed(before, *passed)
        moved = state.select(F.max(F.abs(F.col("share") - F.col("old")))).first()[0] or 0.0
        if moved < tolerance:
            break
    else:
        warnings.warn(f"raking has not settled: the last round moved a share by {moved:.2g}", stacklevel=2)
    return state.select(*cells.columns, "share", *aims)


def mix(docs: DataFrame, budget: float = 0.5, targets: dict[str, dict[str | None, float]] | None = None, temperature: float = 0.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """docs with three more columns: tokens (long), probability (double) and kept (boolean).

    budget is the wanted part of all tokens; targets and temperature as in rake(). A cell's probability is its wanted tokens
    over its own, 1 at most. kept draws each id once, by hash: the expected tokens of each source, language and topic are then
    as raked.

    A null source, language or topic counts as the value ''. Documents without words weigh nothing in the raking and are drawn
    with their cell's probability, 0 in a cell without words. Rows that repeat an id share its draw. An empty table gives an
    empty result. Names that docs already has are kept; the new columns then begin with an underscore."""
    own = free_name(docs, "mix_source", "mix_lang", "mix_topic", "tokens", "probability", "kept")
    dims, (n, p, kept) = own[:3], own[3:]
    text = F.col(text_col)
    based = docs.withColumns({dims[0]: F.coalesce(F.col(source_col).cast("string"), F.lit("")), dims[1]: F.coalesce(F.col(lang_col).cast("string"), F.lit("")), dims[2]: F.coalesce(topic if topic is not None else topic_of(text), F.lit("")), n: tokens if tokens is not None else word_count(text)})
    cells = rake(based.groupBy(*dims).agg(F.sum(n).alias("tokens")), dims, dict(zip(dims, [(targets or {}).get(k) for k in ("source", "lang", "topic")], strict=True)), temperature, budget)
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    rates = cells.select(*[F.col(d).alias(f"_{d}") for d in dims], F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("share") * F.lit(total * float(budget)), F.col("tokens")), F.lit(0.0))).alias(p))
    if cells.count() <= CELLS_IN_ONE_TASK:
        rates = F.broadcast(rates)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / F.lit(float(1 << 53))
    joined = based.join(rates, [F.col(d) == F.col(f"_{d}") for d in dims])
    return joined.select(*docs.columns, n, p, (draw < F.col(p)).alias(kept))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    # what the mixture needs of the texts is read off once
    light = stored(docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), word_count(F.col("text")).alias("words")), "mixture")
    out = mix(light.withColumn("text", F.lit("")), targets=TARGETS, topic=F.col("topic"), tokens=F.col("words"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", "probability", "kept")
