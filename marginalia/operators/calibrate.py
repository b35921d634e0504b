"""Agreement of predicted with human findings: pair scores, one-to-one matches, precision and recall by dimension.

Findings of a paper that read alike are one text with several members; texts are scored and matched, members only counted off."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.fuzzy import PAIR_THRESHOLD, scored_blocks
from marginalia.functions.text import collapse
from marginalia.storage import freed, stored

#: Texts of one side of a paper that meet in one task, at most about.
BLOCK = 1_000
#: What may be matched in one task: as many pairs of members, whatever paper they are of.
LAST_PAIRS = 200_000


def texts(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (paper_id, name, quote, location, description, n) of findings and their members (paper_id, name, nth, ord), nth
    from 0 in order of ord. A text is named by its first member."""
    clean = lambda c: F.lower(collapse(F.coalesce(c, F.lit(""))))
    rows = found.select("paper_id", F.col("ord").cast("bigint").alias("ord"), clean("quote").alias("quote"), F.lower(F.coalesce("location", F.lit(""))).alias("location"), clean("description").alias("description"))
    same = ["paper_id", "quote", "location", "description"]
    each = stored(rows.groupBy(*same).agg(F.array_sort(F.collect_list("ord")).alias("own")).withColumn(name, F.get("own", 0)), f"texts-{name}")
    return each.select(*same, name, F.size("own").alias("n")), each.select("paper_id", name, F.posexplode("own").alias("nth", "ord"))


def pairs(truth: DataFrame, predicted: DataFrame, threshold: float = PAIR_THRESHOLD) -> DataFrame:
    """(paper_id, t, p, score) of the texts(paper_id, t or p, quote, location, description) of a paper that reach the threshold.

    A paper's texts meet in blocks of bounded size, in which bounds from common words, lengths and letters settle all but a few
    pairs before any string is compared. No pair is written that does not reach the threshold."""

    def dealt(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        size = df.groupBy("paper_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias(f"{name}_blocks"))
        return df.select("paper_id", name, "quote", "location", "description").join(size, "paper_id").withColumn(f"{name}_block", F.pmod(F.xxhash64(name), F.col(f"{name}_blocks")).cast("int")), size

    (t, t_size), (p, p_size) = dealt(truth, "t"), dealt(predicted, "p")
    t = t.drop("t_blocks").join(p_size, "paper_id").withColumn("p_block", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1))).drop("p_blocks")
    p = p.drop("p_blocks").join(t_size, "paper_id").withColumn("t_block", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1))).drop("t_blocks")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = scored_blocks(*[[df[c].tolist() for c in ("quote", "location", "description")] for df in (left, right)], threshold)
        rows = [(left["paper_id"].iat[i], int(left["t"].iat[i]), int(right["p"].iat[j]), s) for i, j, s in found]
        return pd.DataFrame(rows, columns=["paper_id", "t", "p", "score"])

    key = ["paper_id", "t_block", "p_block"]
    return t.groupBy(*key).cogroup(p.groupBy(*key)).applyInPandas(meet, "paper_id string, t bigint, p bigint, score double")


def match(truth: DataFrame, predicted: DataFrame, threshold: float = PAIR_THRESHOLD) -> DataFrame:
    """(paper_id, t, p, score): of all pairs of findings of a paper that reach the threshold the best, then the best of what is
    left; ties by t, then p. t and p are the findings' ord."""
    (t, t_members), (p, p_members) = texts(truth, "t"), texts(predicted, "p")
    return assigned(stored(pairs(t, p, threshold), "pairs"), t_members, p_members)


def assign(scored: DataFrame) -> DataFrame:
    """Of the scored pairs(paper_id, t, p, score) of each paper the best, then the best of what is left; ties by t, then p."""
    own = stored(scored.select("paper_id", F.col("t").cast("bigint").alias("t"), F.col("p").cast("bigint").alias("p"), "score"), "pairs")
    members = lambda name: own.select("paper_id", name, F.lit(0).alias("nth"), F.col(name).alias("ord")).distinct()
    return assigned(own, members("t"), members("p"))


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["score", "t", "p"], ascending=[False, True, True])
    used_t, used_p, keep = set(), set(), []
    for i, t, p in zip(rows.index, rows["t"], rows["p"], strict=True):
        if t not in used_t and p not in used_p:
            used_t.add(t)
            used_p.add(p)
            keep.append(i)
    return rows.loc[keep]


_EDGE = ["paper_id", "t", "p"]


def _chained(edges: DataFrame, best: DataFrame, sure: DataFrame) -> DataFrame:
    """The pairs that follow from sure ones along chains: a pair with one better neighbour alone is matched just if that one is not.
    Such pairs point at that neighbour; jumping doubles the reach of the pointers, and counts whether they went an odd number of
    steps, until they show pairs that point nowhere. Only texts with one member left take part, and edges has best_t and best_p."""
    alone = (F.col("t_left") == 1) & (F.col("p_left") == 1)
    second = lambda k, order: best.where(F.col(f"best_{k}") != F.col("p" if k == "t" else "t")).groupBy("paper_id", k).agg(F.min(F.struct(*order)).alias("m"))
    s_t = second("t", [(-F.col("score")).alias("s"), "p_head", "p"]).select("paper_id", "t", F.col("m.p").alias("second_t"))
    s_p = second("p", [(-F.col("score")).alias("s"), "t_head", "t"]).select("paper_id", "p", F.col("m.t").alias("second_p"))
    rows = best.where(alone).join(s_t, ["paper_id", "t"], "left").join(s_p, ["paper_id", "p"], "left")
    by_t = (F.col("best_p") == F.col("t")) & (F.col("second_t") == F.col("p"))
    by_p = (F.col("best_t") == F.col("p")) & (F.col("second_p") == F.col("t"))
    chain = rows.where(by_t | by_p).select(*_EDGE, F.when(by_t, F.struct("t", F.col("best_t").alias("p"))).otherwise(F.struct(F.col("best_p").alias("t"), "p")).alias("to"), F.lit(True).alias("odd"))
    # the better neighbour must have one member of each side left as well
    single = best.where(alone).select("paper_id", F.struct("t", "p").alias("to"))
    chain = stored(chain.join(single, ["paper_id", "to"], "left_semi").select(*_EDGE, "to", "odd"), "chain")
    while True:
        on = chain.select("paper_id", F.struct("t", "p").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
        jump = stored(chain.join(on, ["paper_id", "to"], "left").select(*_EDGE, F.coalesce("next", "to").alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("next").isNotNull().alias("moved")), "chain")
        freed(chain)
        chain = jump
        if chain.where("moved").isEmpty():
            break
    ends = sure.where(alone).select("paper_id", F.struct("t", "p").alias("to"))
    return chain.where("not odd").join(ends, ["paper_id", "to"], "left_semi").select(*_EDGE)


def assigned(scored: DataFrame, t_members: DataFrame, p_members: DataFrame) -> DataFrame:
    """assign() for texts with members(paper_id, t or p, nth, ord): scored pairs of texts stand for all pairs of their members, which
    are never written.

    A pair of texts that is the best one of both, by score and then by the first members left, is matched whatever else there is:
    as many members as both have left, if no other pair of either scores the same, else the first of each. Rounds take all such
    pairs at once; where they get on slowly, chains of pairs in which each waits for the one before are settled together. What
    has no more than LAST_PAIRS pairs of members is matched in one task for each paper."""
    side = lambda members, k: members.groupBy("paper_id", k).agg(F.count(F.lit(1)).alias(f"{k}_left"), F.min("ord").alias(f"{k}_head")).withColumn(f"{k}_used", F.lit(0))
    edges = scored.select(*_EDGE, "score").join(side(t_members, "t"), ["paper_id", "t"]).join(side(p_members, "p"), ["paper_id", "p"])
    edges = stored(edges, "edges")
    names, done, slow = edges.columns, [], False
    for _ in itertools.count():
        size = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("t_left") * F.col("p_left")), F.lit(0))).first()
        if size[1] <= LAST_PAIRS:
            break
        of_t = edges.groupBy("paper_id", "t").agg(F.min(F.struct((-F.col("score")).alias("s"), "p_head", "p")).alias("m")).select("paper_id", "t", F.col("m.p").alias("best_t"))
        of_p = edges.groupBy("paper_id", "p").agg(F.min(F.struct((-F.col("score")).alias("s"), "t_head", "t")).alias("m")).select("paper_id", "p", F.col("m.t").alias("best_p"))
        best = stored(edges.join(of_t, ["paper_id", "t"]).join(of_p, ["paper_id", "p"]), "best")
        sure = best.where("best_t = p and best_p = t")
        # where both have several members left, all of them go together only if no other pair has this score
        many = sure.where("t_left > 1 and p_left > 1")
        ties = lambda k: edges.join(many.select("paper_id", k, F.col("score").alias("_s")), ["paper_id", k]).where("score = _s").groupBy("paper_id", k).agg(F.count(F.lit(1)).alias(f"ties_{k}"))
        k = F.when((F.coalesce("ties_t", F.lit(2)) == 1) & (F.coalesce("ties_p", F.lit(2)) == 1), F.least("t_left", "p_left")).otherwise(1)
        now = sure.join(ties("t"), ["paper_id", "t"], "left").join(ties("p"), ["paper_id", "p"], "left").select(*_EDGE, "score", "t_used", "p_used", k.cast("bigint").alias("k"))
        if slow:
            more = _chained(edges, best, sure)
            now = now.unionByName(best.join(more, _EDGE, "left_semi").select(*_EDGE, "score", "t_used", "p_used", F.lit(1).cast("bigint").alias("k")))
        now = stored(now, "matches")
        done.append(now)

        def left(df: DataFrame, taken: DataFrame, k: str, members: DataFrame) -> DataFrame:
            spent = taken.select("paper_id", k, F.col("k").alias("_k"))
            df = df.join(spent, ["paper_id", k], "left").withColumn("_k", F.coalesce("_k", F.lit(0))).where(F.col(f"{k}_left") > F.col("_k"))
            df = df.withColumns({f"{k}_left": F.col(f"{k}_left") - F.col("_k"), f"{k}_used": (F.col(f"{k}_used") + F.col("_k")).cast("int")})
            used = taken.select("paper_id", k, (F.col(f"{k}_used") + F.col("k")).alias("nth"))
            heads = used.join(members, ["paper_id", k, "nth"]).select("paper_id", k, F.col("ord").alias("_head"))
            df = df.join(heads, ["paper_id", k], "left")
            return df.withColumn(f"{k}_head", F.coalesce("_head", f"{k}_head")).drop("_k", "_head")

        rest = stored(left(left(edges, now, "t", t_members), now, "p", p_members).select(names), "edges")
        slow = rest.count() > 0.75 * size[0]
        freed(best, edges)
        edges = rest
    own = lambda members, k: members.select("paper_id", k, "nth", F.col("ord").alias(f"{k}_ord"))
    last = edges.join(own(t_members, "t"), ["paper_id", "t"]).where("nth >= t_used").drop("nth").join(own(p_members, "p"), ["paper_id", "p"]).where("nth >= p_used")
    out = last.select("paper_id", F.col("t_ord").alias("t"), F.col("p_ord").alias("p"), "score").groupBy("paper_id").applyInPandas(_greedy, "paper_id string, t bigint, p bigint, score double")
    for now in done:
        each = now.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
        each = each.withColumns({"t_nth": (F.col("t_used") + F.col("i")).cast("int"), "p_nth": (F.col("p_used") + F.col("i")).cast("int")})
        each = each.join(own(t_members, "t").withColumnRenamed("nth", "t_nth"), ["paper_id", "t", "t_nth"]).join(own(p_members, "p").withColumnRenamed("nth", "p_nth"), ["paper_id", "p", "p_nth"])
        out = out.unionByName(each.select("paper_id", F.col("t_ord").alias("t"), F.col("p_ord").alias("p"), "score"))
    return out


def tagged(truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each match (tp), missed truth (fn) and spurious prediction (fp), with the severity and category of the truth,
    or of the prediction for fp, the pass of the prediction, and whether severities agree."""
    side = lambda df, k: df.select("paper_id", F.col("ord").alias(k), F.col("severity").alias(f"{k}_severity"), F.col("category").alias(f"{k}_category"), F.col("source_pass").alias(f"{k}_pass"))
    t, p = side(truth, "t"), side(predicted, "p")
    tp = matches.join(t, ["paper_id", "t"]).join(p, ["paper_id", "p"]).select("paper_id", F.lit("tp").alias("tag"), F.col("t_severity").alias("severity"), F.col("t_category").alias("category"), F.col("p_pass").alias("source_pass"), (F.col("t_severity") == F.col("p_severity")).alias("agrees"))
    none = F.lit(None).cast("boolean").alias("agrees")
    fn = t.join(matches, ["paper_id", "t"], "left_anti").select("paper_id", F.lit("fn").alias("tag"), F.col("t_severity").alias("severity"), F.col("t_category").alias("category"), F.lit(None).cast("string").alias("source_pass"), none)
    fp = p.join(matches, ["paper_id", "p"], "left_anti").select("paper_id", F.lit("fp").alias("tag"), F.col("p_severity").alias("severity"), F.col("p_category").alias("category"), F.col("p_pass").alias("source_pass"), none)
    out = tp.unionByName(fn).unionByName(fp)
    return out.withColumns({"category": F.when(F.coalesce("category", F.lit("")) == "", "uncategorised").otherwise(F.lower("category")), "source_pass": F.when(F.col("tag") == "fn", None).otherwise(F.when(F.coalesce("source_pass", F.lit("")) == "", "unknown").otherwise(F.col("source_pass")))})


def listed(truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """(tag, paper_id, ord, description): missed findings of the truth (fn), and predicted ones that are none of its (fp)."""
    side = lambda df, k, tag: df.select("paper_id", F.col("ord").alias(k), "description").join(matches, ["paper_id", k], "left_anti").select(F.lit(tag).alias("tag"), "paper_id", F.col(k).alias("ord"), "description")
    return side(truth, "t", "fn").unionByName(side(predicted, "p", "fp"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("tag") == k).alias(k) for k in ("tp", "fp", "fn")]


def with_rates(df: DataFrame) -> DataFrame:
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    df = df.withColumns({"precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("tp") + F.col("fn"))})
    return df.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_dimension(rows: DataFrame) -> DataFrame:
    """Counts and rates overall, by severity and by category, in one aggregation."""
    named = F.when(F.grouping("severity") == 0, "severity").when(F.grouping("category") == 0, "category").otherwise("overall")
    sets = rows.groupingSets([[], ["severity"], ["category"]], "severity", "category").agg(named.alias("dimension"), *_counts())
    return with_rates(sets.select("dimension", F.coalesce("severity", "category", F.lit("")).alias("value"), "tp", "fp", "fn"))


def by_pass(rows: DataFrame) -> DataFrame:
    return with_rates(rows.where("tag <> 'fn'").groupBy("source_pass").agg(*_counts()))


def by_paper(rows: DataFrame) -> DataFrame:
    agreement = F.coalesce(F.try_divide(F.count_if("agrees"), F.count_if(F.col("tag") == "tp")), F.lit(0.0)).alias("severity_agreement")
    return with_rates(rows.groupBy("paper_id").agg(*_counts(), agreement))


def without_failed(rows: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of papers that ran, and the papers(paper_id, error) that did not, which are listed but never scored."""
    failed = papers.where("coalesce(error, '') <> ''")
    return rows.join(failed, "paper_id", "left_anti"), failed
