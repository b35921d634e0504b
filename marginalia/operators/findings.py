"""Findings: rules that turn checked replies into rows, removal of repeats, agreement between runs, counts and order.

A reply row is one struct of marginalia.schemas.REPLIES with its place: (paper_id, entry, reply)."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.fuzzy import QUOTE_DUPLICATE, Texts, partial_ratio
from marginalia.functions.text import collapse, strip
from marginalia.storage import freed, stored

COLUMNS = ["paper_id", "ord", "severity", "category", "location", "quote", "description", "correction", "source_pass", "verdict", "url", "stability"]


def _or(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(a, F.lit("")) == "", b).otherwise(a)


def _rows(df: DataFrame, source: str, order: list[Column], **values: Column | str) -> DataFrame:
    """df to findings; order gives the place of each row within the source: entry, part of the reply, item, the last two of them
    below a million."""
    keys = [*order, F.lit(0), F.lit(0), F.lit(0)][:3]
    place = (keys[0].cast("bigint") * 1_000_000 + keys[1]) * 1_000_000 + keys[2]
    own = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()} | {"source_pass": F.lit(source), "ord": place}
    return df.select("paper_id", *[F.coalesce(own.get(c, F.lit("single_run" if c == "stability" else "")), F.lit("")).alias(c) if c != "ord" else own[c].alias(c) for c in COLUMNS[1:]])


def from_pass1(replies: DataFrame) -> DataFrame:
    """The reply's findings, then its misspellings and inconsistent spellings; domain terms give none."""
    base = replies.select("paper_id", "entry", F.col("reply.section").alias("section"), F.col("reply.findings").alias("f"), F.col("reply.spellcheck_triage").alias("t"))
    own = base.select("paper_id", "entry", "section", F.posexplode("f").alias("pos", "x"))
    own = _rows(own, "pass1", [F.col("entry"), F.lit(0), F.col("pos")], severity=F.col("x.severity"), category=F.col("x.category"), location=_or(F.col("x.location"), F.col("section")), quote=F.col("x.quote"), description=F.col("x.description"), correction=F.col("x.correction"))
    t = base.select("paper_id", "entry", "section", F.posexplode("t").alias("pos", "x")).where(F.col("x.classification").isin("typo", "inconsistent"))
    typo = F.col("x.classification") == "typo"
    said = F.when(typo, F.concat(F.lit("Misspelling: '"), F.col("x.token"), F.lit("'."))).otherwise(F.concat(F.lit("Inconsistent spelling of '"), F.col("x.token"), F.lit("' across the paper.")))
    words = _rows(t, "pass1", [F.col("entry"), F.lit(1), F.col("pos")], severity="minor", category=F.when(typo, "spelling").otherwise("language"), location=_or(F.col("x.location"), F.col("section")), quote=_or(F.col("x.quote"), F.col("x.token")), description=said, correction=F.col("x.correction"))
    return own.unionByName(words)


@F.pandas_udf(T.BooleanType())
def _near_udf(needles: pd.Series, haystack: pd.Series) -> pd.Series:
    return pd.Series([h is not None and any(partial_ratio(n, h) >= 90 for n in ns) for ns, h in zip(needles, haystack, strict=True)], dtype=bool)


def covered(needles: Column, haystack: Column) -> Column:
    """Whether the small-letter haystack tells of the needles: one of over 25 characters nearly stands in it, or all shorter
    ones do. Blank needles don't count; none at all cover nothing. An exact hit settles a long needle without Python."""
    wanted = F.filter(F.transform(needles, lambda n: F.lower(strip(F.coalesce(n, F.lit(""))))), lambda n: n != "")
    short, long = F.filter(wanted, lambda n: F.length(n) <= 25), F.filter(wanted, lambda n: F.length(n) > 25)
    exact = F.exists(long, lambda n: F.contains(haystack, n))
    unsure = ~exact & (F.size(long) > 0)
    near = _near_udf(F.when(unsure, long), F.when(unsure, haystack))
    return exact | near | ((F.size(short) > 0) & F.forall(short, lambda n: F.contains(haystack, n)))


def _haystack(found: DataFrame) -> DataFrame:
    """One text of all findings of a reply."""
    said = F.concat_ws(" ", "quote", "description", "location")
    return found.groupBy("paper_id", "entry").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("s")))), lambda x: x["s"]), " ")).alias("hay"))


def from_pass2(replies: DataFrame) -> DataFrame:
    """The reply's findings, then failed number checks, then claims without support, each unless what is there covers it: the
    claims look at promoted number checks too."""
    place = lambda df: df.withColumn("entry", F.floor(F.col("ord") / F.lit(10**12)))
    own = replies.select("paper_id", "entry", F.posexplode("reply.findings").alias("pos", "x"))
    own = _rows(own, "pass2", [F.col("entry"), F.lit(0), F.col("pos")], severity=F.col("x.severity"), category=F.col("x.category"), location=F.col("x.location"), quote=F.col("x.quote"), description=F.col("x.description"))
    hay = replies.select("paper_id", "entry").join(_haystack(place(own)), ["paper_id", "entry"], "left").fillna("", ["hay"])
    n = replies.select("paper_id", "entry", F.posexplode("reply.number_checks").alias("pos", "x")).where("x.verdict = 'verified_incorrect'").join(hay, ["paper_id", "entry"])
    n = n.withColumn("values", F.filter("x.values", lambda v: strip(v) != "")).where(~covered(F.concat("values", F.array("x.quantity")), F.col("hay")))
    numbers = _rows(n, "pass2", [F.col("entry"), F.lit(1), F.col("pos")], severity="major", category="numbers", location=F.array_join("x.locations", "; "), quote=_or(F.array_join("values", " vs "), F.col("x.quantity")), description=F.trim(F.concat("x.quantity", F.lit(": the values disagree across locations. "), "x.recomputation")), verdict=F.col("x.verdict"))
    both = own.unionByName(numbers)
    hay2 = replies.select("paper_id", "entry").join(_haystack(place(both)), ["paper_id", "entry"], "left").fillna("", ["hay"])
    c = replies.select("paper_id", "entry", F.posexplode("reply.claim_checks").alias("pos", "x")).where((F.col("x.verdict") != "supported") & (strip(F.col("x.claim_quote")) != "")).join(hay2, ["paper_id", "entry"])
    c = c.where(~covered(F.array("x.claim_quote"), F.col("hay")))
    said = F.trim(F.concat(F.lit("Claim is "), "x.verdict", F.lit(". "), "x.explanation", F.lit(" Supporting evidence found: "), _or(F.col("x.supporting_evidence"), F.lit("none")), F.lit(".")))
    claims = _rows(c, "pass2", [F.col("entry"), F.lit(2), F.col("pos")], severity="major", category="claims", location=F.col("x.location"), quote=F.col("x.claim_quote"), description=said, verdict=F.col("x.verdict"))
    return both.unionByName(claims)


def reference_severity(status: Column, supports: Column) -> Column:
    return F.when(status == "retracted", "critical").when(status.isin("not_found", "metadata_mismatch"), "major").when(supports.isin("different", "unrelated"), "major").when(supports == "weaker", "minor")


def from_pass3(checks: DataFrame, missing: DataFrame) -> DataFrame:
    """checks(paper_id, ord, ref_index, raw, status, found_at, mismatch_details, supports_claim, notes, location) and
    missing(paper_id, ord, quote, location, why_needed)."""
    head = F.concat(F.lit("Reference ["), F.col("ref_index").cast("string"), F.lit("]"))
    status, supports = F.col("status"), F.col("supports_claim")
    told = F.when(status == "retracted", " is retracted. ").when(status == "not_found", " could not be found in a bibliographic database. ").when(status == "metadata_mismatch", " metadata does not match the published record. ")
    told = told.when(supports.isin("different", "unrelated"), F.concat(F.lit(" does not support the claim it is cited for ("), supports, F.lit("). "))).otherwise(" supports a weaker claim than the one it is cited for. ")
    bad = checks.withColumn("sev", reference_severity(status, supports)).where("sev is not null")
    refs = _rows(bad, "pass3", [F.lit(0), F.col("ord")], severity=F.col("sev"), category="reference", location=_or(F.col("location"), head), quote=F.substring("raw", 1, 300), description=F.trim(F.concat(head, told, _or(F.col("mismatch_details"), F.coalesce("notes", F.lit(""))))), verdict=status, url=F.col("found_at"))
    lacking = _rows(missing, "pass3", [F.lit(1), F.col("ord")], severity="major", category="citation", location=F.col("location"), quote=F.col("quote"), description=F.trim(F.concat(F.lit("Claim needs a citation and has none. "), F.coalesce("why_needed", F.lit("")))))
    return refs.unionByName(lacking)


def from_pass4(facts: DataFrame, engagement: DataFrame) -> DataFrame:
    """facts(paper_id, ord, claim_quote, location, source_url, source_says, verdict) and engagement(paper_id, ord, work, url,
    why_relevant)."""
    wrong = _rows(facts.where("verdict = 'verified_incorrect'"), "pass4", [F.lit(0), F.col("ord")], severity="major", category="external_fact", location=F.col("location"), quote=F.col("claim_quote"), description=F.concat(F.lit("Contradicted by an external source: "), F.coalesce("source_says", F.lit(""))), verdict=F.col("verdict"), url=F.col("source_url"))
    return wrong.unionByName(_rows(engagement, "pass4", [F.lit(1), F.col("ord")], severity="minor", category="missing_engagement", quote=F.col("work"), description=F.trim(F.concat(F.lit("Relevant work the paper does not engage with. "), F.coalesce("why_relevant", F.lit("")))), url=F.col("url")))


def keep_supplied_urls(facts: DataFrame, engagement: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses that allowed(paper_id, url) lacks are discarded: a fact loses its verdict with it, an engagement goes."""
    ok = allowed.where("url <> ''").select(F.col("paper_id").alias("_paper"), F.col("url").alias("_url")).distinct().withColumn("_ok", F.lit(True))
    f = facts.join(ok, (F.col("paper_id") == F.col("_paper")) & (F.col("source_url") == F.col("_url")), "left")
    foreign = (F.coalesce("source_url", F.lit("")) != "") & F.col("_ok").isNull()
    says = F.when(foreign, F.trim(F.concat(F.coalesce("source_says", F.lit("")), F.lit(" [url discarded: not in the supplied search results]")))).otherwise(F.col("source_says"))
    f = f.withColumns({"verdict": F.when(foreign, "could_not_verify").otherwise(F.col("verdict")), "source_says": says, "source_url": F.when(foreign, "").otherwise(F.col("source_url"))}).select(*facts.columns)
    e = engagement.join(ok, (F.col("paper_id") == F.col("_paper")) & (F.col("url") == F.col("_url")), "left")
    return f, e.where("coalesce(url, '') = '' or _ok").select(*engagement.columns)


# Repeats and runs -----------------------------------------------------------------------------------------------------------


#: Letters of a quote in the key of exact repeats and of runs.
KEY = 120


def with_key(found: DataFrame, letters: int | None = KEY) -> DataFrame:
    """k_category, k_location, k_quote: findings equal in these and in their pass are the same issue. Of quotes the first letters
    count, or all of them. k_id stands for k_quote."""
    quote = F.lower(collapse(F.col("quote")))
    keyed = found.withColumns({"k_category": F.lower(strip(F.col("category"))), "k_location": F.lower(strip(F.col("location"))), "k_quote": quote if letters is None else F.substring(quote, 1, letters)})
    return keyed.withColumn("k_id", F.coalesce(F.md5("k_quote"), F.lit("")))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(F.lit("critical"), F.lit("major"), F.lit("minor")), severity), F.lit(4)).cast("int")


BLOCK = ["paper_id", "source_pass", "k_category", "k_location"]


def _order() -> list[Column]:
    return [severity_rank(F.col("severity")), F.col("source_pass"), F.col("category"), F.col("location"), F.col("ord")]


def ordered(found: DataFrame) -> DataFrame:
    """found with place (from 1 in each paper): severity, pass, category, location, then as they came."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(*_order())).cast("bigint"))


def _hashed(rows: DataFrame, letters: int | None = KEY) -> DataFrame:
    """paper_id, ord, what orders a finding, and a hash of its key of 128 bits, without any text."""
    key = F.md5(F.to_json(F.struct("source_pass", "k_category", "k_location", "k_quote")))
    return with_key(rows, letters).select(*[c for c in rows.columns if c in ("paper_id", "ord", "run_no", "severity", "source_pass", "category", "location")], key.alias("key"))


def dedupe_exact(found: DataFrame, letters: int | None = KEY) -> DataFrame:
    """The first finding, in order, of each equal key. ord tells the findings of a paper apart. Keys are hashed, so that texts are
    read, but neither sorted nor moved before it is known which stay."""
    first = _hashed(found, letters).groupBy("paper_id", "key").agg(F.min(F.struct(*_order())).alias("m"))
    return found.join(first.select("paper_id", F.col(f"m.{first.schema['m'].dataType.names[-1]}").alias("ord")), ["paper_id", "ord"], "left_semi").select(found.columns)


#: Quotes that are held against those kept at a time, and pairs.
SLICE, PAIRS = 512, 1_000_000


def _firsts(texts: Texts, own: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """For each of own places the first of kept places whose quote is at least 88 alike, or -1."""
    found = {}
    by_size = kept[np.argsort(texts.sizes[kept], kind="stable")]
    sizes = texts.sizes[by_size]
    # quotes that are alike have lengths that are
    reach = (200 - QUOTE_DUPLICATE) / QUOTE_DUPLICATE + 1e-9
    low, high = np.searchsorted(sizes, texts.sizes[own] / reach, "left"), np.searchsorted(sizes, texts.sizes[own] * reach, "right")
    many = np.where(texts.sizes[own] > 0, high - low, 0)
    for rows in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1):
        n = many[rows]
        q = np.repeat(own[rows], n)
        k = by_size[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[rows], n)]
        k, q = texts.open(k, q, QUOTE_DUPLICATE)
        for at in np.lexsort((k, q)).tolist():
            if int(q[at]) not in found and texts.reaches(int(k[at]), int(q[at]), QUOTE_DUPLICATE):
                found[int(q[at])] = int(k[at])
    return np.array([found.get(x, -1) for x in own.tolist()], np.int64)


def _first_alike(quotes: list[str], leaders: list[str]) -> list[int]:
    """For each quote the place of the first leader that is at least 88 alike, or -1."""
    texts = Texts([*leaders, *quotes])
    return _firsts(texts, np.arange(len(leaders), len(texts.texts)), np.arange(len(leaders))).tolist()


def _leaders(quotes: list[str]) -> list[int]:
    """For distinct quotes in order, the place of the first kept one that each matches, or its own if it is kept. A slice meets those
    kept before it; what is left of it is then gone through in order."""
    texts, out, kept, at, size = Texts(quotes), np.arange(len(quotes)), np.zeros(0, np.int64), 0, 32
    while at < len(quotes):
        own = np.arange(at, min(at + size, len(quotes)))
        first = _firsts(texts, own, kept)
        out[own[first >= 0]] = first[first >= 0]
        own = own[(first < 0) & (texts.sizes[own] > 0)]
        a, b = np.triu_indices(len(own), 1)
        k, q = texts.open(own[a], own[b], QUOTE_DUPLICATE)
        for i in np.lexsort((k, q)).tolist():
            if out[q[i]] == q[i] and out[k[i]] == k[i] and texts.reaches(int(k[i]), int(q[i]), QUOTE_DUPLICATE):
                out[q[i]] = k[i]
        kept = np.concatenate([kept, own[out[own] == own]])
        at, size = at + size, min(2 * size, SLICE)
    return out.tolist()


#: Quotes of one block that a task takes in order, in the first round and at most; how many of the others a task takes.
HEAD, MOST_HEAD, DEALT = 1024, 32_768, 1024


def _same(a: list[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in a])


def _under(df: DataFrame, names: list[str]) -> DataFrame:
    """df with names under a prefix, for _same()."""
    return df.select(*[F.col(c).alias(f"_{c}") for c in names], *[c for c in df.columns if c not in names])


def with_leader(keys: DataFrame) -> DataFrame:
    """BLOCK, k_id, leader: for each key, keys(BLOCK, k_id, k_quote, o), the one that stands for it. Keys are taken in order of o;
    one whose quote is at least 88 alike that of an earlier one that stands for itself goes to the first such.

    A round takes the first keys of each block in one task, and then meets all others of the block with the leaders found
    there. These are dealt over tasks by length, as alike quotes are of like length, so that few leaders are moved to each task.
    What matches none goes to the next round, which takes twice as many: small blocks are done in one round, a block of very
    many keys never lies in one task, and pairs are never written. Places are found without moving any quote."""
    names, own = [*BLOCK, "k_id"], ["nth", "of"]
    kind = ", ".join(f"{c} string" for c in [*names, "leader"])
    left = stored(keys.select(*names, "k_quote", "o"), "keys")

    def plain(block: pd.DataFrame, leader: list) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(block[c].tolist(), dtype=object) for c in names} | {"leader": pd.Series(leader, dtype=object)})

    def lead(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("nth").reset_index(drop=True)
        return plain(block, block["k_id"].iloc[_leaders(block["k_quote"].tolist())].tolist())

    def meet(block: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leaders = leaders.sort_values("nth")
        ids = leaders["k_id"].tolist()
        return plain(block, [ids[k] if k >= 0 else None for k in _first_alike(block["k_quote"].tolist(), leaders["k_quote"].tolist())])

    # quotes whose places differ by more than one can't be alike
    length = F.floor(F.log(F.greatest(F.coalesce(F.length("k_quote"), F.lit(0)), F.lit(1))) / F.lit(1.001 * math.log((200 - QUOTE_DUPLICATE) / QUOTE_DUPLICATE))).cast("int")
    done, size = None, HEAD
    while True:
        block = Window.partitionBy(*BLOCK)
        placed = stored(left.select(*names, F.row_number().over(block.orderBy("o", "k_id")).alias("nth"), F.count(F.lit(1)).over(block).alias("of")), "places")
        head = stored(left.drop("o").join(_under(placed.where(F.col("nth") <= size), names), _same(names)).select(*names, "k_quote", *own), "head")
        alone = head.where("of = 1").select(*names, F.col("k_id").alias("leader"))
        found = stored(head.where("of > 1").groupBy(*BLOCK).applyInPandas(lead, kind).unionByName(alone), "leaders")
        done = found if done is None else done.unionByName(found)
        more = placed.where(F.col("nth") > size)
        if more.isEmpty():
            freed(left, head, placed)
            return done
        rest = stored(left.join(_under(more, names), _same(names), "left_semi").withColumn("long", length), "keys")
        freed(left, placed)
        lots = rest.groupBy(*BLOCK, "long").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("lots"))
        leaders = head.join(_under(found.where("k_id = leader").drop("leader"), names), _same(names), "left_semi").withColumn("long", F.explode(F.array(length - 1, length, length + 1)))
        place = [*BLOCK, "long"]
        leaders = leaders.join(_under(lots, place), _same(place)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        dealt = rest.join(_under(lots, place), _same(place)).select(*names, "k_quote", "long", F.pmod(F.xxhash64("k_id"), F.col("lots")).cast("int").alias("salt"))
        met = stored(dealt.groupBy(*place, "salt").cogroup(leaders.select(*names, "k_quote", "nth", "long", "salt").groupBy(*place, "salt")).applyInPandas(meet, kind), "met")
        done = done.unionByName(met.where("leader is not null"))
        left = stored(rest.drop("long").join(_under(met.where("leader is null").drop("leader"), names), _same(names), "left_semi"), "keys")
        freed(head, rest)
        size = min(2 * size, MOST_HEAD)


def dedupe(found: DataFrame) -> DataFrame:
    """Findings without those that repeat an earlier kept one: same pass, category and place, and quotes equal or at least 88
    alike, as whole texts. Only rows of one block can meet. Equal quotes are removed natively first, and blocks of one row never
    reach Python."""
    rows = with_key(dedupe_exact(found, None), None)
    led = with_leader(rows.withColumn("o", F.struct(*_order()))).where("k_id = leader").drop("leader")
    return _on_key(rows, led, "left_semi").select(found.columns)


def _on_key(rows: DataFrame, led: DataFrame, how: str = "inner") -> DataFrame:
    names = [*BLOCK, "k_id"]
    return rows.join(_under(led, names), _same(names), how)


def merge_runs_exact(found: DataFrame, runs: int) -> DataFrame:
    """found with run_no: the first finding of each equal key, stable if all runs have the key. ord tells the findings of a run and
    paper apart."""
    per_key = _hashed(found).groupBy("paper_id", "key").agg(F.count_distinct("run_no").alias("seen"), F.min(F.struct("run_no", "ord")).alias("m"))
    kept = per_key.select("paper_id", "m.run_no", "m.ord", "seen")
    both = found.join(kept, ["paper_id", "run_no", "ord"])
    return both.withColumn("stability", F.lit("single_run") if runs == 1 else F.when(F.col("seen") >= runs, "stable").otherwise("unstable")).select(found.columns)


def _merged(rows: DataFrame, names: list[str], runs: int) -> DataFrame:
    per_key = rows.groupBy(*BLOCK, "leader").agg(F.count_distinct("run_no").alias("seen"), F.min_by(F.struct(*names), F.struct("run_no", "ord")).alias("m"))
    return per_key.select("m.*", "seen").withColumn("stability", F.lit("single_run") if runs == 1 else F.when(F.col("seen") >= runs, "stable").otherwise("unstable")).select(names)


def merge_runs(found: DataFrame, runs: int) -> DataFrame:
    """found with run_no, from runs runs of one pass: as merge_runs_exact(), but quotes at least 88 alike count as equal to the
    first kept one that they match. One run is returned as it is."""
    if runs == 1:
        return found.withColumn("stability", F.lit("single_run"))
    rows = with_key(found)
    keys = rows.groupBy(*BLOCK, "k_id", "k_quote").agg(F.min(F.struct("run_no", "ord")).alias("o"))
    return _merged(_on_key(rows, with_leader(keys)), found.columns, runs)


# Counts ---------------------------------------------------------------------------------------------------------------------


def severity_counts(found: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return found.groupBy("paper_id").agg(n("critical"), n("major"), n("minor"), F.count(F.lit(1)).alias("total"))


def stability_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("paper_id", "stability").agg(F.count(F.lit(1)).alias("n"))


def union_passes(*parts: DataFrame) -> DataFrame:
    """Findings of the passes, one after the other; ord is then the place in the paper."""
    both = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        both = part if both is None else both.unionByName(part)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("paper_id").orderBy("_part", "ord")).cast("bigint")).drop("_part")


def limitations(replies: DataFrame) -> DataFrame:
    """replies(paper_id, source_pass, entry, limitations): each distinct limitation of a pass, in the order first seen."""
    text = replies.select("paper_id", "source_pass", "entry", F.posexplode("limitations").alias("pos", "l")).withColumn("l", collapse(F.col("l"))).where("l <> ''")
    first = text.groupBy("paper_id", "source_pass", F.col("l").alias("limitation")).agg(F.min(F.struct("source_pass", "entry", "pos")).alias("m"))
    return first.select("paper_id", "source_pass", "limitation", F.row_number().over(Window.partitionBy("paper_id").orderBy("m")).cast("bigint").alias("place"))
