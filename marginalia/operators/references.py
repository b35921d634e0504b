"""Bibliography entries, the sentences that cite them, and their records in bibliographic databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.fuzzy import TITLE_PLAUSIBLE, score_match
from marginalia.functions.text import citation_numbers, clip, sentences, strip, strip_tags

#: Patterns of identifiers, years, entries and citations.
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
NUMBERED_ENTRY = r"^\s*(?:\[(\d{1,3})\]|(\d{1,3})[.)])\s+(?=\S)"
NUMERIC_CITATION = r"\[(\d{1,3}(?:\s*[-,;]\s*\d{1,3})*)\]"
AUTHOR_YEAR = r"\(?\b([A-Z][A-Za-z'\-]+)(?:\s+et\s+al\.?|\s+(?:and|&)\s+[A-Z][A-Za-z'\-]+)?,?\s*\(?((?:19|20)\d{2})[a-z]?\)?"
AUTHOR = r"\b([A-Z][A-Za-z'\-]{1,20})(?=,\s*(?:[A-Z]\.|[A-Z][a-z]))"
#: Words by which a preprint is known.
PREPRINT_MARKERS = ["arxiv", "biorxiv", "medrxiv", "ssrn", "preprint", "posted-content", "chemrxiv"]


def entries(block: Column) -> Column:
    """The entries of a references text. With two numbered lines or more each begins an entry, and what stands before the first
    is dropped; else a line that begins with a surname and comma does, once the entry before it has a year."""
    lines = F.filter(F.transform(F.split(block, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    numbered = F.size(F.filter(lines, lambda x: x.rlike(NUMBERED_ENTRY))) >= 2
    glue = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(NUMBERED_ENTRY), F.concat(F.lit("\x01"), x)).otherwise(x)), " ")
    by_number = F.slice(F.split(glue, " ?\x01"), 2, 1_000_000)
    # the fold keeps whether the open entry has a year, and marks where entries begin
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        new = (a["open"] != "") & x.rlike(r"^[A-Z][A-Za-z'\-]+,") & a["open"].rlike(YEAR)
        return F.struct(F.when(new, F.concat(a["text"], a["open"], F.lit("\x01"))).otherwise(a["text"]).alias("text"), F.when(new | (a["open"] == ""), x).otherwise(F.concat(a["open"], F.lit(" "), x)).alias("open"))

    by_year = F.split(F.aggregate(lines, start, step, lambda a: F.concat(a["text"], a["open"])), "\x01")
    return F.when(F.size(lines) == 0, F.array().cast("array<string>")).when(numbered, by_number).otherwise(by_year)


def title_guess(raw: Column) -> Column:
    """The first long chunk with few initials and three words or more, else the first long chunk, else null."""
    chunks = F.split(F.regexp_replace(raw, DOI, ""), r"(?<=[.?])\s+")
    parts = F.transform(chunks, lambda p: F.regexp_replace(p, r"^[ .,]+|[ .,]+$", ""))
    long = F.filter(parts, lambda p: (F.length(p) > 15) & ~p.rlike(r"^(?:[A-Z][A-Za-z'\-]+)(?:,? (?:and |& )?[A-Z]\.)+$"))
    good = F.filter(long, lambda p: (F.regexp_count(p, F.lit(r"\b[A-Z]\.")) <= 2) & (F.regexp_count(F.regexp_replace(p, "[^A-Za-z ]", ""), F.lit(r"[A-Za-z]+")) >= 3))
    return F.coalesce(F.get(good, 0), F.get(long, 0))


def authors_guess(raw: Column) -> Column:
    names = F.array_distinct(F.regexp_extract_all(F.substring(raw, 1, 220), F.lit(AUTHOR), 1))
    return F.slice(F.filter(names, lambda n: ~F.lower(n).isin("and", "the")), 1, 8)


def fields(raw: Column) -> Column:
    """A struct (doi, title, year, authors) of an entry without its number; doi, title and year may be null."""
    found = lambda p, c=raw: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    return F.struct(F.regexp_replace(found(DOI), "[.,;]+$", "").alias("doi"), title_guess(raw).alias("title"), found(YEAR).alias("year"), authors_guess(raw).alias("authors"))


def references(sections: DataFrame) -> DataFrame:
    """paper_id, ref_index, ord, raw, doi, title, year, authors."""
    own = sections.where("kind = 'references'").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "text"))), lambda x: x["text"]), "\n").alias("block"))
    return numbered_entries(own.select("paper_id", F.posexplode(entries(F.col("block"))).alias("pos", "entry")))


def numbered_entries(rows: DataFrame) -> DataFrame:
    """rows(paper_id, pos, entry) to references: the entry's own number, or its place where it has none or 0."""
    number = F.coalesce(F.nullif(F.regexp_extract("entry", NUMBERED_ENTRY, 1), F.lit("")), F.nullif(F.regexp_extract("entry", NUMBERED_ENTRY, 2), F.lit(""))).cast("int")
    raw = strip(F.regexp_replace("entry", NUMBERED_ENTRY, ""))
    out = rows.select("paper_id", F.coalesce(F.nullif(number, F.lit(0)), F.col("pos") + 1).alias("ref_index"), (F.col("pos") + 1).alias("ord"), raw.alias("raw"))
    return out.withColumn("f", fields(F.col("raw"))).select("paper_id", "ref_index", "ord", "raw", "f.*")


def citing_sentences(refs: DataFrame, sections: DataFrame, most: int = 4) -> DataFrame:
    """refs with citing_sentences: the first distinct sentences, in document order, that cite each by number or by first author
    and year. Of references with one number the last counts, of those with one author and year the first."""
    place = F.concat("label", F.lit(" (p. "), F.col("start_page").cast("string"), F.lit(")"))
    body = sections.where(~F.col("kind").isin("references", "back_matter")).select("paper_id", "section_idx", place.alias("location"), F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    groups = F.regexp_extract_all("sentence", F.lit(NUMERIC_CITATION), 1)
    cited = body.where(F.col("sentence").rlike(NUMERIC_CITATION)).withColumn("ref_index", F.explode(F.flatten(F.transform(groups, citation_numbers))))
    last = Window.partitionBy("paper_id", "ref_index").orderBy(F.desc("ord"))
    by_number = refs.withColumn("nth", F.row_number().over(last)).where("nth = 1").select("paper_id", "ref_index", F.col("ord").alias("ref"))
    first = Window.partitionBy("paper_id", "surname", "y").orderBy("ord")
    by_name = refs.where("year is not null and size(authors) > 0").select("paper_id", F.lower(F.col("authors")[0]).alias("surname"), F.substring("year", 1, 4).alias("y"), F.col("ord").alias("ref"), "ord")
    by_name = by_name.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("paper_id", "surname", "y", "ref")
    named = body.where(F.col("sentence").rlike(AUTHOR_YEAR)).withColumn("m", F.explode(F.arrays_zip(F.regexp_extract_all("sentence", F.lit(AUTHOR_YEAR), 1).alias("s"), F.regexp_extract_all("sentence", F.lit(AUTHOR_YEAR), 2).alias("y"))))
    named = named.select("paper_id", "section_idx", "pos", "location", "sentence", F.lower("m.s").alias("surname"), F.col("m.y").alias("y"))
    keep = ["paper_id", "ref", "section_idx", "pos", "location", "sentence"]
    hits = cited.join(by_number, ["paper_id", "ref_index"]).select(keep).unionByName(named.join(by_name, ["paper_id", "surname", "y"]).select(keep))
    hits = hits.withColumn("quote", clip(strip(F.col("sentence")), 400)).groupBy("paper_id", "ref", "quote").agg(F.min(F.struct("section_idx", "pos", "location")).alias("m"))
    top = hits.withColumn("nth", F.row_number().over(Window.partitionBy("paper_id", "ref").orderBy("m"))).where(F.col("nth") <= most)
    lists = top.groupBy("paper_id", "ref").agg(F.array_sort(F.collect_list(F.struct("nth", "quote", F.col("m.location").alias("location")))).alias("c"))
    lists = lists.select("paper_id", F.col("ref").alias("ord"), F.transform("c", lambda x: F.struct(x["quote"].alias("quote"), x["location"].alias("location"))).alias("c"))
    none = F.array().cast("array<struct<quote:string,location:string>>")
    return refs.join(lists, ["paper_id", "ord"], "left").select(*refs.columns, F.coalesce("c", none).alias("citing_sentences"))


def has_citation(text: Column) -> Column:
    return text.rlike(NUMERIC_CITATION) | text.rlike(AUTHOR_YEAR)


def missing_citations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose quote carries no citation, and how many rows of each paper do."""
    marked = has_citation(F.coalesce("quote", F.lit("")))
    return rows.where(~marked), rows.groupBy("paper_id").agg(F.count_if(marked).alias("dropped"))


# Records --------------------------------------------------------------------------------------------------------------------


def crossref_record(item: Column) -> Column:
    """A record struct from a work (a variant)."""
    text = lambda path: F.coalesce(F.try_variant_get(item, path, "string"), F.lit(""))
    title, venue, kind = text("$.title[0]"), text("$.container-title[0]"), text("$.type")
    updates = F.coalesce(F.try_variant_get(item, "$.update-to", "array<struct<type:string,label:string>>"), F.array().cast("array<struct<type:string,label:string>>"))
    labels = F.transform(F.filter(updates, lambda u: F.lower(F.concat_ws(" ", u["type"], u["label"])).contains("retract")), lambda u: F.coalesce(u["label"], F.lit("")))
    people = F.slice(F.coalesce(F.try_variant_get(item, "$.author", "array<struct<given:string,family:string>>"), F.array().cast("array<struct<given:string,family:string>>")), 1, 10)
    doi, blob = text("$.DOI"), F.lower(F.concat_ws(" ", kind, text("$.subtype"), venue, title))
    url = F.when(text("$.URL") != "", text("$.URL")).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")
    return F.struct(
        F.lit(True).alias("found"), url.alias("url"), title.alias("title"),
        F.transform(people, lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))).alias("authors"),
        text("$.issued.date-parts[0][0]").alias("year"), venue.alias("venue"), doi.alias("doi"), kind.alias("type"),
        ((F.size(labels) > 0) & (F.array_join(labels, "") != "") | (F.size(labels) > 0) | (kind == "retraction")).alias("is_retracted"),
        F.array_join(labels, "; ").alias("retraction_notes"), blob.rlike("|".join(PREPRINT_MARKERS)).alias("is_preprint"),
        strip_tags(text("$.abstract")).alias("abstract"), F.lit(0.0).alias("match_score"), F.lit("crossref").alias("source"),
    )


def openalex_record(item: Column) -> Column:
    text = lambda path: F.coalesce(F.try_variant_get(item, path, "string"), F.lit(""))
    people = F.slice(F.coalesce(F.try_variant_get(item, "$.authorships", "array<struct<author:struct<display_name:string>>>"), F.array().cast("array<struct<author:struct<display_name:string>>>")), 1, 10)
    return F.struct(
        F.lit(True).alias("found"), text("$.id").alias("url"), text("$.title").alias("title"), F.transform(people, lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))).alias("authors"),
        text("$.publication_year").alias("year"), text("$.primary_location.source.display_name").alias("venue"), F.replace(text("$.doi"), F.lit("https://doi.org/"), F.lit("")).alias("doi"),
        text("$.type").alias("type"), F.coalesce(F.try_variant_get(item, "$.is_retracted", "boolean"), F.lit(False)).alias("is_retracted"), F.lit("").alias("retraction_notes"),
        (text("$.type") == "preprint").alias("is_preprint"), F.lit("").alias("abstract"), F.lit(0.0).alias("match_score"), F.lit("openalex").alias("source"),
    )


def best_by_title(wanted: DataFrame, found: DataFrame, key: list[str], years: bool = True, most: int = 5) -> DataFrame:
    """Of the first records found(key, rank, title, year, ...) for each wanted(key, title, year) the one with the highest title
    score, the earlier rank where equal, if it is TITLE_PLAUSIBLE or more."""
    w = wanted.select(*key, F.col("title").alias("_title"), F.col("year").alias("_year"))
    scored = found.where(F.col("rank") <= most).join(w, key)
    score = score_match(F.col("_title"), F.col("title"), F.col("_year") if years else None, F.col("year") if years else None)
    scored = scored.withColumn("match_score", score).where(F.col("match_score") >= TITLE_PLAUSIBLE)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("match_score") if years else F.lit(1), "rank"))
    return scored.withColumn("nth", nth).where("nth = 1").drop("nth", "_title", "_year")


def cascade(refs: DataFrame, key: list[str], by_doi: DataFrame, by_text: DataFrame, by_title: DataFrame) -> DataFrame:
    """Each reference with the first record that a lookup by DOI, by text, or (if it has a title) by title gave. Each lookup sees
    only what the earlier ones left open."""
    one = by_doi.join(refs.where("doi is not null").select("doi").distinct(), "doi", "left_semi")
    # of several records of one DOI the first by address stays, so that no reference is multiplied
    one = one.withColumn("nth", F.row_number().over(Window.partitionBy("doi").orderBy("url", "title"))).where("nth = 1").drop("nth")
    first = refs.join(one.withColumnRenamed("doi", "_doi").select("_doi", F.struct("*").alias("r1")), F.col("doi") == F.col("_doi"), "left").drop("_doi")
    open_ = first.where("r1 is null").drop("r1")
    second = best_by_title(open_.select(*key, F.coalesce("title", "raw").alias("title"), "year"), by_text, key)
    left = open_.join(second.select(*key), key, "left_anti").where("title is not null and title <> ''")
    third = best_by_title(left.select(*key, "title", "year"), by_title, key, years=False, most=3)
    pick = lambda df, name: df.select(*key, F.lit(name).alias("step"), F.col("url").alias("found_url"), F.col("title").alias("found_title"), "match_score")
    ones = first.where("r1 is not null").select(*key, F.lit("doi").alias("step"), F.col("r1.url").alias("found_url"), F.col("r1.title").alias("found_title"), F.lit(100.0).alias("match_score"))
    return refs.join(ones.unionByName(pick(second, "text")).unionByName(pick(third, "title")), key, "left").withColumn("found", F.col("step").isNotNull())


NO_LOOKUP = "no_search_tool: no lookup result was available for this entry."


def reconcile(refs: DataFrame, records: DataFrame, checks: DataFrame) -> DataFrame:
    """What the model said of each reference, with the facts of its record: a retraction goes before all, a lookup without a
    result makes it not_found, a preprint is noted once, and the address is the record's. A reference without a reply is
    could_not_verify. Of two replies for a number the later counts."""
    last = Window.partitionBy("paper_id", "ref_index").orderBy(F.desc("ord"))
    c = checks.withColumn("nth", F.row_number().over(last)).where("nth = 1").select("paper_id", "ref_index", F.col("status").alias("said"), "found_at", "mismatch_details", "supports_claim", F.col("notes").alias("told"))
    r = records.select("paper_id", "ref_index", "found", "url", "is_retracted", "retraction_notes", "is_preprint")
    all_ = refs.select("paper_id", "ref_index", "raw").join(r, ["paper_id", "ref_index"], "left").join(c, ["paper_id", "ref_index"], "left")
    none = lambda name, value="": F.coalesce(name, F.lit(value))
    silent, retracted = F.col("said").isNull(), none("is_retracted", False)
    status = F.when(silent, "could_not_verify").when(retracted, "retracted").when(~none("found", True), "not_found").otherwise(F.col("said"))
    notes = none("told")
    notes = F.when(retracted & (none("retraction_notes") != ""), F.trim(F.concat(notes, F.lit(" Retraction notice: "), none("retraction_notes")))).otherwise(notes)
    notes = F.when(none("is_preprint", False) & ~F.lower(notes).contains("preprint"), F.trim(F.concat(notes, F.lit(" Indexed as a preprint.")))).otherwise(notes)
    at = F.when(F.col("found").isNull(), F.when(silent, "").otherwise(none("found_at"))).when(F.col("found"), none("url")).otherwise("")
    return all_.select("paper_id", "ref_index", "raw", status.alias("status"), at.alias("found_at"), none("mismatch_details").alias("mismatch_details"), F.when(silent, "could_not_check").otherwise(none("supports_claim", "could_not_check")).alias("supports_claim"), F.when(silent, NO_LOOKUP).otherwise(notes).alias("notes"))


def unverified(refs: DataFrame) -> DataFrame:
    """What stands for the checks where no search tool is there."""
    return refs.select("paper_id", "ref_index", "raw", F.lit("could_not_verify").alias("status"), F.lit("").alias("found_at"), F.lit("").alias("mismatch_details"), F.lit("could_not_check").alias("supports_claim"), F.lit(NO_LOOKUP).alias("notes"))


def batches(refs: DataFrame, size: int = 10) -> DataFrame:
    """paper_id, batch (from 0) and its references in order, with all their columns."""
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord")) - 1
    own = ["ord", *[c for c in refs.columns if c not in ("paper_id", "ord")]]
    rows = refs.withColumn("batch", F.floor(nth / size).cast("int")).groupBy("paper_id", "batch").agg(F.collect_list(F.struct(*own)).alias("refs"))
    return rows.withColumn("refs", F.array_sort("refs", lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)))


def with_records(refs: DataFrame, records: DataFrame) -> DataFrame:
    """refs with record: the struct of records(paper_id, ref_index, ...) for their number, null where there is none."""
    names = [c for c in records.columns if c not in ("paper_id", "ref_index")]
    r = records.select(F.col("paper_id").alias("_paper"), F.col("ref_index").alias("_index"), F.struct(*names).alias("record"))
    return refs.join(r, (F.col("paper_id") == F.col("_paper")) & (F.col("ref_index") == F.col("_index")), "left").select(*refs.columns, "record")
