"""Requests to a model: one row for each call, its payload assembled from the tables of a paper.

A request's stage says which prompt goes before its payload and which reply is expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.json_text import CUT_DATA, as_json, cut, json_text
from marginalia.functions.text import clip
from marginalia.operators.captions import in_order
from marginalia.operators.sections import reviewable
from marginalia.schemas import REPLIES, struct

#: The limits of a payload's parts; so are the headings, notes and names of the parts below.
LIMITS = {"pass0": 120_000, "front": 20_000, "section": 24_000, "digest": 12_000, "tables": 20_000, "inventory": 30_000, "references": 60_000, "claims": 60_000, "results": 20_000, "findings": 40_000, "outputs": 90_000}
SEARCHED_CLAIMS = 25
NO_INVENTORY = "Pass 0 output unavailable"
#: Of each stage its pass, the prompt's name, what is added to the prompt, and the schema of the reply (none: text).
STAGES = {
    "pass0": ("pass0", "pass0_inventory", "", "pass0"),
    "pass1": ("pass1", "pass1_mechanical", "", "pass1"),
    "pass2": ("pass2", "pass2_consistency", "", "pass2"),
    "pass3:refs": ("pass3", "pass3_references", "\n\nFor this call, fill `references` only. Leave `missing_citations` empty; it is collected in a separate call.", "pass3"),
    "pass3:missing": (
        "pass3", "pass3_references", "\n\nFor this call, list ONLY claims in the text below that assert a fact, a prior result, or a method taken from elsewhere and carry no citation. Fill `missing_citations`. Leave `references` empty and set `search_tool_available` to the value given in the input.", "pass3",
    ),
    "pass4:claims": ("pass4", "pass4_claims", "", "pass4_claims"),
    "pass4:verify": ("pass4", "pass4_facts", "", "pass4"),
    "synthesis": ("synthesis", "synthesis", "", None),
}


def request(stage: str, label: Column, payload: Column, paper: Column | str = "paper_id", attempt: Column | None = None) -> list[Column]:
    """A request's columns. Its hash is the key under which a reply is kept, so that a repeated task asks nothing twice; attempts
    tell repeated runs of one request apart."""
    paper = F.col(paper) if isinstance(paper, str) else paper
    attempt = (F.lit(1) if attempt is None else attempt).cast("int")
    key = F.sha2(F.concat_ws("\x01", F.lit(stage), label, payload, F.when(attempt > 1, attempt.cast("string"))), 256)
    return [paper.alias("paper_id"), F.lit(STAGES[stage][0]).alias("pass"), F.lit(stage).alias("stage"), label.alias("label"), payload.alias("payload"), attempt.alias("attempt"), key.alias("request_hash")]


def repeated(requests: DataFrame, times: int) -> DataFrame:
    """Each request `times` times, as attempts of their own."""
    if times == 1:
        return requests
    rows = requests.drop("attempt", "request_hash").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(times))))
    key = F.sha2(F.concat_ws("\x01", "stage", "label", "payload", F.when(F.col("attempt") > 1, F.col("attempt").cast("string"))), 256)
    return rows.withColumn("request_hash", key).select(requests.columns)


# Parts ----------------------------------------------------------------------------------------------------------------------


def _listed(df: DataFrame, order: list[str], line: Column, name: str, between: str = "\n") -> DataFrame:
    return df.select("paper_id", *order, line.alias("_line")).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_line"))), lambda x: x["_line"]), between).alias(name))


def _nested(df: DataFrame, order: list[Column], fields: list[Column | str], name: str, key: tuple[str, ...] = ("paper_id",)) -> DataFrame:
    """Of each key an array of the fields, in order."""
    rows = df.select(*key, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("x")).alias("_s"))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["x"]).alias(name))


def _pages() -> Column:
    return F.concat(F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"))


def _body(sections: DataFrame, limit: int) -> DataFrame:
    """(paper_id, body): whole sections under their headings, each cut by itself."""
    return _listed(sections, ["section_idx"], F.concat(F.lit("=== "), "label", F.lit(" (pages "), _pages(), F.lit(") ===\n"), cut(F.col("text"), limit)), "body", "\n\n")


CAPTION = ["id", "caption", "page", "referenced_in_text"]


def _captions(found: DataFrame, name: str, key: tuple[str, ...] = ("paper_id",)) -> DataFrame:
    return _nested(found, [F.col("nth")], CAPTION, name, key)


def _inventory(replies: DataFrame, fields: list[str], limit: int, name: str = "inventory") -> DataFrame:
    """(paper_id, name): fields of the replies(paper_id, reply) of pass 0 as JSON."""
    rows = replies.select("paper_id", F.struct(*[F.col(f"reply.{f}").alias(f) for f in fields]).alias("x"))
    return rows.select("paper_id", as_json(rows.schema, "x", limit).alias(name))


# Requests -------------------------------------------------------------------------------------------------------------------


def pass0(papers: DataFrame, sections: DataFrame, captions: DataFrame, refs: DataFrame, limit: int = LIMITS["pass0"]) -> DataFrame:
    """papers(paper_id, text, page_count, metadata map): what was extracted, and the whole text if it fits beside that, else front
    matter, headings, captions and bibliography."""
    captions = in_order(captions)
    heads = _nested(sections, [F.col("section_idx")], [F.col("section_idx").alias("index"), "number", "title", "kind", _pages().alias("pages"), F.length("text").alias("chars")], "detected_sections")
    caps = _captions(captions, "detected_captions")
    bib = _nested(refs, [F.col("ord")], [F.col("ref_index").alias("index"), F.substring("raw", 1, 400).alias("raw"), F.col("raw").alias("whole")], "bib")
    all_ = papers.join(heads, "paper_id", "left").join(caps, "paper_id", "left").join(bib, "paper_id", "left")
    all_ = all_.withColumn("hint", F.struct(
        F.col("metadata").alias("pdf_metadata"), F.col("page_count"), F.col("detected_sections"), F.col("detected_captions"), F.coalesce(F.size("bib"), F.lit(0)).alias("detected_reference_count"),
        F.transform("bib", lambda r: F.struct(r["index"].alias("index"), r["raw"].alias("raw"))).alias("detected_bibliography"),
    ))
    hints = F.concat(F.lit("=== EXTRACTION HINTS (from the PDF, deterministic) ===\n"), as_json(all_.schema, "hint", limit // 4), F.lit("\nThese hints come from layout heuristics and may be wrong or incomplete. Correct them from the text where they disagree."))
    all_ = all_.withColumn("hints", hints).withColumn("left", F.greatest(F.lit(limit) - F.length("hints"), F.lit(limit // 4)))
    lines = lambda name, line: F.coalesce(F.array_join(F.transform(name, line), "\n"), F.lit(""))
    headings = lines("detected_sections", lambda s: F.trim(F.concat(s["number"], F.lit(" "), s["title"], F.lit(" (pages "), s["pages"], F.lit(")"))))
    short = F.concat(
        F.lit("=== FRONT MATTER ===\n"), F.substring("text", 1, LIMITS["front"]), F.lit("\n\n=== SECTION HEADINGS ===\n"), headings, F.lit("\n\n=== CAPTIONS ===\n"), lines("detected_captions", lambda c: F.concat(c["id"], F.lit(": "), c["caption"])),
        F.lit("\n\n=== BIBLIOGRAPHY ===\n"), lines("bib", lambda r: F.concat(F.lit("["), r["index"].cast("string"), F.lit("] "), r["whole"])),
    )
    note = "NOTE: the paper exceeded the input budget, so you are given the front matter, the section headings, all captions and the bibliography instead of the full text. Record this in `limitations`."
    whole = F.concat("hints", F.lit("\n\n=== FULL PAPER TEXT ===\n"), "text")
    payload = F.when(F.length("text") <= F.col("left"), whole).otherwise(F.concat(F.lit(note + "\n\n"), "hints", F.lit("\n\n"), cut(short, F.col("left"))))
    return all_.select(*request("pass0", F.lit("pass0:inventory"), payload))


def pass1(sections: DataFrame, captions: DataFrame, candidates: DataFrame, inventories: DataFrame, limit: int = LIMITS["section"], language: str = "en") -> DataFrame:
    """A request for each section worth a review, with section_idx: captions on its pages, words that the checker doesn't know,
    and a digest of inventories(paper_id, reply of pass 0). language stands for a paper without one."""
    key = ("paper_id", "section_idx")
    on_pages = sections.select(*key, "start_page", "end_page").join(in_order(captions), "paper_id").where(F.col("page").between(F.col("start_page"), F.col("end_page")))
    words = _nested(candidates, [-F.col("occurrences"), F.lower("token")], ["token", "sentence", "location", "occurrences", F.col("suggestion").alias("checker_suggestion")], "words", key)
    digest = _inventory(inventories, ["language", "title", "sections", "figures", "tables"], LIMITS["digest"], "digest")
    s = reviewable(sections).join(_captions(on_pages, "caps", key), list(key), "left").join(words, list(key), "left").join(digest, "paper_id", "left")
    none = F.lit(f'{{\n "language": "{language}",\n "note": "{NO_INVENTORY}"\n}}')
    payload = F.concat(
        F.lit("=== PASS 0 INVENTORY (condensed) ===\n"), F.coalesce("digest", none), F.lit("\n\n=== SECTION UNDER REVIEW ===\ntitle: "), "label", F.lit("\npages: "), _pages(), F.lit("\n\n"), cut(F.col("text"), limit),
        F.lit("\n\n=== FIGURES AND TABLES ON THESE PAGES ===\n"), as_json(s.schema, "caps"), F.lit("\n\n=== SPELLCHECKER CANDIDATES FOR THIS SECTION ===\n"), as_json(s.schema, "words", None, {"checker_suggestion"}),
        F.lit("\n("), F.coalesce(F.size("words"), F.lit(0)).cast("string"), F.lit(" candidates; classify every one of them.)"),
    )
    return s.select(*request("pass1", F.concat(F.lit("pass1:"), F.substring("label", 1, 40)), payload), "section_idx")


def pass2(papers: DataFrame, sections: DataFrame, tables: DataFrame, inventories: DataFrame, limit: int = LIMITS["section"]) -> DataFrame:
    """The sections that state results, or the second half of a paper without any, with the inventory and the texts around the
    tables(paper_id, id, text)."""
    own = _body(sections.where(F.col("kind").isin("abstract", "results", "discussion", "conclusion", "limitations")), limit)
    tab = _listed(in_order(tables.withColumn("kind", F.lit("table"))), ["nth"], F.col("text"), "tables", "\n\n")
    known = _inventory(inventories, ["title", "language", "research_questions_or_hypotheses", "key_numbers", "figures", "tables"], LIMITS["inventory"])
    half = cut(F.substring(F.col("text"), (F.floor(F.length("text") / 2) + 1).cast("int"), F.length("text")), 2 * limit)
    all_ = papers.select("paper_id", "text").join(own, "paper_id", "left").join(tab, "paper_id", "left").join(known, "paper_id", "left")
    wanted = F.coalesce("body", F.concat(F.lit("=== PAPER TEXT (second half; section split unavailable) ===\n"), half))
    note = F.when(F.col("body").isNull(), "NOTE: the abstract/results/discussion/conclusion sections could not be identified. Record this in `limitations`.\n\n").otherwise("")
    payload = F.concat(note, F.lit("=== PASS 0 INVENTORY ===\n"), F.coalesce("inventory", F.lit(f'{{\n "note": "{NO_INVENTORY}"\n}}')), F.lit("\n\n"), wanted, F.lit("\n\n=== TABLE CONTENTS (text around each table caption) ===\n"), cut(F.coalesce("tables", F.lit("")), LIMITS["tables"]))
    return all_.select(*request("pass2", F.lit("pass2:consistency"), payload))


def pass3(batched: DataFrame) -> DataFrame:
    """A request for each batch of references: references.batches() of references with their citing sentences and with record, a
    struct as in BIB_RECORDS, null where no lookup was made. Each entry shows what the paper says, what cites it, and what the
    lookup found."""
    ref = batched.schema["refs"].dataType.elementType
    kind = struct("index int, raw string, parsed struct<title:string,year:string,authors:array<string>,doi:string>, citing_sentences array<struct<quote:string,location:string>>")
    record = ref["record"].dataType

    def entry(r: Column) -> Column:
        """The text of an entry, one level in. A record not made is {"found": false}."""
        own = F.struct(r["ref_index"].alias("index"), r["raw"].alias("raw"), F.struct(r["title"].alias("title"), r["year"].alias("year"), r["authors"].alias("authors"), r["doi"].alias("doi")).alias("parsed"), r["citing_sentences"].alias("citing_sentences"))
        cut_record = r["record"].withField("abstract", F.substring(r["record"]["abstract"], 1, 1200))
        found = F.coalesce(F.when(r["record"].isNotNull(), json_text(cut_record, record, 2)), F.lit('{\n   "found": false\n  }'))
        head = json_text(own, kind, 1)
        return F.concat(F.substring(head, F.lit(1), F.length(head) - 3), F.lit(',\n  "lookup_result": '), found, F.lit("\n }"))

    listed = F.concat(F.lit("[\n "), F.array_join(F.transform("refs", entry), ",\n "), F.lit("\n]"))
    payload = F.concat(
        F.lit("=== BIBLIOGRAPHY ENTRIES WITH LOOKUP RESULTS ===\n"), cut(listed, LIMITS["references"], CUT_DATA),
        F.lit("\n\nThe `lookup_result` block is what a bibliographic database returned for that entry. Compare it with `raw`. Use only the URL in `lookup_result.url`; never invent one. Return one object in `references` for every index listed above."),
    )
    number = lambda i: F.element_at("refs", i)["ref_index"].cast("string")
    return batched.select(*request("pass3:refs", F.concat(F.lit("pass3:refs "), number(1), F.lit("-"), number(-1)), payload), "batch")


def pass3_missing(sections: DataFrame, available: bool, limit: int = LIMITS["section"]) -> DataFrame:
    """A request for each paper that has an introduction, background, methods or a discussion: which claims there lack a citation.
    available: whether references could be looked up."""
    body = _body(sections.where(F.col("kind").isin("introduction", "background", "methods", "discussion")), limit)
    return body.select(*request("pass3:missing", F.lit("pass3:missing_citations"), F.concat(F.lit(f"search_tool_available: {available}\n\n"), "body")))


def claim_sections(sections: DataFrame) -> DataFrame:
    """Introduction and background; the first two reviewable sections of a paper without these."""
    own = sections.where(F.col("kind").isin("introduction", "background"))
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy("section_idx"))
    rest = reviewable(sections).join(own.select("paper_id").distinct(), "paper_id", "left_anti").withColumn("nth", nth).where("nth <= 2").drop("nth")
    return own.unionByName(rest)


def pass4_claims(papers: DataFrame, sections: DataFrame, inventories: DataFrame, limit: int = LIMITS["section"]) -> DataFrame:
    """A request for each of papers(paper_id): which claims can be checked, with the research questions of the inventory."""
    asked = inventories.select("paper_id", F.col("reply.research_questions_or_hypotheses").alias("questions"))
    all_ = papers.select("paper_id").join(_body(claim_sections(sections), limit), "paper_id", "left").join(asked, "paper_id", "left")
    return all_.select(*request("pass4:claims", F.lit("pass4:claims"), F.concat(F.lit("=== RESEARCH QUESTIONS (from Pass 0) ===\n"), as_json(all_.schema, "questions"), F.lit("\n\n=== TEXT ===\n"), F.coalesce("body", F.lit("")))))


def wanted_searches(claims: DataFrame, main: DataFrame, most: int = SEARCHED_CLAIMS) -> DataFrame:
    """(query): what must be searched for the first `most` claims of each paper and for its main(paper_id, main_result_query)."""
    first = _first_claims(claims, most).select("query")
    return first.unionByName(main.select(F.col("main_result_query").alias("query"))).where("coalesce(query, '') <> ''").distinct()


def _first_claims(claims: DataFrame, most: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord"))
    query = F.when(F.coalesce("search_query", F.lit("")) == "", F.col("claim_quote")).otherwise(F.col("search_query"))
    return claims.withColumns({"nth": nth, "query": query}).where(F.col("nth") <= most)


def searched_claims(claims: DataFrame, results: DataFrame, most: int = SEARCHED_CLAIMS, each: int = 5) -> DataFrame:
    """claims(paper_id, ord, claim_quote, location, search_query) with what a search for each found: the first `most` claims of
    a paper, by their query or else their quote, and the first `each` results(query, rank, title, url, snippet)."""
    c = _first_claims(claims, most)
    return c.join(_results(results, each), "query", "left").select("paper_id", "ord", "claim_quote", "location", "query", "results")


def _results(results: DataFrame, each: int) -> DataFrame:
    return results.where(F.col("rank") <= each).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url", clip(F.col("snippet"), 800, "").alias("snippet")))).alias("results"))


def _plain(results: Column) -> Column:
    return F.transform(results, lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["snippet"].alias("snippet")))


def pass4_verify(searched: DataFrame, main: DataFrame, results: DataFrame, each: int = 5) -> DataFrame:
    """A request for each paper of main(paper_id, main_result_query): its searched_claims() with their results, and the results of
    the main question. A paper without claims has an empty list."""
    rows = _nested(searched, [F.col("ord")], ["claim_quote", "location", "query", _plain(F.col("results")).alias("results")], "claims")
    # queries and results meet in equal keys, so that results of a query stand once whatever asks for it
    asked = main.withColumnRenamed("main_result_query", "query").join(_results(results, each), "query", "left").join(rows, "paper_id", "left")
    asked = asked.withColumn("main", F.struct("query", _plain(F.col("results")).alias("results")))
    payload = F.concat(
        F.lit("search_tool_available: true\n\n=== CLAIMS WITH SEARCH RESULTS ===\n"), as_json(asked.schema, "claims", LIMITS["claims"]),
        F.lit("\n\n=== SEARCH RESULTS FOR THE PAPER'S MAIN RESEARCH QUESTION ===\n"), as_json(asked.schema, "main", LIMITS["results"]),
    )
    return asked.select(*request("pass4:verify", F.lit("pass4:verify"), payload))


def dropped_claims(claims: DataFrame, most: int = SEARCHED_CLAIMS) -> DataFrame:
    """(paper_id, limitation): how many claims of a paper are beyond those that are searched, where there are any."""
    n = claims.groupBy("paper_id").agg((F.count(F.lit(1)) - most).alias("n")).where("n > 0")
    return n.select("paper_id", F.concat(F.col("n").cast("string"), F.lit(f" extracted claims beyond the first {most} were not searched and remain unchecked.")).alias("limitation"))


def without_search(claims: DataFrame) -> DataFrame:
    """The fact checks that stand for all claims where no search tool is there."""
    return claims.select("paper_id", "ord", "claim_quote", "location", F.lit("").alias("source_url"), F.concat(F.lit("no_search_tool - suggested query: "), "search_query").alias("source_says"), F.lit("could_not_verify").alias("verdict"))


FINDING = ["severity", "category", "location", "quote", "description", "correction", "source_pass", "verdict", "url", "stability"]
#: The outputs of all passes of a paper, as the synthesis shows them; those that did not run are null. Pass 1 has a reply for each
#: section, pass 2 one; of repeated runs both have the list of all runs.
OUTPUTS = f"pass0 {REPLIES['pass0']}, pass1 array<{REPLIES['pass1']}>, pass2 {REPLIES['pass2']}, pass3 {REPLIES['pass3']}, pass4 {REPLIES['pass4']}"
REPEATED = f"pass0 {REPLIES['pass0']}, pass1 struct<runs:array<array<{REPLIES['pass1']}>>>, pass2 struct<runs:array<{REPLIES['pass2']}>>, pass3 {REPLIES['pass3']}, pass4 {REPLIES['pass4']}"


def synthesis(found: DataFrame, audit: DataFrame, outputs: DataFrame) -> DataFrame:
    """found: findings in order (place), with all that is known of each; audit(paper_id, ref_index, line); outputs(paper_id, outputs),
    a struct as OUTPUTS or REPEATED says."""
    f = _nested(found, [F.col("place")], FINDING, "found")
    all_ = outputs.join(f, "paper_id", "left").join(_listed(audit, ["ref_index"], F.col("line"), "audit"), "paper_id", "left")
    names = set(all_.schema["outputs"].dataType.names)
    payload = F.concat(
        F.lit("=== MERGED FINDINGS (deduplicated across repeated runs) ===\n"), as_json(all_.schema, "found", LIMITS["findings"]),
        F.lit("\n\n=== REFERENCE AUDIT (already resolved; reproduce these lines verbatim in section 3, do not re-judge any status) ===\n"), F.coalesce("audit", F.lit("- No bibliography entries were checked.")),
        F.lit("\n\n=== PASS OUTPUTS ===\n"), as_json(all_.schema, "outputs", LIMITS["outputs"], names),
    )
    return all_.select(*request("synthesis", F.lit("synthesis"), payload))
