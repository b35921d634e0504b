"""The registered queries of the review dataflow, each with the SQL that states its result for DuckDB where SQL can.

The test tables hold no citations, headings or captions, so inputs are built from them by SELECTs that both engines run: the
constants below, with {documents} and the like in place of the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import affixes, replies, text
from marginalia.functions.fuzzy import score_match
from marginalia.operators import calibrate, captions, findings, model_calls, payloads, references, report, sections, spelling
from marginalia.plans import review
from marginalia.schemas import REPLIES, struct
from marginalia.sources import files
from marginalia.storage import shared_dir, stored
from marginalia.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("documents", "labels", "benchmark", "pages", "conversations", "events")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    plain = sql
    for t in TABLES:
        plain = plain and plain.replace("{%s}" % t, t)

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if plain:
            ORACLES[function.__name__] = plain
        return function

    return add


def view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if "{%s}" % t in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{d}/{t}.parquet") for t in used})


SEVERITY = "CASE WHEN {0} % 3 = 0 THEN 'critical' WHEN {0} % 3 = 1 THEN 'major' ELSE 'minor' END"
FINDING = "SELECT source AS paper_id, doc_id AS ord, " + SEVERITY.format("doc_id") + """ AS severity, lang AS category,
  'Section ' || CAST(doc_id % 2 AS STRING) AS location, text AS quote, text AS description, '' AS correction,
  'pass' || CAST(1 + doc_id % 2 AS STRING) AS source_pass, '' AS verdict, '' AS url, 'single_run' AS stability FROM {documents}"""
PREDICTED = FINDING + " WHERE doc_id % 5 <> 0"
TRUTH = """SELECT d.source AS paper_id, d.doc_id AS ord, CASE WHEN l.toxic = 1 THEN 'critical' WHEN l.quality = 0 THEN 'major' ELSE 'minor' END AS severity,
  d.lang AS category, 'Section ' || CAST(d.doc_id % 2 AS STRING) AS location, d.text AS quote, d.text AS description, 'pass1' AS source_pass
  FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""
RUNS = "SELECT f.*, r.run_no FROM (" + FINDING + ") f CROSS JOIN (SELECT 0 AS run_no UNION ALL SELECT 1 AS run_no) r WHERE r.run_no = 0 OR f.ord % 5 <> 0"
NL = "chr(10)"
# A third of a document in each of three places
THIRD = "CAST(floor(length(text) / 3) AS INT)"
PAPER_TEXT = f"""'Abstract' || {NL} || substr(text, 1, {THIRD}) || {NL} || '1 Introduction' || {NL} || substr(text, {THIRD} + 1, {THIRD}) || ' [' || CAST(doc_id % 20 + 1 AS STRING) || ', ' || CAST(doc_id % 7 + 1 AS STRING) || '-' || CAST(doc_id % 7 + 3 AS STRING) || ']. As Table 1 shows, more.'
  || {NL} || 'Table 1. Means of all measures' || {NL} || 'a b c' || {NL} || '2.1 Results and Discussion' || {NL} || substr(text, 2 * {THIRD} + 1) || {NL} || 'Figure 2: Development over time' || {NL} || 'References' || {NL} || '[1] Belady, L. (1966). A study of replacement algorithms. Systems Journal.' || {NL} || '[2] Mattson, R. (1970). Evaluation techniques for storage hierarchies. doi:10.1000/ab.12.'"""
PAPERS = f"SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, doc_id, {PAPER_TEXT} AS text FROM {{documents}}"


def lines(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, PAPERS)
    rows = p.select("paper_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.withColumn("page", (F.floor(F.col("line_no") / 5) + 1).cast("int"))


LINES_SQL = f"""papers AS ({PAPERS}), lines AS (
  SELECT paper_id, i - 1 AS line_no, parts[i] AS text, (i - 1) // 5 + 1 AS page
  FROM (SELECT paper_id, string_split(text, {NL}) AS parts FROM papers) s, range(1, len(parts) + 1) t(i))"""


# Text -----------------------------------------------------------------------------------------------------------------------

FLAT = r"trim(regexp_replace(text, '\s*\n\s*', ' ', 'g'))"
PIECES = rf"string_split(regexp_replace({FLAT}, '([.!?])\s+([A-Z\[(])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(f"SELECT doc_id, i - 1 AS pos, p[i] AS piece FROM (SELECT doc_id, {PIECES} AS p FROM {{documents}}) s, range(1, len(p) + 1) t(i) WHERE p[i] <> ''")
def sentence_pieces(spark, d):
    docs = view(spark, d, "SELECT doc_id, text FROM {documents}")
    return docs.select("doc_id", F.posexplode(text.sentence_pieces(F.col("text"))).alias("pos", "piece")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "piece")


ABBREVIATED = "SELECT doc_id, replace(replace(text, ', ', ' et al. The '), ' the ', ' Smith, L. And ') AS text FROM {documents}"
GOES_ON = r"(regexp_matches(p, '(^|[^A-Za-z.])[A-Z]\.$') OR regexp_matches(lower(p), '(^|[^a-z.])(" + "|".join(a.replace(".", r"\.") for a in text.ABBREVIATIONS) + r")\.+$'))"


@query(f"""SELECT doc_id, i - 1 AS pos, trim(s[i]) AS sentence FROM (
  SELECT doc_id, string_split(array_to_string([CASE WHEN {GOES_ON} THEN p || ' ' ELSE p || chr(1) END FOR p IN pieces], ''), chr(1)) AS s
  FROM (SELECT doc_id, {PIECES.replace("{documents}", "")} AS pieces FROM ({ABBREVIATED}))) q, range(1, len(s) + 1) t(i) WHERE trim(s[i]) <> ''""")
def sentences_with_abbreviations(spark, d):
    docs = view(spark, d, ABBREVIATED)
    return docs.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(text, ', ', ' – '), 'fi', 'ﬁ'), ' ', '  '), '\s*$', '')) IS NOT NULL AS ok,
  regexp_replace(text, '[ \t]+', ' ', 'g') AS plain FROM {documents}""")
def normalised_text(spark, d):
    docs = view(spark, d, "SELECT doc_id, replace(replace(text, 'fi', 'ﬁ'), ' ', '  ') AS text FROM {documents}")
    return docs.select("doc_id", F.lit(True).alias("ok"), text.normalise(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(replace(text, ' th', 'a-' || chr(10) || 'th'), '([a-z])-\n', '\1', 'g') AS joined FROM {documents}")
def dehyphenated_lines(spark, d):
    docs = view(spark, d, "SELECT doc_id, replace(text, ' th', 'a-' || chr(10) || 'th') AS text FROM {documents}")
    return docs.select("doc_id", text.join_lines(F.split("text", "\n")).alias("joined"))


SPANS = """SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, 1 + CAST(floor(n.k / 2) AS INT) AS page, CAST(doc_id % 3 AS INT) AS block, n.k AS line, n.s AS span, CASE WHEN n.k = 1 THEN ' ' WHEN n.k = 3 AND n.s = 1 THEN NULL WHEN n.s = 0 THEN replace(text, 'fi', 'ﬁ') ELSE ' –  ' || lang || chr(9) END AS text,
  CAST(CASE WHEN n.s = 0 THEN 10.126 ELSE 9 + doc_id % 4 END AS DOUBLE) AS size, CASE WHEN n.s = 0 THEN 4 ELSE CAST(doc_id % 2 * 16 AS INT) END AS flags, CAST(72.04 AS DOUBLE) AS x0, CAST(100.26 + n.k AS DOUBLE) AS y0 FROM {documents}
  JOIN (SELECT 0 AS k, 0 AS s UNION ALL SELECT 0 AS k, 1 AS s UNION ALL SELECT 1 AS k, 0 AS s UNION ALL SELECT 2 AS k, 1 AS s UNION ALL SELECT 3 AS k, 0 AS s UNION ALL SELECT 3 AS k, 1 AS s) n ON doc_id % 7 > 0 OR n.k = 2"""


@query(rf"""WITH l AS (SELECT paper_id, page, block, line, trim(regexp_replace(replace(replace(string_agg(coalesce(text, ''), '' ORDER BY span), 'ﬁ', 'fi'), '–', '-'), '[ \t]+', ' ', 'g'), ' ' || {NL} || chr(13)) AS text, round(max(size), 2) AS size, max(flags) AS flags, round(min(x0), 1) AS x0, round(min(y0), 1) AS y0 FROM ({SPANS}) s GROUP BY ALL),
  k AS (SELECT *, sum(length(text)) OVER (PARTITION BY paper_id) AS total, row_number() OVER (PARTITION BY paper_id ORDER BY page, block, line) - 1 AS line_no FROM l WHERE text <> '')
  SELECT paper_id, CAST(line_no AS INTEGER) AS line_no, text, CAST(page AS INTEGER) AS page, size, flags & 16 > 0 AS bold, x0, y0 FROM k WHERE total >= 200""")
def lines_from_spans(spark, d):
    return files.lines_of_spans(view(spark, d, SPANS))


@query(r"SELECT page_id, trim(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), ' ' || chr(10) || chr(9) || chr(13)) AS plain FROM {pages}")
def html_stripped(spark, d):
    return view(spark, d, "SELECT page_id, html FROM {pages}").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query(r"""SELECT page_id, trim(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '-.') AS slug, regexp_matches(lower(url), '^https?://') AS safe,
  CASE WHEN length(url) <= 40 THEN url ELSE substr(url, 1, 37) || '...' END AS short, substr(sha256(url), 1, 16) AS hash FROM {pages}""")
def slugs_clips_hashes(spark, d):
    u = F.col("url")
    return view(spark, d, "SELECT page_id, url FROM {pages}").select("page_id", text.slug(u).alias("slug"), text.safe_url(u).alias("safe"), text.clip(u, 40).alias("short"), text.short_hash(u).alias("hash"))


GROUPS = "SELECT doc_id, CAST(doc_id % 20 + 1 AS STRING) || ', ' || CAST(doc_id % 9 + 1 AS STRING) || '-' || CAST(doc_id % 9 + doc_id % 80 AS STRING) || '; ' || CAST(doc_id % 5 AS STRING) AS g FROM {documents}"


@query(r"""WITH parts AS (SELECT doc_id, trim(unnest(regexp_split_to_array(g, '[,;]'))) AS p FROM (""" + GROUPS + r""")),
  bounds AS (SELECT doc_id, p, TRY_CAST(regexp_extract(p, '^(\d+)-', 1) AS INT) AS lo, TRY_CAST(regexp_extract(p, '-(\d+)$', 1) AS INT) AS hi FROM parts)
  SELECT doc_id, CAST(unnest(CASE WHEN lo IS NULL THEN [CAST(p AS INT)] WHEN hi - lo > 0 AND hi - lo < 60 THEN range(lo, hi + 1) ELSE [] END) AS BIGINT) AS number FROM bounds""")
def citation_ranges(spark, d):
    return view(spark, d, GROUPS).select("doc_id", F.explode(text.citation_numbers(F.col("g"))).alias("number")).select("doc_id", F.col("number").cast("bigint").alias("number"))


ERRORS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'HTTP 400: prompt exceeds the Context Window, schema' WHEN 1 THEN 'response_format is not supported' WHEN 2 THEN 'connection refused' ELSE '422 Unprocessable' END AS m FROM {events}"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'context' WHEN 2 THEN 'other' ELSE 'format' END AS kind FROM {events}")
def error_classes(spark, d):
    return view(spark, d, ERRORS).select("event_id", text.error_class(F.col("m")).alias("kind"))


REPLY = """SELECT conv_id, turn, role, translate(CASE turn % 3 WHEN 0 THEN '<think><x></think> Here: ' || chr(96) || chr(96) || chr(96) || 'json' || chr(10) || '«"section": "' || role || '"»' || chr(10) || chr(96) || chr(96) || chr(96) || ' done'
  WHEN 1 THEN 'Sure. «"section": "' || role || '"» and «more»' ELSE '«"section": 5»' END, '«»', chr(123) || chr(125)) AS reply FROM {conversations}"""


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '{\"section\": 5}' ELSE '{\"section\": \"' || role || '\"}' END AS json, turn % 3 <> 2 AS valid, CASE WHEN turn % 3 <> 2 THEN role END AS section FROM {conversations}")
def json_recovered(spark, d):
    r = view(spark, d, REPLY)
    p = r.withColumn("p", replies.parsed(F.col("reply"), "pass1"))
    return p.select("conv_id", "turn", replies.recover_udf("reply").alias("json"), F.col("p.ok").alias("valid"), F.col("p.value.section").alias("section"))


# Spelling -------------------------------------------------------------------------------------------------------------------

TOKENS = r"""SELECT doc_id, source AS paper_id, regexp_replace(regexp_replace(regexp_replace(c, '^[.,;:()\[\]{}"]+|[.,;:()\[\]{}"]+$', '', 'g'), '^[''’-]+|[''’-]+$', '', 'g'), '[''’]s$', '') AS token,
  regexp_replace(c, '^[.,;:()\[\]{}"]+|[.,;:()\[\]{}"]+$', '', 'g') AS raw FROM (SELECT doc_id, source, unnest(regexp_split_to_array(text, '\s+')) AS c FROM {documents} WHERE lang = 'en')"""
CHECKABLE = r"length(token) >= 3 AND regexp_full_match(token, '[A-Za-z][A-Za-z''’-]*') AND NOT regexp_matches(raw, '[0-9_]') AND upper(token) <> token"


def _english(spark, d):
    return view(spark, d, "SELECT doc_id, source AS paper_id, text FROM {documents} WHERE lang = 'en'")


@query(f"SELECT paper_id, lower(token) AS token, count(*) AS n FROM ({TOKENS}) WHERE {CHECKABLE} GROUP BY ALL")
def token_counts(spark, d):
    return spelling.word_counts(_english(spark, d), "paper_id").withColumnRenamed("word", "token")


COMMON_SQL = ", ".join(f"'{w}'" for w in spelling.COMMON_ACADEMIC)


@query(f"""WITH t AS (SELECT doc_id, paper_id, lower(token) AS w FROM ({TOKENS}) WHERE {CHECKABLE} AND NOT contains(token, '-')),
  lexicon AS (SELECT w FROM t GROUP BY w HAVING count(DISTINCT doc_id) >= 3),
  n AS (SELECT paper_id, w, count(*) AS n FROM t ANTI JOIN lexicon USING (w) WHERE w NOT IN ({COMMON_SQL}) GROUP BY ALL)
  SELECT paper_id, w AS token, n AS occurrences FROM n QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, w) <= 20""")
def spelling_candidates(spark, d):
    t = stored(spelling.word_counts(_english(spark, d), "doc_id", "paper_id").where(~F.contains("word", F.lit("-"))), "tokens")
    lexicon = t.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df >= 3").select("word", F.lit("").alias("language"))
    words = t.groupBy("paper_id", "word").agg(F.sum("n").alias("occurrences")).withColumn("language", F.lit(""))
    found = spelling.unknown(words, spark.createDataFrame([], "paper_id string, word string"), lexicon)
    return spelling.ranked(found, ["paper_id"], 20).select("paper_id", F.col("word").alias("token"), "occurrences")


LEXICON = "SELECT lower(regexp_replace(word, '[^A-Za-z]', '', 'g')) AS word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM {documents} WHERE lang = 'en')"


#: A word and what is left of it without one letter: words one edit apart have one of these in common.
LEAN_SQL = LEAN = "SELECT word, unnest(list_concat([word], [substr(word, 1, i - 1) || substr(word, i + 1) FOR i IN range(1, length(word) + 1)])) AS lean FROM "


@query(f"""WITH l AS (SELECT word, count(*) AS frequency FROM ({LEXICON}) WHERE word <> '' GROUP BY word), typed AS (SELECT word FROM l WHERE frequency = 1),
  known AS (SELECT * FROM l WHERE frequency >= 5), near AS (SELECT DISTINCT t.word, k.word AS suggestion FROM ({LEAN} typed) t JOIN ({LEAN} known) k USING (lean))
  SELECT n.word, n.suggestion FROM near n JOIN known k ON k.word = n.suggestion WHERE damerau_levenshtein(n.word, n.suggestion) = 1
  QUALIFY row_number() OVER (PARTITION BY n.word ORDER BY k.frequency DESC, n.suggestion) = 1""")
def spelling_suggestions(spark, d):
    docs = view(spark, d, "SELECT text FROM {documents} WHERE lang = 'en'")
    w = docs.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    w = w.select(F.lower(F.regexp_replace("w", "[^A-Za-z]", "")).alias("word"), "n").where("word <> ''")
    n = stored(w.groupBy("word").agg(F.sum("n").alias("frequency")), "words")
    return spelling.suggestions(n.where("frequency = 1").select("word"), n.where("frequency >= 5"))


# Structure ------------------------------------------------------------------------------------------------------------------

KIND_SQL = "CASE " + " ".join("WHEN regexp_matches(lower(title), '{}') THEN '{}'".format("|".join(w), k) for k, w in sections.KINDS) + " ELSE 'other' END"
KNOWN_SQL = ", ".join(f"'{h}'" for h in sections.KNOWN_HEADINGS)
HEADINGS_SQL = rf"""h0 AS (SELECT paper_id, line_no, trim(text) AS t FROM lines WHERE length(trim(text)) BETWEEN 1 AND 120 AND NOT regexp_matches(trim(text), '[.!?,;:]$')),
  h1 AS (SELECT paper_id, line_no, CASE WHEN regexp_matches(t, '^\d+(\.\d+)*\.?\s+\S') THEN regexp_extract(t, '^(\d+(?:\.\d+)*)', 1) WHEN lower(t) IN ({KNOWN_SQL}) THEN '' END AS number,
           CASE WHEN regexp_matches(t, '^\d+(\.\d+)*\.?\s+\S') THEN regexp_extract(t, '^\d+(?:\.\d+)*\.?\s+(.*)$', 1) ELSE t END AS title FROM h0),
  h2 AS (SELECT *, count(*) OVER (PARTITION BY paper_id, lower(title)) AS times, coalesce(lead(line_no) OVER (PARTITION BY paper_id ORDER BY line_no), (SELECT max(line_no) + 1 FROM lines l WHERE l.paper_id = h1.paper_id)) - line_no AS gap
         FROM h1 WHERE number IS NOT NULL AND NOT (number <> '' AND regexp_matches(substr(title, 1, 1), '^\p{{Ll}}'))),
  h AS (SELECT paper_id, line_no, number, title FROM h2 WHERE times <= 2 AND gap >= 2),
  s AS (SELECT l.*, h.number, h.title, count(h.number) OVER (PARTITION BY l.paper_id ORDER BY l.line_no) AS nth FROM lines l LEFT JOIN h USING (paper_id, line_no)),
  sec AS (SELECT paper_id, nth, max(number) AS number, coalesce(max(title), 'Front matter') AS title, min(page) FILTER (number IS NULL) AS start_page, max(page) FILTER (number IS NULL) AS end_page,
          coalesce(string_agg(text, {NL} ORDER BY line_no) FILTER (number IS NULL), '') AS text FROM s GROUP BY paper_id, nth),
  sections AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY nth) - 1 AS section_idx, coalesce(number, '') AS number, title, trim(coalesce(number, '') || ' ' || title) AS label, {KIND_SQL} AS kind, text, start_page, end_page FROM sec)"""


@query(f"WITH {LINES_SQL}, {HEADINGS_SQL} SELECT paper_id, CAST(section_idx AS BIGINT) AS section_idx, number, title, label, kind, text, CAST(start_page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page FROM sections")
def paper_sections(spark, d):
    s = sections.sections(lines(spark, d))
    return s.withColumns({c: F.col(c).cast("bigint") for c in ("section_idx", "start_page", "end_page")})


@query(f"WITH {LINES_SQL}, {HEADINGS_SQL} SELECT paper_id, label FROM sections WHERE kind NOT IN ('references', 'back_matter') AND length(trim(text)) > 200")
def reviewable_sections(spark, d):
    return sections.reviewable(sections.sections(lines(spark, d))).select("paper_id", "label")


AFFIXES = "SFX S Y 2\nSFX S y ies [^aeiou]y\nSFX S 0 s [^y]\nPFX U Y 1\nPFX U 0 un .\nSFX N N 1\nSFX N e ing e\n"


@query(f"""WITH w AS (SELECT DISTINCT word, length(word) % 3 AS k FROM ({LEXICON}) l WHERE word <> ''),
  s AS (SELECT word, CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN substr(word, 1, length(word) - 1) || 'ies' WHEN regexp_matches(word, '[^y]$') THEN word || 's' END AS form FROM w WHERE k < 2)
  SELECT DISTINCT form AS word FROM (SELECT word AS form FROM w UNION ALL SELECT form FROM s UNION ALL SELECT 'un' || word FROM w WHERE k = 1 UNION ALL SELECT 'un' || s.form FROM s JOIN w ON w.word = s.word AND w.k = 1 UNION ALL SELECT substr(word, 1, length(word) - 1) || 'ing' FROM w WHERE k = 2 AND word LIKE '_%e') f WHERE form IS NOT NULL""")
def affix_forms(spark, d):
    docs = view(spark, d, "SELECT text FROM {documents} WHERE lang = 'en'")
    w = docs.select(F.explode(F.split("text", " ")).alias("w")).select(F.lower(F.regexp_replace("w", "[^A-Za-z]", "")).alias("word")).where("word <> ''").distinct()
    k = F.length("word") % 3
    flags = F.when(k == 0, F.array(F.lit("S"))).when(k == 1, F.array(F.lit("U"), F.lit("S"))).otherwise(F.array(F.lit("N")))
    return affixes.forms(w.withColumn("flags", flags), affixes.rules(spark, AFFIXES))


BETWEEN_SQL = r"""string_split(array_to_string([CASE WHEN {goes_on} THEN p || ' ' ELSE p || chr(1) END FOR p IN {pieces}], ''), chr(1))""".format(goes_on=GOES_ON, pieces=PIECES)
SAID_SQL = rf"""body AS (SELECT paper_id, section_idx, label, start_page, regexp_replace(regexp_replace(text, '\\[A-Za-z]+|\$[^$]*\$', ' ', 'g'), 'https?://\S+|www\.\S+|\b10\.\d{{4,9}}/\S+', ' ', 'g') AS text FROM sections),
  said AS (SELECT paper_id, section_idx, label, start_page, i, trim(s[i]) AS sentence FROM (SELECT *, {BETWEEN_SQL} AS s FROM body) m, range(1, len(s) + 1) t(i) WHERE trim(s[i]) <> '')"""
ENDS_SQL = r"""regexp_replace({0}, '^[.,;:()\[\]{{}}"]+|[.,;:()\[\]{{}}"]+$', '', 'g')"""
TOKEN_SQL = r"""regexp_replace(regexp_replace({0}, '^[''’-]+|[''’-]+$', '', 'g'), '[''’]s$', '')"""


@query(rf"""WITH {LINES_SQL}, {HEADINGS_SQL}, {SAID_SQL},
  raw AS (SELECT paper_id, section_idx, label, start_page, i, j, sentence, {ENDS_SQL.format("chunks[j]")} AS raw FROM (SELECT *, regexp_split_to_array(sentence, '\s+') AS chunks FROM said) c, range(1, len(chunks) + 1) u(j)),
  tok AS (SELECT *, lower(token) AS w FROM (SELECT *, {TOKEN_SQL.format("raw")} AS token FROM raw) t WHERE {CHECKABLE}),
  allow AS (SELECT paper_id, lower(unnest(regexp_extract_all(text, '\(([A-Z][A-Za-z0-9]{{1,9}})s?\)', 1))) AS w FROM papers UNION SELECT paper_id, unnest(['belady', 'systems', 'journal', 'mattson', 'evaluation']) FROM papers),
  seen AS (SELECT paper_id, section_idx, label, start_page, w, count(*) AS n, arg_min(token, (i, j)) AS token, arg_min(sentence, (i, j)) AS sentence FROM tok WHERE w NOT IN ({COMMON_SQL}) GROUP BY ALL),
  open_words AS (SELECT * FROM seen ANTI JOIN allow USING (paper_id, w)),
  every AS (SELECT paper_id, lower({TOKEN_SQL.format("raw")}) AS w FROM (SELECT paper_id, {ENDS_SQL.format("c")} AS raw, {TOKEN_SQL.format(ENDS_SQL.format("c"))} AS token FROM (SELECT paper_id, unnest(regexp_split_to_array(text, '\s+')) AS c FROM sections) x) y WHERE {CHECKABLE}),
  lexicon AS (SELECT w FROM every GROUP BY w HAVING count(DISTINCT paper_id) >= 3),
  parts AS (SELECT DISTINCT paper_id, whole, w FROM (SELECT paper_id, w AS whole, unnest(string_split(w, '-')) AS w FROM open_words WHERE contains(w, '-')) p WHERE length(w) >= 3 AND w NOT IN ({COMMON_SQL})),
  odd AS (SELECT DISTINCT paper_id, whole AS w FROM parts ANTI JOIN allow USING (paper_id, w) ANTI JOIN lexicon USING (w)),
  unknown_words AS (SELECT * FROM open_words ANTI JOIN lexicon USING (w) WHERE NOT contains(w, '-') UNION ALL SELECT * FROM open_words SEMI JOIN odd USING (paper_id, w) WHERE contains(w, '-')),
  top AS (SELECT * FROM unknown_words QUALIFY row_number() OVER (PARTITION BY paper_id, section_idx ORDER BY n DESC, w) <= 120),
  typed AS (SELECT DISTINCT w AS word FROM top), known AS (SELECT w AS word FROM lexicon),
  near AS (SELECT DISTINCT t.word, k.word AS suggestion FROM ({LEAN_SQL} typed) t JOIN ({LEAN_SQL} known) k USING (lean)),
  better AS (SELECT word, min(suggestion) AS suggestion FROM near WHERE damerau_levenshtein(word, suggestion) = 1 AND (levenshtein(word, suggestion) = 2 OR regexp_replace(word, '[a-z]', '', 'g') = regexp_replace(suggestion, '[a-z]', '', 'g')
    OR length(regexp_replace(word, '[a-z]', '', 'g')) > length(regexp_replace(suggestion, '[a-z]', '', 'g'))) GROUP BY word)
  SELECT paper_id, CAST(section_idx AS BIGINT) AS section_idx, token, CASE WHEN length(sentence) <= 300 THEN sentence ELSE substr(sentence, 1, 297) || '...' END AS sentence, label || ' (p. ' || start_page || ')' AS location, n AS occurrences, suggestion FROM top LEFT JOIN better ON better.word = top.w""")
def section_spelling(spark, d):
    s = stored(sections.sections(lines(spark, d)), "sections")
    # a paper's words are counted where it lies, each once
    t = spelling.word_counts(s.repartition("paper_id"), "paper_id").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("word")
    found = spelling.candidates(s, spelling.allowlist(view(spark, d, PAPERS), references.references(s)), stored(t, "lexicon"))
    return found.withColumn("section_idx", F.col("section_idx").cast("bigint"))


INVENTORY = "SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, n.ord, n.number, n.title FROM {documents} JOIN (SELECT 1 AS ord, '' AS number, 'abstract!' AS title, 0 AS k UNION ALL SELECT 2 AS ord, '1' AS number, ' Introduction' AS title, 0 AS k UNION ALL SELECT 3 AS ord, '2.1' AS number, 'Results, and discussion' AS title, 1 AS k UNION ALL SELECT 4 AS ord, '' AS number, 'REFERENCES' AS title, 0 AS k UNION ALL SELECT 5 AS ord, '' AS number, 'No such' AS title, 0 AS k) n ON doc_id % 3 >= n.k"
TITLE_KEY_SQL = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]+', '', 'g'))"


@query(rf"""WITH {LINES_SQL}, {HEADINGS_SQL},
  wanted AS (SELECT paper_id, ord, trim(number) AS number, trim(title) AS title FROM ({INVENTORY}) i),
  mark AS (SELECT l.paper_id, w.ord, w.number, w.title, min(l.line_no) AS line_no FROM lines l JOIN wanted w ON w.paper_id = l.paper_id AND length(l.text) <= 120 AND {TITLE_KEY_SQL.format("l.text")} IN ({TITLE_KEY_SQL.format("w.title")}, {TITLE_KEY_SQL.format("trim(w.number || ' ' || w.title)")}) GROUP BY ALL),
  s2 AS (SELECT l.*, m.number, m.title, count(m.number) OVER (PARTITION BY l.paper_id ORDER BY l.line_no) AS nth FROM lines l LEFT JOIN mark m USING (paper_id, line_no)),
  sec2 AS (SELECT paper_id, nth, max(number) AS number, coalesce(max(title), 'Front matter') AS title, min(page) FILTER (number IS NULL) AS start_page, max(page) FILTER (number IS NULL) AS end_page, coalesce(string_agg(text, {NL} ORDER BY line_no) FILTER (number IS NULL), '') AS text FROM s2 GROUP BY paper_id, nth),
  fresh AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY nth) - 1 AS section_idx, coalesce(number, '') AS number, title, trim(coalesce(number, '') || ' ' || title) AS label, {KIND_SQL} AS kind, text, start_page, end_page FROM sec2),
  better AS (SELECT f.paper_id FROM (SELECT paper_id, count(*) AS n FROM fresh GROUP BY paper_id) f JOIN (SELECT paper_id, count(*) AS n FROM sections GROUP BY paper_id) o ON o.paper_id = f.paper_id AND f.n >= o.n),
  taken AS (SELECT * FROM fresh SEMI JOIN better USING (paper_id) UNION ALL SELECT * FROM sections ANTI JOIN better USING (paper_id))
  SELECT paper_id, CAST(section_idx AS BIGINT) AS section_idx, number, title, label, kind, text, CAST(start_page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page FROM taken""")
def sections_from_inventory(spark, d):
    own = lines(spark, d)
    found = sections.accept_resplit(sections.sections(own), sections.resplit(own, view(spark, d, INVENTORY)))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("section_idx", "start_page", "end_page")})


@query(rf"""WITH {LINES_SQL}, {HEADINGS_SQL},
  c AS (SELECT paper_id, line_no, page, text, regexp_extract(text, '^(Figure|Table)\s*(\d+)\s*[.:]\s*(.*)$', ['k', 'n', 'c']) AS m FROM lines WHERE regexp_matches(text, '^(Figure|Table)\s*\d+\s*[.:]\s*.{{10}}')),
  named AS (SELECT DISTINCT s.paper_id, m.k || ' ' || m.n AS id FROM (SELECT paper_id, unnest(string_split(text, {NL})) AS line FROM sections WHERE kind <> 'references') s, LATERAL (SELECT regexp_extract(line, '\b(Figure|Table)s?\.?\s*(\d+)\b', ['k', 'n']) AS m) x
            WHERE m.k <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.paper_id = s.paper_id AND c.text = s.line))
  SELECT paper_id, lower(m.k) AS kind, m.k || ' ' || m.n AS id, trim(m.c) AS caption, CAST(page AS BIGINT) AS page, (paper_id, m.k || ' ' || m.n) IN (SELECT (paper_id, id) FROM named) AS referenced_in_text FROM c""")
def paper_captions(spark, d):
    own = lines(spark, d)
    found = captions.with_mentions(captions.captions(own), captions.mentions(own, sections.sections(own)))
    return found.withColumn("page", F.col("page").cast("bigint"))


@query(f"""WITH {LINES_SQL}, spot AS (SELECT paper_id, min(line_no) AS spot FROM lines WHERE text LIKE 'Table 1%' OR contains(text, 'Means of all measures') GROUP BY paper_id)
  SELECT l.paper_id, 'Table 1' AS id, string_agg(text, {NL} ORDER BY line_no) AS text FROM lines l JOIN spot USING (paper_id) WHERE line_no BETWEEN greatest(0, spot - 2) AND spot + 39 GROUP BY l.paper_id""")
def table_windows(spark, d):
    own = lines(spark, d)
    return captions.table_windows(own, captions.captions(own))


@query(f"WITH {LINES_SQL}, {HEADINGS_SQL}, c AS (SELECT paper_id, page, regexp_extract(text, '^((Figure|Table) \\d+)[.:] ', 1) AS id FROM lines WHERE regexp_matches(text, '^(Figure|Table) \\d+[.:] ')) SELECT s.paper_id, CAST(section_idx AS BIGINT) AS section_idx, c.id FROM sections s JOIN c ON s.paper_id = c.paper_id AND c.page BETWEEN s.start_page AND s.end_page")
def captions_by_section(spark, d):
    own = lines(spark, d)
    return captions.per_section(captions.captions(own), sections.sections(own)).select("paper_id", F.col("section_idx").cast("bigint").alias("section_idx"), "id")


# References -----------------------------------------------------------------------------------------------------------------

ENTRIES = """SELECT 'p' || CAST(item_id % 4 AS STRING) AS paper_id, CAST(item_id AS INT) AS pos, CASE WHEN item_id % 2 = 0 THEN '[' || CAST(item_id + 1 AS STRING) || '] ' ELSE '' END
  || 'Surname, X. (' || CAST(1950 + item_id % 60 AS STRING) || '). ' || substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 60) || '. Venue. doi:10.1000/x.' || CAST(item_id AS STRING) || '.' AS entry FROM {benchmark}"""
SPARK_ENTRIES = ENTRIES.replace(", 'g')", ")")


@query(rf"""WITH e AS ({ENTRIES}) SELECT paper_id, CAST(CASE WHEN entry LIKE '[%' THEN CAST(regexp_extract(entry, '^\[(\d+)\]', 1) AS INT) ELSE pos + 1 END AS BIGINT) AS ref_index, regexp_replace(entry, '^\[\d+\]\s+', '') AS raw,
  regexp_extract(entry, '10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]*[A-Za-z0-9]') AS doi, nullif(regexp_extract(entry, '\b(19|20)\d{{2}}\b'), '') AS year, 'Surname' AS author FROM e""")
def reference_fields(spark, d):
    r = references.numbered_entries(view(spark, d, SPARK_ENTRIES))
    return r.select("paper_id", F.col("ref_index").cast("bigint").alias("ref_index"), "raw", "doi", "year", F.element_at("authors", 1).alias("author"))


TITLED = """SELECT 'p' || CAST(item_id % 4 AS STRING) AS paper_id, CAST(item_id AS INT) AS pos, '[' || CAST(item_id + 1 AS STRING) || '] ' || CASE item_id % 5
  WHEN 0 THEN 'Surname, X., Other, Y. and Third, Z. (1999). ' || text || ' Venue of venues, 12(3). doi:10.1000/x.y/12.' WHEN 1 THEN 'Surname, A. B. C. D. Of initials E. many. ' || text || '? Proceedings of Things.' WHEN 2 THEN 'Short. Tiny.'
  WHEN 3 THEN 'Surname, X. and Otherlong, Y. and Third, Z. 1234567890 12345678. Then ' || upper(text) ELSE text END AS entry FROM {benchmark}"""
DOI_SQL = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
TITLE_SQL = rf"""list_extract(list_concat([p FOR p IN long IF length(regexp_extract_all(p, '\b[A-Z]\.')) <= 2 AND length(regexp_extract_all(regexp_replace(p, '[^A-Za-z ]', '', 'g'), '[A-Za-z]+')) >= 3], long), 1)"""
LONG_SQL = rf"""[p FOR p IN [regexp_replace(c, '^[ .,]+|[ .,]+$', '', 'g') FOR c IN string_split(regexp_replace(regexp_replace(raw, '{DOI_SQL}', '', 'g'), '([.?])\s+', '\1' || chr(1), 'g'), chr(1))] IF length(p) > 15 AND NOT regexp_full_match(p, '[A-Z][A-Za-z''\-]+(,? (and |& )?[A-Z]\.)+')]"""


@query(rf"SELECT paper_id, CAST(pos + 1 AS BIGINT) AS ord, {TITLE_SQL} AS title FROM (SELECT *, {LONG_SQL} AS long FROM (SELECT paper_id, pos, regexp_replace(entry, '^\[\d+\]\s+', '') AS raw FROM ({TITLED}) e) r) l")
def reference_titles(spark, d):
    return references.numbered_entries(view(spark, d, TITLED)).select("paper_id", F.col("ord").cast("bigint").alias("ord"), "title")


CITES_SQL = rf"""body AS (SELECT paper_id, section_idx, label, start_page, kind, text FROM sections WHERE kind NOT IN ('references', 'back_matter')),
  said AS (SELECT paper_id, section_idx, label, start_page, i, trim(s[i]) AS sentence FROM (SELECT *, {BETWEEN_SQL} AS s FROM body) m, range(1, len(s) + 1) t(i) WHERE trim(s[i]) <> ''),
  grouped AS (SELECT paper_id, section_idx, label, start_page, i, sentence, unnest(regexp_extract_all(sentence, '\[(\d{{1,3}}(?:\s*[-,;]\s*\d{{1,3}})*)\]', 1)) AS g FROM said),
  part AS (SELECT paper_id, section_idx, label, start_page, i, sentence, trim(unnest(string_split(replace(g, ';', ','), ','))) AS p FROM grouped),
  bound AS (SELECT *, TRY_CAST(regexp_extract(p, '^(\d+)\s*-\s*(\d+)$', 1) AS INT) AS lo, TRY_CAST(regexp_extract(p, '^(\d+)\s*-\s*(\d+)$', 2) AS INT) AS hi FROM part),
  number AS (SELECT paper_id, section_idx, label, start_page, i, CASE WHEN length(sentence) <= 400 THEN sentence ELSE substr(sentence, 1, 397) || '...' END AS quote, unnest(CASE WHEN lo IS NOT NULL THEN CASE WHEN hi - lo > 0 AND hi - lo < 60 THEN range(lo, hi + 1) ELSE [] END WHEN regexp_full_match(p, '\d+') THEN [CAST(p AS BIGINT)] ELSE [] END) AS ref_index FROM bound),
  quoted AS (SELECT paper_id, ref_index, quote, min((section_idx, i, label || ' (p. ' || start_page || ')')) AS m FROM number WHERE ref_index IN (1, 2) GROUP BY ALL),
  cited AS (SELECT paper_id, ref_index, quote, m[3] AS location, row_number() OVER (PARTITION BY paper_id, ref_index ORDER BY m) AS nth FROM quoted QUALIFY nth <= 4)"""


@query(rf"""WITH {LINES_SQL}, {HEADINGS_SQL}, {CITES_SQL}, refs AS (SELECT paper_id, unnest([1, 2]) AS ref_index FROM papers)
  SELECT paper_id, CAST(ref_index AS BIGINT) AS ref_index, count(quote) AS n, '[' || coalesce(string_agg('{{"quote":' || CAST(to_json(quote) AS VARCHAR) || ',"location":' || CAST(to_json(location) AS VARCHAR) || '}}', ',' ORDER BY nth), '') || ']' AS sentences FROM refs LEFT JOIN cited USING (paper_id, ref_index) GROUP BY paper_id, ref_index""")
def citing_sentences(spark, d):
    s = stored(sections.sections(lines(spark, d)), "sections")
    refs = references.citing_sentences(references.references(s), s)
    return refs.select("paper_id", F.col("ref_index").cast("bigint").alias("ref_index"), F.size("citing_sentences").cast("bigint").alias("n"), F.to_json("citing_sentences").alias("sentences"))


@query(f"WITH e AS ({ENTRIES}), n AS (SELECT paper_id, pos, row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1 AS k FROM e) SELECT paper_id, CAST(k // 3 AS BIGINT) AS batch, count(*) AS refs, CAST(min(pos) + 1 AS BIGINT) AS first FROM n GROUP BY paper_id, k // 3")
def reference_batches(spark, d):
    b = references.batches(references.numbered_entries(view(spark, d, SPARK_ENTRIES)), 3)
    return b.select("paper_id", F.col("batch").cast("bigint").alias("batch"), F.size("refs").cast("bigint").alias("refs"), F.array_min(F.col("refs.ord")).cast("bigint").alias("first"))


# Titles that a lookup gives have a last word in the alphabet's order, of several lengths, put behind: how alike they are follows from lengths.
WORDS_SQL = "array_to_string(list_sort([w FOR w IN string_split(trim(regexp_replace(lower(title), '[^a-z0-9 ]+', ' ', 'g')), ' ') IF w <> '']), ' ')"


@query(rf"""WITH e AS ({ENTRIES}), r AS (SELECT paper_id, pos + 1 AS ord, regexp_replace(entry, '^\[\d+\]\s+', '') AS raw FROM e), l AS (SELECT *, {LONG_SQL} AS long FROM r), t AS (SELECT paper_id, ord, raw, {TITLE_SQL} AS title FROM l),
  n AS (SELECT *, length({WORDS_SQL}) AS n, CASE ord % 3 WHEN 0 THEN 41 WHEN 1 THEN 5 ELSE 0 END AS more FROM t), s AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE 200.0::DOUBLE * n / (n + n + more) END AS plain FROM n),
  p AS (SELECT *, CASE WHEN ord % 5 = 0 THEN greatest(0, plain - 25) ELSE plain END AS dated FROM s)
  SELECT paper_id, CAST(ord AS BIGINT) AS ord, ord % 4 = 0 OR dated >= 78 OR plain >= 78 AS found, CASE WHEN ord % 4 = 0 THEN 'doi' WHEN dated >= 78 THEN 'text' WHEN plain >= 78 THEN 'title' END AS step,
    CASE WHEN ord % 4 = 0 THEN 'https://doi.org/10.1000/x.' || (ord - 1) WHEN dated >= 78 OR plain >= 78 THEN 'https://example.org/' || ord END AS found_url, CASE WHEN ord % 4 = 0 THEN 100 WHEN dated >= 78 THEN dated WHEN plain >= 78 THEN plain END AS match_score FROM p""")
def lookup_cascade(spark, d):
    refs = references.numbered_entries(view(spark, d, SPARK_ENTRIES))
    more = F.when(F.col("ord") % 3 == 0, " " + "z" * 40).when(F.col("ord") % 3 == 1, " zzzz").otherwise("")
    found = refs.select("paper_id", "ord", F.lit(1).alias("rank"), F.concat("title", more).alias("title"), F.when(F.col("ord") % 5 == 0, "1905").otherwise(F.col("year")).alias("year"), F.concat(F.lit("https://example.org/"), F.col("ord").cast("string")).alias("url"))
    by_doi = refs.where("ord % 4 = 0").select("doi", F.concat(F.lit("https://doi.org/"), "doi").alias("url"), "title").dropDuplicates(["doi"])
    return references.cascade(refs, ["paper_id", "ord"], by_doi, found, found).select("paper_id", F.col("ord").cast("bigint").alias("ord"), "found", "step", "found_url", "match_score")


CHECKS = """SELECT 'p' || CAST(item_id % 4 AS STRING) AS paper_id, CAST(item_id AS INT) AS ref_index, item_id AS ord, 'Raw ' || CAST(item_id AS STRING) AS raw,
  CASE item_id % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'metadata_mismatch' WHEN 2 THEN 'not_found' WHEN 3 THEN 'retracted' ELSE 'could_not_verify' END AS status, 'https://example.org/' || CAST(item_id AS STRING) AS found_at,
  CASE WHEN item_id % 2 = 0 THEN 'Year differs.' ELSE '' END AS mismatch_details, CASE item_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'weaker' WHEN 2 THEN 'different' ELSE 'unrelated' END AS supports_claim, 'Seen.' AS notes, '' AS location FROM {benchmark}"""


@query(f"""WITH c AS ({CHECKS}), s AS (SELECT *, CASE WHEN status = 'retracted' THEN 'critical' WHEN status IN ('not_found', 'metadata_mismatch') THEN 'major' WHEN supports_claim IN ('different', 'unrelated') THEN 'major' WHEN supports_claim = 'weaker' THEN 'minor' END AS severity FROM c)
  SELECT paper_id, severity, 'Reference [' || ref_index || ']' AS location, raw AS quote, status AS verdict, found_at AS url,
  'Reference [' || ref_index || ']' || CASE status WHEN 'retracted' THEN ' is retracted. ' WHEN 'not_found' THEN ' could not be found in a bibliographic database. ' WHEN 'metadata_mismatch' THEN ' metadata does not match the published record. '
    ELSE CASE WHEN supports_claim = 'weaker' THEN ' supports a weaker claim than the one it is cited for. ' ELSE ' does not support the claim it is cited for (' || supports_claim || '). ' END END || CASE WHEN mismatch_details = '' THEN notes ELSE mismatch_details END AS description
  FROM s WHERE severity IS NOT NULL""")
def reference_findings(spark, d):
    none = spark.createDataFrame([], "paper_id string, ord bigint, quote string, location string, why_needed string")
    return findings.from_pass3(view(spark, d, CHECKS), none).select("paper_id", "severity", "location", "quote", "verdict", "url", "description")


@query(f"""WITH c AS ({CHECKS}) SELECT paper_id, CAST(ref_index AS BIGINT) AS ref_index, '- [' || ref_index || '] ' || CASE status WHEN 'verified' THEN 'verified' WHEN 'metadata_mismatch' THEN 'metadata mismatch' WHEN 'not_found' THEN 'not found' WHEN 'retracted' THEN 'RETRACTED' ELSE 'could not verify' END
  || ': ' || raw || ' (' || found_at || ')' || CASE WHEN status <> 'verified' THEN ' - ' || CASE WHEN mismatch_details = '' THEN notes ELSE mismatch_details END ELSE '' END AS line FROM c""")
def reference_audit(spark, d):
    return report.audit_lines(view(spark, d, CHECKS)).select("paper_id", F.col("ref_index").cast("bigint").alias("ref_index"), "line")


RECORDS = "SELECT paper_id, ref_index, ref_index % 3 <> 0 AS found, 'https://r.org/' || CAST(ref_index AS STRING) AS url, ref_index % 7 = 1 AS is_retracted, 'Withdrawn' AS retraction_notes, ref_index % 2 = 0 AS is_preprint FROM (" + CHECKS + ") c"


@query(f"""WITH c AS ({CHECKS}), r AS ({RECORDS}), j AS (SELECT c.*, r.found, r.url AS u, r.is_retracted, r.is_preprint, c.ref_index % 6 <> 5 AS replied FROM c JOIN r USING (paper_id, ref_index))
  SELECT paper_id, CAST(ref_index AS BIGINT) AS ref_index, CASE WHEN NOT replied THEN 'could_not_verify' WHEN is_retracted THEN 'retracted' WHEN NOT found THEN 'not_found' ELSE status END AS status, CASE WHEN found THEN u ELSE '' END AS found_at,
  CASE WHEN NOT replied THEN 'no_search_tool: no lookup result was available for this entry.' ELSE notes || CASE WHEN is_retracted THEN ' Retraction notice: Withdrawn' ELSE '' END || CASE WHEN is_preprint THEN ' Indexed as a preprint.' ELSE '' END END AS notes FROM j""")
def references_reconciled(spark, d):
    c = view(spark, d, CHECKS)
    r = references.reconcile(c.select("paper_id", "ref_index", "raw"), view(spark, d, RECORDS), c.where("ref_index % 6 <> 5"))
    return r.select("paper_id", F.col("ref_index").cast("bigint").alias("ref_index"), "status", "found_at", "notes")


QUOTES = "SELECT source AS paper_id, doc_id AS ord, substr(text, 1, 50) || CASE doc_id % 4 WHEN 0 THEN ' [3, 5]' WHEN 1 THEN ' (Belady et al., 1966)' ELSE '' END AS quote FROM {documents}"


@query("SELECT source AS paper_id, doc_id AS ord FROM {documents} WHERE doc_id % 4 > 1")
def missing_citations(spark, d):
    return references.missing_citations(view(spark, d, QUOTES))[0].select("paper_id", "ord")


@query()
def title_scores(spark, d):
    b = view(spark, d, "SELECT item_id, substr(text, 1, 60) AS a, substr(text, 10, 70) AS b FROM {benchmark}")
    return b.select("item_id", score_match(F.col("a"), F.col("b"), F.lit("2001"), F.lit("2005")).alias("score"))


# Findings -------------------------------------------------------------------------------------------------------------------

KEYED = r"SELECT *, lower(trim(category)) AS kc, lower(trim(location)) AS kl, substr(lower(regexp_replace(trim(quote), '\s+', ' ', 'g')), 1, 120) AS kq, CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 ELSE 3 END AS rank FROM (%s) f"


@query("SELECT paper_id, ord, severity, quote FROM (" + KEYED % FINDING + ") q QUALIFY row_number() OVER (PARTITION BY paper_id, source_pass, kc, kl, kq ORDER BY rank, source_pass, category, location, ord) = 1")
def findings_dedupe_exact(spark, d):
    return findings.dedupe_exact(view(spark, d, FINDING)).select("paper_id", "ord", "severity", "quote")


@query()
def findings_dedupe_fuzzy(spark, d):
    return findings.dedupe(view(spark, d, FINDING)).select("paper_id", "ord", "severity", "quote")


@query("""WITH q AS (""" + KEYED % RUNS + """) SELECT paper_id, arg_min(ord, (run_no, ord)) AS ord, CASE WHEN count(DISTINCT run_no) >= 2 THEN 'stable' ELSE 'unstable' END AS stability FROM q GROUP BY paper_id, source_pass, kc, kl, kq""")
def runs_merged_exact(spark, d):
    return findings.merge_runs_exact(view(spark, d, RUNS), 2).select("paper_id", "ord", "stability")


@query()
def runs_merged_fuzzy(spark, d):
    return findings.merge_runs(view(spark, d, RUNS), 2).select("paper_id", "ord", "stability")


@query("SELECT paper_id, ord, row_number() OVER (PARTITION BY paper_id ORDER BY rank, source_pass, category, location, ord) AS place FROM (" + KEYED % FINDING + ") q")
def findings_sorted(spark, d):
    return findings.ordered(view(spark, d, FINDING)).select("paper_id", "ord", "place")


@query("SELECT paper_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) AS total FROM (" + FINDING + ") f GROUP BY paper_id")
def severity_counts(spark, d):
    return findings.severity_counts(view(spark, d, FINDING))


@query("""WITH q AS (""" + KEYED % RUNS + """), m AS (SELECT paper_id, CASE WHEN count(DISTINCT run_no) >= 2 THEN 'stable' ELSE 'unstable' END AS stability FROM q GROUP BY paper_id, source_pass, kc, kl, kq) SELECT paper_id, stability, count(*) AS n FROM m GROUP BY ALL""")
def stability_counts(spark, d):
    return findings.stability_counts(findings.merge_runs_exact(view(spark, d, RUNS), 2))


@query("WITH f AS (" + FINDING + """) SELECT paper_id, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN count(*) FILTER (severity = 'critical') || ' critical and ' || count(*) FILTER (severity = 'major') || ' major findings were reported. The most serious: ' || arg_min(description, ord) FILTER (severity = 'critical')
  WHEN count(*) FILTER (severity = 'major') > 0 THEN 'No critical findings. ' || count(*) FILTER (severity = 'major') || ' major findings were reported. The most serious: ' || arg_min(description, ord) FILTER (severity = 'major')
  ELSE 'No critical or major findings. ' || count(*) || ' findings in total, all minor.' END AS line FROM f GROUP BY paper_id""")
def verdict_lines(spark, d):
    return report.verdict_lines(view(spark, d, FINDING))


@query(r"SELECT paper_id, source_pass AS pass, severity, trim(regexp_replace(quote, '\s+', ' ', 'g')) AS quote, trim(regexp_replace(description, '\s+', ' ', 'g')) AS description FROM (" + FINDING + ") f")
def findings_export(spark, d):
    return report.export(view(spark, d, FINDING)).select("paper_id", "pass", "severity", "quote", "description")


TRIAGE = """SELECT source AS paper_id, doc_id AS entry, 'Section ' || CAST(doc_id % 4 AS STRING) AS section, text AS quote, CASE doc_id % 3 WHEN 0 THEN 'typo' WHEN 1 THEN 'inconsistent' ELSE 'domain_term' END AS classification FROM {documents}"""


@query("""WITH t AS (""" + TRIAGE + """) SELECT paper_id, 'major' AS severity, 'grammar' AS category, section AS location, quote, 'd' AS description FROM t
  UNION ALL SELECT paper_id, 'minor', CASE classification WHEN 'typo' THEN 'spelling' ELSE 'language' END, section, 'teh', CASE classification WHEN 'typo' THEN 'Misspelling: ''teh''.' ELSE 'Inconsistent spelling of ''teh'' across the paper.' END FROM t WHERE classification <> 'domain_term'""")
def pass1_findings(spark, d):
    t = view(spark, d, TRIAGE)
    triage = F.array(F.struct(F.lit("teh").alias("token"), F.col("classification"), F.lit("the").alias("correction"), F.lit("").alias("quote"), F.lit("").alias("location")))
    own = F.array(F.struct(F.lit("major").alias("severity"), F.lit("grammar").alias("category"), F.lit("").alias("location"), F.col("quote"), F.lit("d").alias("description"), F.lit("").alias("correction")))
    r = t.select("paper_id", "entry", F.struct("section", triage.alias("spellcheck_triage"), own.alias("findings")).alias("reply"))
    return findings.from_pass1(r).select("paper_id", "severity", "category", "location", "quote", "description")


def _pass2(spark, d):
    t = view(spark, d, "SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, 0 AS entry, doc_id, substr(text, 1, 60) AS quote FROM {documents}")
    own = F.array(F.struct(F.lit("major").alias("severity"), F.lit("numbers").alias("category"), F.lit("p. 1").alias("location"), F.when(F.col("doc_id") % 2 == 0, "31.4% and 27.2%").otherwise("nothing").alias("quote"), F.lit("rate of hits").alias("description"), F.lit("").alias("correction")))
    numbers = F.array(F.struct(F.lit("rate").alias("quantity"), F.array(F.lit("p. 1"), F.lit("p. 4")).alias("locations"), F.array(F.lit("31.4%"), F.lit(" "), F.lit("27.2%")).alias("values"), F.lit("No.").alias("recomputation"), F.when(F.col("doc_id") % 5 == 0, "verified_correct").otherwise("verified_incorrect").alias("verdict")))
    claims = F.array(F.struct(F.when(F.col("doc_id") % 3 == 0, "27.2%").otherwise(F.lit("it wins")).alias("claim_quote"), F.lit("p. 9").alias("location"), F.lit("").alias("supporting_evidence"), F.when(F.col("doc_id") % 7 == 0, "supported").otherwise("overreach").alias("verdict"), F.lit("Too far.").alias("explanation")))
    return t.select("paper_id", "entry", F.struct(numbers.alias("number_checks"), claims.alias("claim_checks"), own.alias("findings")).alias("reply"))


@query("""WITH t AS (SELECT 'd' || doc_id AS paper_id, doc_id FROM {documents})
  SELECT paper_id, 'numbers' AS category, 'p. 1' AS location, CASE WHEN doc_id % 2 = 0 THEN '31.4% and 27.2%' ELSE 'nothing' END AS quote, 'rate of hits' AS description FROM t
  UNION ALL SELECT paper_id, 'numbers', 'p. 1; p. 4', '31.4% vs 27.2%', 'rate: the values disagree across locations. No.' FROM t WHERE doc_id % 5 <> 0 AND doc_id % 2 <> 0
  UNION ALL SELECT paper_id, 'claims', 'p. 9', CASE WHEN doc_id % 3 = 0 THEN '27.2%' ELSE 'it wins' END, 'Claim is overreach. Too far. Supporting evidence found: none.' FROM t WHERE doc_id % 7 <> 0 AND (doc_id % 3 <> 0 OR (doc_id % 2 <> 0 AND doc_id % 5 = 0))""")
def pass2_findings(spark, d):
    return findings.from_pass2(_pass2(spark, d)).select("paper_id", "category", "location", "quote", "description")


FACTS = "SELECT source AS paper_id, doc_id AS ord, 'c' AS claim_quote, 'p. 2' AS location, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'https://e.org/' || CAST(doc_id % 4 AS STRING) END AS source_url, 'says' AS source_says, CASE WHEN doc_id % 2 = 0 THEN 'verified_incorrect' ELSE 'verified_correct' END AS verdict FROM {documents}"


@query("""WITH f AS (""" + FACTS + """) SELECT paper_id, ord, CASE WHEN ord % 4 IN (1, 2) THEN '' ELSE source_url END AS source_url, CASE WHEN ord % 4 IN (1, 2) THEN 'could_not_verify' ELSE verdict END AS verdict, CASE WHEN ord % 4 IN (1, 2) THEN 'says [url discarded: not in the supplied search results]' ELSE 'says' END AS source_says FROM f""")
def urls_allowed(spark, d):
    facts = view(spark, d, FACTS)
    allowed = facts.select("paper_id").distinct().select("paper_id", F.lit("https://e.org/0").alias("url"))
    none = spark.createDataFrame([], "paper_id string, ord bigint, work string, url string, why_relevant string")
    return findings.keep_supplied_urls(facts, none, allowed)[0].select("paper_id", "ord", "source_url", "verdict", "source_says")


@query("SELECT paper_id, 'external_fact' AS category, claim_quote AS quote, 'Contradicted by an external source: says' AS description, source_url AS url FROM (" + FACTS + ") f WHERE verdict = 'verified_incorrect'")
def pass4_findings(spark, d):
    none = spark.createDataFrame([], "paper_id string, ord bigint, work string, url string, why_relevant string")
    return findings.from_pass4(view(spark, d, FACTS), none).select("paper_id", "category", "quote", "description", "url")


NOTES = "SELECT source AS paper_id, 'pass' || CAST(doc_id % 2 AS STRING) AS source_pass, doc_id AS entry, 'Note  ' || CAST(doc_id % 6 AS STRING) AS note FROM {documents}"


@query(r"WITH n AS (SELECT paper_id, source_pass, regexp_replace(note, '\s+', ' ', 'g') AS limitation, min(entry) AS e FROM (" + NOTES + ") x GROUP BY ALL) SELECT paper_id, source_pass, limitation, row_number() OVER (PARTITION BY paper_id ORDER BY source_pass, e) AS place FROM n")
def limitations_distinct(spark, d):
    return findings.limitations(view(spark, d, NOTES).select("paper_id", "source_pass", "entry", F.array("note").alias("limitations")))


# Calibration ----------------------------------------------------------------------------------------------------------------

TAGGED = r"""WITH t AS (SELECT *, lower(trim(category)) AS c, substr(lower(regexp_replace(trim(quote), '\s+', ' ', 'g')), 1, 120) AS q FROM (""" + TRUTH + r""") x), p AS (SELECT *, lower(trim(category)) AS c, substr(lower(regexp_replace(trim(quote), '\s+', ' ', 'g')), 1, 120) AS q FROM (""" + PREDICTED + r""") x),
  tn AS (SELECT *, row_number() OVER (PARTITION BY paper_id, c, q ORDER BY ord) AS nth FROM t), pn AS (SELECT *, row_number() OVER (PARTITION BY paper_id, c, q ORDER BY ord) AS nth FROM p),
  j AS (SELECT coalesce(tn.paper_id, pn.paper_id) AS paper_id, CASE WHEN tn.ord IS NULL THEN 'fp' WHEN pn.ord IS NULL THEN 'fn' ELSE 'tp' END AS tag, coalesce(tn.severity, pn.severity) AS severity, lower(coalesce(tn.category, pn.category)) AS category, pn.source_pass, tn.severity = pn.severity AS agrees
        FROM tn FULL JOIN pn ON tn.paper_id = pn.paper_id AND tn.c = pn.c AND tn.q = pn.q AND tn.nth = pn.nth),
  """
RATES = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0) AS f1"""
COUNTS = "count(*) FILTER (tag = 'tp') AS tp, count(*) FILTER (tag = 'fp') AS fp, count(*) FILTER (tag = 'fn') AS fn"


def _tagged(spark, d):
    """Findings of equal category and quote are matched one by one, in order: what the counts are held against without kernels."""
    t, p = view(spark, d, TRUTH), view(spark, d, PREDICTED)

    def numbered(df: DataFrame, name: str) -> DataFrame:
        key = [F.lower(F.trim("category")).alias("c"), F.substring(F.lower(F.trim(F.regexp_replace("quote", r"\s+", " "))), 1, 120).alias("q")]
        return df.select("paper_id", F.col("ord").alias(name), *key).withColumn("nth", F.row_number().over(Window.partitionBy("paper_id", "c", "q").orderBy(name)))

    # only what is counted goes on
    t, p = (df.drop("quote", "description") for df in (t.join(numbered(t, "ord"), ["paper_id", "ord"]), p.join(numbered(p, "ord"), ["paper_id", "ord"])))
    own = lambda df, name: df.select("paper_id", "c", "q", "nth", F.col("ord").alias(name))
    matches = own(t, "t").join(own(p, "p"), ["paper_id", "c", "q", "nth"]).select("paper_id", "t", "p", F.lit(100.0).alias("score"))
    return calibrate.tagged(t, p, matches)


@query(TAGGED + f"a AS (SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(category) = 0 THEN 'category' ELSE 'overall' END AS dimension, coalesce(severity, category, '') AS value, {COUNTS} FROM j GROUP BY GROUPING SETS ((), (severity), (category))) SELECT dimension, value, {RATES} FROM a")
def confusion_by_dimension(spark, d):
    return calibrate.by_dimension(_tagged(spark, d))


@query(TAGGED + f"a AS (SELECT source_pass, {COUNTS} FROM j WHERE tag <> 'fn' GROUP BY source_pass) SELECT source_pass, {RATES} FROM a")
def confusion_by_pass(spark, d):
    return calibrate.by_pass(_tagged(spark, d))


@query(TAGGED + f"a AS (SELECT paper_id, {COUNTS}, coalesce(count(*) FILTER (agrees) / nullif(count(*) FILTER (tag = 'tp'), 0), 0) AS severity_agreement FROM j WHERE paper_id <> 'src1' GROUP BY paper_id) SELECT paper_id, severity_agreement, {RATES} FROM a")
def confusion_by_paper(spark, d):
    rows, _ = calibrate.without_failed(_tagged(spark, d), spark.createDataFrame([("src1", "timeout"), ("src2", "")], "paper_id string, error string"))
    return calibrate.by_paper(rows)


PASSAGE = "substr(text, 1 + CAST(doc_id % 3 AS INT) * 140, 140) AS quote, substr(text, 30, 60) AS description"


@query()
def greedy_matches(spark, d):
    """A reviewer quotes a passage, not a document: these findings quote 140 letters from one of three places."""
    t, p = (view(spark, d, x.replace("d.text", "text").replace("text AS quote, text AS description", PASSAGE.replace("doc_id", "d.doc_id") if "d.doc_id" in x else PASSAGE)) for x in (TRUTH, FINDING))
    return calibrate.match(t, p)


# Planted likenesses ----------------------------------------------------------------------------------------------------------

# Quotes of 64 hexadecimal digits in threes: the first, one with two digits replaced (97 alike), one with the first 28 replaced
# (about 75 alike). Digits of different threes are some 40 alike, so that what the rules make of them follows.
GROUP = "CAST(floor(doc_id / 3) AS BIGINT)"
DIGITS = f"md5(CAST({GROUP} AS STRING)) || md5('b' || CAST({GROUP} AS STRING))"
PLANTED = f"""SELECT 'p' || CAST({GROUP} % 20 AS STRING) AS paper_id, doc_id AS ord, {GROUP} AS g, doc_id % 3 AS k, {SEVERITY.format("(doc_id % 7)")} AS severity, 'c' || CAST({GROUP} % 4 AS STRING) AS category, 'Section ' || CAST({GROUP} % 2 AS STRING) AS location,
  CASE doc_id % 3 WHEN 0 THEN {DIGITS} WHEN 1 THEN substr({DIGITS}, 1, 30) || 'zz' || substr({DIGITS}, 33) ELSE substr(md5('c' || CAST({GROUP} AS STRING)), 1, 28) || substr({DIGITS}, 29) END AS quote,
  md5('d' || CAST({GROUP} AS STRING)) AS description, '' AS correction, 'pass' || CAST({GROUP} % 2 AS STRING) AS source_pass, '' AS verdict, '' AS url, 'single_run' AS stability FROM {{documents}}"""
PLANTED_RUNS = f"SELECT f.*, 0 AS run_no FROM ({PLANTED}) f WHERE k <> 1 UNION ALL SELECT f.*, 1 AS run_no FROM ({PLANTED}) f WHERE k = 1 AND g % 2 = 0 OR k = 2 AND g % 3 = 0"
PLANTED_TRUTH = f"SELECT * FROM ({PLANTED}) f WHERE k = 0"
PLANTED_PREDICTED = f"SELECT * FROM ({PLANTED}) f WHERE k > 0 AND g % 5 <> 0"


@query(f"SELECT paper_id, ord, severity, quote FROM (SELECT *, CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 ELSE 3 END AS rank FROM ({PLANTED}) x) f QUALIFY row_number() OVER (PARTITION BY g, k = 2 ORDER BY rank, ord) = 1")
def findings_dedupe_planted(spark, d):
    return findings.dedupe(view(spark, d, PLANTED).drop("g", "k")).select("paper_id", "ord", "severity", "quote")


@query(f"SELECT paper_id, arg_min(ord, (run_no, ord)) AS ord, CASE WHEN count(DISTINCT run_no) >= 2 THEN 'stable' ELSE 'unstable' END AS stability FROM ({PLANTED_RUNS}) f GROUP BY paper_id, g, k = 2")
def runs_merged_planted(spark, d):
    return findings.merge_runs(view(spark, d, PLANTED_RUNS).drop("g", "k"), 2).select("paper_id", "ord", "stability")


PLANTED_MATCHES = f"SELECT t.paper_id, t.ord AS t, p.ord AS p, CAST(98.125 AS DOUBLE) AS score FROM ({PLANTED_TRUTH}) t JOIN ({PLANTED_PREDICTED}) p ON t.g = p.g AND p.k = 1"


@query(PLANTED_MATCHES)
def matches_planted(spark, d):
    return calibrate.match(view(spark, d, PLANTED_TRUTH), view(spark, d, PLANTED_PREDICTED))


PLANTED_TAGS = f"""WITH j AS (SELECT coalesce(t.paper_id, p.paper_id) AS paper_id, CASE WHEN t.ord IS NULL THEN 'fp' WHEN p.ord IS NULL THEN 'fn' ELSE 'tp' END AS tag, coalesce(t.severity, p.severity) AS severity, coalesce(t.category, p.category) AS category, p.source_pass, t.severity = p.severity AS agrees
  FROM ({PLANTED_TRUTH}) t FULL JOIN ({PLANTED_PREDICTED}) p ON t.g = p.g AND p.k = 1), """


def _planted_tags(spark, d):
    t, p = view(spark, d, PLANTED_TRUTH), view(spark, d, PLANTED_PREDICTED)
    return calibrate.tagged(t, p, stored(calibrate.match(t, p), "matches"))


@query(PLANTED_TAGS + f"a AS (SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(category) = 0 THEN 'category' ELSE 'overall' END AS dimension, coalesce(severity, category, '') AS value, {COUNTS} FROM j GROUP BY GROUPING SETS ((), (severity), (category))) SELECT dimension, value, {RATES} FROM a")
def calibration_by_dimension(spark, d):
    return calibrate.by_dimension(_planted_tags(spark, d))


@query(f"SELECT 'fn' AS tag, t.paper_id, t.ord, t.description FROM ({PLANTED_TRUTH}) t ANTI JOIN ({PLANTED_MATCHES}) m ON m.t = t.ord UNION ALL SELECT 'fp', p.paper_id, p.ord, p.description FROM ({PLANTED_PREDICTED}) p ANTI JOIN ({PLANTED_MATCHES}) m ON m.p = p.ord")
def missed_and_spurious(spark, d):
    t, p = view(spark, d, PLANTED_TRUTH), view(spark, d, PLANTED_PREDICTED)
    return calibrate.listed(t, p, stored(calibrate.match(t, p), "matches"))


@query(PLANTED_TAGS + f"a AS (SELECT source_pass, {COUNTS} FROM j WHERE tag <> 'fn' GROUP BY source_pass) SELECT source_pass, {RATES} FROM a")
def calibration_by_pass(spark, d):
    return calibrate.by_pass(_planted_tags(spark, d))


@query(PLANTED_TAGS + f"a AS (SELECT paper_id, {COUNTS}, coalesce(count(*) FILTER (agrees) / nullif(count(*) FILTER (tag = 'tp'), 0), 0) AS severity_agreement FROM j GROUP BY paper_id) SELECT paper_id, severity_agreement, {RATES} FROM a")
def calibration_by_paper(spark, d):
    return calibrate.by_paper(_planted_tags(spark, d))


TITLES = """SELECT item_id, regexp_replace(lower(text), '[^a-z ]', '') AS a, CASE item_id % 4 WHEN 3 THEN '' ELSE upper(regexp_replace(lower(text), '[^a-z ]', '')) || '!' END AS b, CASE item_id % 4 WHEN 1 THEN '1990' WHEN 2 THEN '2000' ELSE '2001' END AS y FROM {benchmark}"""


@query("SELECT item_id, CAST(CASE WHEN trim(a) = '' OR item_id % 4 = 3 THEN 0 WHEN item_id % 4 = 1 THEN 75 ELSE 100 END AS DOUBLE) AS score FROM (" + TITLES.replace("'[^a-z ]', '')", "'[^a-z ]', '', 'g')") + ") t")
def title_scores_planted(spark, d):
    return view(spark, d, TITLES).select("item_id", score_match(F.col("a"), F.col("b"), F.lit("2001"), F.col("y")).alias("score"))


@query("WITH t AS (SELECT 'd' || doc_id AS paper_id, doc_id FROM {documents}) SELECT paper_id, 'pass2' AS source_pass, count(*) AS n, count(*) FILTER (promoted) AS promoted FROM (SELECT paper_id, false AS promoted FROM t UNION ALL SELECT paper_id, true FROM t WHERE doc_id % 6 = 5) x GROUP BY paper_id")
def covered_by_any_needle(spark, d):
    """Of five values of over 25 letters, which are needles, one is nearly quoted by a finding (or none, in a sixth of the rows)."""
    t = view(spark, d, "SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, 0 AS entry, doc_id FROM {documents}")
    words = ["apples", "trains", "violet", "copper", "walnut"]
    values = F.array(*[F.concat(F.lit(f"{w} {w[::-1]} {w} beside {w} and "), F.lit("quite unlike the others")) for w in words])
    near = F.element_at(F.concat(F.transform(values, lambda v: F.regexp_replace(v, "quite", "quit")), F.array(F.lit("nothing of the kind"))), (F.col("doc_id") % 6 + 1).cast("int"))
    own = F.array(F.struct(F.lit("major").alias("severity"), F.lit("numbers").alias("category"), F.lit("p. 1").alias("location"), near.alias("quote"), F.lit("seen").alias("description"), F.lit("").alias("correction")))
    numbers = F.array(F.struct(F.lit("a quantity of its own that is nowhere").alias("quantity"), F.array(F.lit("p. 1")).alias("locations"), values.alias("values"), F.lit("No.").alias("recomputation"), F.lit("verified_incorrect").alias("verdict")))
    none = F.array().cast("array<struct<claim_quote:string,location:string,supporting_evidence:string,verdict:string,explanation:string>>")
    found = findings.from_pass2(t.select("paper_id", "entry", F.struct(numbers.alias("number_checks"), none.alias("claim_checks"), own.alias("findings")).alias("reply")))
    return found.groupBy("paper_id", "source_pass").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") != "").alias("promoted"))


# Requests, runs, jobs -------------------------------------------------------------------------------------------------------


def _asked(requests: DataFrame) -> DataFrame:
    return requests.select("paper_id", "label", "payload", "request_hash")


def _asked_sql(stage: str, label: str, rows: str) -> str:
    """rows gives paper_id and payload; label is SQL."""
    return f"SELECT paper_id, {label} AS label, payload, sha256('{stage}' || chr(1) || {label} || chr(1) || payload) AS request_hash FROM ({rows}) asked"


def _cut_sql(text: str, most: int | str, mark: str = "[TRUNCATED: section longer than the configured limit]") -> str:
    return f"CASE WHEN length({text}) <= {most} THEN {text} ELSE substr({text}, 1, {most}) || {NL} || '... {mark}' END"


def _str(text: str) -> str:
    """SQL for a text as JSON; null is null."""
    return f"coalesce(CAST(to_json({text}) AS VARCHAR), 'null')"


def _pad(depth: int) -> str:
    return f"{NL} || '{' ' * depth}'"


def _object(depth: int, **fields: str) -> str:
    """SQL for an object at a depth, whose fields are SQL for JSON. Requests show JSON as Python's json.dumps(indent=1) does."""
    return "'{' || " + " || ',' || ".join(f"{_pad(depth + 1)} || '\"{k}\": ' || {v}" for k, v in fields.items()) + f" || {_pad(depth)} || '}}'"


def _list(depth: int, joined: str) -> str:
    """SQL for a list at a depth; joined: its elements with _between(depth) between them, null for none."""
    return f"coalesce('[' || {_pad(depth + 1)} || ({joined}) || {_pad(depth)} || ']', '[]')"


def _between(depth: int) -> str:
    return f"',' || {_pad(depth + 1)}"


def _literal(depth: int, *values: str) -> str:
    """SQL for a list of a few elements."""
    return _list(depth, f" || {_between(depth)} || ".join(values)) if values else "'[]'"


PARTS = """SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, 0 AS section_idx, '3' AS number, 'Results' AS title, '3 Results' AS label, CASE WHEN doc_id % 2 = 0 THEN 'results' ELSE 'other' END AS kind, text, 1 AS start_page, 2 AS end_page FROM {documents}
  UNION ALL SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, 1 AS section_idx, '' AS number, 'Introduction' AS title, 'Introduction' AS label, CASE WHEN doc_id % 3 = 0 THEN 'introduction' ELSE 'method' END AS kind, text || text AS text, 2 AS start_page, 3 AS end_page FROM {documents}"""
PART_SQL = f"'=== ' || label || ' (pages ' || start_page || '-' || end_page || ') ===' || {NL} || " + _cut_sql("text", 24_000)
DOC = "CAST(substr(paper_id, 2) AS BIGINT)"
FIGURES = """SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, n.kind, n.id, 'Rate of "hits" in paper ' || CAST(doc_id AS STRING) || ' by ' || lang AS caption, n.page, doc_id % 2 = 0 AS referenced_in_text FROM {documents}
  JOIN (SELECT 'table' AS kind, 'Table 2' AS id, 3 AS page, 1 AS k UNION ALL SELECT 'figure' AS kind, 'Figure 10' AS id, 2 AS page, 1 AS k UNION ALL SELECT 'figure' AS kind, 'Figure 9' AS id, 2 AS page, 0 AS k UNION ALL SELECT 'figure' AS kind, 'Figure IV' AS id, 1 AS page, 2 AS k) n ON doc_id % 3 >= n.k"""
FIGURE_PLACE = "kind, CASE id WHEN 'Figure 9' THEN 9 WHEN 'Figure 10' THEN 10 WHEN 'Figure IV' THEN 1000000 ELSE 2 END"
CITED = """SELECT 'd' || CAST(d.doc_id AS STRING) AS paper_id, CAST(n.k AS INT) AS ord, CAST(n.k + d.doc_id % 2 AS INT) AS ref_index, CASE n.k WHEN 2 THEN d.text ELSE 'Entry ' || CAST(d.doc_id AS STRING) END AS raw FROM {documents} d JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) n ON d.doc_id % 4 >= n.k"""


def _inventories(spark, d):
    """Of two papers in three the inventory that pass 0 gives; INVENTORY_SQL shows parts of it."""
    i = view(spark, d, "SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, doc_id, lang, text FROM {documents} WHERE doc_id % 3 <> 1")
    figure = lambda k: F.struct(F.lit(k).alias("id"), F.lit('A "caption"').alias("caption"), (F.col("doc_id") % 2 == 0).alias("referenced_in_text"))
    none = F.array().cast("array<struct<id:string,caption:string,referenced_in_text:boolean>>")
    parts = F.array(F.struct(F.lit("1").alias("number"), F.lit("Introduction").alias("title"), F.lit("1-2").alias("pages")))
    numbers = F.array(F.struct(F.lit("31.4%").alias("value"), F.lit("rate").alias("meaning"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("p. 1"), F.lit("p. 4"))).otherwise(F.array().cast("array<string>")).alias("locations")))
    reply = F.struct(
        F.array().cast("array<string>").alias("limitations"), F.col("lang").alias("language"), F.col("text").alias("title"), parts.alias("sections"), F.array(F.lit("why?"), F.col("lang")).alias("research_questions_or_hypotheses"),
        F.array(figure("Figure 1"), figure("Figure 2")).alias("figures"), none.alias("tables"), numbers.alias("key_numbers"), F.array().cast("array<struct<index:int,raw:string>>").alias("bibliography"),
    )
    return i.select("paper_id", reply.alias("reply"))


KNOWN_FIGURES = _literal(1, *[_object(2, id=f"'\"{k}\"'", caption="'\"A \\\"caption\\\"\"'", referenced_in_text="CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END") for k in ("Figure 1", "Figure 2")])
KNOWN_NUMBERS = _literal(1, _object(2, value="'\"31.4%\"'", meaning="'\"rate\"'", locations=f"CASE WHEN doc_id % 2 = 0 THEN {_literal(3, chr(39) + chr(34) + 'p. 1' + chr(34) + chr(39), chr(39) + chr(34) + 'p. 4' + chr(34) + chr(39))} ELSE '[]' END"))
DATA_CUT = "[TRUNCATED]"
FOUND_SQL = _object(2, index="section_idx", number=_str("number"), title=_str("title"), kind=_str("kind"), pages="'\"' || start_page || '-' || end_page || '\"'", chars="length(text)")
CAPTION_SQL = lambda depth: _object(depth, id=_str("id"), caption=_str("caption"), page="page", referenced_in_text="CASE WHEN referenced_in_text THEN 'true' ELSE 'false' END")
HINT_SQL = _object(
    0, pdf_metadata=f"CASE WHEN doc_id % 2 = 0 THEN {_object(1, title=_str('lang'), author=_str(chr(39) + 'A ' + chr(34) + 'B' + chr(34) + chr(39)))} ELSE '{{}}' END", page_count="(3 + doc_id % 4)", detected_sections=_list(1, "heads"), detected_captions=_list(1, "caps"),
    detected_reference_count="coalesce(n_refs, 0)", detected_bibliography=_list(1, "bib"),
)


@query(_asked_sql("pass0", "'pass0:inventory'", f"""WITH h AS (SELECT paper_id, string_agg({FOUND_SQL}, {_between(1)} ORDER BY section_idx) AS heads, string_agg(trim(number || ' ' || title || ' (pages ' || start_page || '-' || end_page || ')'), {NL} ORDER BY section_idx) AS headings FROM ({PARTS}) p GROUP BY paper_id),
  c AS (SELECT paper_id, string_agg({CAPTION_SQL(2)}, {_between(1)} ORDER BY {FIGURE_PLACE}) AS caps, string_agg(id || ': ' || caption, {NL} ORDER BY {FIGURE_PLACE}) AS captions FROM ({FIGURES}) f GROUP BY paper_id),
  b AS (SELECT paper_id, count(*) AS n_refs, string_agg({_object(2, index="ref_index", raw=_str("substr(raw, 1, 400)"))}, {_between(1)} ORDER BY ord) AS bib, string_agg('[' || ref_index || '] ' || raw, {NL} ORDER BY ord) AS bibliography FROM ({CITED}) r GROUP BY paper_id),
  j AS (SELECT *, 'd' || doc_id AS paper FROM {{documents}} LEFT JOIN h ON h.paper_id = 'd' || doc_id LEFT JOIN c ON c.paper_id = 'd' || doc_id LEFT JOIN b ON b.paper_id = 'd' || doc_id),
  t AS (SELECT *, {HINT_SQL} AS hint FROM j),
  u AS (SELECT *, '=== EXTRACTION HINTS (from the PDF, deterministic) ===' || {NL} || {_cut_sql("hint", 2000, DATA_CUT)} || {NL} || 'These hints come from layout heuristics and may be wrong or incomplete. Correct them from the text where they disagree.' AS hints FROM t),
  v AS (SELECT *, greatest(8000 - length(hints), 2000) AS room, '=== FRONT MATTER ===' || {NL} || substr(text, 1, 20000) || {NL} || {NL} || '=== SECTION HEADINGS ===' || {NL} || headings || {NL} || {NL} || '=== CAPTIONS ===' || {NL} || coalesce(captions, '') || {NL} || {NL} || '=== BIBLIOGRAPHY ===' || {NL} || coalesce(bibliography, '') AS short FROM u)
  SELECT paper AS paper_id, CASE WHEN length(text) <= room THEN hints || {NL} || {NL} || '=== FULL PAPER TEXT ===' || {NL} || text
    ELSE 'NOTE: the paper exceeded the input budget, so you are given the front matter, the section headings, all captions and the bibliography instead of the full text. Record this in `limitations`.' || {NL} || {NL} || hints || {NL} || {NL} || {_cut_sql("short", "room")} END AS payload FROM v"""))
def requests_pass0(spark, d):
    papers = view(spark, d, "SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, doc_id, lang, text FROM {documents}")
    about = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("title"), F.col("lang"), F.lit("author"), F.lit('A "B"')))
    papers = papers.select("paper_id", "text", (3 + F.col("doc_id") % 4).cast("int").alias("page_count"), about.alias("metadata"))
    return _asked(payloads.pass0(papers, view(spark, d, PARTS), view(spark, d, FIGURES), view(spark, d, CITED), 8_000))


WORDS = """SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, CAST(n.k % 2 AS INT) AS section_idx, 'Word' || CAST(n.k AS STRING) AS token, text AS sentence, 'p. "1"' AS location, CASE WHEN n.k < 2 THEN 'better' WHEN n.k = 2 THEN '' END AS suggestion, CAST(doc_id % 3 * n.k AS BIGINT) AS occurrences FROM {documents}
  JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) n ON doc_id % 5 > n.k"""
DIGEST_SQL = _cut_sql("digest", 12_000, DATA_CUT)
WORD_SQL = (
    f"'{{' || {_pad(2)} || '\"token\": ' || {_str('token')} || ',' || {_pad(2)} || '\"sentence\": ' || {_str('sentence')} || ',' || {_pad(2)} || '\"location\": ' || {_str('location')} || ',' || {_pad(2)} || '\"occurrences\": ' || occurrences"
    f" || CASE WHEN coalesce(suggestion, '') <> '' THEN ',' || {_pad(2)} || '\"checker_suggestion\": ' || {_str('suggestion')} ELSE '' END || {_pad(1)} || '}}'"
)


@query(f"""WITH s AS (SELECT *, {DOC} AS doc_id FROM ({PARTS}) p WHERE length(trim(text)) > 200),
  i AS (SELECT 'd' || doc_id AS paper_id, {_object(0, language=_str("lang"), title=_str("text"), sections=_literal(1, _object(2, number="'\"1\"'", title="'\"Introduction\"'", pages="'\"1-2\"'")), figures=KNOWN_FIGURES, tables="'[]'")} AS digest FROM {{documents}} WHERE doc_id % 3 <> 1),
  c AS (SELECT s.paper_id, s.section_idx, string_agg({CAPTION_SQL(1)}, {_between(0)} ORDER BY {FIGURE_PLACE.replace("kind", "f.kind")}) AS caps FROM s JOIN ({FIGURES}) f ON f.paper_id = s.paper_id AND f.page BETWEEN s.start_page AND s.end_page GROUP BY s.paper_id, s.section_idx),
  w AS (SELECT paper_id, section_idx, count(*) AS n, string_agg({WORD_SQL}, {_between(0)} ORDER BY occurrences DESC, lower(token)) AS words FROM ({WORDS}) x GROUP BY paper_id, section_idx),
  r AS (SELECT s.paper_id, 'pass1:' || label AS label, '=== PASS 0 INVENTORY (condensed) ===' || {NL} || coalesce({DIGEST_SQL}, {_object(0, language="'\"en\"'", note="'\"Pass 0 output unavailable\"'")}) || {NL} || {NL} || '=== SECTION UNDER REVIEW ===' || {NL} || 'title: ' || label || {NL} || 'pages: ' || start_page || '-' || end_page || {NL} || {NL} || {_cut_sql("text", 24_000)}
    || {NL} || {NL} || '=== FIGURES AND TABLES ON THESE PAGES ===' || {NL} || {_list(0, "caps")} || {NL} || {NL} || '=== SPELLCHECKER CANDIDATES FOR THIS SECTION ===' || {NL} || {_list(0, "words")} || {NL} || '(' || coalesce(n, 0) || ' candidates; classify every one of them.)' AS payload
    FROM s LEFT JOIN i ON i.paper_id = s.paper_id LEFT JOIN c ON c.paper_id = s.paper_id AND c.section_idx = s.section_idx LEFT JOIN w ON w.paper_id = s.paper_id AND w.section_idx = s.section_idx)
  SELECT paper_id, label, payload, sha256('pass1' || chr(1) || label || chr(1) || payload) AS request_hash FROM r""")
def requests_pass1(spark, d):
    return _asked(payloads.pass1(view(spark, d, PARTS), view(spark, d, FIGURES), view(spark, d, WORDS), _inventories(spark, d)))


@query(_asked_sql("pass2", "'pass2:consistency'", f"""WITH parts AS ({PARTS}), own AS (SELECT paper_id, string_agg({PART_SQL}, {NL} || {NL} ORDER BY section_idx) AS body FROM parts WHERE kind = 'results' GROUP BY paper_id),
  half AS (SELECT 'd' || doc_id AS paper_id, doc_id, lang, text, substr(text, CAST(floor(length(text) / 2) AS INT) + 1) AS h FROM {{documents}}),
  i AS (SELECT paper_id, {_object(0, title=_str("text"), language=_str("lang"), research_questions_or_hypotheses=_literal(1, "'\"why?\"'", _str("lang")), key_numbers=KNOWN_NUMBERS, figures=KNOWN_FIGURES, tables="'[]'")} AS inventory FROM half WHERE doc_id % 3 <> 1)
  SELECT half.paper_id, CASE WHEN body IS NULL THEN 'NOTE: the abstract/results/discussion/conclusion sections could not be identified. Record this in `limitations`.' || {NL} || {NL} ELSE '' END || '=== PASS 0 INVENTORY ===' || {NL} || coalesce({_cut_sql("inventory", 30_000, DATA_CUT)}, {_object(0, note="'\"Pass 0 output unavailable\"'")}) || {NL} || {NL}
    || coalesce(body, '=== PAPER TEXT (second half; section split unavailable) ===' || {NL} || {_cut_sql("h", 48_000)}) || {NL} || {NL} || '=== TABLE CONTENTS (text around each table caption) ===' || {NL} || CASE WHEN doc_id % 4 = 0 THEN {_cut_sql(f"'b' || {NL} || {NL} || text", 20_000)} ELSE '' END AS payload FROM half LEFT JOIN own USING (paper_id) LEFT JOIN i USING (paper_id)"""))
def requests_pass2(spark, d):
    papers = view(spark, d, "SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, doc_id, text FROM {documents}")
    near = F.explode(F.array(F.struct(F.lit("Table 10").alias("id"), F.col("text")), F.struct(F.lit("Table 9").alias("id"), F.lit("b").alias("text"))))
    tables = papers.where("doc_id % 4 = 0").select("paper_id", near.alias("t")).select("paper_id", "t.*")
    return _asked(payloads.pass2(papers.select("paper_id", "text"), view(spark, d, PARTS), tables, _inventories(spark, d)))


LOOKED_UP = """SELECT 'p' || CAST(item_id % 4 AS STRING) AS paper_id, CAST(item_id AS INT) AS ord, CAST(item_id + 1 AS INT) AS ref_index, item_id, text AS raw, CASE WHEN item_id % 3 > 0 THEN '10.1000/x.' || CAST(item_id AS STRING) END AS doi,
  CASE WHEN item_id % 5 > 0 THEN 'On "' || substr(text, 1, 20) || '"' END AS title, CASE WHEN item_id % 2 = 0 THEN '1999' END AS year FROM {benchmark}"""
RECORD_SQL = _object(
    2, found="CASE WHEN item_id % 7 = 1 THEN 'false' ELSE 'true' END", url=_str("'https://r.org/' || item_id"), title=_str("title"), authors=_literal(3, _str("'X. Surname'")), year="'\"1999\"'", venue="'\"\"'", doi=_str("doi"), type="'\"article\"'",
    is_retracted="CASE WHEN item_id % 7 = 2 THEN 'true' ELSE 'false' END", retraction_notes="'\"\"'", is_preprint="'false'", abstract=_str("substr(raw || raw || raw || raw, 1, 1200)"), match_score="CASE WHEN item_id % 2 = 0 THEN '98.125' ELSE '100.0' END", source="'\"stub\"'",
)
ENTRY_SQL = _object(
    1, index="ref_index", raw=_str("raw"), parsed=_object(2, title=_str("title"), year=_str("year"), authors=f"CASE item_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN {_literal(3, _str(chr(39) + 'Surname' + chr(39)))} ELSE {_literal(3, _str(chr(39) + 'Surname' + chr(39)), _str(chr(39) + 'Other' + chr(39)))} END", doi=_str("doi")),
    citing_sentences=f"CASE WHEN item_id % 2 = 0 THEN {_literal(2, _object(3, quote=_str('raw'), location=_str(chr(39) + '1 Introduction (p. 1)' + chr(39))), _object(3, quote=_str(chr(39) + 'So [1].' + chr(39)), location=_str(chr(39) + '2 Methods (p. 2)' + chr(39))))} ELSE '[]' END",
    lookup_result=f"CASE WHEN item_id % 6 = 5 THEN {_object(2, found=chr(39) + 'false' + chr(39))} ELSE {RECORD_SQL} END",
)


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord) - 1 AS k FROM ({LOOKED_UP}) e),
  b AS (SELECT paper_id, 'pass3:refs ' || min(ref_index) || '-' || max(ref_index) AS label, {_list(0, f"string_agg({ENTRY_SQL}, {_between(0)} ORDER BY ord)")} AS listed FROM n GROUP BY paper_id, k // 10),
  r AS (SELECT paper_id, label, '=== BIBLIOGRAPHY ENTRIES WITH LOOKUP RESULTS ===' || {NL} || {_cut_sql("listed", 60_000, DATA_CUT)} || {NL} || {NL}
    || 'The `lookup_result` block is what a bibliographic database returned for that entry. Compare it with `raw`. Use only the URL in `lookup_result.url`; never invent one. Return one object in `references` for every index listed above.' AS payload FROM b)
  SELECT paper_id, label, payload, sha256('pass3:refs' || chr(1) || label || chr(1) || payload) AS request_hash FROM r""")
def requests_pass3(spark, d):
    r = view(spark, d, LOOKED_UP)
    people = F.array(F.lit("Surname"), F.lit("Other"))
    cite = lambda quote, place: F.struct(quote.alias("quote"), F.lit(place).alias("location"))
    cited = F.when(F.col("item_id") % 2 == 0, F.array(cite(F.col("raw"), "1 Introduction (p. 1)"), cite(F.lit("So [1]."), "2 Methods (p. 2)"))).otherwise(F.array().cast("array<struct<quote:string,location:string>>"))
    refs = r.select("paper_id", "ord", "ref_index", "raw", "doi", "title", "year", F.slice(people, F.lit(1), (F.col("item_id") % 3).cast("int")).alias("authors"), cited.alias("citing_sentences"))
    records = r.where("item_id % 6 <> 5").selectExpr(
        "paper_id", "ref_index", "item_id % 7 <> 1 AS found", "'https://r.org/' || item_id AS url", "title", "array('X. Surname') AS authors", "'1999' AS year", "'' AS venue", "doi", "'article' AS type", "item_id % 7 = 2 AS is_retracted", "'' AS retraction_notes", "false AS is_preprint",
        "raw || raw || raw || raw AS abstract", "CAST(CASE WHEN item_id % 2 = 0 THEN 98.125 ELSE 100 END AS DOUBLE) AS match_score", "'stub' AS source",
    )
    return _asked(payloads.pass3(references.batches(references.with_records(refs, records))))


@query(_asked_sql("pass3:missing", "'pass3:missing_citations'", f"SELECT paper_id, 'search_tool_available: True' || {NL} || {NL} || string_agg({PART_SQL}, {NL} || {NL} ORDER BY section_idx) AS payload FROM ({PARTS}) p WHERE kind = 'introduction' GROUP BY paper_id"))
def requests_pass3_missing(spark, d):
    return _asked(payloads.pass3_missing(view(spark, d, PARTS), True))


@query(_asked_sql("pass4:claims", "'pass4:claims'", f"""WITH parts AS ({PARTS}), wanted AS (SELECT * FROM parts WHERE kind = 'introduction' UNION ALL SELECT * FROM parts p WHERE length(trim(text)) > 200 AND NOT EXISTS (SELECT 1 FROM parts q WHERE q.paper_id = p.paper_id AND q.kind = 'introduction')),
  bodies AS (SELECT paper_id, string_agg({PART_SQL}, {NL} || {NL} ORDER BY section_idx) AS body FROM wanted GROUP BY paper_id)
  SELECT 'd' || doc_id AS paper_id, '=== RESEARCH QUESTIONS (from Pass 0) ===' || {NL} || CASE WHEN doc_id % 3 <> 1 THEN {_literal(0, "'\"why?\"'", _str("lang"))} ELSE '[]' END || {NL} || {NL} || '=== TEXT ===' || {NL} || coalesce(body, '') AS payload FROM {{documents}} LEFT JOIN bodies ON bodies.paper_id = 'd' || doc_id"""))
def requests_pass4(spark, d):
    papers = view(spark, d, "SELECT 'd' || CAST(doc_id AS STRING) AS paper_id FROM {documents}")
    return _asked(payloads.pass4_claims(papers, view(spark, d, PARTS), _inventories(spark, d)))


CLAIMS = "SELECT 'p' || CAST(doc_id % 8 AS STRING) AS paper_id, doc_id AS ord, CASE WHEN doc_id % 11 = 0 THEN text ELSE 'claim ' || CAST(doc_id % 7 AS STRING) END AS claim_quote, 'p. 1' AS location, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'q' || CAST(doc_id % 5 AS STRING) END AS search_query FROM {documents}"
RESULTS = "SELECT DISTINCT 'q' || CAST(doc_id % 4 AS STRING) AS query, CAST(doc_id % 9 AS INT) AS rank, 't' || CAST(doc_id % 9 AS STRING) AS title, 'https://u.org/' || CAST(doc_id % 9 AS STRING) AS url, 'a \"b\"' AS snippet FROM {documents}"
MAIN = "SELECT DISTINCT 'p' || CAST(doc_id % 10 AS STRING) AS paper_id, CASE doc_id % 10 WHEN 9 THEN '' ELSE 'q' || CAST(doc_id % 5 AS STRING) END AS main_result_query FROM {documents}"
FIRST_CLAIMS = f"SELECT *, CASE WHEN search_query = '' THEN claim_quote ELSE search_query END AS query FROM ({CLAIMS}) x QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ord) <= 25"


@query(f"""WITH c AS ({FIRST_CLAIMS}), r AS (SELECT query, string_agg(title, ',' ORDER BY rank) AS titles FROM ({RESULTS}) y WHERE rank <= 5 GROUP BY query) SELECT paper_id, ord, c.query, coalesce(titles, '') AS titles FROM c LEFT JOIN r ON r.query = c.query""")
def claims_searched(spark, d):
    c = payloads.searched_claims(view(spark, d, CLAIMS), view(spark, d, RESULTS))
    return c.select("paper_id", "ord", "query", F.coalesce(F.array_join(F.col("results.title"), ","), F.lit("")).alias("titles"))


RESULT_SQL = lambda depth: f"(SELECT string_agg({_object(depth, title=_str('title'), url=_str('url'), snippet=_str('snippet'))}, {_between(depth - 1)} ORDER BY rank) FROM ({RESULTS}) y WHERE rank <= 5 AND y.query = c.query)"


@query(_asked_sql("pass4:verify", "'pass4:verify'", f"""WITH c AS ({FIRST_CLAIMS}), found AS (SELECT paper_id, {_list(0, f"string_agg({_object(1, claim_quote=_str('claim_quote'), location=_str('location'), query=_str('c.query'), results=_list(2, RESULT_SQL(3)))}, {_between(0)} ORDER BY ord)")} AS claims FROM c GROUP BY paper_id),
  m AS (SELECT paper_id, {_object(0, query=_str("query"), results=_list(1, RESULT_SQL(2)))} AS main FROM (SELECT paper_id, main_result_query AS query FROM ({MAIN}) x) c)
  SELECT m.paper_id, 'search_tool_available: true' || {NL} || {NL} || '=== CLAIMS WITH SEARCH RESULTS ===' || {NL} || coalesce({_cut_sql("claims", 60_000, DATA_CUT)}, '[]') || {NL} || {NL} || '=== SEARCH RESULTS FOR THE PAPER''S MAIN RESEARCH QUESTION ===' || {NL} || {_cut_sql("main", 20_000, DATA_CUT)} AS payload FROM m LEFT JOIN found USING (paper_id)"""))
def requests_pass4_verify(spark, d):
    results = view(spark, d, RESULTS)
    return _asked(payloads.pass4_verify(payloads.searched_claims(view(spark, d, CLAIMS), results), view(spark, d, MAIN), results))


@query(f"SELECT paper_id, (count(*) - 15) || ' extracted claims beyond the first 15 were not searched and remain unchecked.' AS limitation FROM ({CLAIMS}) c GROUP BY paper_id HAVING count(*) > 15")
def claims_dropped(spark, d):
    return payloads.dropped_claims(view(spark, d, CLAIMS), 15)


@query(f"SELECT DISTINCT query FROM (SELECT query FROM ({FIRST_CLAIMS}) c UNION ALL SELECT main_result_query FROM ({MAIN}) m) q WHERE query <> ''")
def searches_wanted(spark, d):
    return payloads.wanted_searches(view(spark, d, CLAIMS), view(spark, d, MAIN))


@query(f"SELECT paper_id, ord, '' AS source_url, 'no_search_tool - suggested query: ' || search_query AS source_says, 'could_not_verify' AS verdict FROM ({CLAIMS}) c")
def claims_without_search(spark, d):
    return payloads.without_search(view(spark, d, CLAIMS)).select("paper_id", "ord", "source_url", "source_says", "verdict")


FINDING_SQL = _object(1, **{c: _str(c) for c in payloads.FINDING})
# Of every paper the outputs of passes 1 and 3; of those with an even number that of pass 0 as well.
ONE_SQL = _literal(1, _object(2, limitations=_literal(3, _str("'cut \"short\"'")), section=_str("paper_id"), spellcheck_triage="'[]'", findings="'[]'"))
THREE_SQL = _object(1, limitations="'[]'", search_tool_available="'true'", references=_literal(2, _object(3, index="1", raw=_str("'Raw'"), status=_str("'verified'"), found_at="'\"\"'", mismatch_details="'\"\"'", citing_sentences=_literal(4, _object(5, quote=_str("'So [1].'"), location="'\"\"'")), supports_claim=_str("'yes'"), notes="'\"\"'")), missing_citations="'[]'")
ZERO_SQL = _object(1, limitations="'[]'", language=_str("'en'"), title="'\"\"'", sections="'[]'", research_questions_or_hypotheses="'[]'", figures="'[]'", tables="'[]'", key_numbers="'[]'", bibliography="'[]'")
OUTPUTS_SQL = f"CASE WHEN {DOC} % 2 = 0 THEN {_object(0, pass0=ZERO_SQL, pass1=ONE_SQL, pass3=THREE_SQL)} ELSE {_object(0, pass1=ONE_SQL, pass3=THREE_SQL)} END"


@query(_asked_sql("synthesis", "'synthesis'", f"""WITH f AS (SELECT *, CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 ELSE 3 END AS rank FROM ({PLANTED}) x),
  j AS (SELECT paper_id, {_list(0, f"string_agg({FINDING_SQL}, {_between(0)} ORDER BY rank, source_pass, category, location, ord)")} AS found FROM f GROUP BY paper_id),
  a AS (SELECT paper_id, string_agg('- ' || ord, {NL} ORDER BY ord) AS audit FROM f WHERE k = 2 AND g % 20 < 10 GROUP BY paper_id)
  SELECT j.paper_id, '=== MERGED FINDINGS (deduplicated across repeated runs) ===' || {NL} || {_cut_sql("found", 40_000, DATA_CUT)} || {NL} || {NL} || '=== REFERENCE AUDIT (already resolved; reproduce these lines verbatim in section 3, do not re-judge any status) ===' || {NL} || coalesce(audit, '- No bibliography entries were checked.') || {NL} || {NL} || '=== PASS OUTPUTS ===' || {NL} || {OUTPUTS_SQL} AS payload FROM j LEFT JOIN a USING (paper_id)"""))
def requests_synthesis(spark, d):
    f = view(spark, d, PLANTED)
    audit = f.where("k = 2 AND g % 20 < 10").select("paper_id", F.col("ord").alias("ref_index"), F.concat(F.lit("- "), F.col("ord").cast("string")).alias("line"))
    kinds = {k: t for k, t in zip(["pass0", "pass1", "pass3"], [REPLIES["pass0"], f"array<{REPLIES['pass1']}>", REPLIES["pass3"]], strict=True)}
    papers = f.select("paper_id").distinct()
    zero = F.when(F.substring("paper_id", 2, 9).cast("int") % 2 == 0, F.lit('{"language": "en", "limitations": [], "title": "", "sections": [], "research_questions_or_hypotheses": [], "figures": [], "tables": [], "key_numbers": [], "bibliography": []}'))
    one = F.concat(F.lit('[{"limitations": ["cut \\"short\\""], "section": "'), "paper_id", F.lit('", "spellcheck_triage": [], "findings": []}]'))
    three = F.lit('{"limitations": [], "search_tool_available": true, "references": [{"index": 1, "raw": "Raw", "status": "verified", "found_at": "", "mismatch_details": "", "citing_sentences": [{"quote": "So [1].", "location": ""}], "supports_claim": "yes", "notes": ""}], "missing_citations": []}')
    said = papers.select("paper_id", F.struct(*[F.from_json(c, kinds[k]).alias(k) for k, c in (("pass0", zero), ("pass1", one), ("pass3", three))]).alias("outputs"))
    return _asked(payloads.synthesis(findings.ordered(f.drop("g", "k")), audit, said))


CALLS = "SELECT CAST(user_id AS STRING) AS run_id, event_type, value, event_id FROM {events}"


@query("SELECT CAST(user_id AS STRING) AS run_id, count(*) AS calls, count(*) FILTER (event_id % 9 = 0) AS errors, CAST(sum(event_id % 11) AS BIGINT) AS prompt_tokens, CAST(sum(3) AS BIGINT) AS completion_tokens FROM {events} GROUP BY user_id")
def usage_by_run(spark, d):
    c = view(spark, d, CALLS).select("run_id", F.create_map(F.lit("prompt_tokens"), F.col("event_id") % 11, F.lit("completion_tokens"), F.lit(3).cast("bigint")).alias("usage"), F.col("value").alias("duration_s"), (F.col("event_id") % 9 != 0).alias("ok"))
    u = model_calls.usage_of_runs(c)
    return u.select("run_id", "calls", "errors", F.col("total_usage.prompt_tokens").alias("prompt_tokens"), F.col("total_usage.completion_tokens").alias("completion_tokens"))


@query("SELECT CAST(user_id AS STRING) AS paper_slug, max(lpad(CAST(event_id AS STRING), 12, '0')) AS run_id FROM {events} WHERE user_id % 3 <> 0 GROUP BY user_id UNION ALL SELECT CAST(user_id AS STRING), min(lpad(CAST(event_id AS STRING), 12, '0')) FROM {events} WHERE user_id % 3 = 0 GROUP BY user_id")
def latest_runs(spark, d):
    from marginalia.sources.files import latest_runs as latest

    e = view(spark, d, "SELECT CAST(user_id AS STRING) AS paper_slug, lpad(CAST(event_id AS STRING), 12, '0') AS run_id, user_id FROM {events}")
    pointers = e.where("user_id % 3 = 0").groupBy("paper_slug").agg(F.min("run_id").alias("run_id"))
    return latest(e, pointers)


@query("SELECT CAST(event_id AS STRING) AS run_id, user_id % 2 = 0 AS available FROM {events} ORDER BY event_id DESC LIMIT 100")
def run_history(spark, d):
    e = view(spark, d, "SELECT CAST(event_id AS STRING) AS run_id, CAST(user_id AS STRING) AS slug, event_id AS line, user_id FROM {events}")
    return files.history(e, e.where("user_id % 2 = 0").select(F.col("slug").alias("paper_slug"), "run_id"), 100).select("run_id", "available")


@query("""SELECT CAST(user_id AS STRING) AS model, string_agg(DISTINCT nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), '|' ORDER BY nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, '')) AS quantization,
  coalesce(string_agg(DISTINCT CASE WHEN event_id % 5 <> 0 THEN 'p' || CAST(event_id % 5 AS STRING) END, ',' ORDER BY CASE WHEN event_id % 5 <> 0 THEN 'p' || CAST(event_id % 5 AS STRING) END), '') AS providers FROM {events} GROUP BY user_id""")
def model_endpoints(spark, d):
    e = view(spark, d, "SELECT CAST(user_id AS STRING) AS model, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS quantization, CASE WHEN event_id % 5 <> 0 THEN 'p' || CAST(event_id % 5 AS STRING) END AS provider FROM {events}")
    return model_calls.model_endpoints(e).select("model", "quantization", F.array_join("providers", ",").alias("providers"))


OUTPUTS = """SELECT source AS paper_id, doc_id, 'pass' || CAST(doc_id % 5 AS STRING) AS source_pass, translate(CASE doc_id % 5 WHEN 0 THEN '«"n": 0»' WHEN 1 THEN '[«"n": 0», [«"n": 1», 5]]' WHEN 2 THEN '«"runs": [«"n": 0», [«"n": 1», «"n": 2»]]»' WHEN 3 THEN '«"runs": [«"runs": [«"n": 0»]», «"runs": 3»]»' ELSE '7' END, '«»', chr(123) || chr(125)) AS json FROM {documents}"""


@query("SELECT doc_id, CAST(unnest(CASE doc_id % 5 WHEN 0 THEN [0] WHEN 1 THEN [0, 1] WHEN 2 THEN [0, 1, 2] WHEN 3 THEN [0, -1] ELSE [] END) AS BIGINT) AS n FROM {documents}")
def outputs_flattened(spark, d):
    o = view(spark, d, OUTPUTS)
    flat = files.flattened(o.select(F.col("doc_id").cast("string").alias("paper_id"), "source_pass", "json"))
    return flat.select(F.col("paper_id").cast("bigint").alias("doc_id"), F.coalesce(F.get_json_object("json", "$.n").cast("bigint"), F.lit(-1).cast("bigint")).alias("n"))


REVIEWS = """SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, doc_id, translate(CASE doc_id % 3 WHEN 0 THEN '[«"severity": "minor", "category": " claims ", "quote": "q", "pass": "pass2", "source_pass": "x"»]'
  WHEN 1 THEN '«"notes": "by hand", "findings": [«"quote": 5, "url": "https://e.org"», «"severity": "critical", "source_pass": "pass1"»]»' ELSE '«"notes": "nothing found"»' END, '«»', chr(123) || chr(125)) AS text FROM {documents}"""


@query("""WITH r AS (SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, doc_id % 3 AS k FROM {documents})
  SELECT paper_id, CAST(0 AS BIGINT) AS ord, CASE k WHEN 0 THEN 'minor' ELSE 'major' END AS severity, CASE k WHEN 0 THEN 'claims' ELSE '' END AS category, CASE k WHEN 0 THEN 'q' ELSE '5' END AS quote, CASE k WHEN 0 THEN 'pass2' ELSE '' END AS source_pass, CASE k WHEN 0 THEN '' ELSE 'https://e.org' END AS url FROM r WHERE k < 2
  UNION ALL SELECT paper_id, 1, 'critical', '', '', 'pass1', '' FROM r WHERE k = 1""")
def truth_loaded(spark, d):
    return files.truth_findings(view(spark, d, REVIEWS)).select("paper_id", "ord", "severity", "category", "quote", "source_pass", "url")


@query("SELECT 'd' || CAST(doc_id AS STRING) AS paper_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'by hand' ELSE 'nothing found' END AS notes FROM {documents}")
def truth_notes(spark, d):
    return files.truth_notes(view(spark, d, REVIEWS))


STATES = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query(f"SELECT CAST(user_id AS STRING) AS job_id, arg_max({STATES}, event_id) AS status, count(*) AS event_count, arg_max({STATES}, event_id) IN ('done', 'failed') AS finished FROM {{events}} GROUP BY user_id")
def job_states(spark, d):
    return jobs.state(view(spark, d, f'SELECT CAST(user_id AS STRING) AS job_id, event_id AS offset, {STATES} AS status FROM {{events}}'))


@query("SELECT CAST(user_id AS STRING) AS job_id, event_id FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, lpad(CAST(event_id AS STRING), 12, '0')) > 3")
def job_events_since(spark, d):
    e = view(spark, d, "SELECT CAST(user_id AS STRING) AS job_id, ts, event_id, lpad(CAST(event_id AS STRING), 12, '0') AS message, 'running' AS status FROM {events}")
    return jobs.since(jobs.numbered(e), 3).select("job_id", "event_id")


# A whole review -------------------------------------------------------------------------------------------------------------

# What a model is made to answer to each request, the same in all papers, but that every third paper has no inventory.
CANNED = {
    "pass0": '{"language": "en", "title": "T", "limitations": ["Read  in parts."]}',
    "pass1": '{"findings": [{"severity": "major", "category": "grammar", "quote": "it say", "description": "Agreement."}], "spellcheck_triage": [{"token": "teh", "classification": "typo", "correction": "the"}, {"token": "GPU", "classification": "domain_term"}]}',
    "pass2": '{"number_checks": [{"quantity": "rate", "values": ["1.5%", "2.5%"], "locations": ["p. 1", "p. 2"], "recomputation": "No.", "verdict": "verified_incorrect"}], "claim_checks": [{"claim_quote": "it always wins", "location": "p. 3", "verdict": "overreach", "explanation": "Too far."}]}',
    "pass3:refs": '{"references": [{"index": 1, "status": "verified", "supports_claim": "weaker", "notes": "Seen."}, {"index": 2, "status": "verified", "supports_claim": "yes", "notes": "Seen."}]}',
    "pass3:missing": '{"missing_citations": [{"quote": "Stores fail.", "location": "1", "why_needed": "A fact."}, {"quote": "Shown in [1].", "location": "1"}]}',
    "pass4:claims": '{"claims": [{"claim_quote": "Stores are old.", "location": "1", "search_query": "stores"}, {"claim_quote": "Disks spin.", "location": "1", "search_query": ""}], "main_result_query": "main"}',
    "pass4:verify": '{"fact_checks": [{"claim_quote": "Stores are old.", "source_url": "https://s.org/stores", "source_says": "New.", "verdict": "verified_incorrect"}, {"claim_quote": "Disks spin.", "source_url": "https://made.up/", "source_says": "No.", "verdict": "verified_incorrect"}], "missing_engagement": [{"work": "W", "url": "https://s.org/main", "why_relevant": "Near."}, {"work": "V", "url": "https://made.up/"}]}',
}


def canned_means(spark: SparkSession) -> review.Means:
    """Means of a review whose model, lookup and search always answer the same."""

    def ask(requests: DataFrame) -> DataFrame:
        said = F.create_map(*[F.lit(x) for k, text in CANNED.items() for x in (k, replies.parse(text, struct(REPLIES[payloads.STAGES[k][3]]))[0])])
        third = (F.col("stage") == "pass0") & (F.crc32(F.col("payload").cast("binary")) % 3 == 0)
        rows = requests.withColumn("json", F.when(~third, said[F.col("stage")]))
        return rows.select("request_hash", "stage", "label", "json", F.lit(None).cast("string").alias("text"), F.lit("m").alias("model"), F.lit("json_schema").alias("mode"), F.col("json").isNotNull().alias("ok"), F.lit(1).alias("attempts"), F.lit(0.5).cast("double").alias("duration_s"), F.lit(None).cast("map<string,bigint>").alias("usage"), F.lit("").alias("error"))

    def lookup(refs: DataFrame) -> DataFrame:
        """Finds references of uneven numbers."""
        return refs.selectExpr("paper_id", "ref_index", "ref_index % 2 = 1 AS found", "'https://r.org/' || ref_index AS url", "coalesce(title, '') AS title", "authors", "coalesce(year, '') AS year", "'' AS venue", "coalesce(doi, '') AS doi", "'article' AS type", "false AS is_retracted", "'' AS retraction_notes", "true AS is_preprint", "'' AS abstract", "CAST(100 AS DOUBLE) AS match_score", "'canned' AS source")

    def search(queries: DataFrame) -> DataFrame:
        return queries.selectExpr("query", "1 AS rank", "query AS title", "'https://s.org/' || query AS url", "'said' AS snippet")

    lexicon = spark.createDataFrame([("the", 9)], "word string, frequency int")
    return review.Means(ask=ask, replies=f"{shared_dir(spark).rstrip('/')}/marginalia/replies-{uuid.uuid4().hex}", lexicon=lexicon, lookup=lookup, search=search)


def _reviewed(spark, d) -> review.Review:
    papers = view(spark, d, PAPERS).select("paper_id", "text", F.lit(1).alias("page_count"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return review.review(spark, lines(spark, d), papers, canned_means(spark))


@query(rf"""WITH {LINES_SQL}, {HEADINGS_SQL}, {CITES_SQL}, own AS (SELECT paper_id, label FROM sections WHERE kind NOT IN ('references', 'back_matter') AND length(trim(text)) > 200),
  cited_in AS (SELECT paper_id FROM sections WHERE kind IN ('introduction', 'background', 'methods', 'discussion') GROUP BY paper_id), first_cite AS (SELECT paper_id, ref_index, location FROM cited WHERE nth = 1), r AS (SELECT paper_id, unnest([1, 2]) AS ref_index FROM papers)
  SELECT paper_id, 'pass1' AS source_pass, 'major' AS severity, 'grammar' AS category, label AS location, 'it say' AS quote, 'Agreement.' AS description, '' AS verdict, '' AS url FROM own
  UNION ALL SELECT paper_id, 'pass1', 'minor', 'spelling', label, 'teh', 'Misspelling: ''teh''.', '', '' FROM own
  UNION ALL SELECT paper_id, 'pass2', 'major', 'numbers', 'p. 1; p. 2', '1.5% vs 2.5%', 'rate: the values disagree across locations. No.', 'verified_incorrect', '' FROM papers
  UNION ALL SELECT paper_id, 'pass2', 'major', 'claims', 'p. 3', 'it always wins', 'Claim is overreach. Too far. Supporting evidence found: none.', 'overreach', '' FROM papers
  UNION ALL SELECT r.paper_id, 'pass3', CASE r.ref_index WHEN 1 THEN 'minor' ELSE 'major' END, 'reference', coalesce(location, 'Reference [' || r.ref_index || ']'), CASE r.ref_index WHEN 1 THEN 'Belady, L. (1966). A study of replacement algorithms. Systems Journal.' ELSE 'Mattson, R. (1970). Evaluation techniques for storage hierarchies. doi:10.1000/ab.12.' END,
    'Reference [' || r.ref_index || ']' || CASE r.ref_index WHEN 1 THEN ' supports a weaker claim than the one it is cited for. ' ELSE ' could not be found in a bibliographic database. ' END || 'Seen. Indexed as a preprint.', CASE r.ref_index WHEN 1 THEN 'verified' ELSE 'not_found' END, CASE r.ref_index WHEN 1 THEN 'https://r.org/1' ELSE '' END FROM r LEFT JOIN first_cite c ON c.paper_id = r.paper_id AND c.ref_index = r.ref_index
  UNION ALL SELECT paper_id, 'pass3', 'major', 'citation', '1', 'Stores fail.', 'Claim needs a citation and has none. A fact.', '', '' FROM cited_in
  UNION ALL SELECT paper_id, 'pass4', 'major', 'external_fact', '', 'Stores are old.', 'Contradicted by an external source: New.', 'verified_incorrect', 'https://s.org/stores' FROM papers
  UNION ALL SELECT paper_id, 'pass4', 'minor', 'missing_engagement', '', 'W', 'Relevant work the paper does not engage with. Near.', '', 'https://s.org/main' FROM papers""")
def review_run(spark, d):
    """The findings of a whole review of all papers, from lines over eight kinds of requests and their replies to merged rows."""
    return _reviewed(spark, d).findings.select("paper_id", "source_pass", "severity", "category", "location", "quote", "description", "verdict", "url")
