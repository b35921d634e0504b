"""The queries of this subpackage and, where SQL can state what they return, that SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from marginalia.llm import alignment, ann, html, lexical, minhash, mixing, packing, pii, quality, sharding, suffix, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_min_bin_slack_packing": packing.op1,
    "op2_nnpu_toxicity": toxicity.op2,
    "op3_isolation_forest_quality": quality.op3,
    "op4_feistel_pseudonyms": pii.op4,
    "op5_anisotropic_search": ann.op5,
    "op6_raked_mixture": mixing.op6,
    "op7_histogram_sort_shards": sharding.op7,
    "op8_redirect_classes": urls.op8,
    "op9_induced_sorting_dedup": suffix.op9,
    "op10_lsh_forest": minhash.op10,
    "op11_token_alignment": alignment.op11,
    "op12_host_suffix_extraction": html.op12,
    "op13_windowed_ranking": lexical.op13,
    "pipeline": corpus_pipeline.run,
}

def _part(of: str, n: int) -> str:
    return f"regexp_extract({of}, '{urls.REFERENCE}', {n})"


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"


def _node(url: str) -> str:
    return f"translate(regexp_extract({url}, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || {_host(url)} || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"


def _no_dots(path: str) -> str:
    folded = f"list_reduce(list_prepend('', string_split({path}, '/')[2:]), lambda so_far, part: CASE WHEN part = '..' THEN regexp_replace(so_far, '/[^/]*$', '') WHEN part = '.' THEN so_far ELSE so_far || '/' || part END)"
    return f"CASE WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN {folded} || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END ELSE {path} END"


_QUOTED = {name: getattr(urls, name).replace("'", "''") for name in ("CANONICAL_TAG", "REFRESH_TAG", "HREF", "GOES_TO")}

_OP8 = f"""
WITH RECURSIVE rules(kind, own, start) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), html AS (
  SELECT url, regexp_replace(html, '{urls.COMMENT}', '', 'g') AS html FROM pages WHERE contains(url, '://')
), tags AS (
  SELECT url, regexp_extract(html, '{_QUOTED["CANONICAL_TAG"]}', 0) AS canonical, regexp_extract(html, '{_QUOTED["REFRESH_TAG"]}', 0) AS refresh FROM html
), links AS (
  SELECT url, regexp_extract(canonical, '{_QUOTED["HREF"]}', 1) || regexp_extract(canonical, '{_QUOTED["HREF"]}', 2) || regexp_extract(canonical, '{_QUOTED["HREF"]}', 3) AS link FROM tags
  UNION ALL SELECT url, regexp_extract(refresh, '{_QUOTED["GOES_TO"]}', 1) FROM tags
), clean AS (
  SELECT url, replace(trim(regexp_replace(link, '[\t\r\n]', '', 'g')), '&amp;', '&') AS link FROM links
), cut AS (
  SELECT url, {_part("link", 1)} AS scheme, {_part("link", 2)} AS host, {_part("link", 3)} AS path, {_part("link", 4)} AS query,
         {_part("url", 1)} || ':' AS here, {_part("url", 2)} AS base_host, {_part("url", 3)} AS base, {_part("url", 4)} AS base_query
  FROM clean WHERE link <> ''
), whole AS (
  SELECT *, CASE WHEN starts_with(path, '/') THEN path ELSE regexp_extract(CASE WHEN base = '' THEN '/' ELSE base END, '(?s)^(.*/)', 1) || path END AS from_base FROM cut
), targets AS (
  SELECT url, CASE WHEN scheme <> '' AND starts_with(host, '//') THEN scheme || ':' || host || {_no_dots("path")} || query
                   WHEN scheme <> '' THEN NULL
                   WHEN host <> '' THEN here || host || {_no_dots("path")} || query
                   WHEN path = '' THEN here || base_host || base || CASE WHEN query = '' THEN base_query ELSE query END
                   ELSE here || base_host || {_no_dots("from_base")} || query END AS to_url
  FROM whole
), edges AS (
  SELECT DISTINCT {_node("url")} AS a, {_node("to_url")} AS b FROM targets WHERE to_url IS NOT NULL
), both_ways AS (
  SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach(node, r) AS (
  SELECT a, a FROM both_ways UNION SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.node WHERE reach.r < e.b
), classes AS (
  SELECT node, min(r) AS root FROM reach GROUP BY node
), nodes AS (
  SELECT node, root, {_host("node")} AS host, {_path("node")} AS path FROM classes
), judged AS (
  SELECT node, root, (SELECT arg_max(kind, length(own || start)) FROM rules WHERE (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)) AS said FROM nodes
), of_class AS (
  SELECT root, min(said) AS said FROM judged GROUP BY root
), of_node AS (
  SELECT j.node, c.said FROM judged j JOIN of_class c ON c.root = j.root
), parts AS (
  SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, CASE WHEN contains(url, '://') THEN {_node("url")} END AS node FROM pages
), fits AS (
  SELECT page_id, own || start AS rule, kind, row_number() OVER (PARTITION BY page_id ORDER BY length(own || start) DESC) AS nth
  FROM parts JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.kind, n.said, 'allow') AS verdict, n.said AS alias_verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.nth = 1 LEFT JOIN of_node n ON n.node = p.node
"""

_OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.doc_id WHERE reach.r < e.b
), least AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.c AS component_id, s.doc_id = l.c AS kept
FROM sets s JOIN least l ON l.doc_id = s.doc_id
"""

_OP13 = rf"""
WITH numbered AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{lexical._UPPER}', '{lexical._LOWER}') AS text FROM documents
), words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(text, '{lexical.TERM}')) AS term FROM numbered
), tfs AS (
  SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY row
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{lexical._UPPER}', '{lexical._LOWER}'), '{lexical.TERM}')) AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY term, docs
), scores AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (row), whole GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES: dict[str, str] = {"op8_redirect_classes": _OP8, "op10_lsh_forest": _OP10, "op13_windowed_ranking": _OP13}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
