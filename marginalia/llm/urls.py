"""URL rules over redirect classes: a page that no rule fits takes the decision of its aliases.

Two urls are aliases if a chain of redirects (meta refresh) and canonical links joins them. Classes are the connected
components of these edges. A page's own rule decides first. Otherwise its class decides: an explicit allow of any alias goes
before a block of another; a class without any rule takes the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import components, free_name
from marginalia.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules that the query op8_redirect_classes is given.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
COMMENT = r"(?s)<!--.*?-->"
CANONICAL_TAG = r"(?is)<link\s(?:[^>]*\s)?rel\s*=\s*[\"']?(?:[a-z-]+\s+)*canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\s(?:[^>]*\s)?http-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)[\s\"']href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
GOES_TO = r"(?is)\burl\s*=\s*['\"]?([^\"'>]*)"
#: scheme, authority with its slashes, path, query with its mark: the parts of a reference; a fragment is left out.
REFERENCE = r"(?s)^(?:([^:/?#]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, like 'net/es/', and its verdict; both null if none fits. A list of rules is a parameter, not
    data: each is one branch of an expression. Of equal rules the first allow counts."""
    rule = verdict = None
    for kind, own, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule = F.when(fits, own + start) if rule is None else rule.when(fits, own + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _without_dots(path: Column) -> Column:
    """path with its segments . and .. resolved."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    last = F.element_at(parts, -1)
    done = F.aggregate(parts, F.lit(""), lambda so_far, part: F.when(part == "..", F.regexp_replace(so_far, "/[^/]*$", "")).when(part == ".", so_far).otherwise(F.concat(so_far, F.lit("/"), part)))
    done = F.when(last.isin(".", ".."), F.concat(done, F.lit("/"))).otherwise(done)
    return F.when(path.rlike(r"/\.\.?(/|$)"), done).otherwise(path)


def _absolute(link: Column, url: Column) -> Column:
    """link as seen from url, by the rules for references; null where there is none or it leads to no host (mailto: and the
    like)."""
    link = F.regexp_replace(F.trim(F.regexp_replace(link, r"[\t\r\n]", "")), "&amp;", "&")
    part = lambda of, n: F.regexp_extract(of, REFERENCE, n)
    scheme, host, path, query = (part(link, n) for n in range(1, 5))
    base_path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_extract(base_path, r"(?s)^(.*/)", 1), path))
    here = F.concat(part(url, 1), F.lit(":"))
    return (
        F.when(link == "", None)
        .when((scheme != "") & host.startswith("//"), F.concat(scheme, F.lit(":"), host, _without_dots(path), query))
        .when(scheme != "", None)
        .when(host != "", F.concat(here, host, _without_dots(path), query))
        .when(path == "", F.concat(here, part(url, 2), part(url, 3), F.when(query == "", part(url, 4)).otherwise(query)))
        .otherwise(F.concat(here, part(url, 2), _without_dots(full), query))
    )


def node_of(url: Column) -> Column:
    """What is one node of the graph: scheme and host in lower case, without the fragment."""
    return F.concat(F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER), F.lit("://"), host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's url and the target of its canonical link or refresh. The first such tag outside of comments counts."""
    url, html = F.col(url_col), F.col(html_col)
    # most pages have neither: no other pattern is run there
    has = lambda word: F.when(F.lower(html).contains(word), F.regexp_replace(html, COMMENT, ""))
    tag = F.regexp_extract(has("canonical"), CANONICAL_TAG, 0)
    canonical = F.concat(*[F.regexp_extract(tag, HREF, n) for n in (1, 2, 3)])
    refresh = F.regexp_extract(F.regexp_extract(has("refresh"), REFRESH_TAG, 0), GOES_TO, 1)
    both = pages.where(url.contains("://")).select(url.alias("url"), F.explode(F.array(canonical, refresh)).alias("link")).where("link <> ''")
    both = both.select("url", _absolute(F.col("link"), F.col("url")).alias("to")).where("to is not null")
    return both.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b")).where("a <> b")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None, url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """pages with five more columns: host, path, rule, verdict, and alias_verdict (what its class says, null if nothing).

    edges(a, b) are further alias pairs of urls, such as a crawler's redirects. Null urls and urls without '://' have an empty
    host and path, no rule and no aliases: they get the default. Very long html is read whole. Repeated rows are judged alike. Names that pages already has
    are kept; the new columns then begin with an underscore."""
    url = F.col(url_col)
    host, path, rule, verdict, alias, node = free_name(pages, "host", "path", "rule", "verdict", "alias_verdict", "node")
    pairs = alias_edges(pages, url_col, html_col)
    if edges is not None:
        pairs = pairs.unionAll(edges.where(F.col("a").contains("://") & F.col("b").contains("://")).select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    pairs = stored(pairs.distinct(), "url-edges")
    own_rule, own = rule_of(F.col(host), F.col(path), rules)
    out = pages.withColumns({host: host_of(url), path: path_of(url)}).withColumns({rule: own_rule, verdict: own})
    if pairs.isEmpty():
        out = out.withColumn(alias, F.lit(None).cast("string"))
    else:
        member = components(pairs, "url")
        _, said = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
        # a url of the graph need not be a page: every node is judged by its own rule
        of_class = member.withColumn("said", said).groupBy("root").agg(F.min(F.when(F.col("said").isNotNull(), F.col("said"))).alias("said"))  # 'allow' sorts before 'block'
        of_node = member.join(of_class, "root").where("said is not null").select(F.col("node").alias("_node"), F.col("said").alias(alias))
        out = out.withColumn(node, F.when(url.contains("://"), node_of(url))).join(of_node, F.col(node) == F.col("_node"), "left").drop(node, "_node")
    return out.withColumn(verdict, F.coalesce(F.col(verdict), F.col(alias), F.lit(default)))


def op8(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "alias_verdict")
