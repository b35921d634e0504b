"""Text functions as column expressions. White space, as everywhere here, is the Unicode kind."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character of Unicode white space, in Java's dialect (as [\\s\\x1c-\\x1f\\x85\\p{Z}], but without asking for categories), and all
#: these characters.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Typographic characters and what stands for them.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
SINGLE = ("\u2018\u2019\u201c\u201d\u2013\u2014\u00a0\u2212", "''\"\"-- -")

#: Words after whose period a sentence goes on.
ABBREVIATIONS = """al e.g eg i.e ie cf vs etc approx ca resp viz fig figs eq eqs no nos ref refs sec secs ch chap p pp vol vols ed eds
trans dr prof mr mrs ms st inc ltd co dept univ est min max avg std""".split()


def strip(col: Column) -> Column:
    """Looks at the ends alone: a pattern would be tried at each character of a long text."""
    return F.btrim(col, F.lit(BLANKS))


def collapse(col: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col, f"{WS}+", " "))


def normalise(col: Column) -> Column:
    """Typographic characters to plain ones, runs of blanks and tabs to one blank."""
    for bad, good in LIGATURES.items():
        col = F.replace(col, F.lit(bad), F.lit(good))
    return strip(F.regexp_replace(F.translate(col, *SINGLE), r"[ \t]+", " "))


def join_lines(texts: Column) -> Column:
    """An array of lines as one text; a hyphen at the end of a line after a small letter joins it to the next."""
    return F.regexp_replace(F.array_join(texts, "\n"), r"(?<=[a-z])-\n", "")


def _goes_on(piece: Column) -> Column:
    token = F.regexp_extract(F.substring_index(F.rtrim(piece, F.lit(BLANKS)), " ", -1), r"([A-Za-z.]+)\.$", 1)
    return token.rlike("^[A-Z]$") | F.regexp_replace(F.lower(token), r"\.+$", "").isin(ABBREVIATIONS)


def _flat(text: Column) -> Column:
    """Lines without blanks at their ends, joined by a blank; empty ones go."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), " ")


def sentences(text: Column) -> Column:
    """An array of sentences. Whether a piece goes on depends on its own last token alone, so pieces are joined by a blank or by
    a mark in one pass, and cut at the marks."""
    pieces = F.split(_flat(text), rf"(?<=[.!?]){WS}+(?=[A-Z\[(])")
    marked = F.array_join(F.transform(pieces, lambda p: F.concat(p, F.when(_goes_on(p), " ").otherwise("\x01"))), "")
    return F.filter(F.transform(F.split(marked, "\x01"), strip), lambda s: s != "")


def sentence_pieces(text: Column) -> Column:
    """The pieces before abbreviations are looked at."""
    return F.filter(F.split(_flat(text), rf"(?<=[.!?]){WS}+(?=[A-Z\[(])"), lambda s: s != "")


def raw_tokens(sentence: Column) -> Column:
    """White-space chunks without brackets, commas and the like at their ends."""
    return F.transform(F.filter(F.split(sentence, f"{WS}+"), lambda c: c != ""), lambda c: F.btrim(c, F.lit('.,;:()[]{}"')))


def token_of(raw: Column) -> Column:
    """A raw token without quotes and hyphens at its ends and without a possessive."""
    bare = F.btrim(raw, F.lit("'\u2019-"))
    return F.when(F.right(bare, F.lit(2)).isin("'s", "\u2019s"), F.substring(bare, F.lit(1), F.length(bare) - 2)).otherwise(bare)


def checkable(token: Column, raw: Column, least: int = 3) -> Column:
    """Long enough, letters (with apostrophes and hyphens inside) only, no digit or underscore, not all upper case."""
    return (F.length(token) >= least) & token.rlike(r"^[A-Za-z][A-Za-z'\u2019\-]*\z") & ~raw.rlike(r"[\d_]") & (F.upper(token) != token)


def without_markup(text: Column) -> Column:
    """LaTeX commands and formulas, then addresses and DOIs, give way to a blank."""
    has = lambda c, *marks: functools.reduce(Column.__or__, [c.contains(F.lit(m)) for m in marks])
    plain = F.when(has(text, "\\", "$"), F.regexp_replace(text, r"\\[A-Za-z]+|\$[^$]*\$", " ")).otherwise(text)
    return F.when(has(plain, "http", "www.", "10."), F.regexp_replace(plain, r"https?://\S+|www\.\S+|\b10\.\d{4,9}/\S+", " ")).otherwise(plain)


def clip(col: Column, most: int, mark: str = "...") -> Column:
    """The first characters and a mark, most together, where col is longer."""
    return F.when(F.length(col) <= most, col).otherwise(F.concat(F.substring(col, 1, most - len(mark)), F.lit(mark)))


def cell(col: Column) -> Column:
    """For a table in Markdown: one line, bars escaped, 220 characters at most."""
    return clip(F.replace(collapse(col), F.lit("|"), F.lit("\\|")), 220)


def slug(col: Column, default: str = "paper") -> Column:
    s = F.regexp_replace(F.regexp_replace(col, r"[^a-zA-Z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(s == "", default).otherwise(s)


def safe_filename(col: Column) -> Column:
    """The last part of a path, letters, digits, '.', '_', '-' and blanks only, ending in .pdf."""
    name = F.trim(F.regexp_replace(F.regexp_extract(col, r"([^/\\]*)$", 1), r"[^\p{L}\p{N}._ -]", ""))
    name = F.when(name == "", "paper").otherwise(name)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def safe_url(col: Column) -> Column:
    return F.coalesce(col.rlike("^(?i)https?://"), F.lit(False))


def title_key(col: Column, gap: str = " ") -> Column:
    """Small letters, digits and blanks; what else there was gives way to gap."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9 ]+", gap))


def year_of(col: Column) -> Column:
    y = F.regexp_extract(col, r"((?:19|20)\d{2})", 1)
    return F.when(y != "", y.cast("int"))


def strip_tags(col: Column) -> Column:
    return strip(F.replace(F.regexp_replace(col, "<[^>]+>", " "), F.lit("&amp;"), F.lit("&")))


def citation_numbers(group: Column) -> Column:
    """'3, 5-7' to [3, 5, 6, 7]. A range counts if it rises by less than 60."""

    def part(p: Column) -> Column:
        lo, hi = F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", 1).try_cast("int"), F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", 2).try_cast("int")
        return F.when((hi - lo > 0) & (hi - lo < 60), F.sequence(lo, F.least(hi, lo + 60))).when(p.rlike(r"^\d+$"), F.array(p.try_cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.transform(F.split(group, "[,;]"), lambda p: F.trim(p)), part))


def language(col: Column) -> Column:
    """English variants to en, others to their first two letters."""
    low = F.lower(col)
    return F.when(low.startswith("en"), "en").otherwise(F.substring(low, 1, 2))


def dictionary_name(col: Column) -> Column:
    low = F.lower(col)
    return F.when(low.isin("en-gb", "en_gb"), "en_GB").when(low.isin("en-us", "en_us", "en"), "en_US").otherwise(col)


def run_id(started: Column, seed: Column) -> Column:
    return F.concat(F.date_format(started, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-s"), seed.cast("string"))


def short_hash(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 16)


#: What the messages of a model server look like.
CONTEXT_MARKERS = ("context length", "context window", "maximum context", "context_length", "too long", "too many tokens", "exceeds", "reduce the length", "prompt is too")
FORMAT_MARKERS = ("response_format", "json_schema", "json schema", "unsupported", "not supported", "invalid_request_error", "422", "schema")


def error_class(message: Column) -> Column:
    """context, format or other; context goes first."""
    low = F.lower(message)
    any_of = lambda words: F.coalesce(*[F.when(low.contains(w), True) for w in words], F.lit(False))
    return F.when(any_of(CONTEXT_MARKERS), "context").when(any_of(FORMAT_MARKERS), "format").otherwise("other")


def uncoded_reply(text: Column) -> Column:
    """A reply without its think block, reduced to the body of its first fence if it has one."""
    clean = strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    body = F.regexp_extract(clean, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(clean.rlike(r"(?s)```(?:json)?\s*.*?```"), strip(body)).otherwise(clean)
