"""Words for a spelling check: tokens that a lexicon and an allow-list don't know, counted and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import checkable, clip, language, raw_tokens, sentences, token_of, without_markup
from marginalia.storage import stored

#: Words that papers use and dictionaries reject.
COMMON_ACADEMIC = "et al etal vs cf ibid eg ie arxiv doi isbn issn http https www pdf url dataset datasets preprint supplementary".split()
ACRONYM = r"\(([A-Z][A-Za-z0-9]{1,9})s?\)"
WORD = r"[A-Za-z][A-Za-z'’\-]*"


def allowlist(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """(paper_id, word): authors, capitalised words of references, acronyms that papers(paper_id, text) define. Common words are
    allowed everywhere, without a row here."""
    authors = refs.select("paper_id", F.explode("authors").alias("word"))
    names = refs.select("paper_id", F.explode(F.regexp_extract_all("raw", F.lit(WORD), 0)).alias("word")).where(F.col("word").rlike("^[A-Z]") & (F.length("word") > 2))
    acronyms = papers.select("paper_id", F.explode(F.regexp_extract_all("text", F.lit(ACRONYM), 1)).alias("word"))
    return authors.unionByName(names).unionByName(acronyms).select("paper_id", F.lower("word").alias("word")).distinct()


def word_counts(texts: DataFrame, *by: str, least: int = 3) -> DataFrame:
    """(by, word, n): checkable tokens of texts(by, text) in small letters, with how often each stands for each value of by. Equal raw
    tokens are counted before any pattern is run on them."""
    raw = texts.select(*by, F.explode_outer(raw_tokens(F.col("text"))).alias("raw")).where("raw is not null").groupBy(*by, "raw").agg(F.count(F.lit(1)).alias("n"))
    t = raw.withColumn("token", token_of(F.col("raw"))).where(checkable(F.col("token"), F.col("raw"), least))
    return t.groupBy(*by, F.lower("token").alias("word")).agg(F.sum("n").alias("n"))


def ranked(words: DataFrame, by: list[str], most: int) -> DataFrame:
    """Of each by the `most` words(by, word, occurrences) that stand most often, ties by the alphabet."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("occurrences"), "word"))
    return words.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def unknown(words: DataFrame, allow: DataFrame, lexicon: DataFrame, least: int = 3) -> DataFrame:
    """The rows of words(paper_id, word, language, ...) that neither allow(paper_id, word) nor lexicon(word, language) has, nor the list
    of common words. A word with hyphens is unknown if one of its parts of `least` letters or more is, and is itself not allowed."""
    known = lexicon.select("word", "language").distinct().withColumn("_known", F.lit(True))
    hyphened = F.col("word").contains("-")
    # the lexicon knows most words, so it goes first, and what is left is small
    open_ = words.where(~F.col("word").isin(COMMON_ACADEMIC)).join(known, ["word", "language"], "left").where(hyphened | F.col("_known").isNull())
    open_ = stored(open_.select(words.columns), "open-words")
    joined = open_.where(hyphened)
    parts = joined.select("paper_id", "language", F.col("word").alias("whole"), F.explode(F.split("word", "-")).alias("word")).distinct()
    odd = parts.where((F.length("word") >= least) & ~F.col("word").isin(COMMON_ACADEMIC)).join(allow, ["paper_id", "word"], "left_anti").join(known, ["word", "language"], "left_anti")
    odd = odd.select("paper_id", F.col("whole").alias("word")).distinct()
    return open_.where(~hyphened).unionByName(joined.join(odd, ["paper_id", "word"], "left_semi").select(words.columns)).join(allow, ["paper_id", "word"], "left_anti").select(words.columns)


def candidates(sections: DataFrame, allow: DataFrame, lexicon: DataFrame, least: int = 3, most: int = 120, languages: DataFrame | None = None) -> DataFrame:
    """paper_id, section_idx, token, sentence, location, occurrences, suggestion: of each section the unknown() words that stand most
    often, as they stand first, with the sentence of that place.

    lexicon(word): small letters, of bounded size, which AQE reads from its statistics when it picks the join. Where it has a
    language, languages(paper_id, language) tells which words count for a paper, English for those it lacks. suggestion is the word
    one edit away that the lexicon has with the highest frequency (one alike where it has none), the first in the alphabet of
    equals; null if there is none."""
    several = "language" in lexicon.columns
    lexicon = lexicon.withColumns({"language": language(F.col("language")) if several else F.lit(""), "frequency": F.col("frequency") if "frequency" in lexicon.columns else F.lit(1)})
    place = F.concat("label", F.lit(" (p. "), F.col("start_page").cast("string"), F.lit(")"))
    section = ["paper_id", "section_idx"]
    own = sections.select(*section, "text", place.alias("location"))
    if several and languages is not None:
        own = own.join(languages.select("paper_id", F.nullif(language(F.col("language")), F.lit("")).alias("_spoken")), "paper_id", "left")
        own = own.withColumn("language", F.coalesce("_spoken", F.lit("en"))).drop("_spoken")
    else:
        own = own.withColumn("language", F.lit("en" if several else ""))
    # a section's tokens are counted where it lies; a place is one number, sentence and token, so that counting needs no sort
    said = stored(own.select(*section, "language", "location", sentences(without_markup(F.col("text"))).alias("said")), "said")
    spots = said.repartition(*section).select(*section, "language", F.posexplode("said").alias("s", "sentence"))
    # explode() alone would make each array twice, once to filter empty ones out
    spots = spots.select(*section, "language", "s", F.posexplode_outer(raw_tokens(F.col("sentence"))).alias("t", "raw")).where("raw is not null")
    # equal raw tokens of a section meet before any pattern is run on them; their sentences are looked up once they are chosen
    raw = spots.groupBy(*section, "language", "raw").agg(F.count(F.lit(1)).alias("n"), F.min(F.shiftleft(F.col("s").cast("bigint"), 32) + F.col("t")).alias("at"))
    raw = raw.withColumn("token", token_of(F.col("raw"))).where(checkable(F.col("token"), F.col("raw"), least))
    words = raw.groupBy(*section, "language", F.lower("token").alias("word")).agg(F.sum("n").alias("occurrences"), F.min("at").alias("at"))
    found = stored(ranked(unknown(words, allow, lexicon, least), section, most), "unknown")
    better = suggestions(found.select("word", "language").distinct(), lexicon, "language")
    found = found.join(better, ["word", "language"], "left").join(said.drop("language"), section).withColumn("sentence", F.get("said", F.shiftright("at", 32).cast("int")))
    token = token_of(F.get(raw_tokens(F.col("sentence")), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))
    return found.select(*section, token.alias("token"), clip(F.col("sentence"), 300).alias("sentence"), "location", "occurrences", "suggestion")


def lean(word: Column) -> Column:
    """The word and what is left of it without one letter. Words one deletion, swap, replacement or insertion apart have one of
    these in common."""
    spots = F.sequence(F.lit(1), F.length(word))
    return F.array_distinct(F.concat(F.array(word), F.transform(spots, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def one_edit_apart(word: Column, other: Column) -> Column:
    """Whether one deletion, swap of neighbours, replacement or insertion of a small letter leads from word to other."""
    spots = F.sequence(F.lit(1), F.length(word) - 1)
    swapped = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word)))
    swap = (F.length(word) == F.length(other)) & (F.length(word) > 1) & (F.levenshtein(word, other) == 2) & F.exists(F.when(F.length(word) > 1, spots), lambda i: swapped(i) == other)
    mine, theirs = (F.regexp_replace(w, "[a-z]", "") for w in (word, other))
    return swap | (F.levenshtein(word, other) == 1) & ((F.length(theirs) < F.length(mine)) | (theirs == mine))


def suggestions(words: DataFrame, lexicon: DataFrame, *by: str) -> DataFrame:
    """(word, by, suggestion): of lexicon(word, by, frequency) the most frequent word one edit away, ties to the first in the alphabet.
    Words meet in an equi-join of what is left of them without one letter; words(word, by) are distinct."""
    typed = words.where(F.length("word") > 0).select(F.col("word").alias("typed"), *by, F.explode(lean(F.col("word"))).alias("lean"))
    known = lexicon.select(F.col("word").alias("known"), *by, "frequency", F.explode(lean(F.col("word"))).alias("lean"))
    near = typed.join(known, ["lean", *by]).where(F.col("typed") != F.col("known")).where(one_edit_apart(F.col("typed"), F.col("known")))
    nth = F.row_number().over(Window.partitionBy("typed", *by).orderBy(F.desc("frequency"), "known"))
    return near.withColumn("nth", nth).where("nth = 1").select(F.col("typed").alias("word"), *by, F.col("known").alias("suggestion"))
