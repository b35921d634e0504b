"""Word lists with affix rules: all forms of the words of a list, as a table, from the two files that spelling dictionaries come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "kind string, flag string, crosses boolean, strip string, add string, condition string"


def rules(spark: SparkSession, aff: str) -> DataFrame:
    """The prefix and suffix rules of an affix file's text, as RULES. A file has some hundreds at most."""
    crosses, rows = {}, []
    for line in aff.splitlines():
        parts = line.split()
        if len(parts) < 4 or parts[0] not in ("PFX", "SFX"):
            continue
        kind, flag = parts[:2]
        if (kind, flag) not in crosses:
            # the first line of a flag says whether it goes with the other kind, and how many rules follow
            crosses[kind, flag] = parts[2] == "Y"
            continue
        strip, add = ("" if x == "0" else x for x in (parts[2], parts[3].split("/")[0]))
        condition = parts[4] if len(parts) > 4 else "."
        own = "" if condition == "." else condition
        rows.append((kind, flag, crosses[kind, flag], strip, add, f"^(?:{own})" if kind == "PFX" else f"(?:{own})$"))
    return spark.createDataFrame(rows, RULES)


def _with(words: DataFrame, table: DataFrame, kind: str) -> DataFrame:
    """words(word, flags) with each rule of one kind that fits: word, flags, crosses and the form."""
    own = table.where(F.col("kind") == kind).select("flag", "crosses", "strip", "add", "condition")
    rows = words.withColumn("flag", F.explode("flags")).join(own, "flag")
    strip, word = F.col("strip"), F.col("word")
    kept = F.length(word) - F.length(strip)
    if kind == "SFX":
        fits, form = word.endswith(strip), F.concat(F.substring(word, F.lit(1), kept), F.col("add"))
    else:
        fits, form = word.startswith(strip), F.concat(F.col("add"), F.substring(word, F.length(strip) + 1, F.length(word)))
    return rows.where(fits & F.expr("word rlike condition") & (kept > 0)).withColumn("form", form)


def entries(text: Column) -> Column:
    """Of the text of a word list an array of (word, flags): one word a line, behind a slash a letter for each flag. The first line
    is a number."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+")[0]), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$"))
    return F.transform(lines, lambda x: F.struct(F.split(x, "/")[0].alias("word"), F.filter(F.split(F.coalesce(F.get(F.split(x, "/"), 1), F.lit("")), ""), lambda f: f != "").alias("flags")))


def forms(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word): the small-letter forms of words(word, flags): each word, with a suffix, with a prefix, and with both where both rules
    go with the other kind. Rules meet words by their flag."""
    words = words.select("word", "flags")
    suffixed = _with(words, table, "SFX")
    # a suffixed form goes on to prefixes that its word has
    both = _with(suffixed.where("crosses").select(F.col("form").alias("word"), "flags"), table.where("crosses"), "PFX")
    every = words.select("word").unionAll(suffixed.select("form")).unionAll(_with(words, table, "PFX").select("form")).unionAll(both.select("form"))
    return every.select(F.lower("word").alias("word")).distinct()


def lexicon(spark: SparkSession, aff_path: str, dic_path: str) -> DataFrame:
    """(word) of a dictionary's two files."""
    whole = lambda path: spark.read.text(path, wholetext=True)
    aff = whole(aff_path).first()["value"]
    return forms(whole(dic_path).select(F.explode(entries(F.col("value"))).alias("e")).select("e.*"), rules(spark, aff))
