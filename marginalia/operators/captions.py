"""Captions of figures and tables, and whether the text mentions them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPTION = r"(?i)^(Figure|Fig\.?|Table|Chart|Algorithm|Listing)\s*(\d+|[IVXLC]+)(\s*[.:\-–]\s*|\s+)(.*)$"
MENTION = r"(?i)\b(Figure|Fig\.?|Table|Chart|Algorithm|Listing)s?\.?\s*(\d+|[IVXLC]+)\b"


def _kind(raw: Column) -> Column:
    low = F.regexp_replace(F.lower(raw), r"\.+$", "")
    return F.when(low.isin("figure", "fig"), "figure").when(low == "table", "table").otherwise("other")


def _id(kind: Column, number: Column) -> Column:
    return F.concat(F.initcap(kind), F.lit(" "), F.upper(number))


def caption_of(text: Column) -> Column:
    """A struct (kind, id, caption) where a line is a caption: ten characters or more, after a separator or in upper case."""
    kind, caption = _kind(F.regexp_extract(text, CAPTION, 1)), F.trim(F.regexp_extract(text, CAPTION, 4))
    sure = (F.trim(F.regexp_extract(text, CAPTION, 3)) != "") | F.substring(caption, 1, 1).rlike(r"^\p{Lu}")
    return F.when(text.rlike(CAPTION) & (F.length(caption) >= 10) & sure, F.struct(kind.alias("kind"), _id(kind, F.regexp_extract(text, CAPTION, 2)).alias("id"), caption.alias("caption")))


def captions(lines: DataFrame) -> DataFrame:
    """The first caption of each figure and table: paper_id, kind, id, caption, page."""
    found = lines.withColumn("c", caption_of(F.col("text"))).where("c is not null and c.kind <> 'other'")
    first = found.groupBy("paper_id", F.col("c.id").alias("id")).agg(F.min(F.struct("line_no", "page", "c")).alias("m"))
    return first.select("paper_id", "m.c.kind", "id", "m.c.caption", "m.page")


def mentions(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, id): what section lines mention, caption lines and references left out."""
    own = lines.where(caption_of(F.col("text")).isNotNull()).select("paper_id", F.col("text").alias("line")).distinct()
    body = sections.where("kind <> 'references'").select("paper_id", F.explode(F.split("text", "\n")).alias("line"))
    body = body.where(F.col("line").rlike(MENTION)).join(own, ["paper_id", "line"], "left_anti")
    hit = body.select("paper_id", F.explode(F.regexp_extract_all("line", F.lit(MENTION), 0)).alias("m"))
    kind = _kind(F.regexp_extract("m", MENTION, 1))
    return hit.select("paper_id", kind.alias("kind"), _id(kind, F.regexp_extract("m", MENTION, 2)).alias("id")).where("kind <> 'other'").select("paper_id", "id").distinct()


def with_mentions(found: DataFrame, named: DataFrame) -> DataFrame:
    flag = named.withColumn("referenced_in_text", F.lit(True))
    return found.join(flag, ["paper_id", "id"], "left").select("paper_id", "kind", "id", "caption", "page", F.coalesce("referenced_in_text", F.lit(False)).alias("referenced_in_text"))


def order_key(id_: Column) -> list[Column]:
    tail = F.element_at(F.split(id_, " "), -1)
    number = tail.try_cast("int")
    return [F.coalesce(number, F.lit(1_000_000)), F.when(number.isNull(), tail).otherwise("")]


def table_windows(lines: DataFrame, found: DataFrame, window: int = 40) -> DataFrame:
    """(paper_id, id, text): lines around the first line that begins with a table's id or holds the head of its caption."""
    t = found.where("kind = 'table'").select("paper_id", "id", "caption")
    hit = lines.join(t, "paper_id").where(F.col("text").startswith(F.col("id")) | F.col("text").contains(F.substring("caption", 1, 40)))
    at = hit.groupBy("paper_id", "id").agg(F.min("line_no").alias("at"))
    # lines are dealt to the windows by joins on equal keys: a window spans window + 2 numbers
    spread = at.select("paper_id", "id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - 2), F.col("at") + window - 1)).alias("line_no"))
    block = spread.join(lines.select("paper_id", "line_no", "text"), ["paper_id", "line_no"])
    return block.groupBy("paper_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def per_section(found: DataFrame, sections: DataFrame) -> DataFrame:
    """Captions on the pages of each section."""
    s = sections.select("paper_id", "section_idx", "start_page", "end_page")
    return s.join(found, "paper_id").where(F.col("page").between(F.col("start_page"), F.col("end_page"))).select("paper_id", "section_idx", "kind", "id", "caption", "page")


def in_order(found: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy("kind", *order_key(F.col("id"))))
    return found.withColumn("nth", nth.cast("bigint"))
