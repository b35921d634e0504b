"""Histogram sort: rows into shards of near equal bytes, by one exchange.

The order of rows is that of a 128-bit key: a hash of the text, then a hash of the id, so that equal texts lie side by side and
are cut apart only where a boundary must fall inside a group too large for one shard's tolerance. Boundaries are found as in a
histogram sort: every round counts, exactly and across all partitions, the bytes below each candidate boundary, which are the
edges of equal slices of the key space; the next round refines only the slices that hold a wanted boundary and are still heavier
than the tolerance. What goes to the driver is one row for each slice, of which the number of shards sets the bound, not the
number of rows. Rows are numbered in runs of keys that one task can sort; what stands before a run is summed from the runs'
counts, which stay distributed. Rows move once, to their run."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import free_name
from marginalia.storage import stored

#: Bits of the key read by each round; the key has 128.
ROUND_BITS = 8
ROUNDS = 16


@dataclass
class Slice:
    """All keys that begin with digits; sums of what lies in it."""

    digits: tuple[int, ...]
    rows: int
    size: int
    shard: int = 0


@dataclass
class Splitters:
    """leaves: disjoint slices in key order that hold all rows; refined: by length, the slices that were cut further."""

    leaves: list[Slice] = field(default_factory=list)
    refined: list[list[str]] = field(default_factory=list)
    rows: int = 0


def _digit(high: Column, low: Column, level: int) -> Column:
    """Digit number level of the key, of ROUND_BITS bits; high and low are its signed halves, read as unsigned."""
    half, place = (high, level) if level < ROUNDS // 2 else (low, level - ROUNDS // 2)
    return F.shiftrightunsigned(half, 64 - ROUND_BITS * (place + 1)).bitwiseAND(F.lit((1 << ROUND_BITS) - 1)).cast("int")


def _name(digits: tuple[int, ...]) -> str:
    return ".".join(map(str, digits))


def _prefix(high: Column, low: Column, levels: int) -> Column:
    return F.concat_ws(".", *[_digit(high, low, i).cast("string") for i in range(levels)])


def find_splitters(keyed: DataFrame, n_shards: int, tolerance: float) -> Splitters:
    """keyed has high, low and size. A slice is refined while a wanted boundary lies inside it and it is heavier than tolerance
    of a shard: n_shards - 1 slices in a round at most, each of which adds 256 candidates at most."""
    high, low = F.col("high"), F.col("low")
    total, open_, leaves, refined, limit = None, None, [], [], 0.0
    for level in range(ROUNDS):
        frame = keyed
        if open_ is not None:
            frame = keyed.where(_prefix(high, low, level).isin([_name(s.digits) for s in open_]))
        counted = frame.groupBy(_prefix(high, low, level + 1).alias("at")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")).collect()
        found = [Slice(tuple(map(int, r["at"].split("."))), r["rows"], r["size"]) for r in counted]
        if total is None:
            total, rows = sum(s.size for s in found), sum(s.rows for s in found)
            limit = tolerance * total / n_shards
        leaves = sorted([*leaves, *found], key=lambda s: s.digits)
        before, open_ = 0, []
        for s in leaves:
            inside = int(before * n_shards // max(total, 1)) != int((before + s.size) * n_shards // max(total, 1))
            if len(s.digits) == level + 1 and level + 1 < ROUNDS and s.rows > 1 and inside and s.size > limit:
                open_.append(s)
            before += s.size
        if not open_:
            break
        gone = {s.digits for s in open_}
        refined.append([_name(s.digits) for s in open_])
        leaves = [s for s in leaves if s.digits not in gone]
    before = 0
    for s in leaves:
        # a slice goes to the shard in whose range its middle lies: each boundary is off by half a slice at most
        s.shard = min(n_shards - 1, int((before + s.size / 2) * n_shards // max(total, 1)))
        before += s.size
    return Splitters(leaves, refined, rows)


def _placed(rows: DataFrame, found: Splitters, high: str, low: str, at: str, shard: str) -> DataFrame:
    """rows with their shard."""
    # one row for each slice, of which there are 256 for each refined one at most: the number of shards bounds them
    table = rows.sparkSession.createDataFrame([(_name(s.digits), s.shard) for s in found.leaves], f"_slice string, {shard} int")
    slice_ = _prefix(F.col(high), F.col(low), len(found.refined) + 1)
    for depth in range(len(found.refined), 0, -1):
        own = _prefix(F.col(high), F.col(low), depth)
        slice_ = F.when(~own.isin(found.refined[depth - 1]), own).otherwise(slice_)
    return rows.withColumn(at, slice_).join(F.broadcast(table), F.col(at) == F.col("_slice")).drop(at, "_slice")


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, tolerance: float = 0.002, rows_a_task: int = 20_000) -> DataFrame:
    """docs with two more columns: shard (int, 0 to n_shards - 1) and slot (long, from 0 without gaps in each shard).

    size_col names a long column of sizes; without it the size is the text's bytes in UTF-8 plus 16. The shards' sums of sizes
    are as equal as whole rows permit, within tolerance of a shard or the largest row. A run of keys that one task numbers has
    about rows_a_task rows; a text of many more copies is cut into runs by the hash of the id, so that only rows equal in both
    stay together.

    Null texts have no bytes, and null ids hash as a value of their own; repeated rows each get a slot. An empty table gives an
    empty result. Names that docs already has are kept; the new columns then begin with an underscore."""
    high, low, size, at, shard, slot, run, text_run, id_run = free_name(docs, "key_high", "key_low", "key_size", "key_slice", "shard", "slot", "key_run", "text_run", "id_run")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.withColumns({high: F.xxhash64(text), low: F.xxhash64(F.lit(7), F.col(id_col)), size: F.col(size_col) if size_col else F.octet_length(text).cast("long") + 16})
    keyed = stored(base.select(high, low, size), "shard-keys")
    found = find_splitters(keyed.toDF("high", "low", "size"), n_shards, tolerance)
    bits = max(0, math.ceil(math.log2(max(1, found.rows / rows_a_task))))
    first = F.shiftrightunsigned(F.col(high), 64 - bits) if bits else F.lit(0).cast("long")
    crowded = keyed.groupBy(first.alias("_run")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * rows_a_task)
    # as many rows as crowded runs, at most one for each 4 * rows_a_task rows
    crowded = stored(crowded.select("_run", F.ceil(F.log2(F.col("n") / rows_a_task)).cast("int").alias("_bits")), "crowded")

    def runs(rows: DataFrame) -> DataFrame:
        rows = _placed(rows, found, high, low, at, shard).withColumn(run, first).join(crowded, F.col(run) == F.col("_run"), "left")
        return rows.withColumns({text_run: F.when(F.col("_bits").isNotNull(), F.col(high)).otherwise(0), id_run: F.when(F.col("_bits").isNotNull(), F.expr(f"shiftrightunsigned({low}, 64 - _bits)")).otherwise(0)}).drop("_run", "_bits")

    names = [shard, run, text_run, id_run]
    sums = runs(keyed).groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias("_n"))
    sums = stored(sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("_0").orderBy("_1", "_2", "_3")) - F.col("_n")).drop("_n"), "runs")
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & (F.col(c) == F.col(f"_{i}"))
    numbered = runs(base).join(sums, same)
    order = Window.partitionBy(*names).orderBy(high, low, id_col, size)
    out = numbered.withColumn(slot, F.row_number().over(order).cast("long") - 1 + F.col("_before"))
    return out.select(*docs.columns, shard, slot)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumns({"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    out = shard_documents(docs, 40, size_col="size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
