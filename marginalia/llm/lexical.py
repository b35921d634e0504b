"""Ranked lexical search: every query against all documents, by integer scores of the terms that they share.

Documents are read once. Each task keeps, of its documents, how often the terms of the queries stand in them, in order of id. Sums
over all documents give the weights. Then each task goes through its postings in windows of WINDOW documents: a term's postings in
the window become what it adds to each document's score, once for all queries; each query adds its terms up in one array that fits
the cache, with a bitset that tells which documents were met, and harvests that array into the heap of its best documents. Only
heaps leave the tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.words import alone, slices, texts_of
from marginalia.storage import freed, stored

#: What a term is made of, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, TERM_SCALE, LENGTH_SHARE, SATURATION = 1000, 1_000_000_000, 50, 20
#: Documents of a window: an array of scores takes 64 KB.
WINDOW = 8192
#: Terms of queries that one reading of the documents serves, about. More queries are taken in several blocks.
BLOCK_TERMS = 200_000
#: Parts in which the heaps of the tasks are merged first.
SALTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes as parts of terms, small letters for large ones, and all others as blanks; a byte over 127 belongs to a term.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def postings(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """id, n, terms (places in known) and tf of each row of docs(id, text) with a term, whether known or not."""
    number = {t: i for i, t in enumerate(known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for b in slices(batches):
            keep, n, found, times, ends = [], [], [], [], [0]
            for i, text in enumerate(texts_of(b.column(1))):
                if words := terms(text):
                    own = np.fromiter((k for k in map(number.get, words) if k is not None), np.int32)
                    own, often = np.unique(own, return_counts=True)
                    keep.append(i)
                    n.append(len(words))
                    found.append(own)
                    times.append(often)
                    ends.append(ends[-1] + len(own))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t))) for x, t in ((found, np.int32), (times, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, tf array<long>")


class _Heap:
    """The best documents of a query: score, whether the id is null, id; sorted, the best first."""

    def __init__(self, most: int):
        self.most, self.rows = most, np.zeros((3, 0), np.int64)

    def least(self) -> int:
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.most else 1

    def harvest(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([score, null, ids])], 1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.most]]


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - rows)
            held.append(part)
            rows, b = rows + part.num_rows, b.slice(part.num_rows)
            if rows == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def best(posted: DataFrame, queries: list[list[int]], weights: list[int], n_docs: int, n_terms: int, most: int) -> DataFrame:
    """query (its place), id, score: of each task's rows the best ones for each query."""

    def scored(window: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
        """Of each term: what it adds, to which slots (None: to all, in their order), and the bitset of its slots."""
        lists = [window.column(k).chunk(0) if window.column(k).num_chunks else pa.array([], window.schema.field(k).type) for k in ("terms", "tf")]
        size = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term, tf = (x.flatten().to_numpy() for x in lists)
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * window.column("n").to_numpy() * n_docs) // n_terms
        slot = np.repeat(np.arange(len(size)), size)
        adds = np.asarray(weights, np.int64)[term] * ((TERM_SCALE * tf) // (SCALE * tf + SATURATION * m[slot]))
        order = np.argsort(term, kind="stable")
        term, slot, adds = term[order], slot[order], adds[order]
        edge = np.flatnonzero(np.diff(term, prepend=-1))
        out = {}
        for t, a, z in zip(term[edge].tolist(), edge.tolist(), np.append(edge, len(term))[1:].tolist(), strict=True):
            met = np.zeros(len(size), bool)
            met[slot[a:z]] = True
            if 4 * (z - a) > len(size):
                dense = np.zeros(len(size), np.int64)
                dense[slot[a:z]] = adds[a:z]
                out[t] = dense, None, np.packbits(met)
            else:
                out[t] = adds[a:z], slot[a:z], np.packbits(met)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [_Heap(most) for _ in queries]
        for window in _windows(batches, WINDOW):
            found, rows = scored(window), window.num_rows
            ids = window.column("id").combine_chunks()
            null, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            total, met = np.empty(rows, np.int64), np.empty(-(-rows // 8), np.uint8)
            for own, heap in zip(queries, heaps, strict=True):
                total[:], met[:] = 0, 0
                for adds, slots, bits in map(found.__getitem__, filter(found.__contains__, own)):
                    if slots is None:
                        total += adds
                    else:
                        total[slots] += adds
                    met |= bits
                at = np.flatnonzero(np.unpackbits(met, count=rows))
                at = at[total[at] >= heap.least()]
                if len(at):
                    heap.harvest(total[at], null[at], ids[at])
        for q, heap in enumerate(heaps):
            score, null, ids = heap.rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q), pa.int32()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], ["query", "id", "score"])

    return posted.select("id", "n", "terms", "tf").mapInArrow(run, "query int, id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    found = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(TERM), 0)
    return items.select("item", F.explode(F.array_distinct(found)).alias("term")).groupBy("item").agg(F.collect_set("term").alias("terms"))


def search(docs: DataFrame, items: DataFrame, most: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_col, rank, id_col, score: of each item the `most` documents with the highest scores above 0, equal scores by id.

    Ids of documents are whole numbers; rows that repeat one are documents of their own, and a null id comes after all others.
    Rows of items that repeat an id are one item with the terms of all; a null id is an item as well. Texts that are null, empty or
    without terms are in no result. Texts are read whole. Empty tables give an empty result. Other columns play no part; if a
    column of the result would come twice, the later one begins with an underscore.

    Documents are read once for every BLOCK_TERMS terms of items or so. What the driver and each task hold follows from such a
    block: its terms, their weights and the heaps."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = stored(_item_terms(items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))), "items")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    kind = asked.schema["item"].dataType
    parts = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        known = sorted({t for r in own for t in r["terms"]})
        number = {t: i for i, t in enumerate(known)}
        posted = stored(postings(docs, [t.encode() for t in known]).sortWithinPartitions("id"), "postings")
        n_docs, n_terms = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["t"]: r["df"] for r in posted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
        weights = [math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(known))]
        found = best(posted, [sorted(number[t] for t in r["terms"]) for r in own], weights, n_docs, max(1, n_terms), most)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(own)], f"_q int, item {kind.simpleString()}")
        # names has a row for each item of the block, BLOCK_TERMS at most
        kept = stored(found.join(F.broadcast(names), F.col("query") == F.col("_q")).select("item", "id", "score"), "heaps")
        freed(posted)
        parts.append(kept)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    dealt = out.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= most)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)
    names = [item_col]
    for name in ("rank", id_col, "score"):
        while name.lower() in {x.lower() for x in names}:
            name = "_" + name
        names.append(name)
    return last.select("item", F.col("rank").cast("int").alias("rank"), "id", "score").toDF(*names)


def op13(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
