"""Minimum bin slack packing of token sequences into windows of a fixed capacity.

A document longer than the capacity gives full windows and a remainder. All remainders are seen as one histogram of lengths,
which has capacity rows at most however many documents there are. The packer takes one window after the other: a bitset
dynamic programme over the lengths still there finds the largest total up to the capacity, backtracking gives how many of each
length make it up, and that multiset is taken as often as the histogram allows. Rows then find their window from their rank
among the rows of their length, by a join with the table of multisets."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import free_name
from marginalia.llm.words import Cache, alone, slices, texts_of
from marginalia.storage import stored

#: Rows of one length are ranked in hash buckets of about so many, then offset: no task ranks all rows of a common length.
BUCKET_ROWS = 2_000


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths with the largest total up to capacity, as length: times.

    Bit s of a reached set is on if some choice among the lengths seen so far totals s. Lengths are added from the longest to
    the shortest, each in chunks of 1, 2, 4, ... copies, and the walk back takes a chunk only where the total was not reached
    without it, so that ties use the longest pieces."""
    full = (1 << (capacity + 1)) - 1
    reached, steps = 1, []
    for length in sorted((k for k, n in counts.items() if n > 0 and k <= capacity), reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(chunk, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & full
            left -= take
            chunk *= 2
        if reached >> capacity & 1:
            break
    total, out = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Multisets and how many windows each fills, until no length is left. A window begins with the longest length there is, so
    that the small ones are not spent before the large ones; the subset-sum fills the rest. Every entry uses up one length or
    leaves fewer of it than a window takes, so that entries grow with the capacity and not with the rows."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        seed = max(left)
        own = fill(left | {seed: left[seed] - 1}, capacity - seed)
        own[seed] = own.get(seed, 0) + 1
        times = min(left[k] // m for k, m in own.items())
        out.append((own, times))
        for k, m in own.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return out


#: Letters whose lower case is one letter each and that no normalisation changes; a chunk of them, digits and signs but no
#: apostrophe falls into runs of letters, single digits and runs of signs, each a token run of its own.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[!-&(-~{_LETTERS}]+")
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")


class _Chunks(Cache):
    """White-space-separated chunks to their ids, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self._ids, 250_000)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model if self._is_plain() else None

    def _is_plain(self) -> bool:
        """Whether the vocabulary lower-cases, cuts runs as _RUNS does and reads bytes as letters."""
        form = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        cut = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["invert"] and cut[0]["pattern"].get("Regex", "").endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
            and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"] and not form["model"]["dropout"]
        )

    def _ids(self, chunk: bytes) -> bytes:
        if self.model is not None and chunk.isalpha():
            low = chunk.lower()
            return self._run(low.decode()) if low == chunk else self[low]
        text = chunk.decode()
        if self.model is None or not _PLAIN.fullmatch(text) or "<|" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        low = text.lower()
        runs = _RUNS.findall(low)
        if len(runs) > 1:
            return b"".join([self[r.encode()] for r in runs])
        return self._run(low if low.isascii() else low.encode().decode("latin-1").translate(_AS_LETTERS))

    def _run(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


#: The letters that stand for bytes in a vocabulary of bytes: those that print stand for themselves, the others follow from 256.
_AS_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


@functools.cache
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def tokenize(docs: DataFrame, path: str, keep: list[str], capacity: int, end_id: int = 2, text_col: str = "text") -> DataFrame:
    """keep and the pieces of each document: start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its white-space-separated chunks;
    each distinct chunk is tokenized once for many documents. A null text is empty: its one piece holds end_id alone."""
    schema = docs.select(*keep).schema
    types = [f.dataType.simpleString() for f in schema]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _chunks(path)
        alone(cache)
        for b in slices(batches, 256):
            row, start, length, ids, total = [], [], [], [], []
            for i, text in enumerate(texts_of(b.column(b.num_columns - 1))):
                cache.trim()
                all_ids = b"".join(map(cache.__getitem__, text.split())) + end
                n = len(all_ids) // 4
                for at in range(0, n, capacity):
                    row.append(i)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    ids.append(all_ids[4 * at : 4 * (at + capacity)])
                    total.append(n)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:-1]], pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], [*[f"k{i}" for i in range(len(keep))], "start", "length", "ids", "doc_tokens"])

    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    out = out.mapInArrow(run, ", ".join([*[f"k{i} {t}" for i, t in enumerate(types)], "start long, length long, ids binary, doc_tokens long"]))
    return out.toDF(*schema.names, "start", "length", "ids", "doc_tokens")


def _entries(counts: dict[int, int], capacity: int) -> tuple[list[tuple], list[tuple]]:
    """The plan as two small tables, whose sizes follow from the capacity: for each length (length, parts, width), and for each
    length and multiple of width that an entry of the plan covers (length, cell, from, to, each, first sequence, offset)."""
    own, first = {k: [] for k in counts}, 0
    taken = dict.fromkeys(counts, 0)
    for multiset, times in plan(counts, capacity):
        offset = 0
        for length in sorted(multiset, reverse=True):
            to = taken[length] + multiset[length] * times
            own[length].append((taken[length], to, multiset[length], first, offset))
            taken[length] = to
            offset += multiset[length] * length
        first += times
    lengths, cells = [], []
    for length, found in own.items():
        # as many cells as entries: together they are met twice for each entry at most
        width = -(-counts[length] // len(found))
        lengths.append((length, max(1, -(-counts[length] // BUCKET_ROWS)), width))
        cells += [(length, cell, *e) for e in found for cell in range(e[0] // width, (e[1] - 1) // width + 1)]
    return lengths, cells


def assign(pieces: DataFrame, capacity: int, order: list[Column]) -> DataFrame:
    """pieces (with a column length, from 1 to capacity) with sequence_id and offset, both long.

    order: columns that tell pieces apart; pieces equal in all of them may change places. Other columns are carried along, and
    names that clash are no error. pieces is read twice: pass a stored table. An empty table gives an empty result."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths, cells = _entries(counts, capacity)
    # both tables follow from the capacity (one row, and a few, for each of its lengths), so they may be broadcast
    lengths = spark.createDataFrame(lengths, "_length long, _parts long, _width long")
    cells = spark.createDataFrame(cells, "_len long, _cell long, _from long, _to long, _each long, _first long, _offset long")
    parts, width, bucket, rank, before = free_name(pieces, "parts", "width", "bucket", "rank", "before")
    named = lengths.select(F.col("_length"), F.col("_parts").alias(parts), F.col("_width").alias(width))
    dealt = pieces.join(F.broadcast(named), F.col("length") == F.col("_length")).drop("_length").withColumn(bucket, F.pmod(F.xxhash64(*order), F.col(parts)))
    sums = dealt.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select(F.col("length").alias("_l"), F.col(bucket).alias("_b"), (F.sum("_n").over(Window.partitionBy("length").orderBy(bucket)) - F.col("_n")).alias(before))
    # sums has one row for each BUCKET_ROWS rows, and one for each length
    placed = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("length", bucket).orderBy(*order)) - 1)
    placed = placed.join(sums, (F.col("length") == F.col("_l")) & (F.col(bucket) == F.col("_b"))).withColumn(rank, F.col(rank) + F.col(before))
    found = placed.join(F.broadcast(cells), (F.col("length") == F.col("_len")) & (F.floor(F.col(rank) / F.col(width)) == F.col("_cell")) & (F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_to")))
    nth = F.col(rank) - F.col("_from")
    return found.select(*pieces.columns, (F.col("_first") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_offset") + nth % F.col("_each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids: id_col, start, length, ids, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of end_id alone; ids may be null or repeat, each row is packed on its own; very long
    texts give as many full windows as they fill. An empty table gives an empty result. Other columns of docs play no part; if
    id_col has the name of a new column, that one begins with an underscore."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = stored(tokenize(own, path, ["id"], capacity, end_id), "pieces")
    out = assign(pieces, capacity, [F.col("id"), F.col("start"), F.crc32("ids")])
    return out.toDF(id_col, *free_name(docs.select(id_col), *out.columns[1:]))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_digest(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """As pack(), with a checksum in place of the ids, so that they are neither stored nor moved."""
    pieces = tokenize(docs.select("doc_id", "text"), vocabulary(), ["doc_id"], capacity)
    light = stored(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return assign(light, capacity, [F.col("doc_id"), F.col("start"), F.col("ids_crc32")])


def op1(spark, sf_dir: str) -> DataFrame:
    return pack_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
