"""Quality rules joined by an isolation forest.

Every text gets a few counts (words, symbols, repeated lines, repeated three-word windows). An isolation forest of random splits
over ratios of these counts gives each document its mean path length: a short path marks an odd document. The forest grows on
labelled rows marked good, split over the range of all labelled rows, and the threshold is taken where all labelled rows of both
kinds are told apart best while few good ones are lost."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_name
from marginalia.llm.words import Cache, alone, numbers, slices, texts_of
from marginalia.storage import freed, stored

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_distinct_words"]
BASE = COUNTS[:5]

_KIND = np.ones(256, np.uint8)
_KIND[0x80:0xC0] = 0
_KIND[[0x20, *range(0x09, 0x0E)]] = 2
_KIND[list(SYMBOLS)] = 3
_KIND[list(b"0123456789")] = 4
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 5
#: Word numbers stay below this, so that three of them fit into 64 bits.
_FIT = 1 << 21


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that are found twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if int(ids.max()) < _FIT:
        keys = (ids[:-2] << np.int64(42)) | (ids[1:-1] << np.int64(21)) | ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n + 2, bool)
    for k in range(3):
        inside[k : n + k] |= twice
    return int(inside.sum())


def counts_of(text: bytes, cache: Cache) -> list[int]:
    """The numbers named by COUNTS."""
    words = text.split()
    cache.trim()
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6)
    ids = numbers(words, cache, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [len(words), int(kinds[1:].sum() - kinds[2]), int(kinds[3]), len(lines) - len(set(lines)), repeated_words(ids), len(lines), int(kinds[4]), int(kinds[5]), len(set(words))]


class _Counter(Cache):
    """Numbers words as they come; forgets all of them at once, so that no number is given twice."""

    def __init__(self):
        super().__init__(lambda _: len(self))

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


_WORDS = _Counter()


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios of COUNTS, one row for each document."""
    c = counts.astype(float)
    words, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
    return np.stack([np.log1p(c[:, 0]), c[:, 1] / words, np.sqrt(c[:, 2] / chars), np.sqrt(c[:, 3] / np.maximum(c[:, 5], 1)), np.sqrt(c[:, 4] / words), c[:, 6] / chars, c[:, 7] / chars, c[:, 8] / words ** 0.9], 1)


@dataclass
class Forest:
    """Trees as arrays [tree, node]: split feature (-1: leaf), threshold, first child; at leaves the path length."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    path: np.ndarray
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / usual path length): near 1 for odd rows, below 0.5 for common ones."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][node]
                if (f < 0).all():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.threshold[t][node]
                node = np.where(f < 0, node, self.child[t][node] + right)
            total += self.path[t][node]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def _usual_path(n: int) -> float:
    """The mean path of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, box: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 7) -> Forest:
    """Each tree splits its own sample of the rows x at random features and thresholds until depth log2(rows). Thresholds are
    drawn from the node's part of box (lowest and highest value of each feature, two rows), which may reach far beyond x: what
    lies where x has no rows gets a short path."""
    random = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    size = 2 ** (depth + 1)
    out = Forest(np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), np.int64), np.zeros((trees, size)), max(_usual_path(rows), 1.0))
    for t in range(trees):
        todo, free = [(0, random.choice(len(x), rows, replace=False), box[0], box[1], 0)], 1
        while todo:
            node, own, low, high, level = todo.pop()
            wide = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(wide):
                out.path[t, node] = level + _usual_path(len(own))
                continue
            f = random.choice(wide)
            cut = random.uniform(low[f], high[f])
            right = x[own, f] >= cut
            out.feature[t, node], out.threshold[t, node], out.child[t, node] = f, cut, free
            left_high, right_low = high.copy(), low.copy()
            left_high[f] = right_low[f] = cut
            todo += [(free, own[~right], low, left_high, level + 1), (free + 1, own[right], right_low, high, level + 1)]
            free += 2
    return out


@dataclass
class Judge:
    forest: Forest
    threshold: float


def calibrate(scores: np.ndarray, good: np.ndarray, lost: float) -> float:
    """The threshold with the most bad rows above it less good ones, among those with at most a part lost of the good above."""
    cuts, at = np.unique(scores, return_inverse=True)
    n = [np.bincount(at[own], minlength=len(cuts)) for own in (good, ~good)]
    return threshold(cuts, *n, lost)


def threshold(cuts: np.ndarray, good: np.ndarray, bad: np.ndarray, lost: float, step: float = 0.0) -> float:
    """calibrate() from how many good and bad rows score above the cut before, by step at most, and up to each of the rising cuts."""
    if not good.sum() or not bad.sum():
        return float("inf")
    above = lambda n: 1 - np.cumsum(n) / n.sum()
    caught, wrong = above(bad), above(good)
    gain = np.where(wrong <= lost, caught - wrong, -1.0)
    best = int(gain.argmax())
    return float((cuts[best] + max(cuts[best], cuts[min(best + 1, len(cuts) - 1)] - step)) / 2) if gain[best] > 0 else float("inf")


def _base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])


def with_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and COUNTS of each row; what is not in keep never leaves the scan."""
    schema = docs.select(*keep).schema
    types = [docs.schema[c].dataType.simpleString() for c in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_WORDS)
        for b in slices(batches):
            found = np.array([counts_of(t, _WORDS) for t in texts_of(b.column(b.num_columns - 1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(found[:, k]) for k in range(len(COUNTS))]], [*[f"k{i}" for i in range(len(keep))], *COUNTS])

    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    out = out.mapInArrow(count, ", ".join([*[f"k{i} {t}" for i, t in enumerate(types)], *[f"{c} long" for c in COUNTS]]))
    return out.toDF(*schema.names, *COUNTS)


#: Trees of a forest, rows that each draws, and cells into which scores are counted.
TREES, TREE_ROWS, CELLS = 100, 256, 1 << 14


def _each(counted: DataFrame, keep: list[str], kind: str, make) -> DataFrame:
    """keep and the columns of kind that make() gives for the COUNTS of each row, a list of arrays."""
    names = [x.split()[0] for x in kind.split(", ")]
    types = [f"k{i} {counted.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            c = np.stack([b.column(len(keep) + k).to_numpy(zero_copy_only=False) for k in range(len(COUNTS))], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, make(c))], [*[f"k{i}" for i in range(len(keep))], *names])

    out = counted.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *COUNTS).mapInArrow(run, ", ".join([*types, kind]))
    return out.toDF(*keep, *names)


def fitted(counted: DataFrame, labels: DataFrame, lost: float = 0.003, id_col: str = "doc_id", label_col: str = "quality", seed: int = 7) -> Judge:
    """fit() for with_counts() of documents, kept with id_col."""
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_good")).where("_id is not null and _good in (0, 1)").groupBy("_id").agg(F.min("_good").alias("_good"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(counted.join(labels, F.col(id_col) == F.col("_id")).where(~failed).select("_id", "_good", *COUNTS), "labelled")
    # what trees draw from: as many rows of all good ones as all trees take, by a hash
    good, pick = rows.where("_good = 1"), F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1_000_000))
    share = 1.2 * TREES * TREE_ROWS / max(good.count(), 1)
    pool = good.where(pick < math.ceil(1_000_000 * min(1.0, share))).orderBy(pick, "_id", *COUNTS).limit(TREES * TREE_ROWS).select(*COUNTS).toPandas().to_numpy(np.int64)
    if len(pool) < 16:
        freed(rows)
        return Judge(grow(np.zeros((2, 8)), np.zeros((2, 8)), 1, 2), float("inf"))
    names = [f"x{k}" for k in range(8)]
    box = _each(rows, [], ", ".join(f"{x} double" for x in names), lambda c: list(features(c).T)).agg(*[F.min(x) for x in names], *[F.max(x) for x in names]).first()
    # the forest must not depend on the order in which rows arrive
    forest = grow(features(pool[np.lexsort(pool.T)]), np.array(box).reshape(2, 8), TREES, TREE_ROWS, seed=seed)
    cells = _each(rows, ["_good"], "cell int", lambda c: [np.ceil(forest.score(features(c)) * CELLS).astype(np.int32)])
    found = cells.groupBy("cell").agg(F.count_if(F.col("_good") == 1).alias("good"), F.count_if(F.col("_good") == 0).alias("bad")).orderBy("cell").toPandas()
    freed(rows)
    return Judge(forest, threshold(found["cell"].to_numpy() / CELLS, found["good"].to_numpy(), found["bad"].to_numpy(), lost, 1 / CELLS))


def fit(docs: DataFrame, labels: DataFrame, lost: float = 0.003, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 7) -> Judge:
    """Forest and threshold from all labelled rows (label 1: good, 0: bad): the range in which trees split and the threshold, to one
    of CELLS parts of a score, are taken over all of them; each tree draws its TREE_ROWS from good rows picked evenly by a hash. A
    document with several labels is bad if one says so; null ids and other labels take no part. The forest grows on good rows that
    pass the base rules; with fewer than 16 of them, it rejects nothing. Texts are counted whole, however long."""
    counted = stored(with_counts(docs.select(id_col, text_col), [id_col], text_col), "counts")
    model = fitted(counted, labels, lost, id_col, label_col, seed)
    freed(counted)
    return model


def judge(docs: DataFrame, model: Judge, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and COUNTS with base_failed, score (double) and kept. A null or empty text has no words and fails the base rules;
    ids may be null or repeat, each row is judged by its own text, read whole. An empty table gives an empty result. If keep has
    a column of a new name, the new one begins with an underscore."""
    schema = docs.select(*keep).schema
    types = [f.dataType.simpleString() for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_WORDS)
        for b in slices(batches):
            found = np.array([counts_of(t, _WORDS) for t in texts_of(b.column(b.num_columns - 1))], np.int64).reshape(-1, len(COUNTS))
            score = model.forest.score(features(found))
            failed = _base_failed(found)
            own = [pa.array(found[:, k]) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own, pa.array(failed), pa.array(score), pa.array(~failed & (score <= model.threshold))], [*[f"k{i}" for i in range(len(keep))], *COUNTS, "base_failed", "score", "kept"])

    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    out = out.mapInArrow(run, ", ".join([*[f"k{i} {t}" for i, t in enumerate(types)], *[f"{c} long" for c in COUNTS], "base_failed boolean, score double, kept boolean"]))
    return out.toDF(*schema.names, *free_name(docs.select(*keep), *COUNTS, "base_failed", "score", "kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the base rules and the forest keep. Columns may have any name."""
    model = fit(docs, labels, text_col=text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    return judge(docs.toDF(*names), model, names, text_col=names[docs.columns.index(text_col)]).where("kept").select(*names).toDF(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = stored(with_counts(docs, ["doc_id"]), "counts")
    model = fitted(counted, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def verdict(c: np.ndarray) -> list[np.ndarray]:
        score, failed = model.forest.score(features(c)), _base_failed(c)
        return [failed, ~failed & (score <= model.threshold), score]

    return _each(counted, ["doc_id", *BASE], "base_failed boolean, kept boolean, score double", verdict)
