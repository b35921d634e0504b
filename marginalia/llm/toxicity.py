"""Non-negative positive-unlabelled learning of toxicity.

Confirmed toxic documents are the positives, all other documents are unlabelled. A linear model over the words that a text
holds is trained with numpy on the non-negative risk: prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]);
where the second part turns negative, a step back on it is taken. The loss is the logistic one. As it has no bound, few positives
with words of their own can lift all scores; so in the end the model is shifted until its mean over the unlabelled texts, of which
positives are a part, is at most MOST_MEAN times the class prior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_name
from marginalia.llm.words import Cache, alone, slices, texts_of
from marginalia.storage import freed, stored

#: Words are hashed to so many features.
FEATURES = 1 << 20
#: The highest mean score over unlabelled texts that is left as it is, in class priors.
MOST_MEAN = 1.5
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_~"


def feature_of(word: bytes) -> int:
    word = word.strip(EDGES).lower()
    return xxhash.xxh3_64_intdigest(word) % FEATURES if word else -1


_FEATURES = Cache(feature_of)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _present(text: bytes) -> np.ndarray:
    _FEATURES.trim()
    found = {_FEATURES[w] for w in set(text.split())}
    found.discard(-1)
    return np.fromiter(found, np.int32, len(found))


def features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and the features present in each text, as an array of ints."""
    types = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_FEATURES)
        for b in slices(batches):
            found = [np.sort(_present(t)) for t in texts_of(b.column(b.num_columns - 1))]
            at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(at, pa.array(values, pa.int32()))], [*[f"k{i}" for i in range(len(keep))], "features"])

    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    return out.mapInArrow(run, ", ".join([*[f"k{i} {t}" for i, t in enumerate(types)], "features array<int>"])).toDF(*keep, "features")


@dataclass
class Model:
    """Weights by feature; all others weigh nothing."""

    weights: dict[int, float]
    bias: float

    def score(self, text: bytes) -> float:
        z = self.bias + sum(self.weights.get(int(f), 0.0) for f in _present(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chosen(pos: np.ndarray, unl: np.ndarray, n_pos: int, n_unl: int, least: int = 3, z: float = 4.0) -> np.ndarray:
    """Which features get a weight, from the numbers of positive and unlabelled rows that hold each: those whose rate among the
    positives differs from the unlabelled rate by z standard errors, and that at least `least` rows of one kind hold."""
    p, u = (pos + 0.5) / (n_pos + 1), (unl + 0.5) / (n_unl + 1)
    error = np.sqrt(u * (1 - u) / max(n_pos, 1) + p * (1 - p) / max(n_unl, 1) + 1e-12)
    return (np.maximum(pos, unl) >= least) & (np.abs(p - u) > z * error)


def risk(out: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Of scores before the sigmoid: the second part of the risk, which should not be negative, and the gradient to step along:
    that of the whole risk, or where the second part is negative, against that of this part alone."""
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    s = _sigmoid(out)
    # logistic loss: l(+) = -log s, l(-) = -log(1 - s); their derivatives are s - 1 and s
    negative = np.logaddexp(0, out)
    rest = negative[~positive].mean() - prior * negative[positive].mean()
    grad = np.zeros(len(out))
    if rest >= 0:
        grad[positive] = prior * (s[positive] - 1) / n_pos - prior * s[positive] / n_pos
        grad[~positive] = s[~positive] / n_unl
    else:
        grad[positive] = prior * s[positive] / n_pos
        grad[~positive] = -s[~positive] / n_unl
    return float(rest), grad


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """rows: features of each text, those without a weight left out; positive: which are confirmed."""
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    prior = min(max(prior, 1e-6), 0.999999)
    if not n_pos or not n_unl:
        return Model({}, float(np.log(prior / (1 - prior))))
    owner, flat = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
    used, column = np.unique(flat, return_inverse=True)
    w, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        _, grad = risk(bias + np.bincount(owner, w[column], len(rows)), positive, prior)
        g = np.append(np.bincount(column, grad[owner], len(used)) + ridge * w, grad.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    low, high, plain = bias - 30.0, bias, np.bincount(owner, w[column], len(rows))[~positive]
    if _sigmoid(plain + bias).mean() > MOST_MEAN * prior:
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if _sigmoid(plain + middle).mean() <= MOST_MEAN * prior else (low, middle)
        bias = low
    return Model({int(f): float(x) for f, x in zip(used, w, strict=True)}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 8_000, most_unlabelled: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 7) -> Model:
    """Trains on at most about the given numbers of documents, picked by a hash of their ids; labels and texts of held-out ids
    take no part, nor do null ids and labels other than 0 and 1. A document with several labels is toxic if one says so. The
    prior is the confirmed part of the labelled rows; without labels or texts the model scores all alike. Equal texts, and very
    long ones, count as rows like others; a word counts once in each.

    Features are counted where the rows are; only those that get a weight go to the driver, with the rows that hold them."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where(~held_out("_id") & F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1)).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    n = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic")).first()
    prior = min(max((n["toxic"] + 0.5) / (n["n"] + 1), 1e-4), 0.9)
    draw = lambda col, most, of: F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1_000_000)) < int(min(1_000_000, 1_000_000 * most / max(of, 1)))
    toxic = known.where(F.col("_toxic") == 1).where(draw(F.col("_id"), most_positive, n["toxic"])).select("_id")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the positives' ids are bounded by most_positive, so they may be broadcast
    pos = docs.join(F.broadcast(toxic), F.col("id") == F.col("_id"), "left_semi").select(F.lit(1).alias("positive"), "text")
    # the unlabelled texts stand for all texts: confirmed ones among them stay, or the risk's second part would be too small
    unl = docs.where(~held_out("id") & F.col("id").isNotNull()).where(draw(F.col("id"), most_unlabelled, docs.count() * 0.75)).select(F.lit(0).alias("positive"), "text")
    found = stored(features(pos.unionAll(unl), ["positive"]), "toxic-features")
    held = {r["positive"]: r["n"] for r in found.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    # at most FEATURES rows
    counts = found.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.sum("positive").alias("pos"), F.count(F.lit(1)).alias("n")).where("n >= 3").toArrow()
    f, p, both = (counts.column(k).to_numpy() for k in ("f", "pos", "n"))
    good = np.sort(f[chosen(p, both - p, held.get(1, 0), held.get(0, 0))]).astype(np.int32)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.intersect1d(np.asarray(x, np.int32), good, assume_unique=True) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["positive", "features"])

    got = found.mapInArrow(keep, "positive int, features array<int>").toArrow()
    freed(found)
    rows, positive = [np.asarray(x, np.int32) for x in got.column("features").to_pylist()], got.column("positive").to_numpy() == 1
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes(), bool(positive[i])))  # training must not depend on arrival
    return train([rows[i] for i in order], positive[order], prior)


def score(docs: DataFrame, model: Model, keep: list[str], cut: float = 0.3, text_col: str = "text") -> DataFrame:
    """keep with score (double, 0 to 1) and predicted (int: score >= cut). A null or empty text gets the score of a text without
    any known word. Rows are scored one by one and whole, so ids may be null or repeat and texts may be very long. An empty table
    gives an empty result. If keep has a column of a new name, the new one begins with an underscore."""
    types = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        weights = model.weights
        cache = Cache(lambda w: f if (f := feature_of(w)) in weights else -1)
        for b in slices(batches):
            z = np.full(b.num_rows, model.bias)
            for i, text in enumerate(texts_of(b.column(b.num_columns - 1))):
                cache.trim()
                found = set(map(cache.__getitem__, text.split()))
                found.discard(-1)
                z[i] += sum(weights[f] for f in sorted(found))
            p = _sigmoid(z)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= cut).astype(np.int32))], [*[f"k{i}" for i in range(len(keep))], "score", "predicted"])

    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    return out.mapInArrow(run, ", ".join([*[f"k{i} {t}" for i, t in enumerate(types)], "score double, predicted int"])).toDF(*keep, *free_name(docs.select(*keep), "score", "predicted"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
