"""Maximum inner product search with score-aware anisotropic product quantisation and four-bit table scans.

Vectors are cut into subspaces of two or more dimensions, each coded by one of 16 codewords. Codes and codewords lower a loss
that weighs the part of the residual parallel to the vector more than the rest, as that part shifts the large scores. A query
turns into a table of 16 partial scores for each subspace; two subspaces are read as one byte of code. Rows are coded once, and
meet the queries block by block. What a table score can be off by follows from the row's residuals: each row of a block that may
so be among the nearest is scored again in double precision, be they few or, where rows lie close together, very many."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.words import slices
from marginalia.storage import freed, stored

CODES = 16
#: Rows of one block, at least and at most, numbers in its vectors at most, and queries of one block.
ROW_BLOCK, BLOCK_NUMBERS, QUERY_BLOCK = (4096, 65_536), 1 << 22, 4096
#: Standard deviations by which a table score may be off, taken from twice the variance that residuals of random directions have.
SIGMAS = 3.0


@dataclass
class Quantiser:
    """books: [subspace, code, dimension]; eta: weight of the parallel residual against the orthogonal one."""

    books: np.ndarray
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        """[row, subspace, dimension], padded with zeros."""
        m, _, d = self.books.shape
        return np.pad(x, ((0, 0), (0, m * d - x.shape[1]))).reshape(len(x), m, d)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes [row, subspace]: nearest codewords, then sweeps of coordinate descent on the anisotropic loss."""
        parts = self.split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        codes = np.empty(parts.shape[:2], np.uint8)
        along = np.empty(parts.shape[:2])
        for s, book in enumerate(self.books):
            codes[:, s] = ((parts[:, s, None] - book) ** 2).sum(2).argmin(1)
            along[:, s] = ((parts[:, s] - book[codes[:, s]]) * unit[:, s]).sum(1)
        for _ in range(sweeps):
            for s, book in enumerate(self.books):
                rest = along.sum(1) - along[:, s]
                gap = parts[:, s, None] - book
                own = (gap * unit[:, s, None]).sum(2)
                codes[:, s] = ((gap**2).sum(2) + (self.eta - 1) * (rest[:, None] + own) ** 2).argmin(1)
                along[:, s] = own[np.arange(len(x)), codes[:, s]]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """[row, subspace, dimension]: the codewords."""
        return self.books[np.arange(codes.shape[1]), codes]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """[query, subspace, code]: inner products with the codewords."""
        return np.einsum("qsd,scd->qsc", self.split(queries), self.books).astype(np.float32)


def train(x: np.ndarray, subspaces: int, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Quantiser:
    """From a sample x. threshold: the part of a vector's length from which scores matter; it sets the weight eta."""
    dims = x.shape[1]
    m = min(subspaces, dims)
    width = math.ceil(dims / m)
    m = math.ceil(dims / width)
    random = np.random.default_rng(seed)
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    out = Quantiser(np.zeros((m, CODES, width)), eta)
    parts = out.split(x)
    for s in range(m):
        own = parts[:, s]
        book = own[random.choice(len(own), CODES, replace=len(own) < CODES)].copy()
        for _ in range(rounds):
            at = ((own[:, None] - book) ** 2).sum(2).argmin(1)
            for c in np.unique(at):
                book[c] = own[at == c].mean(0)
        out.books[s] = book
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for _ in range(2):
        codes = out.encode(x, 1)
        along = np.stack([((parts[:, s] - out.books[s][codes[:, s]]) * unit[:, s]).sum(1) for s in range(m)], 1)
        for s in range(m):
            rest = along.sum(1) - along[:, s]
            u, own = unit[:, s], parts[:, s]
            goal = own + (eta - 1) * (rest + (own * u).sum(1))[:, None] * u
            for c in np.unique(codes[:, s]):
                rows = codes[:, s] == c
                left = rows.sum() * np.eye(width) + (eta - 1) * u[rows].T @ u[rows]
                out.books[s][c] = np.linalg.solve(left, goal[rows].sum(0))
            along[:, s] = ((own - out.books[s][codes[:, s]]) * u).sum(1)
    return out


def scan(queries: np.ndarray, codes: np.ndarray, quantiser: Quantiser) -> np.ndarray:
    """Table scores [query, row]."""
    tables = quantiser.tables(queries)
    if tables.shape[1] % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], 1)
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], 1)
    # two four-bit codes are one byte; its table is the sum of theirs
    pairs = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CODES * CODES)
    both = codes[:, 0::2].astype(np.intp) * CODES + codes[:, 1::2]
    out = np.zeros((len(queries), len(codes)), np.float32)
    for s in range(both.shape[1]):
        out += np.take(pairs[:, s], both[:, s], axis=1)
    return out


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A column of lists of one length, as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _best(queries: pa.Table, rows: pa.Table, quantiser: Quantiser, k: int, scale: float) -> pa.Table:
    """(query_id, vec_id, score): of a block of rows the k nearest of each query, its own id left out, ties to the smaller id.

    Scores of the 2 k best by table give what a row must reach. Rows whose table score is below that by more than it can be off are
    let go, all others are scored. An error is the sum over subspaces of the residual times the query's part: it is at most the sum
    of their lengths' products, and beyond SIGMAS times the root of the sum of squares in a few of a hundred thousand pairs."""
    queries, rows = queries.combine_chunks(), rows.combine_chunks()
    parts = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
    if not len(rows) or not len(queries):
        return parts[0]
    ids = rows.column("vec_id").to_numpy()
    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    x = _matrix(rows.column("embedding").chunk(0))
    own, coded = quantiser.split(x * scale), quantiser.decode(codes)
    # a codeword that is too short or too long along its vector is stretched, so that no error is left along the vector
    length = (own**2).sum((1, 2))
    stretch = np.clip(length / np.maximum((own * coded).sum((1, 2)), 1e-30 * length + 1e-300), 0.5, 2.0)
    gaps = (own - coded * stretch[:, None, None]).astype(np.float32)
    gaps = np.sqrt((gaps**2).sum(2)).T
    rough = (1e-5 * np.sqrt(length)).astype(np.float32)  # of sums in single precision
    stretch = stretch.astype(np.float32)
    spread = np.float32(SIGMAS**2 * 2 / quantiser.books.shape[2])
    for at in range(0, len(queries), 64):
        part = queries.slice(at, 64).combine_chunks()
        names, asked = part.column("query_id").to_numpy(), _matrix(part.column("embedding").chunk(0))
        unit = asked / np.abs(asked).max(1)[:, None]
        near = scan(unit, codes, quantiser) * stretch
        near[ids[None, :] == names[:, None]] = -np.inf
        sizes = np.sqrt((quantiser.split(unit) ** 2).sum(2)).astype(np.float32)
        most = np.minimum(np.sqrt(spread * (sizes**2 @ gaps**2)), sizes @ gaps)
        most += np.linalg.norm(unit, axis=1).astype(np.float32)[:, None] * rough
        most += near
        head = np.argpartition(-near, 2 * k - 1, axis=1)[:, : 2 * k] if 2 * k < len(ids) else None
        for i, name in enumerate(names.tolist()):
            open_ = near[i] > -np.inf
            if head is not None:
                first = head[i][open_[head[i]]]
                open_ &= most[i] >= np.partition((x[first] * scale) @ unit[i], -k)[-k] * (1 - 1e-9)
            row = np.flatnonzero(open_)
            score = (x[row] * asked[i]).sum(1)
            if len(row) > k:
                best = score >= np.partition(score, -k)[-k]
                row, score = row[best], score[best]
            order = np.lexsort((ids[row], -score))[:k]
            parts.append(pa.table({"query_id": np.full(len(order), name), "vec_id": ids[row[order]], "score": score[order]}))
    return pa.concat_tables(parts).combine_chunks()


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, embedding array<double>) of the rows that take part: id and vector are there, the vector is not zero and
    has finite components only. Of rows with one id the least vector stays."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & ok).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(v).alias("embedding"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 10_000, subspaces: int = 32, again: int = 400, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the largest inner products found, nearest first, ties to
    the smaller id; a row with the query's own id is left out. queries: as vectors, with the same columns.

    The quantiser is fitted on at most about `sample` vectors, picked by a hash of the id; every row is coded and scanned. In each
    block of rows all are scored exactly whose table score leaves open whether they are among the block's nearest, and its k
    nearest are handed on. again has no effect: how many rows are scored again follows from their residuals. Of equal vectors only
    the k + 1 with the least ids can be among the nearest, so the others are not scanned: a vector that very many rows hold costs
    little.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids, nor vectors of another
    length than the commonest one of the sample (the longest of several). Other columns play no part, whatever their names. An
    empty table gives an empty result."""
    spark = vectors.sparkSession
    every = stored(usable(vectors, id_col, vector_col), "vectors")
    some = every.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_000)) < int(math.ceil(min(1.0, sample / max(every.count(), 1)) * 1_000_000))).orderBy("vec_id").limit(2 * sample)
    found = some.select("embedding").toArrow().column("embedding").combine_chunks()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(found):
        return empty
    lengths = np.array([len(v) for v in found])
    dims = int(max(np.unique(lengths), key=lambda n: ((lengths == n).sum(), n)))
    x = _matrix(found.filter(pa.array(lengths == dims)))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    rows = stored(every.where(F.size("embedding") == dims).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth"), "rows")
    asked = stored(usable(queries, id_col, vector_col).where(F.size("embedding") == dims).withColumnRenamed("vec_id", "query_id"), "queries")
    freed(every)
    n, q = rows.count(), asked.count()
    if not q:
        return empty
    # codes are made of vectors of middling size, so that no square of theirs leaves the range of doubles
    longest = rows.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0] or 1.0
    scale = 2.0 ** min(1000, -math.frexp(longest)[1])
    quantiser = train(x * scale, subspaces, seed=seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            codes = quantiser.encode(_matrix(b.column(1)) * scale)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "code"])

    coded = stored(rows.mapInArrow(encode, "vec_id long, embedding array<double>, code binary"), "codes")
    freed(rows)
    row_blocks = math.ceil(n / min(max(n // 16, ROW_BLOCK[0]), ROW_BLOCK[1], max(1, BLOCK_NUMBERS // dims)))
    query_blocks = math.ceil(q / QUERY_BLOCK)
    block = lambda col, blocks: F.pmod(F.xxhash64(F.lit(seed + 1), col), F.lit(blocks)).cast("int")
    # the query set in blocks against the rows in blocks: a task holds one block of each
    left = asked.select(F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), block("query_id", query_blocks).alias("qb"), "query_id", "embedding")
    right = coded.select(block("vec_id", row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "code", "embedding")
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(lambda a, b: _best(a, b, quantiser, k, scale), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, k: int = 20, queries: int = 100) -> float:
    """The part of the true k nearest that found holds, over the queries with the least ids, against brute force in numpy; for
    tables that fit the driver."""
    rows = usable(vectors).toPandas().sort_values("vec_id")
    x, ids = np.stack(rows["embedding"].to_numpy()), rows["vec_id"].to_numpy()
    got = found.toPandas()
    hits = total = 0
    for query in sorted(got["query_id"].unique())[:queries]:
        exact = x @ x[np.searchsorted(ids, query)]
        near = [i for i in ids[np.lexsort((ids, -exact))][: k + 1] if i != query][:k]
        hits += len(set(near) & set(got.loc[got["query_id"] == query, "vec_id"]))
        total += len(near)
    return hits / max(total, 1)


def op5(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
