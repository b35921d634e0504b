"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is that of its distinct word shingles. Documents with equal sets form one class, which the forest sees once.
Each tree of the forest is one order of the classes, sorted by a signature of its own; two classes that share the first LEAST
values of it are in one region. In a region every class meets its next neighbours in the order, which are those with the longest
common prefix: a region of many classes is thereby read at a greater depth than one of few. Candidates whose whole signatures
agree too little are let go (see floor_of), the others confirmed on the full sets, in two steps: first the likeliest partner of
each class, then those candidates that still join different groups. Groups are connected components. Where a region then still
holds classes of different groups, all pairs across them are compared in blocks, by signature and then on full sets, so that no
pair of a region that reaches the threshold is left apart, wherever it stands in the order and however the order was cut."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import components, free_name
from marginalia.llm.words import alone, mixed, shingles, slices, texts_of
from marginalia.storage import freed, stored

TREES = 20
#: Signature values that two classes must share at the head of a tree's order to be candidates.
LEAST = 4
#: Values by which a tree sorts: LEAST of its own, the others from the trees after it.
DEPTH = 12
#: Neighbours that a class meets on each side in each tree, and how far it looks for those that its size allows.
NEAR, WINDOW = 4, 16

_VALUES = TREES * LEAST
_A = mixed(np.arange(1, _VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mixed(np.arange(1, _VALUES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def set_of(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z are lower-cased."""
    return shingles(np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), np.uint64), size)


def signature(own: np.ndarray) -> bytes:
    """_VALUES numbers of 32 bits, big-endian so that bytes sort as numbers."""
    least = np.full(_VALUES, np.uint64(2**64 - 1))
    for at in range(0, len(own), 256):
        np.minimum(least, (_A[:, None] * own[None, at : at + 256] + _B[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def floor_of(percent: int) -> int:
    """Values of two signatures that agree at least, if their sets reach the threshold: fewer do once in a thousand million."""
    t, total = percent / 100, 0.0
    for agree in range(_VALUES + 1):
        total += math.comb(_VALUES, agree) * t**agree * (1 - t) ** (_VALUES - agree)
        if total > 1e-9:
            return agree
    return _VALUES


def _class_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_shingles, class_key and signature (null for an empty set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for b in slices(batches):
            n, keys, signs = [], [], []
            for text in texts_of(b.column(2)):
                own = set_of(text, size)
                n.append(len(own))
                keys.append(_class_key(own) if len(own) else None)
                signs.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["id", "text_key", "n_shingles", "class_key", "signature"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col))).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text_key binary, n_shingles long, class_key binary, signature binary")


def _fixed(column: pa.Array, kind: str) -> np.ndarray:
    """A column of binary values of one length, without nulls, as a row of numbers each."""
    n = len(column)
    if not n:
        return np.zeros((0, 1), kind)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(n, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a column of binary values."""
    data = np.ascontiguousarray(rows)
    width = data.itemsize * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * width), pa.py_buffer(data.tobytes())])


def _meet(least_share: float):
    """Candidate pairs from rows (region, sort, class_key, n) that come in order. A class meets the next NEAR ones of its region
    that its size allows; sizes are looked at first, so that no place is spent on a class that can't be a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        region, key, count = np.zeros(0, np.int64), np.zeros((0, 2), ">u8"), np.zeros(0, np.int64)
        for b in batches:
            fresh = len(region)
            region = np.concatenate([region, b.column(0).to_numpy()])
            key = np.concatenate([key, _fixed(b.column(2), ">u8").reshape(-1, 2)]).astype(">u8")
            count = np.concatenate([count, b.column(3).to_numpy()])
            n, met = len(region), np.zeros(len(region), np.int8)
            found = []
            for d in range(1, min(WINDOW, n - 1) + 1):
                first = max(fresh - d, 0)
                small, large = np.minimum(count[first + d :], count[first : n - d]), np.maximum(count[first + d :], count[first : n - d])
                i = first + np.flatnonzero((region[first + d :] == region[first : n - d]) & (small >= least_share * large) & (met[first + d :] < NEAR))
                if not len(i) and not (region[first + d :] == region[first : n - d]).any():
                    break
                met[i + d] += 1
                found.append((i, i + d))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                x, y = key[i], key[j]
                swap = (x[:, 0] > y[:, 0]) | (x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1])
                x[swap], y[swap] = y[swap], x[swap]
                yield pa.RecordBatch.from_arrays([_binary(x), _binary(y)], ["a", "b"])
            region, key, count = region[-WINDOW:], key[-WINDOW:], count[-WINDOW:]

    return run


def forest(classes: DataFrame) -> DataFrame:
    """region, sort, class_key, n of the classes of every region that has more than one. A region is a tree and the head of its
    order. classes: class_key, n, signature."""
    trees = F.explode(F.array(*[F.lit(t) for t in range(TREES)]))
    region = F.xxhash64("tree", F.expr(f"substring(signature, tree * {4 * LEAST} + 1, {4 * LEAST})"))
    thin = classes.select("class_key", "signature", trees.alias("tree")).select(region.alias("region"), F.col("tree").cast("byte").alias("tree"), F.col("class_key").alias("_c"))
    # a region of one class gives no candidate: such rows need not be sorted, nor their signatures moved
    full = thin.groupBy("region").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("region").alias("_r"))
    thin = stored(thin.join(full, F.col("region") == F.col("_r")).select("region", "tree", "_c"), "regions")
    round_ = F.concat("signature", F.expr(f"substring(signature, 1, {4 * (DEPTH - LEAST)})"))
    wide = classes.select("class_key", "n", round_.alias("round"))
    rows = thin.join(wide, F.col("_c") == F.col("class_key")).select("region", F.expr(f"substring(round, tree * {4 * LEAST} + 1, {4 * DEPTH})").alias("sort"), "class_key", "n")
    rows = stored(rows, "forest")
    freed(thin)
    return rows


def candidates(rows: DataFrame, share: float) -> DataFrame:
    """(a, b): pairs of classes of the forest's rows that are neighbours in a region."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "region", "sort", "class_key").sortWithinPartitions("region", "sort", "class_key")
    return ordered.mapInArrow(_meet(share), "a binary, b binary").distinct()


def alike(pairs: DataFrame, classes: DataFrame, floor: int) -> DataFrame:
    """(a, b, agree): the pairs whose signatures agree in `floor` values or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for b in slices(batches, 4096):
            agree = (_fixed(b.column(2), "<u4") == _fixed(b.column(3), "<u4")).sum(1)
            keep = pa.array(agree >= floor)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(agree[agree >= floor].astype(np.int32))], ["a", "b", "agree"])

    left, right = (classes.select(F.col("class_key").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, agree int")


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """class_key, n and packed set (64 bits of each shingle) of each wanted(id, text_key, class_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for b in slices(batches, 256):
            own = [set_of(t, size) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["class_key", "n", "packed"])

    text = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.unhex(F.md5(F.col(text_col))).alias("_key"), F.col(text_col).alias("text"))
    wanted = wanted.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text_key", "class_key")
    got = text.join(wanted, (F.col("_id") == F.col("id")) & (F.col("_key") == F.col("text_key"))).select("class_key", "text")
    return got.mapInArrow(run, "class_key binary, n long, packed binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, counted on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for b in slices(batches, 256):
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                one, two = _unpacked(x.as_py()), _unpacked(y.as_py())
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                both = int((two[at] == one).sum())
                ok.append(100 * both >= percent * (len(one) + len(two) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    left, right = (sets.select(F.col("class_key").alias(x), F.col("packed").alias(f"p{x}")) for x in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "pa", "pb")
    return both.mapInArrow(run, "a binary, b binary")


#: Classes and shingles that one side of a block comparison holds, about.
BLOCK, BLOCK_SHINGLES = 256, 250_000
#: Shingles that a block comparison multiplies at a time.
COLUMNS = 4096


def _links_between(sets: list[np.ndarray], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that reach the threshold and whose roots differ, without those that others of them join already."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for low in range(0, int(shared.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[at], column[at] - low] = 1
        both += has @ has.T
    linked = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (roots[:, None] != roots[None, :])
    fresh, out = np.ones(len(sets), bool), []
    for start in np.flatnonzero(linked.any(1)).tolist():
        queue = [start] if fresh[start] else []
        fresh[start] = False
        while queue:
            i = queue.pop()
            found = np.flatnonzero(linked[i] & fresh).tolist()
            fresh[found] = False
            out += [(i, j) for j in found]
            queue += found
    return out


def _partners(signs: np.ndarray, sizes: np.ndarray, roots: np.ndarray, floor: int, share: float) -> np.ndarray:
    """Which pairs of positions may be links across roots, by signatures and sizes; above the diagonal."""
    agree = np.zeros((len(signs), len(signs)), np.int16)
    for column in signs.T:
        agree += column[:, None] == column[None, :]
    small, large = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    return np.triu((agree >= floor) & (small >= share * large) & (roots[:, None] != roots[None, :]), 1)


def left_apart(rows: DataFrame, groups: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes of one region that groups(node, root) hold apart, as many as join what is to be joined.

    Of a region's groups the largest is met only by the others, which meet each other too; both are dealt in blocks, of which
    one task compares two: first by signature, then those classes that have a possible partner in the task on full sets. Pairs
    that are few are passed on one by one, so that a pair found in many regions is confirmed once."""
    own = rows.select("region", "class_key", "n").join(groups, F.col("class_key") == F.col("node"), "left").select("region", "class_key", "n", F.coalesce("root", "class_key").alias("root"))
    own = stored(own, "regions")
    sums = own.groupBy("region", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    regions = sums.groupBy("region").agg(F.count(F.lit(1)).alias("roots"), F.max_by(F.struct("root", "c", "w"), F.struct("c", "root")).alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w")).where("roots > 1")
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    regions = regions.select(F.col("region").alias("_r"), F.col("most.root").alias("most"), blocks(F.col("most.c"), F.col("most.w")).alias("large"), blocks(F.col("c") - F.col("most.c"), F.col("w") - F.col("most.w")).alias("others"))
    met = own.join(regions, F.col("region") == F.col("_r"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("class_key"), F.when(F.col("root") == F.col("most"), F.col("large")).otherwise(F.col("others"))).cast("int"))
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("mine")
    tasks = F.when(F.col("root") == F.col("most"), F.transform(to("others"), lambda x: task("large", x, mine)))
    tasks = tasks.otherwise(F.concat(F.transform(to("others"), lambda x: task("others", F.least(x, mine), F.greatest(x, mine))), F.transform(to("large"), lambda x: task("large", mine, x))))
    met = met.select("region", "class_key", "root", "n", tasks.alias("tasks"))
    met = met.join(classes.select(F.col("class_key").alias("_c"), "signature"), F.col("class_key") == F.col("_c")).select("region", "class_key", "root", "n", "signature", F.explode("tasks").alias("task"))
    met = met.select(F.xxhash64("region", "task").alias("task"), "class_key", "root", "n", "signature")
    floor, share = floor_of(percent), percent / 100

    def numbered(roots: pa.Array) -> np.ndarray:
        return np.unique(_fixed(roots, "S16"), return_inverse=True)[1].reshape(-1)

    def one(t: pa.Table) -> tuple[np.ndarray, ...]:
        alone()
        t = t.combine_chunks()
        return t.column("task")[0].as_py(), _fixed(t.column("class_key").chunk(0), ">u8"), numbered(t.column("root").chunk(0)), t

    def possible(t: pa.Table) -> pa.Table:
        task, keys, roots, t = one(t)
        pairs = _partners(_fixed(t.column("signature").chunk(0), "<u4"), t.column("n").to_numpy(), roots, floor, share) if roots.any() else np.zeros((1, 1), bool)
        i, j = np.nonzero(pairs)
        if len(i) <= len(keys):
            x, y = keys[i], keys[j]
            return pa.table([pa.nulls(len(i), pa.int64()), _binary(x), _binary(y)], ["task", "a", "b"])
        i = np.unique(np.concatenate([i, j]))
        return pa.table([pa.array(np.full(len(i), task)), _binary(keys[i]), pa.nulls(len(i), pa.binary())], ["task", "a", "b"])

    def linked(t: pa.Table) -> pa.Table:
        _, keys, roots, t = one(t)
        found = np.array(_links_between([_unpacked(x.as_py()) for x in t.column("packed")], roots, percent) if roots.any() else [], np.int64).reshape(-1, 2)
        return pa.table([_binary(keys[found[:, 0]]), _binary(keys[found[:, 1]])], ["a", "b"])

    found = stored(met.groupBy("task").applyInArrow(possible, "task long, a binary, b binary"), "possible")
    few = found.where("task is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    many = found.where("task is not null").select("task", F.col("a").alias("class_key"))
    many = many.join(groups, F.col("class_key") == F.col("node"), "left").select("task", "class_key", F.coalesce("root", "class_key").alias("root"))
    many = many.join(sets.select(F.col("class_key").alias("_c"), "packed"), F.col("class_key") == F.col("_c")).select("task", "class_key", "root", "packed")
    out = stored(confirm(few, sets, percent).unionAll(many.groupBy("task").applyInArrow(linked, "a binary, b binary")), "links")
    freed(own, found)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles (long), component_id, kept (boolean) of each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of size-word shingles (words: runs without
    0x20 and 0x09-0x0D, A-Z lower-cased); a text with fewer words has one shingle, its whole sequence. component_id is the least
    id that links reach, and kept marks the row that has it.

    A null text or one without words has an empty set and is linked with nothing: it is its own component. Null ids join their
    group but never name it while another id is there; rows that repeat id and text all get the same result. Texts are read
    whole. An empty table gives an empty result. Other columns of docs play no part; if id_col has the name of a new column, that
    one begins with an underscore."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(sketch(docs, size, "id", "text"), "sketch")
    some = rows.where("class_key is not null")
    # all rows of a class have one signature and one size; a row with an id stands for it before one without
    classes = some.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = stored(classes.select("class_key", "rep.id", "rep.text_key", "n", "signature"), "classes")
    trees = forest(classes)
    pairs = stored(alike(candidates(trees, percent / 100), classes, floor_of(percent)), "pairs")
    wanted = classes.join(trees.select("class_key").distinct(), "class_key", "left_semi").select("id", "text_key", "class_key")
    sets = stored(sets_of(docs, wanted, size, "id", "text").dropDuplicates(["class_key"]), "sets")
    first = pairs.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
    sure = links = stored(confirm(first, sets, percent), "links")
    groups = components(links, "near")
    side = lambda name: groups.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    rest = pairs.join(first.withColumn("done", F.lit(True)), ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b")
    more = stored(confirm(rest, sets, percent), "links")
    if not more.isEmpty():
        links = links.unionAll(more)
        before, groups = groups, components(links, "near")
        freed(before)
    apart = left_apart(trees, groups, classes, sets, percent)
    if not apart.isEmpty():
        before, groups = groups, components(links.unionAll(apart), "near")
        freed(before)
    least = groups.join(classes.select(F.col("class_key").alias("node"), "id"), "node")
    roots = least.groupBy("root").agg(F.min("id").alias("least"))
    named = least.join(roots, "root").select(F.col("node").alias("class_key"), "least")
    full = stored(classes.select("class_key", "id").join(named, "class_key", "left").select(F.col("class_key").alias("_c"), F.coalesce("least", "id").alias("_least")), "named")
    freed(trees, pairs, sets, sure, more, apart, groups, classes)
    # members of one class may be very many: the classes' side holds each key once, and AQE may split the other
    out = rows.select("id", "n_shingles", "class_key").join(full, F.col("class_key") == F.col("_c"), "left")
    out = out.select("id", "n_shingles", F.when(F.col("class_key").isNull(), F.col("id")).otherwise(F.col("_least")).alias("component_id"))
    out = out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.toDF(id_col, *free_name(docs.select(F.col("id").alias(id_col)), *out.columns[1:]))


def keep_first(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id names their group. Ids must tell rows apart."""
    found = near_duplicates(docs.select(id_col, text_col), percent, id_col=id_col, text_col=text_col).where("kept").select(F.col(id_col).alias("_kept_id"))
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("_kept_id")), "left_semi")


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85)
