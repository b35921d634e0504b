"""Repeated byte strings by suffix arrays built with induced sorting.

Which strings can meet is settled first. Every window of LENGTH bytes is named by the least hash of the GRAM-byte strings in it;
equal windows have equal names, wherever they stand. A run of window starts named by one place is a context. Names found once can't
hold a repeat. Contexts of one name and one 128-bit hash form a class. The classes of one name are dealt to one shard, in which a
suffix array over all its contexts is built. A name of very many classes is first cut into finer ones, by bytes that its windows
have in common around the gram, again and again until no name is crowded. In each shard

- sorted_suffixes() classifies suffixes, sorts the leftmost smaller substrings by induction, names them, recurses on the names
  (by prefix doubling once they are very many) and induces the whole array, all in passes over buckets with numpy;
- common_prefixes() gives the permuted common prefix of each suffix with its predecessor: it compares bytes only where the
  preceding bytes differ, as everywhere else the prefix is one less than the previous one.

A window is repeated if it shares LENGTH bytes with a neighbour in the array, or if its class stands in several places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_name
from marginalia.llm.words import alone, mixed, slices, texts_of
from marginalia.storage import freed, stored

#: Bytes hashed at a time: a power of two.
GRAM = 32
#: Bytes worked on at once where texts are hashed; longer texts are cut into tiles that overlap by a window.
TILE = 1 << 20
PLACE_BITS = 21
#: Bytes of contexts in one shard, about.
SHARD_BYTES = 2_000_000
#: A name with more classes than this is cut finer, so that no shard grows with one name.
MOST_CLASSES = 2_000
#: Recursion goes on over alphabets up to this. numpy's passes need few large buckets, so a string of more names is ranked by
#: prefix doubling.
MOST_SYMBOLS = 2048

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# Induced sorting ------------------------------------------------------------------------------------------------------------


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last, a unique least symbol, counts as smaller."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.where(s[:-1] < s[1:], 1, np.where(s[:-1] > s[1:], -1, 0))
    step[-1] = 1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _place(out: np.ndarray, edge: np.ndarray, found: np.ndarray, symbol: np.ndarray, way: int) -> None:
    """found into the buckets of their symbols, in order, at the edges, which move on (way: 1 or -1)."""
    order = symbol.argsort(kind="stable")
    ranked, found = symbol[order], found[order]
    first = np.concatenate([[0], (ranked[1:] != ranked[:-1]).nonzero()[0] + 1])
    own = ranked[first]
    size = np.append(first[1:], len(ranked)) - first
    out[np.repeat(edge[own] - way * first, size) + way * np.arange(len(ranked))] = found
    edge[own] += way * size


def _induce(s: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The array that the leftmost smaller suffixes, given in order, induce. starts: where buckets begin, and the end."""
    n = len(s)
    out = np.full(n, -1, np.int32)
    filled = np.flatnonzero(np.diff(starts)).tolist()
    begin = np.searchsorted(s[lms], np.arange(len(starts))).tolist()
    # what stands before each place, if it is of the type that the pass induces; -1 otherwise
    larger, smaller = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    wide = s[:-1].astype(np.int32)
    larger[1:] = np.where(small[:-1], -1, wide)
    smaller[1:] = np.where(small[:-1], wide, -1)
    head = starts[:-1].copy()
    for c in filled:
        low = new = starts[c]
        sources = []
        while head[c] > new:
            source = out[new : head[c]]
            symbol = larger[source]
            wave = source[symbol == c] - 1
            over = symbol > c
            sources.append((source[over] - 1, symbol[over]))
            new = head[c]
            out[new : new + len(wave)] = wave
            head[c] = new + len(wave)
        if begin[c + 1] > begin[c]:
            source = lms[begin[c] : begin[c + 1]]
            symbol = larger[source]
            over = symbol > c
            sources.append((source[over] - 1, symbol[over]))
        if sources:
            found, symbol = sources[0] if len(sources) == 1 else map(np.concatenate, zip(*sources, strict=True))
            if len(found):
                _place(out, head, found, symbol.astype(np.uint16), 1)
    tail = starts[1:] - 1
    for c in reversed(filled):
        new = starts[c + 1] - 1
        sources = []
        while tail[c] < new:
            source = out[tail[c] + 1 : new + 1][::-1]
            symbol = smaller[source]
            wave = source[symbol == c] - 1
            under = (symbol < c) & (symbol >= 0)
            sources.append((source[under] - 1, symbol[under]))
            new = tail[c]
            out[new - len(wave) + 1 : new + 1] = wave[::-1]
            tail[c] = new - len(wave)
        if head[c] > starts[c]:
            source = out[starts[c] : head[c]][::-1]
            symbol = smaller[source]
            under = (symbol < c) & (symbol >= 0)
            sources.append((source[under] - 1, symbol[under]))
        if sources:
            found, symbol = sources[0] if len(sources) == 1 else map(np.concatenate, zip(*sources, strict=True))
            if len(found):
                _place(out, tail, found, symbol.astype(np.uint16), -1)
    out[0] = n - 1
    return out


def sorted_suffixes(s: np.ndarray) -> np.ndarray:
    """The suffix array of s, small non-negative integers of which the last is the only least one."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable").astype(np.int32)
    small = _smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(s))]).astype(np.int64)
    by_symbol = lms[np.argsort(s[lms], kind="stable")]
    first = _induce(s, small, starts, by_symbol)
    if len(lms) < 2:
        return first
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = first[is_lms[first]]
    # names: equal leftmost smaller substrings, each up to the start of the next, get equal names
    nth = np.empty(n, np.int32)
    nth[lms] = np.arange(len(lms), dtype=np.int32)
    length = np.append(np.diff(lms), 0)[nth[ranked]]
    same = length[1:] == length[:-1]
    pair = np.flatnonzero(same)
    k = 0
    while len(pair):
        left, right = ranked[pair], ranked[pair + 1]
        differs = s[np.minimum(left + k, n - 1)] != s[np.minimum(right + k, n - 1)]
        same[pair[differs]] = False
        pair = pair[~differs]
        pair = pair[length[pair] > k]
        k += 1
    name = np.concatenate([[0], np.cumsum(~same)])
    if name[-1] + 1 == len(lms):
        return _induce(s, small, starts, ranked)
    names = np.empty(len(lms), np.int64)
    names[nth[ranked]] = name
    if name[-1] < MOST_SYMBOLS:
        order = sorted_suffixes(np.append(names + 1, 0).astype(np.uint16))[1:]
    else:
        order = _doubled(names)
    return _induce(s, small, starts, lms[order])


def _doubled(names: np.ndarray) -> np.ndarray:
    """The order of all suffixes of names, by doubling the prefix that ranks stand for. Only suffixes whose rank others share
    are looked at again."""
    n = len(names)
    rank = np.concatenate([np.searchsorted(np.sort(names), names), np.full(1, -1)])
    # ranks are the number of smaller suffixes, so that ties can be split in place
    order = np.argsort(names, kind="stable")
    tied = np.flatnonzero(np.concatenate([[False], names[order][1:] == names[order][:-1]]))
    k = 1
    while len(tied):
        # tied: places in order whose rank is that of the place before; each group begins one place earlier
        group = np.zeros(n + 1, bool)
        group[tied] = True
        group[tied - 1] = True
        place = np.flatnonzero(group)
        own = order[place]
        after = rank[np.minimum(own + k, n)]
        key = (rank[own] << 32) + after + 1
        sort = np.argsort(key, kind="stable")
        own, key = own[sort], key[sort]
        order[place] = own
        same = np.concatenate([[False], key[1:] == key[:-1]])
        rank[own] = place[np.maximum.accumulate(np.where(same, 0, np.arange(len(own))))]
        tied = place[same]
        k *= 2
    return order


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """At each place of s (bytes), the length of the common prefix of its suffix and the one before it in order."""
    n = len(s)
    before = np.empty(n, np.int32)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    here = np.arange(n, dtype=np.int32)
    start = (before <= 0) | (here == 0)
    start[~start] = s[here[~start] - 1] != s[before[~start] - 1]
    place = np.flatnonzero(start & (before >= 0)).astype(np.int64)
    padded = np.concatenate([s.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), 0, (1,)).copy()
    length = np.zeros(n, np.int64)
    other, k = before[place].astype(np.int64), 0
    while len(place):
        # a suffix ends with the unique last symbol, so the zeros behind it are never reached as equal
        x = words[np.minimum(place + k, n + 7)] ^ words[np.minimum(other + k, n + 7)]
        ends = x != 0
        low = x[ends]
        length[place[ends]] = k + np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) // 8
        place, other, k = place[~ends], other[~ends], k + 8
    at = np.maximum.accumulate(np.where(start, here, 0))
    return np.maximum(length[at] - (here - at), 0)


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its windows of length bytes are found again in it or in another. UTF-8 has no bytes 0xFE and
    0xFF, so all symbols fit one byte: 0 ends the text, 1 ends a context."""
    if not contexts:
        return []
    sizes = np.array([len(c) for c in contexts])
    joined = np.frombuffer(b"\xff".join(contexts) + b"\xff\xfe", np.uint8) + np.uint8(2)
    order = sorted_suffixes(joined)
    prefix = common_prefixes(joined, order)
    near = prefix >= length
    found = near.copy()
    found[order[:-1]] |= near[order[1:]]
    at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return [found[a : a + max(0, n - length + 1)] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]


# Names and contexts ---------------------------------------------------------------------------------------------------------


def _grams(b: np.ndarray) -> np.ndarray:
    h, n, m = _BYTE[b], 1, 0xBF58476D1CE4E5B9
    while n < GRAM:
        h = h[:-n] * np.uint64(m) + h[n:]
        m, n = m * m % 2**64, 2 * n
    return mixed(h)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours."""
    n = len(h) - width + 1
    grid = np.concatenate([h, np.full(-len(h) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    left = np.minimum.accumulate(grid, 1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


#: Odd bases of two hashes modulo 2 ** 64, which together tell contexts apart.
_BASES, _POWERS = (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15), {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_POWERS.get(base, ((),))[0]) < n:
        both = []
        for x in (base, pow(base, -1, 2**64)):
            out = np.full(n, np.uint64(x))
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _POWERS[base] = tuple(both)
    return _POWERS[base]


def contexts_of(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of all parts: part number, first window start, window starts, name and both hashes of each context."""
    sizes = np.array([len(p) for p in parts])
    b = np.frombuffer(b"".join(parts), np.uint8)
    if len(b) < length:
        return (np.zeros(0, np.int64),) * 6
    grams = _grams(b)
    # the low bits give the place, so that of grams equal in the others the last one names a window; a window's name follows
    # from its bytes alone, and a repeat inside a text always has another place
    last = np.uint64((1 << PLACE_BITS) - 1)
    place = last - (_least((grams & ~last) | (last - np.arange(len(grams), dtype=np.uint64)), length - GRAM + 1) & last)
    end = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)[: len(place)]
    valid = np.arange(len(place)) + length <= end[part]
    begin = valid.copy()
    begin[1:] &= (place[1:] != place[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(begin)
    stop = np.minimum(np.append(first[1:], len(place)), np.maximum(end[part[first]] - length + 1, 0))
    names = grams[place[first]]
    own, wide = [], _BYTE[b]
    for base in _BASES:
        up, down = _powers(base, max(len(b) + 1, TILE + length))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * up[: len(b)])])
        own.append(mixed((sums[stop - 1 + length] - sums[first]) * down[first] + (stop - first).astype(np.uint64)).view(np.int64))
    return part[first], first - (end - sizes)[part[first]], stop - first, names.view(np.int64), *own


def _tiles(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, offset, bytes) in lots of about TILE bytes; every window lies in exactly one tile."""
    lot, held = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), TILE):
            tile = t[at : at + TILE + length - 1]
            if held + len(tile) > TILE and lot:
                yield lot
                lot, held = [], 0
            lot.append((i, at, tile))
            held += len(tile)
    if lot:
        yield lot


def _lots(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most 512 rows and, but for one long text, TILE bytes."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < whole.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 512]), TILE, side="right")))
            yield whole.slice(at, n)
            at += n


def survey(docs: DataFrame, length: int) -> DataFrame:
    """One row for each row of docs(id, text): key (of id and text) and the arrays first, starts, name, class, more of its
    contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for b in _lots(batches, 1):
            texts = texts_of(b.column(1))
            found = []
            for lot in _tiles(texts, length):
                part, first, *rest = contexts_of([t for _, _, t in lot], length)
                doc, base = np.array([i for i, _, _ in lot]), np.array([o for _, o, _ in lot])
                found.append((doc[part], first + base[part], *rest))
            doc, *rest = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 6
            at = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(t), pa.from_numpy_dtype(t))) for x, t in zip(rest, (np.int32, np.int32, np.int64, np.int64, np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["key", "first", "starts", "name", "class", "more"])

    return docs.select(_key().alias("key"), "text").mapInArrow(run, "key binary, first array<int>, starts array<int>, name array<long>, class array<long>, more array<long>")


def _key():
    """Of the columns id and text; the id's length keeps it apart from the text."""
    own = F.col("id").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.length(own).cast("string"), F.lit("-")), F.lit(" "), F.coalesce(own, F.lit("")), F.coalesce("text", F.lit("")))))


def _shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, name, class, more, context) sorted by shard to (name, class, more, from[], to[]): runs of repeated starts.
    A row that comes again is taken once."""
    held, shard = {}, None
    for b in batches:
        for row in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
            if row[0] != shard:
                yield from _solve(held, length)
                held, shard = {}, row[0]
            held[row[1:4]] = row[4]
    yield from _solve(held, length)


def _solve(rows: dict[tuple[int, int, int], bytes], length: int) -> Iterator[pa.RecordBatch]:
    if not rows:
        return
    low, high = [], []
    for found in repeated_starts(list(rows.values()), length):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
        low.append(edge[0::2].tolist())
        high.append(edge[1::2].tolist())
    yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in zip(*rows, strict=True)], pa.array(low, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int32()))], [*CLASS, "from", "to"])


def _finer(context: bytes, name: int, length: int, step: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """A context cut into (low, starts, name, class, more, bytes) by where its gram lies in its windows, `step` places together.
    Windows of one part have the bytes between the last start and the first end of such places in common, which name the part:
    equal windows get equal names, as before, but far fewer others do. With a step of 1 the name tells all."""
    starts = len(context) - length + 1
    last = np.uint64((1 << PLACE_BITS) - 1)
    grams = _grams(np.frombuffer(context, np.uint8))[: length - GRAM + 1]
    at = int(last - (((grams & ~last) | (last - np.arange(len(grams), dtype=np.uint64))).min() & last))
    number = lambda data, size: hashlib.blake2b(data, digest_size=size).digest()
    for block in range(max(at - starts + 1, 0) // step, at // step + 1):
        low, high = max(0, at - step * block - step + 1), min(starts - 1, at - step * block)
        core, part = context[at - step * block : at - step * block - step + 1 + length], context[low : high + length]
        own = number(part, 16)
        yield low, high - low + 1, *(int.from_bytes(x, "big", signed=True) for x in (number(b"%d,%d,%d," % (step, name, block) + core, 8), own[:8], own[8:])), part


CLASS = ["name", "class", "more"]
_PART = ["part", "part_class", "part_more"]


def _crowded(contexts: DataFrame) -> DataFrame:
    return stored(contexts.groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > MOST_CLASSES).select("_name"), "crowded")


def _cut_finer(contexts: DataFrame, length: int, step: int) -> DataFrame:
    """CLASS, low, starts, _PART and context of the parts of contexts(CLASS, context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            rows, found = [], []
            for i, (name, context) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)):
                for part in _finer(context, name, length, step):
                    rows.append(i)
                    found.append(part)
            at = pa.array(rows, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(3)], *[pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)]], [*CLASS, "low", "starts", *_PART, "context"])

    return contexts.select(*CLASS, "context").mapInArrow(run, "name long, class long, more long, low int, starts int, part long, part_class long, part_more long, context binary")


def _on(left: list[str], right: list[str]):
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & (F.col(a) == F.col(b))
    return out


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """CLASS, from and to: runs of window starts in each class of contexts(CLASS, context) that are found again elsewhere in
    them. The classes of a name that is not crowded are sorted in one shard; those of one that is are cut finer, up to single
    windows, and what is found of a part holds for all classes that have it."""
    level, ready, above, sure, spent = contexts, None, None, None, []
    for step in (max(1, length // 3), max(1, length // 24), 1):
        crowded = _crowded(level)
        spent.append(crowded)
        if crowded.isEmpty():
            break
        hot = F.col("name") == F.col("_name")
        cool = level.join(crowded, hot, "left_anti")
        finer = stored(_cut_finer(level.join(crowded, hot, "left_semi"), length, step), "finer")
        spent.append(finer)
        ready = cool if ready is None else ready.unionByName(cool)
        own = finer.select(*CLASS, "low", "starts", *_PART)
        if above is not None:
            inner = own.toDF("_name", "_class", "_more", "_low", "_starts", "_p", "_pc", "_pm")
            joined = above.join(inner, _on(_PART, ["_name", "_class", "_more"]), "left")
            own = joined.select(*CLASS, (F.col("low") + F.coalesce("_low", F.lit(0))).alias("low"), F.coalesce("_starts", "starts").alias("starts"), F.coalesce("_p", "part").alias("part"), F.coalesce("_pc", "part_class").alias("part_class"), F.coalesce("_pm", "part_more").alias("part_more"))
        above = stored(own, "above")
        spent.append(above)
        parts = stored(finer.groupBy(*_PART).agg(F.first("context").alias("context"), F.count(F.lit(1)).alias("times")), "parts")
        spent.append(parts)
        # a part that several classes have is repeated as a whole
        twice = parts.where("times > 1").select(*_PART).toDF("_name", "_class", "_more")
        twice = above.join(twice, _on(_PART, ["_name", "_class", "_more"]), "left_semi").select(*CLASS, F.array("low").alias("from"), F.array(F.col("low") + F.col("starts")).alias("to"))
        sure = twice if sure is None else sure.unionByName(twice)
        level = parts.select(*[F.col(p).alias(c) for p, c in zip(_PART, CLASS, strict=True)], "context")
    ready = level if ready is None else ready.unionByName(level)
    # a class alone with its name meets no other
    many = ready.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("context")).alias("b")).where("c > 1")
    many = stored(many.select(F.col("name").alias("_name"), "b"), "many")
    total = many.agg(F.sum("b")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    dealt = ready.join(many, F.col("name") == F.col("_name"), "left_semi").withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))
    dealt = dealt.select("shard", *CLASS, "context").repartition(shards, "shard").sortWithinPartitions("shard")
    solved = dealt.mapInArrow(lambda it: _shard(it, length), "name long, class long, more long, from array<int>, to array<int>").where(F.size("from") > 0)
    if above is None:
        out = stored(solved, "solved")
    else:
        solved = stored(solved, "solved")
        parts = above.select(*_PART).distinct().toDF("_name", "_class", "_more")
        runs = above.join(solved.toDF("_name", "_class", "_more", "from", "to"), _on(_PART, ["_name", "_class", "_more"]))
        moved = lambda name: F.transform(name, lambda x: x + F.col("low")).alias(name)
        out = solved.join(parts, _on(CLASS, ["_name", "_class", "_more"]), "left_anti").unionByName(runs.select(*CLASS, moved("from"), moved("to"))).unionByName(sure)
        out = stored(out, "solved")
        spent.append(solved)
    freed(many, *spent)
    return out


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, and spans (arrays from and to, in bytes) of each row of docs.

    A byte is removed if a string of length bytes that covers it also starts anywhere else in the table, in the same text or
    another; strings are judged on the input. A null text is empty: nothing is removed. Ids may be null or repeat; repeated rows
    are copies of each other, so that each loses all its bytes if it has length or more. Texts are read whole, in tiles, however
    long they are. An empty table gives an empty result. Other columns of docs play no part; if id_col has the name of a new
    column, that one begins with an underscore.

    Texts are moved twice: once to cut out contexts that must be sorted, once to meet their spans."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stored(survey(docs, length).withColumn("row", F.monotonically_increasing_id()), "survey")
    rows = stored(found.where(F.size("first") > 0).select("row", "key"), "rows")
    every = found.where(F.size("first") > 0).select("row", F.explode(F.arrays_zip("first", "starts", *CLASS)).alias("x")).select("row", "x.*")
    # written first, so that both sides of the join are plain exchanges, which AQE may split where a name stands very often
    twice = stored(found.select(F.explode("name").alias("_name")).groupBy("_name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_name"), "names")
    again = stored(every.join(twice, F.col("name") == F.col("_name")).drop("_name"), "again")
    freed(found, twice)
    classes = stored(again.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "first", "starts")).alias("at")), "classes")
    many = stored(classes.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("name").alias("_name")), "many")
    met = classes.join(many, F.col("name") == F.col("_name"), "left_semi").select(*CLASS, "at.*")
    asked = stored(met.join(rows, "row").groupBy("key").agg(F.collect_list(F.struct(*CLASS, "first", "starts")).alias("asked")), "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for b in _lots(batches, 0):
            at, wants = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(1)).to_numpy())]), b.column(1).flatten()
            low, n = (wants.field(k).to_numpy() for k in ("first", "starts"))
            contexts = [t[x : x + m - 1 + length] for i, t in enumerate(texts_of(b.column(0))) for x, m in zip(low[at[i] : at[i + 1]].tolist(), n[at[i] : at[i + 1]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[wants.field(k) for k in CLASS], pa.array(contexts, pa.binary())], [*CLASS, "context"])

    keyed = docs.withColumn("key", _key())
    contexts = keyed.select("key", "text").join(asked.select(F.col("key").alias("_k"), "asked"), F.col("key") == F.col("_k")).select("text", "asked")
    contexts = stored(contexts.mapInArrow(cut, "name long, class long, more long, context binary"), "contexts")
    freed(asked, many)
    solved = _repeats(contexts, length)
    all_ = classes.where("copies > 1").select(*CLASS, F.array(F.lit(0)).alias("from"), F.array("at.starts").alias("to"))
    # all starts of a class with copies are repeated, whatever else was found of it
    verdict = stored(all_.unionByName(solved.join(classes.where("copies > 1").select(*[F.col(c).alias(f"_{c}") for c in CLASS]), _on(CLASS, [f"_{c}" for c in CLASS]), "left_anti")).toDF("_name", "_class", "_more", "from", "to"), "verdict")
    shift = lambda name, by: F.transform(name, lambda x: x + by)
    # a class may have very many copies, and one of a crowded name several rows here: both sides are plain exchanges
    runs = again.join(verdict, _on(CLASS, ["_name", "_class", "_more"])).select("row", F.arrays_zip(shift("from", F.col("first")).alias("a"), shift("to", F.col("first") + length - 1).alias("b")).alias("s"))
    one = rows.groupBy("key").agg(F.min("row").alias("row"))
    spans = stored(runs.groupBy("row").agg(F.flatten(F.collect_list("s")).alias("s")).join(one, "row").select(F.col("key").alias("_k"), "s"), "spans")
    freed(contexts, solved, classes, verdict, again, rows)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in _lots(batches, 1):
            size, removed, n, digest, low, high = [], [], [], [], [], []
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = part.column(2).flatten()
            edges = np.stack([flat.field(k).to_numpy().astype(np.int64) for k in ("a", "b")], 1)
            for i, text in enumerate(texts_of(part.column(1))):
                own = edges[at[i] : at[i + 1]]
                own = own[np.argsort(own[:, 0], kind="stable")]
                reach = np.maximum.accumulate(own[:, 1])
                new = np.flatnonzero(np.concatenate([[len(own) > 0], own[1:, 0] > reach[:-1]])[: len(own)])
                a, z = own[new, 0], reach[np.append(new[1:] - 1, len(own) - 1)] if len(own) else own[:, 1]
                kept = hashlib.sha256()
                for x, y in zip([0, *z.tolist()], [*a.tolist(), len(text)], strict=True):
                    kept.update(text[x:y])
                size.append(len(text))
                removed.append(int((z - a).sum()))
                n.append(len(a))
                digest.append(kept.hexdigest())
                low.append(a.tolist())
                high.append(z.tolist())
            both = pa.StructArray.from_arrays([pa.array(x, pa.list_(pa.int64())) for x in (low, high)], ["from", "to"])
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in (size, removed, n)], pa.array(digest, pa.string()), both], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["id"].dataType.simpleString()
    out = keyed.join(spans, F.col("key") == F.col("_k"), "left").select("id", "text", "s")
    out = out.mapInArrow(drop, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans struct<from:array<long>,to:array<long>>")
    return out.toDF(id_col, *free_name(docs.select(F.col("id").alias(id_col)), *out.columns[1:]))


def op9(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("spans")
