"""How the tokens of two tokenizers lie over each other in the same texts.

The tokens of both cover the same bytes. Tokens that overlap are linked; a union-find over this bipartite graph gives components,
which are the smallest groups of neighbouring tokens after which both tokenizers end together. Links of a component are counted
over the whole corpus for each pair of ids, and each document is told how well its own links agree with these counts.

Both tokenizers cut a text at certain blanks whatever stands around them, so that a text's groups are those of its chunks one after
the other; each distinct chunk is aligned once for many documents. Documents are worked on in blocks of bounded size: a block keeps
its documents as numbers of chunks, and its distinct pairs of ids with their times. Pairs are summed over all blocks, and each block
gets the sums of its own pairs back, so that no link of a document is ever moved and no table of pairs is sent to every task."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import free_name
from marginalia.llm.packing import _AS_LETTERS
from marginalia.llm.words import Cache, alone
from marginalia.storage import stored

#: Letters and rows of one block at most, but for one long text.
BLOCK_LETTERS, BLOCK_ROWS = 1_000_000, 5_000
#: Letters encoded in one call.
CALL_LETTERS = 50_000
#: Blocks for one task where blocks meet the sums of their pairs.
TASK_BLOCKS = 16
#: Chunks that a worker keeps aligned, and as many that it has laid aside.
KEPT_CHUNKS = 80_000

#: A chunk begins with a blank or a line end behind something that is no white space, and goes on to the next such place.
_CHUNK = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
SPACE = "▁"
#: Fixed value: where byte-level tokenizers cut texts before they merge.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def components(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """The root of each of n_a + n_b nodes, the least node of its component, for edges from a to n_a + b: each root is hooked to
    the least root it is linked with, and paths are halved until all nodes show roots, until no edge joins two roots."""
    up = np.arange(n_a + n_b)
    left, right = a, b + n_a
    while True:
        x, y = up[left], up[right]
        apart = x != y
        if not apart.any():
            return up
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


class Aligner(Cache):
    """Chunks to (number of A tokens, of B tokens, of groups, groups as text, linked pairs as bytes of a << 32 | b, whether one of
    the two does not give the chunk's bytes). A str stands for itself after a blank, unless it begins with a line end; bytes are
    a chunk as it is."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__(None, KEPT_CHUNKS)
        self.a_path, self.b = a_path, SentencePieceProcessor(model_file=b_path)
        letter = {code: byte for byte, code in _AS_LETTERS.items()}
        form = json.loads(Path(a_path).read_text())
        entries = {i: t for t, i in form["model"]["vocab"].items()} | {t["id"]: t["content"] for t in form["added_tokens"]}
        self.a_bytes = [bytes(letter.get(ord(c), ord(c) & 255) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes))
        # each id with what follows it: of A "," or at a group's end "|", of B "," or ";"
        self.written = [f"{i}{mark}" for own, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(own))]
        cut = form["pre_tokenizer"] or {}
        #: whether no token of either can hold the end of one chunk and the begin of the next
        self.cuts = (
            not form["normalizer"] and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
            and not any(SPACE in p.lstrip(SPACE) or "\n" in p for i, p in enumerate(pieces) if not self.b.is_byte(i))
            and b"".join(self.b_bytes[i] for i in self.b.encode(" a  b \n c ")) == b"  a  b \n c "
        )
        self.fast = self._by_rank(form) if self.cuts else None

    def _by_rank(self, form: dict):
        """The same encoding by ranks, which is several times as fast, where ids follow the order of merges."""
        import tiktoken

        merges = [m if isinstance(m, list) else m.split(" ") for m in form["model"]["merges"]]
        made = [form["model"]["vocab"].get(x + y) for x, y in merges]
        ranks = {t: i for i, t in enumerate(self.a_bytes) if len(t) == 1} | {self.a_bytes[i]: i for i in made if i is not None}
        if None in made or made != sorted(set(made)) or sum(len(t) == 1 for t in ranks) != 256 or len(ranks) != 256 + len(made):
            return None
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.fast else self.a.encode(text, add_special_tokens=False).ids

    @functools.cached_property
    def a(self):
        """The tokenizer itself, which is loaded only where ranks do not do."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.a_path)
        out.encode_special_tokens = True
        return out

    def chunks(self, text: str) -> list[str | bytes]:
        """The keys of a text's chunks, in order; of an empty text none."""
        if not text:
            return []
        if not self.cuts:
            return [b" " + text.encode()]
        words, own = text.split(), text.replace("\n", " \n").split(" ")
        # each blank or line end alone between two words
        if len(words) == len(own) and len(" ".join(words)) == len(text):
            return own
        return [c.encode() for c in _CHUNK.findall(" " + text)]

    def learn(self, keys: list[str | bytes]) -> list[tuple]:
        """The records of keys, of which new ones are aligned together."""
        lot, held = [], 0
        for k in [k for k in keys if k not in self]:
            if k in self.aside:
                self[k] = self.aside[k]
                continue
            text = k.decode() if isinstance(k, bytes) else k if k[0] == "\n" else " " + k
            # a chunk that ends with white space ends a text, and must end what is encoded
            if not self.cuts or text[-1].isspace() or SPACE in text:
                self._align([k], [text])
                continue
            lot.append((k, text))
            held += len(text)
            if held >= CALL_LETTERS:
                self._align(*map(list, zip(*lot, strict=True)))
                lot, held = [], 0
        if lot:
            self._align(*map(list, zip(*lot, strict=True)))
        return [self[k] for k in keys]

    def _align(self, keys: list, texts: list[str]) -> None:
        # B puts a blank before its text, and chunks that begin with a line end have none: a chunk " a" goes first where it may
        lead = " a" if self.cuts else ""
        whole = lead + "".join(texts)
        data = whole.encode()
        a, b = np.array(self._a_ids(whole)), np.array(self.b.encode(whole[1:], num_threads=1))
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            if len(keys) == 1:
                self[keys[0]] = (0, 0, 0, "", b"", True)
            else:
                for k, t in zip(keys, texts, strict=True):
                    self._align([k], [t])
            return
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # two tokens that overlap do so over one stretch without a token's end inside: an end is the end of one link
        end = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        end = end[np.diff(end, prepend=0) > 0]
        x, y = np.searchsorted(a_end, end), np.searchsorted(b_end, end)
        root = components(x, y, len(a), len(b))[x]
        new = np.flatnonzero(np.diff(root, prepend=-1))
        chunk_end = np.cumsum([len(t.encode()) for t in [lead, *texts]])
        link_to, a_to, b_to = (np.searchsorted(e, chunk_end, side="right").tolist() for e in (end, a_end, b_end))
        group_to = np.searchsorted(new, link_to).tolist()
        pairs = ((a[x] << 32) | b[y]).astype("<i8")
        # the tokens of A of a group, then those of B, each with its mark
        low_a, low_b = np.append(x[new], len(a)), np.append(y[new], len(b))
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[low_a[1:] - 1], ends_b[low_b[1:] - 1] = True, True
        marked = np.empty(len(a) + len(b), np.int64)
        marked[np.arange(len(a)) + np.repeat(low_b[:-1], np.diff(low_a))] = a + len(self.a_size) * ends_a
        marked[np.arange(len(b)) + np.repeat(low_a[1:], np.diff(low_b))] = b + 2 * len(self.a_size) + len(self.b_size) * ends_b
        written, to = list(map(self.written.__getitem__, marked.tolist())), [i + j for i, j in zip(a_to, b_to, strict=True)]
        for n, k in enumerate(keys):
            self[k] = (a_to[n + 1] - a_to[n], b_to[n + 1] - b_to[n], group_to[n + 1] - group_to[n], "".join(written[to[n] : to[n + 1]])[:-1], pairs[link_to[n] : link_to[n + 1]].tobytes(), False)


@functools.cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], letters: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, null ones empty, of BLOCK_ROWS rows and so many letters at most."""
    for b in batches:
        at, held, texts = 0, 0, []
        for i, text in enumerate(b.column(1)):
            text = text.as_py() or ""
            if texts and (held + len(text) > letters or len(texts) == BLOCK_ROWS):
                yield b.column(0).slice(at, i - at), texts
                at, held, texts = i, 0, []
            texts.append(text)
            held += len(text)
        if texts:
            yield b.column(0).slice(at), texts


_LONGS = ["n_a", "n_b", "n_groups", "n_links"]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([r.tolist() if len(r) < 8 else r for r in rows], pa.list_(kind))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers as compressed bytes, behind their lengths."""
    sizes = np.array([len(x) for x in arrays])
    return zstandard.compress(np.concatenate([sizes, *arrays]).astype("<i4").tobytes(), 1)


def _unpacked(body: bytes, arrays: int) -> list[np.ndarray]:
    whole = np.frombuffer(zstandard.decompress(body), "<i4")
    return np.split(whole[arrays:], np.cumsum(whole[: arrays - 1]))


def aligned(docs: DataFrame, a_path: str, b_path: str, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """A row for each block of rows of docs(id, text): block, of each document its id, counts and groups_sha256, the block's distinct
    pairs in order with how often they are linked (times), and a body of four arrays, compressed: how many chunks each document has,
    their numbers, how many links each chunk has, their places in pairs."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, number = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        alone(cache)
        for ids, texts in _blocks(batches, block_letters):
            cache.trim()
            numbers = _Numbers()
            chunks = [np.fromiter(map(numbers.__getitem__, cache.chunks(t)), np.int32) for t in texts]
            records = cache.learn(list(numbers))
            count = [np.fromiter((r[k] for r in records), np.int64, len(records)) for k in range(3)]
            bad, groups = np.fromiter((r[5] for r in records), bool, len(records)), [r[3] for r in records]
            chunks = [c if not bad[c].any() else c[:0] for c in chunks]
            digests = [hashlib.sha256(";".join(map(groups.__getitem__, c.tolist())).encode()).hexdigest() if len(c) else "" for c in chunks]
            flat, sizes = np.concatenate(chunks), np.array([len(c) for c in chunks])
            times = np.bincount(flat, minlength=len(records))
            own = np.where(times > 0, np.fromiter((len(r[4]) // 8 for r in records), np.int64, len(records)), 0)
            pairs = np.frombuffer(b"".join(r[4] for r, n in zip(records, times, strict=True) if n), "<i8")
            pairs, pair_at = np.unique(pairs, return_inverse=True)
            often = np.bincount(pair_at, np.repeat(times, own), len(pairs)).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x[flat])]) for x in (*count, own)]
            to = np.cumsum(sizes)
            per = [s[to] - s[to - sizes] for s in sums]
            columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[_lists([x], pa.int64()) for x in per], pa.array([digests], pa.list_(pa.string()))]
            columns += [pa.array([_packed(sizes, flat, own, pair_at)], pa.binary()), *[_lists([x], pa.int64()) for x in (pairs, often)]]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", *_LONGS, "digests", "body", "pairs", "times"])
            number += 1

    longs = ", ".join(f"{c} array<long>" for c in _LONGS)
    return docs.mapInArrow(run, f"block long, ids array<{kind}>, {longs}, digests array<string>, body binary, pairs array<long>, times array<long>")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n, and whether no other pair with the same b has more links."""
    n = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    # a window holds the pairs of one id of B, as many as A has ids at most
    best = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return n.select("pair", "n", (F.col("n") == best).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs.

    Text A is a blank and the text, encoded by a byte-level BPE of the library tokenizers; B is the text, encoded by a BPE model of
    sentencepiece, which adds the blank. Texts that are null or empty, or whose bytes one of the two does not give back, have no
    tokens: their numbers are 0 and their digest is empty. Ids may be null or repeat; each row is aligned and counted on its own.
    Texts are read whole, however long they are. An empty table gives an empty result. Other columns of docs play no part; if
    id_col has the name of a new column, that one begins with an underscore."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(aligned(docs, a_path, b_path, block_letters), "aligned")
    tasks = max(1, -(-blocks.count() // TASK_BLOCKS))
    counts = stored(pair_counts(blocks), "pair-counts")
    asked = blocks.select(F.col("block").alias("_block"), F.explode("pairs").alias("_pair")).join(counts, F.col("_pair") == F.col("pair"))
    sums = asked.select("_block", "pair", "n", "best").repartition(tasks, "_block").groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("s"))
    light = blocks.drop("pairs", "times").repartition(tasks, "block")
    both = light.join(sums, F.col("block") == F.col("_block"), "left").withColumns({"n": F.col("s.n"), "best": F.col("s.best")})
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                flat = lambda name, row=row: row.column(name).flatten()
                sizes, chunks, own, pair_at = _unpacked(row.column("body")[0].as_py(), 4)
                to, chunk_to, out = np.cumsum(sizes), np.cumsum(own), []
                for value in (flat("best"), flat("n")):
                    value = value.to_numpy(zero_copy_only=False).astype(np.int64)
                    total = np.concatenate([[0], np.cumsum(value[pair_at])])
                    total = np.concatenate([[0], np.cumsum((total[chunk_to] - total[chunk_to - own])[chunks])])
                    out.append(pa.array(total[to] - total[to - sizes], pa.int64()))
                yield pa.RecordBatch.from_arrays([flat("ids"), *[flat(c) for c in _LONGS], *out, flat("digests")], ["id", *_LONGS, "n_best", "count_sum", "groups_sha256"])

    out = both.select("ids", *_LONGS, "digests", "body", "n", "best").mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in _LONGS)}, n_best long, count_sum long, groups_sha256 string")
    return out.toDF(id_col, *free_name(docs.select(F.col("id").alias(id_col)), *out.columns[1:]))


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
