"""The main text of web pages: what stands on one page of a host alone, checked by what markup names as the article.

A page is read as blocks of text with where they stand: in an article, in an element that is never main text (menus, footers, forms,
adverts, comments), or elsewhere. All blocks make up the page's token stream, the article's as well. The streams of a host's pages are
laid side by side in suffix arrays, and token strings of WINDOW or more that stand on distinct pages are repeated. Blocks that are
repeated for the most part are boilerplate, the others are the page's own. Then markup is asked: what is never main text goes in any
case, and an article with blocks of its own gets those back that it shares with other pages, as quotes and copies. An article of which
nothing is its own stays too, unless the page has more text of its own elsewhere: then it is a card that many pages show.

What stands in the one article of a page is no evidence against text of other pages that have none.

No task takes a host. Every window of a stream is named by its least gram, salted by host; equal windows have equal names, and a run
of windows named by one place is a context. First names alone are counted, as packed numbers, and each page learns which of its own
stand on another page; of these alone contexts are made. Equal contexts are one class with the first and last page that has it. The
classes of one name are dealt to one shard, in which a suffix array over all its contexts is built. Classes of a name that very many
have are cut into single windows, which are grouped as they are."""

from __future__ import annotations

import functools
import html as references
import itertools
import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_name
from marginalia.llm.suffix import MOST_SYMBOLS, _doubled, _least, sorted_suffixes
from marginalia.llm.urls import host_of
from marginalia.llm.words import alone, mixed
from marginalia.storage import freed, stored, swept

#: Tokens of the shortest string that counts as repeated, and of a gram that names its windows.
WINDOW, GRAM = 8, 4
#: Tokens of one shard, about, and classes of one name beyond which single windows are grouped.
SHARD_TOKENS, MOST_CLASSES = 500_000, 2_000
#: Pages whose names are packed together (one byte tells them apart), bits of a packed name, characters of html that give one shard of names.
LOT, NAME_BITS, SHARD_CHARS = 256, 44, 40_000_000
#: Tokens that are cut side by side, about.
MOST_TOKENS = 50_000

# Elements by what their content is.
#: Elements that begin and end blocks; all others stand inside of one.
BLOCKS = set(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and is no text to be read.
RAW = set("iframe noembed noframes noscript script style textarea title xmp".split())
#: Elements that hold no main text.
OUTSIDE = set("aside audio button canvas datalist dialog footer form head map menu nav object search select svg template video".split())
OUTSIDE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id, and begins of words, that name the same.
OUTSIDE_WORDS = set("ad ads adbox adsense alert banner consent copyright disqus footer gdpr header login masthead menu modal nav notice notices overlay pager pagination popup promo promotion related respond share sharing signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
OUTSIDE_BEGINS = ("advert", "breadcrumb", "comment", "cookie", "navbar", "navigation", "newsletter", "sidebar")
#: A word behind one of these says what is not there.
NOT_WORDS = {"no", "not", "has", "have", "with", "without"}
#: End tags of other elements don't end these.
FIRM = {"article", "main", "body"}

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

ARTICLE, MAIN, OUT, REST = "article", "main", "out", "rest"


@functools.lru_cache(10_000)
def _outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "main") or name[0] == "h" and name[1:].isdigit():
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("role", "").lower() in OUTSIDE_ROLES:
        return True
    both = [found.get("class", ""), found.get("id", "")]
    # sideBar is side and bar, and sidebar
    for words in [[w.lower() for w in _WORD.findall(value)] for value in (*both, *map(str.lower, both))]:
        for before, w in zip(["", *words], words, strict=False):
            said = w in OUTSIDE_WORDS and not (in_article and w == "header") or w.startswith(OUTSIDE_BEGINS)
            if said and before not in NOT_WORDS and (name != "article" or w.startswith("comment")):
                return True
    return False


@functools.lru_cache(10_000)
def _kind(name: str) -> tuple[str, bool, bool, bool, bool]:
    """An element's name in small letters, and whether it ends blocks, is raw, is void, or may change where text stands."""
    name = name.lower()
    return name, name in BLOCKS, name in RAW, name in VOID, name in BLOCKS or name in OUTSIDE


def blocks(html: str) -> list[tuple[str, int, str]]:
    """The blocks of a page in order: where each stands (ARTICLE, MAIN, OUT, REST), the number of its article, its text."""
    out, held, at = [], [], 0
    stack = [("", REST, 0)]  # open elements: name, where their text stands, number of the article
    articles, size, search = 0, len(html), _TAG.search

    def close() -> None:
        if text := " ".join("".join(held).split()):
            out.append((*stack[-1][1:], text))
        held.clear()

    while at < size:
        tag = search(html, at)
        start, end = tag.span() if tag else (size, size)
        if start > at:
            text = html[at:start]
            held.append(references.unescape(text) if "&" in text else text)
        if not tag:
            break
        at = end
        ending, name, attributes = tag.groups()
        if name is None:
            continue
        name, block, raw, void, moves = _kind(name)
        if block and held:
            close()
        if ending:
            if stack[-1][0] == name and not held:
                stack.pop()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if held and stack[-1][1:] != stack[i - 1][1:]:
                        close()
                    del stack[i:]
                    break
                if stack[i][0] in FIRM and name not in FIRM:
                    break
            continue
        if raw:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if void or not block and attributes.endswith("/"):
            continue
        _, where, number = stack[-1]
        if moves and where != OUT:
            if _outside(name, attributes, where == ARTICLE):
                if held:
                    close()
                where = OUT
            elif name == "article" and where != ARTICLE:
                articles += 1
                where, number = ARTICLE, articles
            elif name == "main" and where == REST:
                where = MAIN
        stack.append((name, where, number))
    if held:
        close()
    return out


def settled(found: list[tuple[str, int, str]]) -> list[tuple[str, bool, bool]]:
    """Of each block its text, whether it may be main text, and whether it stands in what markup names as such: the one article, or
    else a main element, that holds text. Without these all blocks that are not outside may be main text; with several articles, theirs."""
    articles = {n for where, n, _ in found if where == ARTICLE}
    wanted = ARTICLE if articles else MAIN if any(where == MAIN for where, *_ in found) else REST
    sure = len(articles) == 1 or wanted == MAIN
    return [(text, where != OUT if sure else where == wanted, where == wanted and sure) for where, _, text in found]


# Streams --------------------------------------------------------------------------------------------------------------------


def stream(found: list[tuple[str, bool, bool]]) -> list[str]:
    """Tokens of all blocks, each block behind a mark."""
    out = []
    for text, *_ in found:
        out.append("\n")
        out.extend(text.split(" "))
    return out


def _pages(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _numbers(lines: list[str]) -> np.ndarray:
    """A 64-bit number of each token of lines that end with a blank: the sum of its bytes' numbers at their places."""
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    ends = np.flatnonzero(data == 32)
    if not len(ends):
        return np.zeros(0, np.uint64)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return mixed(np.add.reduceat(mixed((place << 8 | data).astype(np.uint64)), begins))


def _cut(pages: Iterator[tuple[list[tuple[str, bool, bool]], str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """The streams of pages (settled() blocks, host), some side by side: number of the first page, numbers of the tokens, where pages
    begin, and the contexts: page, first token, end, name, whether they lie in the settled article."""
    first, lines, sizes, hosts, free, spread = 0, [], [], [], [], []

    tokens = 0

    def cut() -> tuple:
        # a host's tokens are its own: equal ones of other hosts have other numbers
        h = mixed(_numbers(lines) ^ np.repeat(np.array(hosts, np.uint64), sizes))
        at = np.cumsum([0, *sizes])
        if len(h) < WINDOW:
            none = np.zeros(0, np.int64)
            return first, h, at, (none, none, none, none.view(np.uint64), none.astype(bool))
        grams = h[: len(h) - GRAM + 1].copy()
        for k in range(1, GRAM):
            grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - GRAM + 1 + k])
        least = _least(grams, WINDOW - GRAM + 1)
        page = np.repeat(np.arange(len(sizes)), sizes)
        whole = page[WINDOW - 1 :] == page[: len(least)]
        outside = np.concatenate([[0], np.cumsum(np.repeat(np.array(free, bool), spread))])
        sure = outside[WINDOW:] == outside[:-WINDOW]
        # of equal grams in a window the first names it, whatever stands before the window
        begins = np.concatenate([[True], (least[1:] != least[:-1]) | (sure[1:] != sure[:-1]) | ~whole[:-1]]) & whole
        edges = np.append(np.flatnonzero(begins | ~whole), len(least))
        begin, end = edges[:-1], edges[1:] + WINDOW - 1
        begin, end = begin[own := begins[begin]], end[own]
        return first, h, at, (page[begin], begin, end, least[begin], sure[begin])

    for found, host in pages:
        own = [text.count(" ") + 2 for text, *_ in found]
        # as in stream()
        lines += [f"\n {text} " for text, *_ in found]
        sizes.append(sum(own))
        hosts.append(xxhash.xxh64_intdigest(host))
        free += [not sure for *_, sure in found]
        spread += own
        tokens += sizes[-1]
        if tokens > MOST_TOKENS:
            yield cut()
            first, tokens = first + len(sizes), 0
            for held in (lines, sizes, hosts, free, spread):
                held.clear()
    if sizes:
        yield cut()


def _short(names: np.ndarray) -> np.ndarray:
    return names >> np.uint64(64 - NAME_BITS)


def _packed_names(names: np.ndarray) -> bytes:
    """Rising numbers as the first and the steps, in four bytes each where they fit."""
    steps = np.diff(names, prepend=np.uint64(0))
    return names[:1].tobytes() + steps[1:].astype(np.uint32).tobytes() if (steps[1:] < 1 << 32).all() else b"-" + names.tobytes()


def _unpacked_names(blob: bytes) -> np.ndarray:
    if len(blob) % 4:
        return np.frombuffer(blob, np.uint64, offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.uint64, 1), np.frombuffer(blob, np.uint32, offset=8).astype(np.uint64)]))


def _names(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Of each lot of pages (key, host, html) the names by shard, with the number of the page in the lot, and one row of the lot's keys."""
    alone()
    for whole in batches:
        for at in range(0, whole.num_rows, LOT):
            b = whole.slice(at, LOT)
            keys = b.column(0).to_numpy(zero_copy_only=False)
            read = ((settled(blocks(html)), host) for host, html in zip(_pages(b.column(1)), _pages(b.column(2)), strict=True))
            parts = [(_short(name), (first + page).astype(np.uint8)) for first, _, _, (page, _, _, name, _) in _cut(read)]
            names, refs = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(names, kind="stable")
            names, refs = names[order], refs[order]
            once = np.concatenate([[True], (names[1:] != names[:-1]) | (refs[1:] != refs[:-1])])[: len(names)]
            names, refs = names[once], refs[once]
            edges = np.searchsorted(names, [np.uint64((k << NAME_BITS) // shards) for k in range(1, shards)])
            parts = [(k, n, r) for k, (n, r) in enumerate(zip(np.split(names, edges), np.split(refs, edges), strict=True)) if len(n)]
            lot = xxhash.xxh64_intdigest(keys.tobytes())
            lot -= (lot >> 63) << 64
            n = len(parts) + 1
            yield pa.RecordBatch.from_arrays([pa.array([*(k for k, *_ in parts), lot % shards], pa.int32()), pa.array([lot] * n, pa.int64()), pa.array([*(r.tobytes() for *_, r in parts), None], pa.binary()), pa.array([*(_packed_names(x) for _, x, _ in parts), keys.tobytes()], pa.binary())], ["shard", "lot", "refs", "names"])


def _met_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _names() in order of shard, with those names alone that stand on several pages."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        names = [_unpacked_names(r[2]) for r in rows]
        flat = np.sort(np.concatenate(names))
        twice = np.unique(flat[1:][flat[1:] == flat[:-1]])
        out = []
        for (lot, refs, _), own in zip(rows, names, strict=True):
            at = np.searchsorted(twice, own)
            hit = at < len(twice)
            hit[hit] = twice[at[hit]] == own[hit]
            if hit.any():
                out.append((lot, np.frombuffer(refs, np.uint8)[hit].tobytes(), own[hit].tobytes()))
        return _lots(out)

    def _lots(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["lot", "refs", "names"])

    held, shard = [], None
    for b in batches:
        rows = list(zip(*[b.column(k).to_pylist() for k in range(4)], strict=True))
        yield _lots([r[1:] for r in rows if r[2] is None])
        for row in rows:
            if row[0] != shard:
                if held:
                    yield solve(held)
                held, shard = [], row[0]
            if row[2] is not None:
                held.append(row[1:])
    if held:
        yield solve(held)


def _by_page(lot: pa.Table) -> pa.Table:
    """key and names of the pages of a lot that have some."""
    rows = list(zip(*[lot.column(k).to_pylist() for k in ("refs", "names")], strict=True))
    keys = np.frombuffer(next(names for refs, names in rows if refs is None), np.int64)
    # copies of a lot say the same twice
    refs = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r, np.uint8) for r, _ in rows if r is not None)])
    names = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(n, np.uint64) for r, n in rows if r is not None)])
    order = np.lexsort([names, refs])
    found, to = np.unique(refs[order], return_index=True)
    parts = np.split(names[order], to[1:]) if len(found) else []
    return pa.table({"key": pa.array(keys[found], pa.int64()), "names": pa.array([n.tobytes() for n in parts], pa.binary())})


def met_names(pages: DataFrame) -> DataFrame:
    """key and names (shortened, rising, as bytes) of pages(key, host, html) that stand on another page as well."""
    shards = 1 + int(pages.agg(F.sum(F.length("html"))).first()[0] or 0) // SHARD_CHARS
    named = pages.select("key", "host", "html").mapInArrow(lambda batches: _names(batches, shards), "shard int, lot long, refs binary, names binary")
    met = stored(named.repartition(max(2, shards), "shard").sortWithinPartitions("shard").mapInArrow(_met_names, "lot long, refs binary, names binary"), "page-lots")
    out = stored(met.groupBy("lot").applyInArrow(_by_page, "key long, names binary").groupBy("key").agg(F.first("names").alias("names")), "page-met")
    freed(met)
    return out


def contexts(pages: DataFrame) -> DataFrame:
    """key, page, first, name, sure, tokens of those contexts of pages(key, host, blob, names) whose names are among names. page
    tells distinct streams apart; sure are contexts within the article that markup settles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for whole in batches:
            for at in range(0, whole.num_rows, LOT):
                b = whole.slice(at, LOT)
                keys, wanted = b.column(0).to_numpy(zero_copy_only=False), b.column(3).to_pylist()
                read = ((unpacked(blob), host) for host, blob in zip(_pages(b.column(1)), b.column(2).to_pylist(), strict=True))
                for first, h, starts, (page, begin, end, name, sure) in _cut(read):
                    asked = wanted[first : first + len(starts) - 1]
                    on = lambda page, names: page.astype(np.uint64) << np.uint64(NAME_BITS) | names
                    met = np.isin(on(page, _short(name)), on(np.repeat(np.arange(len(asked)), [len(x) // 8 for x in asked]), np.frombuffer(b"".join(asked), np.uint64)))
                    page, begin, end, name, sure = page[met], begin[met], end[met], name[met], sure[met]
                    symbols = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    streams = np.array([xxhash.xxh64_intdigest(symbols[x:y]) for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], np.uint64).view(np.int64)
                    to = np.concatenate([[0], np.cumsum(end - begin)])
                    own = symbols[np.arange(to[-1]) + np.repeat(begin - to[:-1], end - begin)]
                    lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(own))
                    columns = (keys[first + page], streams[page], (begin - starts[page]).astype(np.int32), name.view(np.int64), sure)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["key", "page", "first", "name", "sure", "tokens"])

    return pages.select("key", "host", "blob", "names").mapInArrow(run, "key long, page long, first int, name long, sure boolean, tokens array<int>")


def repeated_windows(contexts: list[np.ndarray], low: np.ndarray, high: np.ndarray, sure: np.ndarray | None = None) -> list[np.ndarray]:
    """For each context, which of its windows stand on distinct pages: in contexts whose first and last pages are not all one. For
    contexts that are not sure, those that are do not count."""
    sure = np.zeros(len(contexts), bool) if sure is None else sure
    sizes = np.array([len(c) for c in contexts])
    symbols, ranked = np.unique(np.concatenate(contexts), return_inverse=True)
    to = np.cumsum(sizes + 1)
    joined = np.ones(to[-1] + 1, np.int64)
    joined[-1] = 0
    inside = np.ones(len(joined), bool)
    inside[to - 1] = inside[-1] = False
    joined[inside] = ranked + 2
    order = sorted_suffixes(joined.astype(np.uint16)) if len(symbols) + 2 <= MOST_SYMBOLS else _doubled(joined)
    own = np.repeat(np.arange(len(sizes) + 1), [*(sizes + 1), 1])
    whole = np.arange(len(joined)) + WINDOW <= np.append(to - 1, -1)[own]
    order = order[whole[order]].astype(np.int64)
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for k in range(WINDOW):
        same &= joined[order[1:] + k] == joined[order[:-1] + k]
    first = np.flatnonzero(np.concatenate([[True], ~same])[: len(order)])
    out = np.zeros(len(joined), bool)
    if len(order):
        a, b, inside = low[own[order]], high[own[order]], sure[own[order]]
        apart = lambda a, b: np.repeat(np.minimum.reduceat(a, first) < np.maximum.reduceat(b, first), np.diff(np.append(first, len(order))))
        most = np.iinfo(np.int64)
        out[order] = np.where(inside, apart(a, b), apart(np.where(inside, most.max, a), np.where(inside, most.min, b)))
    return [out[z - n - 1 : z - 1 - WINDOW + 1] for n, z in zip(sizes.tolist(), to.tolist(), strict=True)]


def _runs(found: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    return edge[0::2].tolist(), edge[1::2].tolist()


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, name, class, sure, low, high, tokens) in order of shard to (name, class, sure, a, b), a row for each run of tokens."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        name, kind, sure, low, high = (np.array([r[k] for r in rows]) for k in range(5))
        # the context of a name that has no other asks no array: its windows are repeated all or none
        _, at, many = np.unique(name, return_inverse=True, return_counts=True)
        several = np.flatnonzero(many[at] > 1)
        runs = [([0], [len(r[5]) - WINDOW + 1]) if r[3] < r[4] else ([], []) for r in rows]
        if len(several):
            for i, found in zip(several.tolist(), repeated_windows([rows[i][5] for i in several.tolist()], low[several], high[several], sure[several]), strict=True):
                runs[i] = _runs(found)
        begins, ends = zip(*runs, strict=True)
        own = np.repeat(np.arange(len(rows)), [len(x) for x in begins])
        a, b = (np.array(list(itertools.chain(*x)), np.int32) for x in (begins, ends))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (name[own], kind[own], sure[own], a, b + np.int32(WINDOW - 1))], ["name", "class", "sure", "a", "b"])

    held, shard = [], None
    for b in batches:
        tokens = b.column(6)
        to, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        for i, row in enumerate(zip(*[b.column(k).to_pylist() for k in range(6)], strict=True)):
            if row[0] != shard:
                if held:
                    yield solve(held)
                held, shard = [], row[0]
            held.append((*row[1:], flat[to[i] : to[i + 1]]))
    if held:
        yield solve(held)


def covered(found: DataFrame) -> DataFrame:
    """key and spans (first token and end, as a * 2 ** 32 + b) of what contexts() of a page have in common with distinct pages."""
    kind = ["name", "class", "sure"]
    named = lambda df: df.withColumn("class", F.xxhash64("tokens"))
    classes = stored(found.groupBy("name", "sure", "tokens").agg(F.min("page").alias("low"), F.max("page").alias("high")), "page-classes")
    shards = max(1, -(-int(classes.agg(F.sum(F.size("tokens"))).first()[0] or 0) // SHARD_TOKENS))
    # at most one name of MOST_CLASSES rows
    names = stored(classes.groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > MOST_CLASSES).select("_name"), "page-names")
    met = lambda how: named(classes).join(F.broadcast(names), F.col("name") == F.col("_name"), how)
    dealt = met("left_anti").select(F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"), *kind, "low", "high", "tokens")
    solved = dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_sorted_shards, "name long, class long, sure boolean, a int, b int")
    # the windows of crowded names one by one
    single = met("left_semi").select(*kind, "low", "high", F.explode(F.transform(F.sequence(F.lit(0), F.size("tokens") - WINDOW), lambda i: F.struct(i.alias("at"), F.slice("tokens", i + 1, WINDOW).alias("w")))).alias("x"))
    free = lambda c: F.when(~F.col("sure"), F.col(c))
    twice = single.groupBy(F.col("x.w").alias("_w")).agg((F.min("low") < F.max("high")).alias("anywhere"), F.coalesce(F.min(free("low")) < F.max(free("high")), F.lit(False)).alias("outside")).where("anywhere")
    single = single.join(twice, F.col("x.w") == F.col("_w")).where("sure or outside").select(*kind, F.col("x.at").alias("a"), (F.col("x.at") + WINDOW).alias("b"))
    verdict = stored(solved.unionByName(single).toDF(*[f"_{c}" for c in kind], "a", "b"), "page-verdict")
    freed(classes, names)
    same = functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in kind])
    spans = named(found).select("key", "first", *kind).join(verdict, same).select("key", ((F.col("first") + F.col("a")).cast("long") * F.lit(1 << 32) + F.col("first") + F.col("b")).alias("s"))
    out = stored(spans.groupBy("key").agg(F.collect_list("s").alias("s")), "page-spans")
    freed(verdict)
    return out


# Text -----------------------------------------------------------------------------------------------------------------------


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()


def packed(found: list[tuple[str, bool, bool]]) -> bytes:
    """settled() blocks as compressed bytes, one a line: what is moved of a page."""
    return _zstd()[0].compress("\n".join([f"{may + 2 * sure}{text}" for text, may, sure in found]).encode())


def unpacked(blob: bytes) -> list[tuple[str, bool, bool]]:
    lines = _zstd()[1].decompress(blob).decode()
    return [(x[1:], x[0] in "13", x[0] in "23") for x in lines.split("\n")] if lines else []


def main_text(blob: bytes, spans: np.ndarray) -> tuple[str, int]:
    """Of packed() blocks those that stay, joined by blanks, and how many tokens are covered by spans. A block is the page's own if no
    more than half of its tokens are covered; markup then has the last word, as said above."""
    found = unpacked(blob)
    sizes = [text.count(" ") + 1 for text, *_ in found]
    count = lambda x: np.bincount(x, minlength=sum(sizes) + len(sizes) + 1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(count(spans >> 32) - count(spans & 0xFFFFFFFF)) > 0)])
    end = np.cumsum(np.array(sizes, np.int64) + 1)
    covered = (hit[end] - hit[end - sizes]).tolist() if sizes else []
    repeated = sum(covered)
    stay = [may and 2 * c <= n for (_, may, _), c, n in zip(found, covered, sizes, strict=True)]
    article = [sure for *_, sure in found]
    if any(article):
        elsewhere = sum(n for n, keep, sure in zip(sizes, stay, article, strict=True) if keep and not sure)
        confirmed = any(keep and sure for keep, sure in zip(stay, article, strict=True))
        if confirmed or elsewhere <= sum(n for n, sure in zip(sizes, article, strict=True) if sure):
            stay = article
    return " ".join(text for (text, *_), keep in zip(found, stay, strict=True) if keep), repeated


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars (code points of text) and n_repeated of each row of pages.

    n_repeated counts the page's tokens, in the article and outside of it, that stand in strings of WINDOW tokens or more on distinct
    pages of the host. Pages whose streams are equal are one page: copies of a page don't make its text boilerplate. A null or empty html
    gives an empty text; a null url is a host of its own. Ids may be null or repeat. Pages are read whole, however long they are;
    tags without an end, end tags without a begin and ends that are cut off are read as browsers read them, but that only the end
    tag of an article, of main or body ends these. An empty table gives an empty result. Other columns of pages play no part; if
    id_col or url_col has the name of a new column, that one begins with an underscore."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    keyed = own.withColumn("key", F.xxhash64("url", "html")).withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    kinds = [own.schema[c].dataType.simpleString() for c in ("id", "url")]

    def move(rows: DataFrame, kinds: str) -> DataFrame:
        names = [*rows.columns[:-1], "blob"]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, LOT):
                    b = whole.slice(at, LOT)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([packed(settled(blocks(x))) for x in _pages(b.columns[-1])], pa.binary())], names)

        return rows.mapInArrow(pack, f"{kinds}, blob binary")

    read = keyed.where("html <> ''").select("key", "host", "html")
    met = met_names(read)
    # copies of a page, with its address, are cut into contexts once
    once = move(read, "key long, host string").groupBy("key").agg(F.first("host").alias("host"), F.first("blob").alias("blob"))
    found = stored(contexts(once.join(met.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"))), "page-contexts")
    freed(met)
    # a job's last events are handled after it returns, and hold on to its shuffle files until then: here, all pages
    time.sleep(1)
    swept(pages.sparkSession)
    spans = covered(found)
    freed(found)
    moved = move(keyed.select("key", "id", "url", "html"), f"key long, id {kinds[0]}, url {kinds[1]}")
    both = moved.join(spans.select(F.col("key").alias("_key"), "s"), F.col("key") == F.col("_key"), "left").select("id", "url", "blob", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = b.column(3)
                to, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                texts = [main_text(blob, flat[x:y]) for blob, x, y in zip(b.column(2).to_pylist(), to[:-1].tolist(), to[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([n for _, n in texts], pa.int64())], ["id", "url", "text", "n_chars", "n_repeated"])

    out = both.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long, n_repeated long")
    first = [id_col, url_col]
    return out.toDF(*first, *free_name(own.select(F.col("id").alias(id_col), F.col("url").alias(url_col)), *out.columns[2:]))


def op12(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
