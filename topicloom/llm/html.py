"""Main text of web pages: page structure first, then repeats across the pages of a host.

A page is cut into blocks outside of elements that are boilerplate by their name, role or
class. Where it has article or main elements, the blocks in them are the text.

All blocks of all pages are then judged by what repeats on their host. The token streams of its pages are
searched by suffix arrays for substrings of ``REPEAT`` tokens or more that ``TEXTS`` pages or more share.
A block goes where such substrings cover all of its tokens and it stands beside at least ``TEXTS`` distinct other texts:
the longest other block of a page that is on no more pages of the host, and has a quarter of the
block's words or more. Copies of an article have the same longest other block and count once, so
they stay. What is known to repeat is no text to stand beside, so the search is repeated without it until it
finds nothing more: a menu goes where a longer notice stands on the same pages. Runs that no other pages share are kept, and words inside a block are never cut out.

Articles and their lines are copied between pages too. So of the article or main element with most text of a page a block goes
only where such texts, blocks of the same element, are ``MAIN_TEXTS`` or more and as many as more than half
of the distinct pages of the host; and none goes where nothing else would be left of that element.

A suffix array holds the streams of a few MB of pages, sorted as deep as ``REPEAT`` tokens; it
gives each substring of that length with its number of pages, and Spark adds these up over the
whole host. So a host may have any number of pages, and none of them is compared in part only.

Cases: a null or empty html has an empty text; markup that never closes ends with the page;
a page without repeats keeps all its runs; repeated rows of one page are the same page and
don't count as a repeat; null URLs and those without a host share one host; equal texts are each returned; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topicloom.llm.common import slices, small_batches
from topicloom.llm.url_rules import host_of
from topicloom.scratch import materialize
from topicloom.skew import HOT_FRACTION, MIN_HOT_ROWS, hot_join, join_apart

REPEAT, TEXTS = 5, 5
#: Of a page's largest article: distinct texts beside a block, besides more than half of its host's pages.
MAIN_TEXTS = 20
#: Where a block stands: in the largest article, in another place that is kept; 0 is outside.
MAIN, LOOSE = 1, 2
RAW = "script|style|noscript|template|textarea|title|iframe|object|svg|math|xmp|noframes|noembed"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu "
    "nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "nav footer aside form head select button menu dialog audio video canvas map datalist".split()
)
CONTAINERS = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu form".split())
#: Words of class and id that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist reply replies disqus respond related "
    "recommended share sharing social widget pagination pager toolbar skip copyright".split()
)
#: Words that may stand beside marks in the name of a marked element.
BESIDE = frozenset(
    "area bar block bottom box button buttons container content form global icon icons inner item items "
    "left link links list main outer page post right section site slot text top unit wrap wrapper".split()
)
#: Elements whose start ends an open one of the same kind.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
OPEN = pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64()), ("main", pa.bool_())]))
SEEN = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("place", pa.int32())]))
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _marked(token: str) -> bool:
    """Whether a class or id names boilerplate: all of its words do, but for neutral ones."""
    words = re.findall(r"[a-z0-9]+", token)
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in BESIDE for w in words)


def _boilerplate(name: str, rest: str, inside: bool) -> str | None:
    """Why an element is dropped: for what it is, or for a mark, which may be wrong; else None."""
    if name == "form":
        return "mark"
    if name in DROPPED or (name == "header" and not inside):
        return "kind"
    if not rest.strip() or name in ("html", "body", "main"):
        return None
    fields = {k.lower(): (v or "").strip("\"'").lower() for k, v in ATTRIBUTE.findall(rest)}
    if "hidden" in fields or fields.get("aria-hidden") == "true" or fields.get("role") in ROLES:
        return "kind"
    if re.search(r"display\s*:\s*none", fields.get("style", "")):
        return "kind"
    tokens = f"{fields.get('class', '')} {fields.get('id', '')}".split()
    return "mark" if any(map(_marked, tokens)) else None


def _tags(page: str) -> Iterator[tuple[str, str, int, str]]:
    """Text, breaks, and the start and end of elements: (kind, text or name, number, attributes).

    Elements have numbers in order of their start. End tags that pages may leave out are implied:
    a block ends an open paragraph, an item the item before it, and an end what is open in it.
    Unmatched end tags are skipped. The work is linear in the page.
    """
    open_: list[tuple[str, int]] = []
    blocks_: list[int] = []  # places of open blocks in ``open_``
    many: Counter[str] = Counter()
    number = at = 0

    def close(down_to: int):
        while len(open_) > down_to:
            name, n = open_.pop()
            many[name] -= 1
            if blocks_ and blocks_[-1] == len(open_):
                blocks_.pop()
            yield "end", name, n, ""

    for tag in TAG.finditer(page):
        if tag.start() > at:
            yield "text", page[at : tag.start()], 0, ""
        at = tag.end()
        if tag[3] is None:
            continue
        name = tag[3].lower()
        if tag[2]:
            if name in BLOCKS:
                yield "break", name, 0, ""
            if many[name]:
                down = len(open_) - 1
                while open_[down][0] != name:
                    down -= 1
                yield from close(down)
            continue
        if name in BLOCKS and name != "br":
            if blocks_ and open_[blocks_[-1]][0] == "p":
                yield from close(blocks_[-1])
            if blocks_ and open_[blocks_[-1]][0] in ENDED.get(name, ()):
                yield from close(blocks_[-1])
        if name in BLOCKS:
            yield "break", name, 0, ""
        if name not in VOID and not tag[4].rstrip().endswith("/"):
            if name in BLOCKS:
                blocks_.append(len(open_))
            open_.append((name, number))
            many[name] += 1
            yield "start", name, number, tag[4]
            number += 1
    if at < len(page):
        yield "text", page[at:], 0, ""
    yield from close(0)


def blocks(page: str, whole: bool = False) -> tuple[list[str], bool]:
    """Blocks of text without boilerplate, and whether they come from an article or main.

    A mark counts for nothing on an element that holds more than half of the page's text.
    ``whole`` adds the blocks outside of the article.
    """
    found, own = placed_blocks(page, whole)
    return [block for block, _ in found], own


def placed_blocks(page: str, whole: bool = False) -> tuple[list[tuple[str, int]], bool]:
    """``blocks``, each with the number of the innermost article or main that holds it, else 0."""
    events = list(_tags(page))
    # Characters of text in each element that a mark could drop.
    length, begun, extent = 0, {}, {}
    for kind, name, n, rest in events:
        if kind == "text":
            length += len("".join(name.split()))
        elif kind == "start" and (rest.strip() or name == "form"):
            begun[n] = length
        elif kind == "end" and n in begun:
            extent[n] = length - begun.pop(n)
    held: list[tuple[str, int]] = []  # text or break, and its container
    dropped: int | None = None
    containers = [0]
    for kind, name, n, rest in events:
        if kind == "text":
            if dropped is None:
                held.append((entities.unescape(name), containers[-1]))
        elif kind == "break":
            if dropped is None:
                held.append(("\n", containers[-1]))
        elif kind == "start":
            if dropped is None:
                why = _boilerplate(name, rest, containers[-1] > 0)
                if why == "kind" or (why == "mark" and extent.get(n, 0) * 2 <= length):
                    dropped = n
            if name in CONTAINERS:
                containers.append(n + 1)
        else:
            if name in CONTAINERS:
                containers.pop()
            if dropped == n:
                dropped = None
    own = any(inside and part.strip() for part, inside in held)
    found, run, at = [], [], 0
    for part, inside in [*held, ("\n", 1)]:
        if own and not inside and not whole:
            continue
        if part == "\n":
            block = " ".join("".join(run).split())
            if block:
                found.append((block, at))
            run = []
        else:
            if not any(map(str.strip, run)):
                at = inside
            run.append(part)
    return found, own


def _main(found: list[tuple[str, int]], own: bool) -> int | None:
    """The number of the article with most text."""
    size: Counter[int] = Counter()
    for block, at in found:
        size[at] += len(block)
    return max(size, key=size.get) if own else None


def parsed(pages: DataFrame) -> DataFrame:
    """Written row, host, page_id, url, blocks, open, whole, seen.

    ``open`` has place and hash of the blocks, and whether they are of the largest article. ``whole`` has the blocks
    outside of articles too, null where there are none. ``seen`` has the hash of every distinct block, the number of
    its words and where it stands. Hashes differ between hosts.
    """
    import xxhash

    kind = pages.schema["page_id"].dataType.simpleString()
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                found, opened, wholes, seen = [], [], [], []
                for host, page in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    seed = xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))
                    named = lambda b: xxhash.xxh64_intdigest(b.encode("utf-8", "replace"), seed) - (1 << 63)
                    inner, own = placed_blocks(page)
                    main = _main(inner, own)
                    found.append([b for b, _ in inner])
                    opened.append([{"at": i, "h": named(b), "main": at == main} for i, (b, at) in enumerate(inner)])
                    every = blocks(page, whole=True)[0] if own else found[-1]
                    wholes.append(every if every != found[-1] else None)
                    places = {b["h"]: 0 for b in opened[-1]}
                    for b in opened[-1]:
                        places[b["h"]] |= MAIN if b["main"] else LOOSE
                    words = {named(b): len(b.split()) for b in [*every, *found[-1]]}
                    seen.append([{"h": h, "n": n, "place": places.get(h, 0)} for h, n in words.items()])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(found, pa.list_(pa.string())),
                    pa.array(opened, OPEN), pa.array(wholes, pa.list_(pa.string())), pa.array(seen, SEEN),
                ], names=["page_id", "url", "host", "blocks", "open", "whole", "seen"])

    source = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), source)
    found = rows.mapInArrow(
        run, f"page_id {kind}, url string, host string, blocks array<string>, open array<struct<at: int, h: bigint, main: boolean>>, "
        "whole array<string>, seen array<struct<h: bigint, n: int, place: int>>"
    )
    return materialize(found.select(F.monotonically_increasing_id().alias("row"), "*"), "html-blocks")


def suffix_ranks(tokens: np.ndarray, least: int) -> np.ndarray:
    """Rank of each suffix by its first ``least`` tokens, by prefix doubling; equal ones share it."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    length = 1
    while length < least:
        step = min(length, least - length)  # the last doubling overlaps
        second = np.full(n, -1)
        second[: max(n - step, 0)] = rank[step:]
        order = np.lexsort((second, rank))
        differs = (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(differs)])
        length += step
    return rank


def shared(tokens: np.ndarray, page: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct substrings of ``least`` tokens within one page: a place where each begins, and
    its number of distinct pages. ``tokens`` are those of all pages, ``page`` rises."""
    whole = np.zeros(len(tokens), bool)
    whole[: max(len(tokens) - least + 1, 0)] = page[: max(len(tokens) - least + 1, 0)] == page[least - 1 :]
    places = np.flatnonzero(whole)
    if not len(places):
        return places, places
    rank = suffix_ranks(tokens, least)[places]
    order = np.lexsort((page[places], rank))
    r, p = rank[order], page[places][order]
    first = np.concatenate([[True], np.diff(r) != 0])
    other = first | np.concatenate([[True], np.diff(p) != 0])
    return places[order][first], np.add.reduceat(other.astype(np.int64), np.flatnonzero(first))


def _streams(hosts: list[str], pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of pages, which differ between hosts, and the number of each token's page."""
    import xxhash

    known: dict[tuple[str, str], int] = {}
    tokens, lengths = [], []
    for host, page in zip(hosts, pages):
        seed = xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))
        before = len(tokens)
        for word in " ".join(page).split():
            if (host, word) not in known:
                known[host, word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), seed)
            tokens.append(known[host, word])
        lengths.append(len(tokens) - before)
    return np.array(tokens, np.uint64), np.repeat(np.arange(len(pages)), lengths)


def _names(tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit name of the ``REPEAT`` tokens at each place."""
    found = np.zeros(len(places), np.uint64)
    for k in range(REPEAT):
        found = (found ^ tokens[places + k]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found.view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            tokens, page = _streams(part.column(0).to_pylist(), part.column(1).to_pylist())
            places, pages = shared(tokens, page, REPEAT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_names(tokens, places)), pa.array(pages, pa.int64())], names=["name", "pages"]
            )


def substrings(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Written names of the token substrings that ``TEXTS`` pages or more of a host share.

    Only hosts of the pages ``marked``, which may lose blocks, are searched, all pages of theirs.
    """
    hosts = materialize(marked.select("host").distinct(), "html-hosts")
    stream = F.coalesce("whole", "blocks")
    pages = hot_join(rows, hosts, ["host"]).select("host", stream.alias("stream"), F.array_join(stream, " ").alias("size"))
    found = pages.mapInArrow(_counted, "name long, pages long").groupBy("name").agg(F.sum("pages").alias("pages"))
    return materialize(found.filter(F.col("pages") >= TEXTS).select("name"), "html-substrings")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, place and name of the substrings that reach into the blocks ``gone``."""
    for batch in batches:
        for part in slices(batch, 4):
            pages = part.column(2).to_pylist()
            tokens, page = _streams(part.column(1).to_pylist(), pages)
            reach, whole = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
            begin = 0
            for found, gone in zip(pages, part.column(3).to_pylist()):
                ends = begin + np.cumsum([0, *(len(b.split()) for b in found)])
                for i in (g["at"] for g in gone):
                    reach[max(begin, ends[i] - REPEAT + 1) : ends[i + 1]] = True
                whole[begin : max(begin, ends[-1] - REPEAT + 1)] = True
                begin = ends[-1]
            at = np.flatnonzero(reach & whole)
            first = np.searchsorted(page, np.arange(len(pages)))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(page[at])), pa.array(at - first[page[at]], pa.int64()),
                pa.array(_names(tokens, at)),
            ], names=["row", "place", "name"])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, text, main: the text beside each asked block of a page, in it as a whole and in its largest article."""
    for batch in batches:
        found: list[tuple[int, int, bool]] = []
        for marks in batch.column(0):
            marks = marks.as_py()
            for main in (False, True):
                asked, known = ("main", "main_gone") if main else ("loose", "loose_gone")
                left = [m for m in marks if not m[known] and (not main or m["place"] & MAIN)]
                left.sort(key=lambda m: m["f"])
                best = second = (0, 0)
                for _, group in groupby(left, key=lambda m: m["f"]):
                    equals = list(group)
                    for m in equals:
                        block = (m["n"], m["h"])
                        if block > best:
                            best, second = block, best
                        elif block > second:
                            second = block
                    for m in equals:
                        n, text = second if best == (m["n"], m["h"]) else best
                        if m[asked] and n and n * 4 >= m["n"]:
                            found.append((m["h"], text, main))
        h, text, main = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(text, pa.int64()), pa.array(main, pa.bool_())], names=["h", "text", "main"]
        )


def repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(h, loose_gone, main_gone) of the blocks that stand beside many distinct texts of their host, of which they go
    outside of largest articles or in them; and the hot ones of all blocks, if any."""
    spark = rows.sparkSession
    marks = rows.select("row", "host", F.explode("seen").alias("_b")).select("row", "host", "_b.h", "_b.n", "_b.place")
    counts = marks.groupBy("h").agg(F.first("host").alias("host"), F.count("*").alias("f"), F.bit_or("place").alias("places"))
    common = materialize(counts.filter(F.col("f") >= TEXTS), "html-common")
    # Repeated rows of a page are one page.
    sizes = rows.groupBy("host").agg(F.count_distinct(F.xxhash64("seen")).alias("pages"))
    least = F.greatest(F.floor(F.col("pages") / 2) + 1, F.lit(MAIN_TEXTS))
    placed = lambda place: F.col("places").bitwiseAND(F.lit(place)) > 0
    asked = common.join(sizes, "host").withColumn("least", least).select(
        "h", "f", "least", placed(LOOSE).alias("loose"), (placed(MAIN) & (F.col("f") >= F.col("least"))).alias("main")
    )
    asked = materialize(asked.filter("loose OR main"), "html-asked")
    found = spark.createDataFrame([], "h long, main boolean")
    known = found.select("h", F.lit(True).alias("loose_gone"), F.lit(True).alias("main_gone"))
    if asked.isEmpty():
        return known, None
    total = rows.agg(F.sum(F.size("seen"))).first()[0]
    over = max(MIN_HOT_ROWS, total // HOT_FRACTION)
    keys = common.filter(F.col("f") > over).select("h").collect()
    hot = spark.createDataFrame(keys, "h long") if keys else None
    every = common.select("h", "f").join(asked.select("h", "loose", "main"), "h", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    counted = materialize(
        join_apart(marks, every, ["h"], hot, "left")
        .select("row", "h", "n", "place", F.coalesce("f", F.lit(0)).alias("f"), no("loose"), no("main")),
        "html-counted",
    )
    while True:
        fields = F.struct("h", "n", "place", "f", "loose", "main", no("loose_gone"), no("main_gone"))
        pages = (
            join_apart(counted, known, ["h"], hot, "left").groupBy("row").agg(F.collect_list(fields).alias("marks"))
            .filter(F.exists("marks", lambda m: m["loose"] | m["main"])).select("marks")
        )
        texts = pages.mapInArrow(_beside, "h long, text long, main boolean").distinct()
        many = texts.groupBy("h", "main").agg(F.count("*").alias("_texts")).join(asked.select("h", "least"), "h")
        more = many.filter(F.col("_texts") >= F.when(F.col("main"), F.col("least")).otherwise(TEXTS)).select("h", "main")
        more = materialize(more, "html-repeats")
        if more.isEmpty():
            return known, hot
        found = materialize(found.union(more), "html-repeats")
        known = found.groupBy("h").agg(F.bool_or(~F.col("main")).alias("loose_gone"), F.bool_or("main").alias("main_gone"))
        known = materialize(known, "html-repeats")


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for found, gone, places in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            ends = np.cumsum([0, *(len(b.split()) for b in found)])
            cover = np.zeros(ends[-1] + 1, np.int64)
            at = np.array(places or [], np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + REPEAT, -1)
            bare = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] == 0)])
            drop = {g["at"]: g for g in gone or [] if bare[ends[g["at"] + 1]] == bare[ends[g["at"]]]}
            mains = [i for i, g in drop.items() if g["main"]]
            if mains and len(mains) == drop[mains[0]]["mains"]:
                drop = {i: g for i, g in drop.items() if not g["main"]}
            texts.append(" ".join(b for i, b in enumerate(found) if i not in drop))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""
    rows = parsed(pages)
    size = F.size(F.filter("open", lambda b: b["main"])).alias("mains")
    found, hot = repeats(rows)
    open_ = rows.select("row", size, F.explode("open").alias("_b")).select("row", "mains", "_b.*")
    places = join_apart(open_, found, ["h"], hot).filter("if(main, main_gone, loose_gone)")
    gone = materialize(places.groupBy("row").agg(F.collect_list(F.struct("at", "main", "mains")).alias("gone")), "html-places")
    if gone.isEmpty():
        # All blocks of all pages were judged and stay.
        return rows.select("page_id", "url", F.array_join("blocks", " ").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    marked = materialize(rows.join(gone, "row").select("row", "host", "page_id", "url", "blocks", "gone"), "html-marked")
    own = rows.join(gone.select("row"), "row", "left_anti").select("page_id", "url", F.array_join("blocks", " ").alias("text"))
    placed = materialize(
        marked.select("row", "host", "blocks", "gone", F.array_join("blocks", " ").alias("size"))
        .mapInArrow(_placed, "row long, place long, name long"),
        "html-placed",
    )
    covered = hot_join(placed, substrings(rows, marked), ["name"]).groupBy("row").agg(F.collect_list("place").alias("places"))
    kind = pages.schema["page_id"].dataType.simpleString()
    compared = marked.join(covered, "row", "left").select("page_id", "url", "blocks", "gone", "places").mapInArrow(
        _without_repeats, f"page_id {kind}, url string, text string"
    )
    return own.union(compared).withColumn("n_chars", F.char_length("text").cast("long"))
