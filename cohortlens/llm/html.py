"""Operator 3: main text of HTML pages by a suffix array over the pages of a host.

The pages of a host are token streams, tags and words. A suffix array over the concatenated streams
finds the substrings of at least ``LEAST`` tokens that stand on several pages; they are the site's
template. On pages that mark no article, text they cover is boilerplate. Of an article repetition alone
takes nothing away, since copies and quotations are prose: a block goes if it is mostly links that other
pages have too, or a container of its own that also stands outside articles. Elements that are furniture
by name or class are never main text. The pages of a large host are dealt to several arrays, which ask
each other for the substrings that decide about their blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import SENT, Numbered, Stage, cut, lists, mix, offsets_of, read
from cohortlens.llm.urls import parts
from cohortlens.operators.keyfilter import key_filter, may_match

PAGES = 256  # of one suffix array, on average
SQUEEZED = 16_000_000  # bytes of html packed at a time, one page at least
LEAST = 8  # tokens of a repeated substring
COVER = 0.8  # share of a block's words that makes it boilerplate

#: Elements whose content is no text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "noembed", "noframes"}
#: Elements that are never part of the main text.
FURNITURE = {
    "head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "datalist", "fieldset",
    "label", "input", "svg", "math", "canvas", "object", "embed", "audio", "video", "map", "frameset", "search",
}
#: Elements that end a block of text.
BLOCKS = {
    "html", "body", "main", "article", "section", "header", "hgroup", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6",
    "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "caption", "thead", "tbody", "tfoot", "tr", "td",
    "th", "figure", "figcaption", "address", "hr", "details", "summary", "center",
} | FURNITURE
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
#: Elements that an opening tag of the second set closes.
CLOSES = {
    "p": BLOCKS - {"html", "body", "button", "label", "input", "svg", "math", "canvas", "object", "map"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
#: Elements that hold text as text; others that do are containers.
TEXT = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption",
    "summary", "article", "main", "body", "html",
}
#: Words of class, id and role that mark furniture.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alertdialog", "dialog", "modal", "popup",
    "overlay", "sidebar", "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination",
    "pager", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "disqus", "respond", "replies", "share",
    "sharing", "social", "newsletter", "subscribe", "signup", "login", "related", "recommended", "widget", "search",
    "contentinfo", "complementary", "form",
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Blocks of a page that may be main text, and its token stream."""

    blocks: list[str] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)  # of an article or main element
    linked: list[bool] = field(default_factory=list)  # mostly link text
    spans: list[tuple[int, int]] = field(default_factory=list)  # of a block's words in the stream
    stream: list[str] = field(default_factory=list)

    def container(self, place: int) -> str:
        """The opening tag directly before a block, if it is one that holds other elements; else empty."""
        start = self.spans[place][0]
        tag = self.stream[start - 1] if start else ""
        name = tag[1:].split(" ", 1)[0]
        return tag if tag[:1] == "<" and name in BLOCKS - TEXT else ""

    def heads(self) -> list[int]:
        """Places of the containers with a block of their own outside articles."""
        return [a - 1 for i, (a, _) in enumerate(self.spans) if not self.inside[i] and self.container(i)]


def _marks(attributes: str) -> set[str]:
    found: set[str] = set()
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            found.add("ad")
        elif name != "aria-hidden":
            found.update(_WORD.findall(value))
    return found


def parse(source: str) -> Page:
    """One pass over the markup, with the implied end tags that matter for text."""
    page, open_tags = Page(), []  # (name, furniture, article, link)
    text: list[str] = []
    links = letters = 0
    hidden = article = link = 0

    def end_block() -> None:
        nonlocal links, letters
        words = entities.unescape("".join(text)).split()
        if words:
            page.spans.append((len(page.stream), len(page.stream) + len(words)))
            page.stream.extend(words)
            page.blocks.append(" ".join(words))
            page.inside.append(article > 0)
            page.linked.append(2 * links > letters)
        text.clear()
        links = letters = 0

    def leave() -> None:
        nonlocal hidden, article, link
        name, off, main, anchor = open_tags[-1]
        if name in BLOCKS and not hidden:
            end_block()
        open_tags.pop()
        hidden, article, link = hidden - off, article - main, link - anchor

    def add(piece: str) -> None:
        nonlocal links, letters
        if piece and not hidden:
            text.append(piece)
            letters += len(piece.strip())
            links += len(piece.strip()) if link else 0

    at = 0
    while match := _TOKEN.search(source, at):
        add(source[at: match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if any(x[0] == name for x in open_tags):
                while open_tags[-1][0] != name:
                    leave()
                leave()
                page.stream.append(f"</{name}")
            elif name == "p" and not hidden:
                end_block()
            continue
        while open_tags and name in CLOSES.get(open_tags[-1][0], ()):
            leave()
        # an open p ends at a block element even from inside inline elements
        if name in CLOSES["p"]:
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == "p":
                    while len(open_tags) > depth:
                        leave()
                    break
                if open_tags[depth][0] in BLOCKS:
                    break
        marks = _marks(match[3])
        page.stream.append(f"<{name} {' '.join(sorted(marks))}")
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
            if close is None:
                at = len(source)
            else:
                end = source.find(">", close.end())
                at = len(source) if end < 0 else end + 1
            continue
        if name == "br":
            add(" ")
        if name in BLOCKS and not hidden:
            end_block()
        if name in VOID or match[3].endswith("/") and name not in BLOCKS:
            continue
        main = name in ("article", "main") or "main" in marks and name in ("div", "section")
        off = name in FURNITURE or bool(marks & NAMES) and name not in ("html", "body", "article", "main")
        # the header of a page is furniture, that of an article holds its title
        off = off or name == "header" and not article
        open_tags.append((name, int(off), int(main), int(name == "a")))
        hidden, article, link = hidden + off, article + main, link + (name == "a")
    add(source[at:])
    while open_tags:
        leave()
    end_block()
    return page


def ranks(streams: list[list[str]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token a number shared by all places where the same ``least`` tokens start, its page, and
    whether the page holds so many from there.

    Suffix array by prefix doubling: after each round suffixes are ranked by twice as many tokens.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    total = int(sizes.sum())
    page = np.repeat(np.arange(len(streams)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    if total == 0:
        return page, page, np.zeros(0, bool)
    # a suffix ends with its page: behind it stands a token of the page's own
    rank = Numbered().codes(streams) + 1 + len(streams)
    size = 1
    while size < least:
        step = min(size, least - size)
        follow = np.arange(total) + step
        behind = np.where(follow < ends, rank[np.minimum(follow, total - 1)], 1 + page)
        # both are below the number of tokens and pages, so a pair is one number
        both = rank * (total + len(streams) + 2) + behind
        order = np.argsort(both, kind="stable")
        new = np.cumsum(np.concatenate([[0], both[order][1:] != both[order][:-1]]))
        rank = np.empty(total, np.int64)
        rank[order] = new + 1 + len(streams)
        size += step
    return rank, page, np.arange(total) + least <= ends


def several(rank: np.ndarray, page: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """For each token whether the tokens that start there start on two pages or more."""
    if not len(rank):
        return fits
    low, high = np.full(int(rank.max()) + 1, len(page) + 1), np.full(int(rank.max()) + 1, -1)
    np.minimum.at(low, rank, page)
    np.maximum.at(high, rank, page)
    return fits & (low < high)[rank]


def covering(starts: np.ndarray, streams: list[list[str]], least: int) -> list[np.ndarray]:
    """For each token whether one of the ``least`` tokens up to it is marked."""
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, np.flatnonzero(starts), 1)
    np.add.at(change, np.flatnonzero(starts) + least, -1)
    covered = np.cumsum(change)[:-1] > 0
    return np.split(covered, np.cumsum([len(s) for s in streams])[:-1])


def repeated(streams: list[list[str]], least: int) -> list[np.ndarray]:
    """For each token whether a substring of ``least`` tokens around it stands on another page as well."""
    return covering(several(*ranks(streams, least)), streams, least)


def judged_blocks(
    pages: list[Page], least: int = LEAST
) -> tuple[list[list[int]], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Numbers of the blocks of each page that are main text as far as these pages tell.

    Then for each token of a page whether the tokens that start there fit, start on another page as well,
    and start a container with its text that stands outside articles on some page.
    """
    streams = [p.stream for p in pages]
    rank, page, fits = ranks(streams, least)
    shared = several(rank, page, fits)
    covered = covering(shared, streams, least)
    edges = offsets_of(np.array([len(s) for s in streams], np.int64))
    outside = np.zeros(len(rank), bool)
    for base, p in zip(edges[:-1], pages, strict=True):
        outside[[base + start for start in p.heads()]] = True
    known = np.zeros(int(rank.max(initial=0)) + 1, bool)
    known[rank[outside]] = True
    held = known[rank]
    out = []
    for base, p, cover in zip(edges[:-1], pages, covered, strict=True):
        marked, kept = any(p.inside), []
        for i, (a, b) in enumerate(p.spans):
            template = cover[a:b].mean() >= COVER
            if marked:
                start = base + a - 1
                furniture = p.linked[i] or bool(p.container(i)) and shared[start] and held[start]
                keep = p.inside[i] and not (template and furniture)
            else:
                keep = not template and not p.linked[i]
            if keep:
                kept.append(i)
        out.append(kept)
    split = [np.split(x, edges[1:-1]) for x in (fits, shared, held)]
    return out, *split


def kept_blocks(pages: list[Page], least: int = LEAST) -> list[list[int]]:
    """Numbers of the blocks of each page that are main text as far as these pages tell."""
    return judged_blocks(pages, least)[0]


def main_texts(sources: list[str], least: int = LEAST) -> list[str]:
    """Main text of the pages of one array."""
    pages = [parse(s) for s in sources]
    return ["\n".join(p.blocks[i] for i in kept) for p, kept in zip(pages, kept_blocks(pages, least), strict=True)]


def grams(stream: list[str], least: int = LEAST) -> np.ndarray:
    """Hash of the ``least`` tokens that start at each token where so many are left."""
    if len(stream) < least:
        return np.zeros(0, np.int64)
    numbers = Numbered()
    codes = numbers.codes([stream])
    hashes = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in numbers], np.uint64)[codes]
    found = np.zeros(len(stream) - least + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(least):
            found = mix(found + hashes[i: i + len(found)])
    return found.view(np.int64)


def asked(page: Page, kept: list[int], fits: np.ndarray, shared: np.ndarray, held: np.ndarray, least: int = LEAST) -> list[dict]:
    """The kept blocks of a page that other arrays of its host may take away.

    A block comes with the hashes of all substrings of ``least`` tokens that touch it: ``known`` tells those
    that stand on two pages of this array, ``ask`` those the other arrays decide. ``head`` is the one that
    starts with the container of a block in an article, ``held`` whether this array has it outside articles.
    """
    marked, hashes, out = any(page.inside), None, []
    for i in kept:
        a, b = page.spans[i]
        box = marked and not page.linked[i] and bool(page.container(i))
        if marked and not page.linked[i] and not (box and fits[a - 1]):
            continue
        hashes = grams(page.stream, least) if hashes is None else hashes
        low, high = max(0, a - least + 1), min(b, len(hashes))
        out.append({
            "place": i, "words": b - a, "lead": a - low, "known": shared[low:high].tolist(), "ask": hashes[low:high].tolist(),
            "head": int(hashes[a - 1]) if box else None, "held": bool(box and held[a - 1]),
        })
    return out


def taken(block: dict, answers: dict[int, bool], least: int = LEAST) -> bool:
    """Whether a block of ``asked`` goes, given the hashes that stand on two pages of the host and whether
    they start a container outside articles."""
    covered = np.zeros(block["lead"] + block["words"] + least, bool)
    for at, (known, ask) in enumerate(zip(block["known"], block["ask"], strict=True)):
        if known or ask in answers:
            covered[at: at + least] = True
    template = covered[block["lead"]: block["lead"] + block["words"]].mean() >= COVER
    head = block["head"]
    if not template or head is None:
        return bool(template)
    here = block["known"][block["lead"] - 1] or head in answers
    return bool(here and (block["held"] or answers.get(head, False)))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text) for every row of ``pages``.

    Text of article and main elements is kept, apart from blocks that repeat on other pages of the
    host and are mostly links, or containers that stand outside articles as well. A page
    without these elements keeps the blocks that substrings of two pages don't cover and that aren't
    mostly links. White space inside a block becomes one space, blocks are joined by a newline. Null
    and empty html gives an empty text; rows with null url share an empty host; repeated rows are
    pages of their own. Other columns are ignored. An empty table gives no rows.

    A host with more than ``PAGES`` pages is dealt to several suffix arrays by a number of the row, so
    neither a key nor a page that repeats is one array. The arrays decide together as one array would: the
    blocks that are kept but may go ask for all substrings of ``LEAST`` tokens that touch them, by hash, and
    the pages of their hosts are read once more and tell which of those stand on two pages. A filter of the
    asked hashes, of fixed size, keeps the others out of the exchange. No page is left out.
    """
    spark = pages.sparkSession
    stage = Stage(spark, "html")
    host, _ = parts(pages[url])
    crowded = pages.select(host.alias("host")).groupBy("host").count().where(F.col("count") > PAGES)
    crowded = stage.store(crowded.select("host", F.ceil(F.col("count") / PAGES).cast("int").alias("parts")), "crowded")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of one array that lie in one batch, packed together: they share their template."""
        part, seen = TaskContext.get().partitionId(), 0
        for big in batches:
            for batch in cut(big, SQUEEZED):
                numbers = (part << 36) + seen + np.arange(batch.num_rows)
                seen += batch.num_rows
                arrays = np.asarray(batch.column(4).fill_null(1)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    chunk = (mix(numbers.astype(np.uint64)) % arrays).astype(np.int32)
                hosts = batch.column(2).dictionary_encode()
                code = np.asarray(hosts.indices)
                order = np.lexsort((chunk, code))
                edge = np.flatnonzero(np.diff(code[order]) | np.diff(chunk[order])) + 1
                given = [pa.array(numbers), batch.column(0), batch.column(1), batch.column(3)]
                whole = pa.RecordBatch.from_arrays(given, ["page", "key", "url", "html"]).take(pa.array(order))
                out = []
                for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, whole.schema) as writer:
                        writer.write_batch(whole.slice(a, b - a))
                    data, row = sink.getvalue(), int(order[a])
                    out.append((hosts[row].as_py(), int(chunk[row]), int(arrays[row]), len(data), pa.compress(data, "zstd", asbytes=True)))
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["host", "chunk", "arrays", "size", "data"])

    kind = pages.schema[key].dataType.simpleString()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SENT)
    rows = pages.select(
        pages[key].alias("key"), pages[url].cast("string").alias("url"), host.alias("host"), pages[source].cast("string").alias("html")
    )
    rows = rows.join(crowded, "host", "left").select("key", "url", "host", "html", "parts")
    rows = rows.mapInArrow(squeeze, "host string, chunk int, arrays long, size long, data binary")
    block = pa.struct([
        ("place", pa.int32()), ("words", pa.int32()), ("lead", pa.int32()), ("known", pa.list_(pa.bool_())),
        ("ask", pa.list_(pa.int64())), ("head", pa.int64()), ("held", pa.bool_()),
    ])
    shape = {"places": pa.list_(pa.int32()), "blocks": pa.list_(pa.string()), "open": pa.list_(block)}

    def site(table: pa.Table) -> pa.Table:
        packed = zip(table["data"].to_pylist(), table["size"].to_pylist(), strict=True)
        rows = pa.concat_tables(pa.ipc.open_stream(pa.decompress(d, n, "zstd")).read_all() for d, n in packed)
        found = [parse(t or "") for t in rows["html"].to_pylist()]
        alone = table["arrays"][0].as_py() == 1  # the only array of its host
        out = []
        for page, kept, *facts in zip(found, *judged_blocks(found), strict=True):
            open_ = [] if alone else asked(page, kept, *facts)
            out.append({"places": kept if open_ else [], "blocks": [page.blocks[i] for i in kept], "open": open_})
        columns = {c: pa.array([r[c] for r in out], t) for c, t in shape.items()}
        host = {"host": pa.array([table["host"][0].as_py()] * rows.num_rows, pa.string())}
        return pa.table({c: rows[c] for c in ("page", "key", "url")} | host | columns)

    opened = (
        "array<struct<place: int, words: int, lead: int, known: array<boolean>, ask: array<bigint>, head: bigint, held: boolean>>"
    )
    result = f"page long, key {kind}, url string, host string, places array<int>, blocks array<string>, open {opened}"
    judged = stage.store(rows.groupBy("host", "chunk").applyInArrow(site, result), "pages")
    unsure = judged.where(F.size("open") > 0)
    # a head is among the substrings that touch its block
    asks = unsure.select("host", "page", F.explode(F.array_distinct(F.flatten("open.ask"))).alias("hash"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every substring of a page once, and whether it starts a container outside articles."""
        for big in batches:
            for batch in cut(big, SQUEEZED):
                if not batch.num_rows:
                    continue
                hashes, outside, sizes = [], [], []
                for text in batch.column(1).to_pylist():
                    page = parse(text or "")
                    found = grams(page.stream)
                    heads = np.zeros(len(found), bool)
                    heads[[h for h in page.heads() if h < len(found)]] = True
                    each, place = np.unique(found, return_inverse=True)
                    first = np.zeros(len(each), bool)
                    np.logical_or.at(first, place, heads)
                    hashes.append(each)
                    outside.append(first)
                    sizes.append(len(each))
                lengths = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists(np.concatenate(hashes), lengths, pa.int64()), lists(np.concatenate(outside), lengths, pa.bool_())],
                    ["host", "hashes", "outside"],
                )

    # stored, so that its size is known: pages meet it by broadcast, not by an exchange of all html
    asking = stage.store(unsure.select("host").distinct(), "asking")
    again = pages.select(host.alias("host"), pages[source].cast("string").alias("html")).join(asking, "host", "left_semi")
    said = again.mapInArrow(tell, "host string, hashes array<bigint>, outside array<boolean>")
    said = said.select("host", F.explode(F.arrays_zip("hashes", "outside")).alias("g")).select(
        "host", F.col("g.hashes").alias("hash"), F.col("g.outside").alias("outside")
    )
    wanted = stage.store(asks.select("host", "hash").distinct(), "asked")
    told = may_match(said, key_filter(wanted, ["host", "hash"]), ["host", "hash"]).groupBy("host", "hash")
    # a page tells a substring once, so two tellers are two pages
    told = told.agg(F.count(F.lit(1)).alias("tellers"), F.max("outside").alias("outside")).where(F.col("tellers") > 1)
    answers = asks.join(told, ["host", "hash"]).groupBy("page").agg(F.collect_list(F.struct("hash", "outside")).alias("answers"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for places, blocks, open_, found in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                known = {x["hash"]: x["outside"] for x in found or ()}
                gone = {x["place"] for x in open_ if taken(x, known)}
                left.append([t for i, t in zip(places, blocks, strict=True) if i not in gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left, pa.list_(pa.string()))], ["key", "url", "blocks"])

    # only pages with open blocks wait for the others
    sure = judged.where(F.size("open") == 0).select("key", "url", "blocks")
    decided = unsure.join(answers, "page", "left").select("key", "url", "places", "blocks", "open", "answers")
    decided = decided.mapInArrow(decide, f"key {kind}, url string, blocks array<string>")
    return sure.unionByName(decided).select(F.col("key").alias(key), "url", F.array_join("blocks", "\n").alias("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
