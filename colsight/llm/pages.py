"""Main text of web pages by consensus paths of their hosts.

One parse per page finds its blocks of text, decides which of them are not article, and scores its containers; the best one
is the page's vote for a generalised path (tags with classes, numbers masked). Spark adds the votes up per host. Each page
is then extracted by that of its paths that has most votes at its host; blocks are kept from the first parse, so html is
neither read nor moved again.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsight.llm.shared import cut, free_names

SENT_BYTES = 32 << 20
"""Votes of more bytes are joined by shuffles of narrow rows instead of being sent to all executors."""
HOT_SHARE, SALTS = 1000, 64
"""A host with more than one in so many pages (so many hosts at most) is dealt to several tasks."""
ROWS_AT_ONCE = 256

# ---- fixed values: HTML elements by role and words that name what is not the article ----
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object canvas".split())
BLOCKS = set(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure "
    "figcaption header footer nav aside form fieldset address details summary br hr center".split()
)
DROPPED = set("nav footer aside button select option label input dialog menu head".split()) | RAW
LAYOUT = set("form header".split())
CONTAINERS = set("article main section div td body".split())
IN_PATH = CONTAINERS | {"html"}
CLOSES = {  # an opening tag ends an open one of these, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
IN_PARAGRAPH = set("article main section div p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure header footer nav aside form address hr".split())
AWAY_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments reply replies respond "
    "disqus cookie cookies consent popup modal newsletter subscribe subscription signup login related recommended recommendations pagination pager hidden".split()
)
LAYOUT_WORDS = set("banner sidebar menu nav navbar navigation footer header masthead notice notices alert overlay share sharing social widget toolbar skip".split())
PART_WORDS = set("list inner wrap wrapper container box area content section block item items link links bar slot unit title body text left right top bottom main form btn button".split())
STATE_WORDS = set("has no not with without".split())
AWAY_ROLES = set("navigation banner contentinfo complementary search dialog alert".split())
# ---- end of fixed values ----

# quotes open a value only after "="; what an unclosed one holds is lost, as in browsers
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+|[\"'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}

ARTICLE, LAYOUT_NODE, AWAY_NODE = range(3)


def _named(words: list[str]) -> int:
    """What class and id words say of a node: nothing, that it may be layout, or that it is surely not article. A word
    counts as a whole, by its last part, or by its first one before a part that only says which part it is."""
    kind = ARTICLE
    for word in words:
        parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", word) if p and not p.isdigit()]
        if not parts or parts[0] in STATE_WORDS:
            continue
        ends = {parts[-1]} | ({parts[0]} if len(parts) > 1 and parts[1] in PART_WORDS else set())
        if ends & AWAY_WORDS or parts[0] in {"ad", "ads", "advert", "cookie", "comment", "comments"}:
            return AWAY_NODE
        if ends & LAYOUT_WORDS:
            kind = LAYOUT_NODE
    return kind


def _attributes(source: str) -> tuple[list[str], bool, bool]:
    """(class and id words, whether hidden, whether marked as the article)."""
    words, hidden, main = [], False, False
    for name, a, b, c in ATTRIBUTE.findall(source):
        name, value = name.lower(), (a or b or c).lower()
        if name in {"class", "id"}:
            words += value.split()
        hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in AWAY_ROLES)
        main |= (name == "role" and value in {"main", "article"}) or (name == "itemprop" and value == "articlebody")
    return words, hidden, main


def _path(parent: int, name: str) -> int:
    """A path as one number: that of its parent and its own name."""
    return int.from_bytes(blake2b(f"{parent}/{name}".encode(), digest_size=8).digest(), "big", signed=True)


class Page:
    """Blocks and containers of a page, in page order. Tags may be unclosed, crossed or cut off; character references are
    decoded. Time and memory are linear in the page.

    Text comes in pieces: (block, text, doubt, linked characters); a doubt is the innermost open element that is not
    article by its tag or name, 0 being none. Containers hold ranges of pieces.
    """

    def __init__(self, source: str):
        self.pieces: list[tuple[int, str, int, int]] = []
        self.containers: list[list[int]] = [[0, 0, 0, 0, 0]]  # path, first piece, last, doubt, whether marked as the article
        self.doubts: list[list[int]] = [[-1, ARTICLE, 0]]  # parent, kind, whether it holds a mark of the article itself
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, int, int, bool]] = [("", 0, 0, 0, False)]  # tag, path, container or -1, doubt, marked
        places: dict[str, list[int]] = defaultdict(list)
        held: list[int] = []  # places of containers
        texts: list[str] = []
        block = links = marked = linked = 0

        def say(text: str) -> None:
            nonlocal linked
            if text:
                decoded = html.unescape(text) if "&" in text else text
                texts.append(decoded)
                if links:
                    linked += len(decoded.strip())

        def flush(ends_block: bool) -> None:
            nonlocal block, linked
            if texts:
                text = "".join(texts)
                if text.strip():
                    self.pieces.append((block, text, stack[-1][3], linked))
                elif self.pieces and self.pieces[-1][0] == block:
                    self.pieces.append((block, " ", stack[-1][3], 0))
                texts.clear()
            linked = 0
            block += ends_block

        def pop(to: int) -> None:
            nonlocal links, marked
            while len(stack) > to:
                if len(stack) == 1:
                    break
                tag, _, container, doubt, is_marked = stack[-1]
                if doubt != stack[-2][3]:
                    flush(False)
                if container >= 0:
                    self.containers[container][2] = len(self.pieces)
                    held.pop()
                places[tag].pop()
                links -= tag == "a"
                marked -= is_marked
                stack.pop()

        at = 0
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            say(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in BLOCKS:
                flush(True)
            if m[1]:
                if places[tag]:
                    pop(places[tag][-1])
                continue
            if tag in RAW:
                end = RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in IN_PARAGRAPH and places["p"] and places["p"][-1] > (held[-1] if held else 0):
                pop(places["p"][-1])
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                low = max((places[t][-1] for t in stops if places[t]), default=0)
                after = [places[t][k] for t in ends if (k := bisect_right(places[t], low)) < len(places[t])]
                if after and low:
                    pop(min(after))
            if tag in VOID or (m[3].endswith("/") and tag not in BLOCKS):
                continue
            words, hidden, main = _attributes(m[3]) if m[3].strip() else ([], False, False)
            main |= tag in {"article", "main"}
            _, path, _, doubt, _ = stack[-1]
            if tag in {"html", "body"}:
                kind = ARTICLE
            elif hidden or tag in DROPPED:
                kind = AWAY_NODE
            else:
                kind = max(_named(words), LAYOUT_NODE if tag == "form" or (tag == "header" and not marked) else ARTICLE)
            if kind:
                flush(False)
                self.doubts.append([doubt, kind, 0])
                doubt = len(self.doubts) - 1
            if main or (tag == "h1" and not places["header"]):
                self.doubts[doubt][2] = 1
            container = -1
            if tag in IN_PATH:
                path = _path(path, ".".join([tag, *sorted({re.sub(r"[0-9]+", "#", w) for w in words})]))
            if tag in CONTAINERS:
                container = len(self.containers)
                self.containers.append([path, len(self.pieces), 0, doubt, int(main)])
                held.append(len(stack))
            places[tag].append(len(stack))
            links += tag == "a"
            marked += main
            stack.append((tag, path, container, doubt, main))
        say(source[at:])
        flush(True)
        pop(1)
        self.containers[0][2] = len(self.pieces)

    def _settle(self) -> None:
        """Which doubts stand. Those of layout fall where all text, or all marks of the article and more text than is left,
        lie in one of them: then it wraps the page. ``clean`` says of each doubt whether its text is article."""
        n = len(self.doubts)
        size = [0] * n
        for _, text, doubt, _ in self.pieces:
            size[doubt] += len(text.strip())
        reach, mark = size[:], [d[2] for d in self.doubts]
        inside: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            parent, kind, _ = self.doubts[i]
            if kind == LAYOUT_NODE:
                inside[parent].append(i)
                reach[parent] += reach[i]
                mark[parent] |= mark[i]
        stands = [False] + [True] * (n - 1)
        left, marks, edge = size[0], self.doubts[0][2], inside[0]
        while edge and not (left and marks):
            wraps = max(edge, key=lambda i: (reach[i], -i))
            if left:
                wraps = max((i for i in edge if mark[i]), key=lambda i: (reach[i], -i), default=wraps)
                if not mark[wraps] or reach[wraps] <= left:
                    break
            if not reach[wraps]:
                break
            stands[wraps] = False
            left, marks = left + size[wraps], marks | self.doubts[wraps][2]
            edge = [i for i in edge if i != wraps] + inside[wraps]
        self.clean = [True] * n
        for i in range(1, n):
            self.clean[i] = not stands[i] and self.clean[self.doubts[i][0]]

    def scored(self) -> tuple[list[str], list[tuple[int, int, int]], int, float]:
        """(blocks of article text; path, first block and end of each container with text; the best container's number, -1
        without any; its share of the text). A score is clean text less the noise and links in it, half as much again where
        marked as the article; of equal ones the innermost counts."""
        text, noise, linked, upto, blocks, number = [0], [0], [0], [0], [], -1
        for block, piece, doubt, links in self.pieces:
            size, clean = len(piece.strip()), self.clean[doubt]
            if clean and block == number:
                blocks[-1].append(piece)
            elif clean and size:
                blocks.append([piece])
                number = block
            text.append(text[-1] + size * clean)
            noise.append(noise[-1] + size * (not clean))
            linked.append(linked[-1] + links)
            upto.append(len(blocks))
        ready = [" ".join("".join(b).split()) for b in blocks]
        found, scores = [], []
        for path, a, b, doubt, main in self.containers:
            if self.clean[doubt] and text[b] > text[a]:
                found.append((path, upto[a], upto[b]))
                scores.append(((text[b] - text[a] - noise[b] + noise[a] - linked[b] + linked[a]) * (3 if main else 2), text[b] - text[a]))
        if not found:
            return ready, found, -1, 0.0
        best = max(range(len(found)), key=lambda i: (scores[i][0], i))
        return ready, found, best, scores[best][1] / text[-1]


def host(url_col: str):
    """The host of a URL in lower case; an empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _parsed(names: list[str]):
    """The last column, html, becomes blocks, containers, the own path and its vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("path", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                blocks, spans, own, votes = zip(*(Page(s or "").scored() for s in part.column(part.num_columns - 1).to_pylist()), strict=True)
                flat = np.array([span for s in spans for span in s], np.int64).reshape(-1, 3)
                fields = [pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2].astype(np.int32))]
                ends = np.cumsum([0, *map(len, spans)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(kind)))
                paths = pa.array([s[k][0] if k >= 0 else None for s, k in zip(spans, own, strict=True)], pa.int64())
                new = [pa.array(blocks, pa.list_(pa.string())), lists, paths, pa.array(votes, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=names)

    return run


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with the main text of each row: an empty string for a null, empty or textless page.

    ``keep`` names the columns that stay (all if None); the new name must be free among them. Rows are extracted one by one,
    so repeated rows stay; pages without a host vote together. Paths with equal votes at a host go by their number. A page
    has a vote for its own best container, so some path of it always counts.
    """
    keep = pages.columns if keep is None else keep
    if text in keep:
        raise ValueError(f"column {text} exists already")
    row, site, blocks, spans, own, vote = names = free_names([*keep, text], "row", "site", "blocks", "spans", "own", "vote")
    read = pages.select(*(F.col(f"`{c}`") for c in keep), F.monotonically_increasing_id().alias(row), host(url_col).alias(site), F.col(html_col).cast("string").alias(blocks))
    out = read.drop(blocks).withColumns({blocks: F.lit(None).cast("array<string>"), spans: F.lit(None).cast("array<struct<path:long,first:int,end:int>>"), own: F.lit(None).cast("long"), vote: F.lit(None).cast("double")}).schema
    parsed = cut(read.mapInArrow(_parsed(out.names), out))  # row numbers are written, and so the same ones for all that follows

    votes = parsed.where(F.col(vote) > 0).groupBy(F.col(site).alias("host"), F.col(own).alias("path")).agg(F.sum(F.round(vote, 6).cast("decimal(20,6)")).alias("votes"), F.count("*").alias("n"))
    votes = cut(votes)
    cost = votes.agg(F.coalesce(F.sum(F.length("host") + 64), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if cost["bytes"] <= SENT_BYTES:
        places = votes.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path")))
        known = places.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "place"))).alias(own))
        known = known.withColumnRenamed("host", site)
        ranked = parsed.drop(own, vote).join(F.broadcast(known), site, "left")
        place = F.transform(spans, lambda s: F.struct(F.try_element_at(own, s["path"]).alias("place"), s["path"].alias("path")))
        best = F.array_min(F.filter(place, lambda s: s["place"].isNotNull()))["path"]
        chosen = ranked.withColumn(vote, best)
    else:
        hot = votes.groupBy("host").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SHARE > cost["n"]).select(F.col("host").alias(site), F.lit(SALTS).alias("salts"))
        seen = parsed.select(row, site, F.explode(F.array_distinct(F.transform(spans, lambda s: s["path"]))).alias("path"))
        seen = seen.join(F.broadcast(hot), site, "left")  # at most HOT_SHARE hosts
        seen = seen.withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))).drop("salts")
        salted = votes.withColumnRenamed("host", site).join(F.broadcast(hot), site, "left")
        salted = salted.select(site, "path", "votes", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))).alias("salt"))
        best = seen.join(salted, [site, "path", "salt"]).groupBy(row).agg(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias(vote))
        chosen = parsed.drop(own, vote).join(best, row, "left")
    at = F.filter(spans, lambda s: s["path"] == F.col(vote))
    pieces = F.flatten(F.transform(at, lambda s: F.slice(blocks, s["first"] + 1, s["end"] - s["first"])))
    return chosen.withColumn(text, F.coalesce(F.array_join(pieces, " "), F.lit(""))).select(*(F.col(f"`{c}`") for c in keep), text)


def main_text(source: str) -> str:
    """The text of the page's own best container, without its host's votes."""
    blocks, found, best, _ = Page(source).scored()
    return " ".join(blocks[found[best][1] : found[best][2]]) if best >= 0 else ""
