"""HTML extraction: page structure first, a host's suffix array for what structure leaves open.

Pages are cut into blocks.  Blocks of the page's article (article, main, role=main) are its text; navigation, headers,
footers, asides, forms, notices, adverts, comments and the like are not.  Where a page marks no article, its other
blocks are open: a host's token streams (its blocks outside articles) are searched for long substrings that
repeat across distinct streams by suffix_dedup's sharded suffix arrays, and open blocks that such substrings cover go.
Pages of a host with equal streams are copies of one page and count once, else a page that is stored twice would be
all boilerplate.  Repetition decides nothing within an article, where copied passages must stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.llm import suffix_dedup
from kilngraph.llm._util import as_bytes, bounded, held
from kilngraph.llm.url_filter import host_of

#: Bytes of a substring that counts as boilerplate when it repeats across pages of a host.
LENGTH = 60
GRAM = 24
#: Pages that are parsed together.
ROWS = 256
#: Share of an open block's bytes that must be covered for it to go.
COVER = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|select|textarea|object|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>"""
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("head nav footer aside form button menu dialog".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var".split())
#: What a head can hold: any other tag ends a head whose end tag is left out.
IN_HEAD = frozenset("head html title base link meta".split())
#: What no main element is within: a main element ends those that are open still.
NOT_AROUND_MAIN = frozenset("head nav header footer aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: A class or id token that names something beside the text: a noise word, with words of place before and of kind behind it.
NOISE = re.compile(
    r"(?:(?:site|page|post|entry|main|global|top|bottom|left|right|header|user|js|wp|the)[-_]?)*"
    r"(?:ads?|adverts?|advertis(?:ing|ements?)|sponsor(?:ed|s)?|promo(?:tions?)?|banner|side-?bar|comments?|disqus|respond|replies|cookies?|consent|gdpr|notices?|notifications?|newsletter|subscribe|shar(?:e|ing)|social|"
    r"related(?=[-_]?(?:posts?|articles?|stories|links|content|news|items|reading)|$)|recommend(?:ed|ations?)?|bread-?crumbs?|menu|nav(?:bar|igation)?|footer|masthead|pop-?up|modal|overlay|login|sign-?up|toolbar|widgets?|skip-?links?|header)"
    r"(?:[-_]?(?:area|bars?|block|box|buttons?|container|content|form|icons?|items?|links?|list|posts?|articles?|stories|news|reading|media|notice|consent|banner|section|slot|text|thread|tools|top|bottom|left|right|unit|widget|wrap(?:per)?|wide|\d+|\d+x\d+))*",
    re.I,
)
#: Readers' comments, also where they are marked up as articles.
READERS = re.compile(r"(?:comments?|replies|respond|disqus)(?:[-_].*)?", re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
MAIN, OPEN, OUT, NAMED = 0, 1, 2, 3


def zone_of(tag: str, attrs: str, zone: int, around: bool) -> int | None:
    """The zone that an element opens, None if it opens none.  NAMED: out for its name only, which an article within it
    overrules if `around`."""
    if zone == OUT or (zone == NAMED and not around):
        return None
    at = {}
    if attrs and ("=" in attrs or "hidden" in attrs):
        at = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    if tag in DROPPED or (tag == "header" and zone != MAIN) or "hidden" in at or at.get("aria-hidden") == "true" or at.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", at.get("style", "")):
        return OUT
    names = f"{at.get('class', '')} {at.get('id', '')}".split()
    if names and any(READERS.fullmatch(n) for n in names):
        return OUT
    if tag in ("article", "main") or at.get("role", "").lower() == "main":
        return MAIN
    if names and zone != NAMED and tag not in ("body", "html") and tag not in INLINE and any(NOISE.fullmatch(n) for n in names):
        return NAMED
    return None


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks that have text, in page order.

    Articles within elements that go by their name are no text (related posts), unless the page has no other article."""
    blocks = zoned(page, False)
    return blocks if has_article(blocks) or not any(z == NAMED for z, _ in blocks) else zoned(page, True)


def zoned(page: str, around: bool) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    zones: list[list] = []  # [tag, zone, open elements of that tag within]
    zone, parts = OPEN, []

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((zone, text))
            parts.clear()

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            parts.append(html.unescape(text))
            continue
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        if not m["close"] and zone == OUT:
            at = next((k for k, z in enumerate(zones) if z[1] == OUT), 0)
            left = zones[-1][0] == "head" and tag not in IN_HEAD
            if left or (tag == "main" and all(z[0] in NOT_AROUND_MAIN for z in zones[at:])):
                flush()
                del zones[at:]
                zone = zones[-1][1] if zones else OPEN
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if m["close"]:
            for k in range(len(zones) - 1, -1, -1):
                if zones[k][0] == tag:
                    flush()
                    if zones[k][2]:
                        zones[k][2] -= 1
                    else:
                        del zones[k:]
                        zone = zones[-1][1] if zones else OPEN
                    break
            continue
        new = None if m["attrs"].endswith("/") else zone_of(tag, m["attrs"], zone, around)
        if new is not None:
            flush()
            zones.append([tag, new, 0])
            zone = new
        elif zones and not m["attrs"].endswith("/"):
            for k in range(len(zones) - 1, -1, -1):
                if zones[k][0] == tag:
                    zones[k][2] += 1
                    break
    flush()
    return out


def has_article(blocks: list[tuple[int, str]]) -> bool:
    return any(z == MAIN for z, _ in blocks)


def extract_text(pages: DataFrame, length: int = LENGTH, gram: int = GRAM, cover: float = COVER) -> DataFrame:
    """Per row of pages: page_id, url, text (blocks joined by line feeds, '' if none), n_chars.

    A null html is an empty page; a null url belongs to host ''.  Each row gives a row.
    """
    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """article: the text of pages that mark one or have no open block, else null; text: the blocks outside articles; opened:
        the open ones among them by their bytes' range."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                articles, texts, ranges = [], [], []
                for page in part.column("html").to_pylist():
                    blocks = blocks_of(page)
                    whole = has_article(blocks) or all(z != OPEN for z, _ in blocks)
                    begin, stream, opened = 0, [], []
                    for z, t in blocks:
                        if z != MAIN:
                            size = len(t.encode())
                            if z == OPEN and not whole:
                                opened.append({"start": begin, "end": begin + size})
                            stream.append(t)
                            begin += size + 1
                    articles.append("\n".join(t for z, t in blocks if z == MAIN) if whole else None)
                    texts.append("\n".join(stream))
                    ranges.append(opened)
                arrays = [part.column("page_id"), part.column("url"), pa.array(articles, pa.string()), pa.array(texts, pa.string()), pa.array(ranges, suffix_dedup.RANGES_ARROW)]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "article", "text", "opened"])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The open blocks that repeats cover less."""
        for batch in batches:
            texts = []
            for raw, starts, opened in zip(as_bytes(batch.column("text")), batch.column("starts").to_pylist(), batch.column("opened").to_pylist(), strict=True):
                removed, _ = suffix_dedup.kept(raw, starts, length)
                blocks = []
                for o in opened:
                    covered = sum(max(0, min(b, o["end"]) - max(a, o["start"])) for a, b in removed)
                    if covered < cover * (o["end"] - o["start"]):
                        blocks.append(raw[o["start"] : o["end"]].decode())
                texts.append("\n".join(blocks))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    parsed = held(rows.mapInArrow(parse, f"page_id long, url string, article string, text string, opened {suffix_dedup.RANGES}"))
    out = parsed.where("article is not null").select("page_id", "url", F.col("article").alias("text"))
    opened = parsed.where("article is null")
    if opened.take(1):
        named = lambda df: df.withColumns({"host": host_of(F.col("url")), "doc_id": F.xxhash64("text")})  # noqa: E731  equal streams of a host share an id, and are one
        opened = named(opened)
        streams = named(parsed).join(opened.select("host").distinct(), "host", "left_semi").select("host", "doc_id", "text").dropDuplicates(["host", "doc_id"])
        repeats = suffix_dedup.find_repeats(streams, length, gram, scope="host", across=True)
        found = suffix_dedup.with_starts(opened, repeats, ["page_id", "url", "opened"], scope="host")
        out = out.unionByName(found.select("row.page_id", "row.url", "text", "starts", "row.opened").mapInArrow(unique, "page_id long, url string, text string"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
