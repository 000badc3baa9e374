"""HTML extraction: a host's template is deduced from its pages and dropped, the slots that are left hold the text.

A page is read as a sequence of tokens: block tags with the path of open sections around them, and the text of whole blocks with
the same path. Over the pages of a host, tokens with the same occurrence vector (how often on which page) form an equivalence class.
Vectors are never built: a class key is the sum of hashes of (page, count), which aggregates before the shuffle. A class counts if
its tokens occur on ``SUPPORT`` of the host's different pages and on at least ``PAGES`` of them; a class of one token needs ``SOLO``. Pages are
different where their three longest other blocks differ, so that copies of one article do not make its text a template.
A second reading of the pages checks order and nesting: a class is valid if its tokens come round in one order and
each round lies inside one gap of the classes around it, on all but ``NOISE`` of its pages. Valid classes are the host's template.

Extraction walks a page with its host's template: text that the template holds is dropped, all other text lies in a slot, the gap behind
the template tag met last. Tag rules then say which slots hold the main text: those of the article or main section if there is one (of
the template's, where the page has several), and in it none of a menu, footer, sidebar, notice, advert, form or comment
section. Such sections are known by tag, role, or a whole class or id name (``is_out``); one that encloses the whole article drops nothing.
Without an article, text in no such section stays, apart from three or more blocks in a row that are links only. A page
of which the template would leave nothing keeps its text. Inside slots, runs of text between block tags are blocks: character references
are decoded, white space becomes one space, ends are trimmed, blocks are joined by one space in page order.

Null or empty html gives an empty text; a page without a host belongs to the host ``''``; pages with the same id are the same page
for the counts and keep a row each. A host with fewer than ``PAGES`` different pages has no template. Extra columns are not read.
"""

from __future__ import annotations

import html as html_text
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from talkmetry.llm.common import site, store

#: Share of a host's different pages on which a class occurs, and how many such pages a class of several tokens and one of a single token need.
SUPPORT, PAGES, SOLO = 0.5, 3, 8
#: Share of a class's pages that may break its order or nesting, as cut-off pages do.
NOISE = 0.1
#: Blocks in a row that hold nothing but links make a menu.
MENU = 3
MAIN = frozenset({"article", "main"})
#: Sections that hold no main text: by tag, by role, by a whole class or id name, by the first part of such a name, and (behind
#: ``OUT_PLACES``) by its second part. Fixed values.
OUT_TAGS = frozenset("head nav header footer aside form script style noscript template svg iframe button select textarea dialog menu".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header "
    "masthead cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing social related comment comments "
    "respond disqus widget toolbar pagination pager".split()
)
OUT_FIRST = frozenset("ad ads advert adverts advertisement sponsored nav navbar breadcrumb breadcrumbs sidebar footer cookie cookies comment comments newsletter related social widget disqus".split())
OUT_PLACES = frozenset("site page main global top left right".split())
RAW = frozenset({"script", "style", "noscript", "template", "iframe", "textarea", "title"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags whose end is often left out; they never enclose a section.
LOOSE = INLINE | frozenset("p li dt dd option tr td th thead tbody tfoot colgroup caption h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure figcaption".split())

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def parts(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, source) of text, open, close and void pieces; comments, declarations and raw text are skipped."""
    at, size = 0, len(page)
    while at < size:
        m = _PART.match(page, at)
        piece = m[0]
        at = m.end()
        if piece[0] != "<" or piece == "<":
            yield "text", "", piece
        elif piece[1] in "!?":
            continue
        elif piece[-1] != ">":  # cut off inside a tag
            continue
        else:
            name = _NAME.match(piece)[1].lower()
            if piece[1] == "/":
                yield "close", name, piece
            elif name in VOID or piece.endswith("/>"):
                yield "void", name, piece
            else:
                yield "open", name, piece
                if name in RAW:
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = end.start() if end else size


def is_out_name(name: str) -> bool:
    """A class or id that marks a section without main text: ``comments``, ``cookie-bar``, ``site-footer``, not ``article-header``."""
    if name in OUT_NAMES:
        return True
    words = _WORD.findall(name)
    return bool(words) and (words[0] in OUT_FIRST or words[0] in OUT_PLACES and len(words) == 2 and words[1] in OUT_NAMES)


def is_out(name: str, source: str, in_main: bool = False) -> bool:
    """A section that holds no main text by itself; the header of an article belongs to it."""
    if name in OUT_TAGS and not (in_main and name == "header"):
        return True
    if name in ("body", "html"):
        return False
    for key, value in _MARKS.findall(source):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in OUT_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and any(map(is_out_name, value.split())):
            return True
    return False


class Zone(NamedTuple):
    """Where a piece lies: digest of the path of open sections, token of the outermost main section (0: none), in an out section
    (of the main section, if there is one), main section itself in an out section, inside a link."""

    path: int
    main: int
    out: bool
    enclosed: bool
    link: bool


def token(label: str, path: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{label}|{path}") >> 1


def walk(page: str) -> Iterator[tuple[str, str, str, Zone]]:
    """(kind, name, source, zone): loose tags never enclose, so that a forgotten end tag changes no path. Each piece costs the same
    however deep it lies."""
    path: list[tuple[str, int, bool]] = []  # name, digest up to here, out section
    open_: Counter[str] = Counter()
    outs = before = 0  # open out sections, and how many of them were open before the main section
    main = main_depth = 0
    out_loose = ""  # a loose tag marked as out lasts until its end tag or the end of its section
    depth = 0
    link = False
    for kind, name, source in parts(page):
        if kind == "open":
            if name == "a":
                link = True
            if name not in LOOSE:
                out = is_out(name, source, bool(main))
                path.append((name, xxhash.xxh3_64_intdigest(f"{path[-1][1] if path else ''}>{name}"), out))
                open_[name] += 1
                if name in MAIN and not out and not main:
                    main, main_depth, before = token(f"o{name}", path[-1][1]), len(path), outs
                outs += out
            else:
                if name == out_loose == "p":  # a paragraph ends where the next begins
                    out_loose = ""
                if not out_loose and name not in INLINE and is_out(name, source):
                    out_loose, depth = name, len(path)
        inside = outs - before if main else outs
        yield kind, name, source, Zone(path[-1][1] if path else 0, main, bool(inside or out_loose), bool(main and before), link)
        if kind == "close":
            if name == "a":
                link = False
            if name == out_loose:
                out_loose = ""
            elif open_[name]:
                while path:
                    last, _, out = path.pop()
                    open_[last] -= 1
                    outs -= out
                    if last == name:
                        break
                if len(path) < depth:
                    out_loose = ""
                if main and len(path) < main_depth:
                    main = before = 0


def read(page: str | None) -> Iterator[tuple[str, int, str, Zone]]:
    """(label, token, text, zone) of the tags and blocks of a page in order. The label of a block is ``t``; inline tags and ``p``
    only shape blocks."""
    run: list[str] = []
    at: Zone | None = None
    linked = True

    def block():
        text = " ".join(html_text.unescape("".join(run)).split()) if at else ""
        run.clear()
        return [("t", token(f"t{text}", at.path), text, at._replace(link=linked))] if text else []

    for kind, name, source, zone in walk(page or ""):
        if kind == "text":
            run.append(source)
            if not source.isspace():
                at = at or zone
                linked = linked and zone.link
        elif name not in INLINE:
            yield from block()
            at, linked = None, True
            if name != "p":
                label = f"{kind[0]}{name}"
                yield label, token(label, zone.path), "", zone
    yield from block()


def page_tokens(page: str | None) -> list[tuple[int, int, int, int]]:
    """(token, occurrences, first position, signature) of a page's tokens; token 0 stands for the page. The signature is the
    page's three longest blocks other than the token."""
    count: Counter[int] = Counter()
    first: dict[int, int] = {}
    sizes: dict[int, tuple[int, int]] = {}
    for n, (label, t, text, _) in enumerate(read(page)):
        count[t] += 1
        first.setdefault(t, n)
        if label == "t":
            sizes[t] = (len(text), xxhash.xxh3_64_intdigest(text) >> 1)
    longest = sorted(sizes, key=lambda t: sizes[t], reverse=True)[:4]

    def signature(leave_out: int) -> int:
        kept = [sizes[t][1] for t in longest if t != leave_out][:3]
        return xxhash.xxh3_64_intdigest(repr(sorted(kept))) >> 1

    plain = signature(0)
    return [(0, 1, 0, plain)] + [(t, n, first[t], signature(t) if t in longest else plain) for t, n in count.items()]


def _map(df: DataFrame, schema: str, rows) -> DataFrame:
    """``rows(*row)`` for each row of ``df``, written out after some 50 000 rows."""
    ddl = StructType.fromDDL(schema)
    arrow = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for n, row in enumerate(zip(*[c.to_pylist() for c in batch.columns]), 1):
                out += rows(*row)
                if len(out) > 50_000 or out and n == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out = []

    return df.mapInArrow(run, ddl)


def breaks(page: str | None, classes: list[dict]) -> set[int]:
    """Ids of the classes whose order or nesting the page breaks."""
    place = {t: (c["id"], k) for c in classes for k, t in enumerate(c["tokens"]) if len(c["tokens"]) > 1}
    size = {c["id"]: len(c["tokens"]) for c in classes}
    bad: set[int] = set()
    rounds: list[list[int]] = []  # open rounds: class, next member
    started: Counter[int] = Counter()
    for _, t, _, _ in read(page):
        if t not in place:
            continue
        c, k = place[t]
        if k == 0:
            if started[c]:
                bad.add(c)
            rounds.append([c, 1])
            started[c] += 1
            continue
        if not started[c]:
            bad.add(c)
            continue
        while rounds[-1][0] != c:  # a round inside this gap that has not ended
            last, _ = rounds.pop()
            started[last] -= 1
            bad.add(last)
        if rounds[-1][1] != k:
            bad.add(c)
        rounds[-1][1] = k + 1
        if k + 1 == size[c]:
            rounds.pop()
            started[c] -= 1
    return bad | {c for c, _ in rounds}


def host_classes(pages: DataFrame) -> DataFrame:
    """(host, classes) of hosts with a class that counts; a class is id, pages and its tokens in page order."""
    body = pages.select(site("url").alias("host"), "page_id", "html")
    tokens = _map(body, "host string, page_id long, token long, n int, at int, signature long", lambda host, i, page: [(host, i, *t) for t in page_tokens(page)])
    one = tokens.groupBy("host", "token", "signature").agg(
        F.sum(F.xxhash64("page_id", "n").cast("decimal(38,0)")).alias("vector"), F.count(F.lit(1)).alias("pages"), F.sum("at").alias("at"))
    per = one.groupBy("host", "token").agg(F.sum("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("at").alias("at"), F.count(F.lit(1)).alias("kinds"))
    per = store(per.where(F.col("kinds") >= PAGES), "tokens")
    size = per.where("token = 0").select("host", F.col("kinds").alias("all_kinds"))
    often = per.where("token <> 0").join(size, "host").where(F.col("kinds") >= SUPPORT * F.col("all_kinds"))
    # Tokens on half of a host's pages are at most twice as many as a page has, so neither a class nor a host grows with the pages.
    member = F.struct((F.col("at") / F.col("pages")).alias("place"), "token")
    classes = often.groupBy("host", "vector", "pages").agg(F.array_sort(F.collect_list(member)).alias("members"), F.min("kinds").alias("kinds"))
    classes = classes.where((F.size("members") > 1) | (F.col("kinds") >= SOLO))
    entry = F.struct(F.xxhash64("vector", "pages").alias("id"), "pages", F.transform("members", lambda m: m["token"]).alias("tokens"))
    return classes.groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("classes"))


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of the host's valid classes, those on most pages first."""
    classes = store(host_classes(pages), "classes")
    body = pages.select(site("url").alias("host"), "html").join(classes, "host")
    broken = _map(body.select("host", "html", "classes"), "host string, id long", lambda host, page, known: [(host, c) for c in breaks(page, known)])
    broken = broken.groupBy("host", "id").agg(F.count(F.lit(1)).alias("times"))
    one = classes.select("host", F.explode("classes").alias("c")).select("host", "c.*")
    valid = one.join(broken, ["host", "id"], "left").where(F.coalesce("times", F.lit(0)) <= NOISE * F.col("pages"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("p"), "id", "tokens")))
    return valid.groupBy("host").agg(F.flatten(F.transform(listed, lambda c: c["tokens"])).alias("template"))


def slots(page: str | None, template: frozenset[int]) -> list[tuple[int, str, Zone, bool]]:
    """(slot, text, zone, held) of a page's blocks: the slot is the template tag met last, ``held`` blocks belong to the template."""
    out = []
    slot = 0
    for label, t, text, zone in read(page):
        if label == "t":
            out.append((slot, text, zone, t in template))
        elif t in template:
            slot = t
    return out


def _menus(blocks: list[tuple[int, str, Zone, bool]]) -> list[tuple[int, str, Zone, bool]]:
    """``blocks`` without runs of ``MENU`` or more that are links only; a page of nothing else keeps them."""
    kept = []
    for link, run in groupby(blocks, key=lambda b: b[2].link):
        run = list(run)
        if not link or len(run) < MENU:
            kept += run
    return kept or blocks


def extract(page: str | None, template: frozenset[int]) -> str:
    """Text of the slots that hold the main text."""
    found = [b for b in slots(page, template) if not b[2].out]
    main = [b for b in found if b[2].main]
    main = [b for b in main if not b[2].enclosed] or main
    main = [b for b in main if b[2].main in template] or main
    chosen = main or _menus([b for b in found if not b[2].main])
    return " ".join(text for _, text, _, held in chosen if not held) or " ".join(text for _, text, _, _ in chosen)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    templates = store(host_templates(pages), "templates")
    body = pages.select("page_id", "url", "html", site("url").alias("host"))
    # The templates are broadcast only where their stored size is under Spark's own limit; else both sides are shuffled by host.
    joined = body.join(templates, "host", "left").select("page_id", "url", "html", "template")

    def row(page_id, url, page, template):
        text = extract(page, frozenset(template or ()))
        return [(page_id, url, text, len(text))]

    return _map(joined, "page_id long, url string, text string, n_chars long", row)
