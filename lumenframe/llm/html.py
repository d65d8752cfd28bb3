"""Main text of web pages by consensus of their host.

Each page scores its containers and names the best by its generalised tag-class path (numbers in classes
dropped).  Votes are added up per host in Spark; the path with most votes is the host's.  A second pass
extracts each page again from the containers on its host's path; a page without such a container keeps its
own best.

Elements whose tag, role, class or id names a part beside the article (menu, sidebar, advert, ...) are *suspect*.
A suspect's text is left out, however long it is, as long as less suspect text is left: a class or id can mislead, a tag or
a role hardly does, and comments are comments.  A name misleads where nothing less suspect is left, or where a class
holds the page's only main heading, and most of the text as suspect as itself; then it only lowers the score.  That is
put to the vote of the host, too, by path.

Scale: votes are one short row per page and suspect path, pre-aggregated per (host, path) before the shuffle, so
a host with a third of all pages costs a few rows per task.  The winners are broadcast where their number is
within ``broadcast_hosts``, else joined by a shuffle.  Reading a page takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship_code, stored

# fixed values: element names of the HTML standard, and words that name parts of a page that aren't its article
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "option", "audio", "video", "noframes", "xmp"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "picture", "source"))
CONTAINERS = frozenset(("html", "body", "main", "article", "section", "div", "td", "table", "tbody", "tr", "center", "content"))
BESIDE = frozenset(("nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDE = frozenset(("ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "nav", "navbar", "navigation", "menu", "menubar", "topbar", "sidebar", "sidebars", "aside", "footer", "masthead", "breadcrumb", "breadcrumbs", "comments", "comment", "commentlist", "disqus", "replies", "reply", "respond", "discussion", "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup", "popup", "modal", "overlay", "login", "search", "searchform", "pagination", "pager", "toolbar", "skip", "widget", "widgets", "header"))
CONTENT = frozenset(("article", "articles", "blog", "body", "content", "entry", "main", "page", "post", "recipe", "story", "text"))
COMMENTS = frozenset(("comments", "comment", "commentlist", "disqus", "replies", "reply", "respond", "discussion"))
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|</?[a-zA-Z!?][^>]*\Z""", re.S)
#: containers deeper than this are not told apart; their text stays
DEEPEST = 64
#: inline elements are no longer told apart in a stack of this size
TALLEST = 512
#: what a rescued suspect's text counts
PENALTY = 0.25
#: how suspect a part is: by class or id, by tag or role, as comments; 0 for none
BY_CLASS, BY_TAG, AS_COMMENTS = 1, 2, 3
ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
LETTERS = re.compile(r"[a-z]+")
NUMBERS = re.compile(r"\d+")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)


class Block(NamedTuple):
    """Text between two block boundaries, how much of it is linked, the (number, path) of the containers and the (number, path, tier) of the suspects around it, outermost first, and whether it is a main heading."""

    text: str
    linked: int
    around: tuple
    suspects: tuple
    heading: bool


class Open(NamedTuple):
    """An open element: what of it and of the elements around it counts for its text."""

    name: str
    path: str = ""
    hidden: bool = False
    linked: bool = False
    article: bool = False
    depth: int = 0
    around: tuple = ()
    suspects: tuple = ()


def named(value: str) -> tuple[bool, bool, bool]:
    """What names in a class, id or role say: (beside the article, part of it, comments).  A name with words of both kinds says nothing."""
    beside = inside = comments = False
    for one in value.split():
        words = set(LETTERS.findall(one))
        off, on = bool(words & ASIDE) and not words & {"with", "has", "no"}, bool(words & CONTENT)
        beside |= off and not on
        inside |= on and not off
        comments |= off and not on and bool(words & COMMENTS)
    return beside, inside, comments


def attributes(raw: str) -> tuple[str, tuple[bool, bool, bool], str, bool]:
    """Generalised class list, what the names say, role, whether hidden."""
    if "=" not in raw and "hidden" not in raw:
        return "", (False, False, False), "", False
    classes, names, role, hidden = "", [], "", False
    for name, a, b, c in ATTR.findall(raw):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        elif name == "style":
            hidden |= bool(UNSEEN.search(value))
        else:
            names.append(value)
            if name == "class":
                classes = ".".join(sorted(set(NUMBERS.sub("", value).split())))
            elif name == "role":
                role = value
    return classes, named(" ".join(names)), role, hidden


def blocks(html: str) -> list[Block]:
    """The blocks of text outside scripts, styles and hidden parts, in page order."""
    out: list[Block] = []
    stack: list[Open] = [Open("")]
    opened: dict[str, int] = {}
    skipped: dict[str, int] = {}
    ends: dict[str, tuple[int, int]] = {}  # the next end of each raw element
    text: list[str] = []
    linked, numbers, at, n = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if text:
            # a reference can't begin in one piece and end in another, so pieces are decoded one by one
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, linked, stack[-1].around, stack[-1].suspects, bool(opened.get("h1"))))
            text.clear()
        linked = 0

    def shut(k: int) -> None:
        for x in stack[k:]:
            opened[x.name] -= 1
        del stack[k:]

    while at < n:
        m = TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at and not stack[-1].hidden:
            piece = unescape(html[at:end])
            text.append(piece)
            if stack[-1].linked:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        closing, name, inner = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        inline = name in INLINE
        if closing:
            if not inline:
                flush()
            if skipped.get(name):
                skipped[name] -= 1
            elif opened.get(name):
                k = len(stack) - 1
                while stack[k].name != name and not (inline and stack[k].name not in INLINE):
                    k -= 1
                if stack[k].name == name:
                    if inline and k < len(stack) - 1:  # only this one: what is open inside goes on outside it
                        above = stack[k + 1 :]
                        shut(k)
                        for x in above:
                            was = stack[-1]
                            stack.append(x._replace(linked=was.linked or x.name == "a", hidden=was.hidden, suspects=was.suspects))
                            opened[x.name] = opened.get(x.name, 0) + 1
                    else:
                        shut(k)
            continue
        if name in RAW:
            if not inner.rstrip().endswith("/") or name in ("script", "style"):
                a, b = ends.get(name, (-1, -1))
                if a < at:
                    close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                    a, b = ends[name] = close.span() if close else (n, n)
                at = b if a < n else n if name in ("script", "style") else at
            continue
        if name in VOID:
            if name == "br":
                text.append(" ")
            elif name == "hr":
                flush()
            continue
        classes, (beside, inside, comments), role, hidden = attributes(inner) if inner else ("", (False, False, False), "", False)
        if not inline:
            flush()
            others = CLOSES.get(name, frozenset())
            if opened.get("p") or any(opened.get(x) for x in others):
                for k in range(len(stack) - 1, 0, -1):
                    open_name = stack[k].name
                    if open_name == "p" or open_name in others:
                        shut(k)
                        break
                    if open_name in CONTAINERS or open_name in ("ul", "ol", "dl") or open_name in BESIDE:
                        break
        was = stack[-1]
        hidden = was.hidden or hidden or name == "head"
        suspect = by_tag = False
        if name not in ("html", "body", "article", "main", "head"):
            by_tag = name in BESIDE and not (name == "header" and was.article) or role in ("navigation", "banner", "search", "dialog", "contentinfo", "complementary")
            suspect = by_tag or beside and not inside and not (was.article and "header" in classes and not comments)
        if inline and len(stack) > TALLEST and not hidden and not suspect:
            skipped[name] = skipped.get(name, 0) + 1
            continue
        path, around, suspects, depth = was.path, was.around, was.suspects, was.depth + (not inline)
        if not inline and depth <= DEEPEST:
            path = f"{path}>{name}.{classes}" if classes else f"{path}>{name}"
            if name in CONTAINERS:
                around = (*around, (numbers, path))
                numbers += 1
        if suspect and len(suspects) < DEEPEST:
            suspects = (*suspects, (numbers, path if not inline else f"{path}>{name}.{classes}", AS_COMMENTS if comments else BY_TAG if by_tag else BY_CLASS))
            numbers += 1
        if not inner.endswith("/") or not inline:
            stack.append(Open(name, path, hidden, was.linked or name == "a", was.article or name in ("article", "main"), depth, around, suspects))
            opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def misnamed(found: list[Block]) -> dict[int, tuple[str, bool]]:
    """Each suspect's path, and whether its name misleads: nothing less suspect is left, and it holds most of what is as suspect as itself.

    One by class alone misleads, too, where it holds the page's only main heading and most of the text of no suspect or of such ones.
    """
    total, own, out = [0, 0, 0, 0], {}, {}
    heads: list[set[int]] = []
    for b in found:
        plain = max(0, len(b.text) - b.linked)
        tier = max((t for _, _, t in b.suspects), default=0)
        total[tier] += plain
        if b.heading:
            heads.append({number for number, _, _ in b.suspects})
        for number, path, t in b.suspects:
            own[number] = own.get(number, 0) + (plain if tier == t else 0)
            out[number] = path, t
    told = {}
    for k, (path, t) in out.items():
        leads = t == BY_CLASS and bool(heads) and all(k in h for h in heads)
        most = 2 * own[k] > total[t] + (total[0] if leads else 0)
        told[k] = path, most and (leads or not sum(total[:t]))
    return told


def kept(found: list[Block], rescued: set[str]) -> list[Block]:
    """The blocks that lie in no suspect but those on ``rescued`` paths."""
    return [b for b in found if all(path in rescued for _, path, _ in b.suspects)]


def scores(found: list[Block]) -> dict[int, tuple[float, str]]:
    """Score and path of each container: text that isn't linked, of the blocks it holds; nearer containers take more."""
    out: dict[int, tuple[float, str]] = {}
    for b in found:
        share = max(0, len(b.text) - 2 * b.linked) * (1.0 if len(b.text) >= 40 else 0.5) * (PENALTY if b.suspects else 1.0)
        for number, path in reversed(b.around):
            bonus = 1.25 if path.rpartition(">")[2].partition(".")[0] in ("article", "main") else 1.0
            out[number] = (out.get(number, (0.0, path))[0] + share * bonus, path)
            share *= 0.9
    return out


def best(found: list[Block]) -> tuple[int, str] | None:
    """Number and path of the container with the highest score; ties to the one that begins first."""
    ranked = scores(found)
    if not ranked:
        return None
    number = max(ranked, key=lambda k: (ranked[k][0], -k))
    return number, ranked[number][1]


def ballot(html: str | None) -> tuple[str | None, dict[str, int]]:
    """A page's votes: the path of its best container, and for each suspect path whether its name misleads (1) or not (-1)."""
    found = blocks(html or "")
    told = misnamed(found)
    own = best(kept(found, {path for path, yes in told.values() if yes}))
    votes: dict[str, int] = {}
    for path, yes in told.values():
        votes[path] = votes.get(path, 0) + (1 if yes else -1)
    return own and own[1], votes


def extract(html: str | None, path: str | None, rescued: set[str]) -> str:
    """Text of the containers on ``path``, or of the page's own best container, or of all blocks, without suspects but those ``rescued``."""
    all_blocks = blocks(html or "")
    found = kept(all_blocks, rescued)
    if not found:  # a page that has nothing else, whatever its host says
        found = kept(all_blocks, {p for p, yes in misnamed(all_blocks).values() if yes})
    if path:
        on = [b for b in found if any(p == path for _, p in b.around)]
        if on:
            return "\n".join(b.text for b in on)
    own = best(found)
    return "\n".join(b.text for b in found if own is None or any(k == own[0] for k, _ in b.around))


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", url or "")
    return m[1].lower() if m else ""


def extract_pages(pages: DataFrame, broadcast_hosts: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages(page_id, url, html, ...)``.

    Null or empty html gives empty text.  Pages without a host vote together.  Ties between containers go to the
    one that begins first, between paths to the shorter, then the smaller.  Repeated rows vote and are returned
    as often as they occur; other columns are left out.
    """
    ship_code(pages.sparkSession)

    def vote(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            votes: dict[tuple[str, bool, str], int] = {}
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                host, (path, told) = host_of(url), ballot(html.as_py())
                for suspect, where, n in [(False, path, 1)] * (path is not None) + [(True, p, n) for p, n in told.items()]:
                    votes[host, suspect, where] = votes.get((host, suspect, where), 0) + n
            cols = list(zip(*votes, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "suspect", "path", "votes"])

    votes = pages.select("url", "html").mapInArrow(lean(vote), "host string, suspect boolean, path string, votes long")
    total = votes.groupBy("host", "suspect", "path").agg(F.sum("votes").alias("votes"))
    # most votes; ties to the shorter, then the smaller path; and the suspect paths that most pages with them call misnamed
    winner = F.min_by(F.when(~F.col("suspect"), F.col("path")), F.when(~F.col("suspect"), F.struct(-F.col("votes"), F.length("path"), "path"))).alias("path")
    won = stored(total.where("not suspect or votes > 0").groupBy("host").agg(winner, F.collect_list(F.when(F.col("suspect"), F.col("path"))).alias("rescued")), "paths")
    few = won.count() <= broadcast_hosts
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(F.broadcast(won) if few else won, "host", "left")

    def again(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            text = [extract(h.as_py(), p, set(r or ())) for h, p, r in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.select("page_id", "url", "html", "path", "rescued").mapInArrow(lean(again), f"page_id {kind}, url string, text string, n_chars long")


def op7_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; see ``extract_pages``."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
