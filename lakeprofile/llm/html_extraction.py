"""HTML extraction by consensus: pages vote on the path of the main text of their host, and are read again with it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm.common import free_names, stored

BROADCAST_HOSTS = 50_000  # hosts, largest first, whose paths are broadcast
PATH_CHARS = 400  # longer paths go on from a digest of all their steps
DECAY = 0.6  # share of a block's score that the next container above gets
SEMANTIC = 1.5  # factor of article and main
DOUBTFUL = 0.5  # factor of text that stands under a class word and stays
TOP_SHARE = 0.2  # share of the best container's text from which text right below the body belongs to it

# Elements and words of the HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption pre figure figcaption address nav header "
    "footer aside form fieldset details summary hr br menu dialog hgroup search option".split()
)
DOUBTED = frozenset("form fieldset".split())  # may be wrapped around a whole page
DROPPED = frozenset("nav footer aside form menu dialog button select fieldset label input search header head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words that name what is left out, words that may also name a topic, and words that say nothing of either kind.
SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer topbar comment comments disqus cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe signup login pagination pager".split()
)
UNSURE = frozenset(
    "discussion reply replies respond share sharing social related recommended recommendations promotion subscription "
    "masthead toolbar widget skip copyright".split()
)
FILLER = frozenset(
    "area article bar block body bottom box button buttons container form global has header inner item items left "
    "link links list outer page post primary reader readers right secondary section site slot text top unit user wrap wrapper".split()
)
GROUPS = CONTAINERS | frozenset("ul ol dl table aside nav header footer details dialog figure".split())
CLOSES_P = BLOCKS - {"br", "option"}
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|textarea|object|canvas|video|audio|title)\b(?>[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*)[^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")


class Element(NamedTuple):
    tag: str
    path: str
    container: int  # the nearest container, itself included
    dropped: bool
    mark: int  # the nearest mark, its own included; -1 if there is none
    inside: bool  # in an article or main


class Block(NamedTuple):
    container: int
    text: str
    links: int  # characters in links
    heading: bool
    doubted: bool  # stands under a class word


class Page(NamedTuple):
    """Containers as (path, place of the one above, tag), and text blocks."""

    containers: list[tuple[str, int, str]]
    blocks: list[Block]


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _is_dropped(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether tag, role or style alone say that an element is no main text."""
    if tag in DROPPED and tag not in DOUBTED:
        return not (tag == "header" and inside)
    if not attributes:
        return False
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return "display:none" in attributes.get("style", "").replace(" ", "")


LINKED, PARTLY, WHOLLY = 1, 2, 3  # how much a mark says


def _mark(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """What class, id or a form suggest of an element; `_left_out` judges it by what it holds. 0: nothing.

    ``WHOLLY``: a name that says nothing else, such as ``cookie-notice``. ``PARTLY``: such a word among others, on a group
    of blocks outside article and main. ``LINKED``: all other cases, such as ``share-price``, where links have to confirm it.
    """
    if tag in DOUBTED:
        return WHOLLY
    if not attributes or tag in ("html", "body"):
        return 0
    names = [*attributes.get("class", "").split(), *attributes.get("id", "").split()]
    if tag in ("article", "main"):
        return WHOLLY if any(n.lower() in ("comment", "comments", "ad", "advert") for n in names) else 0
    found = 0
    for name in names:
        words = {w.lower() for w in _NAMES.findall(name)}
        if words & SURE:
            own = WHOLLY if words <= SURE | UNSURE | FILLER else PARTLY if tag in GROUPS and not inside else LINKED
        else:
            own = LINKED if words & UNSURE else 0
        found = max(found, own)
    return found


def _is_heart(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element shows that what it stands in is no mere addition; articles such as ``comment-body`` do not."""
    if tag in ("main", "h1"):
        return True
    first = _NAMES.match(attributes.get("class", "").strip()) if tag == "article" else None
    return tag == "article" and (first is None or first[0].lower() not in SURE | UNSURE)


def _left_out(marks: list[tuple[int, int]], hearts: set[int], pieces: Iterable[tuple[int, str, int]]) -> list[bool]:
    """For each mark, given as (mark around it, what it says), whether its text is left out.

    It is not if an article, main or h1 stands in it, or most of the text outside links (a third under a name that says
    other things too), or if links had to confirm it and are less than half of its text: then scores and votes decide.
    Where that leaves nothing of a page, no mark counts.
    """
    weights, linked = [0] * len(marks), [0] * len(marks)
    holds = [k in hearts for k in range(len(marks))]
    seen = set()
    total = 0
    for mark, text, links in pieces:
        size = sum(map(len, text.split()))
        if size:
            seen.add(mark)
        if not links:
            total += size
        if mark >= 0:
            (linked if links else weights)[mark] += size
    for k in range(len(marks) - 1, -1, -1):
        above = marks[k][0]
        if above >= 0:
            weights[above] += weights[k]
            linked[above] += linked[k]
            holds[above] |= holds[k]
    out: list[bool] = []
    for k, (above, says) in enumerate(marks):
        large = (3 if says == PARTLY else 2) * weights[k] > total
        stays = holds[k] or large or (says == LINKED and linked[k] <= weights[k])
        out.append((above >= 0 and out[above]) or not stays)
    if all(mark >= 0 and out[mark] for mark in seen):
        return [False] * len(marks)
    return out


def parsed(html: str) -> Page:
    """The text blocks of a page and the containers that they stand in. Broken markup is read as browsers would."""
    containers: list[tuple[str, int, str]] = [("", -1, "")]
    runs: list[tuple[int, bool, list[tuple[int, str, int]]]] = []  # container, heading, pieces (mark, text, characters in links)
    marks: list[tuple[int, int]] = []
    hearts: set[int] = set()
    stack = [Element("", "", 0, False, -1, False)]
    opened: dict[str, int] = {}
    pieces: list[tuple[int, str, int]] = []
    at = 0

    def flush() -> None:
        if pieces:
            heading = bool(opened.get("h1") or opened.get("h2"))
            runs.append((stack[-1].container, heading, pieces.copy()))
            pieces.clear()

    def say(text: str) -> None:
        if text and not stack[-1].dropped:
            text = unescape(text) if "&" in text else text
            pieces.append((stack[-1].mark, text, len(text.strip()) if opened.get("a") else 0))

    def close(tag: str) -> None:
        while True:
            top = stack.pop()
            opened[top.tag] -= 1
            if top.tag == tag:
                return

    def enter(tag: str, raw: str) -> None:
        if tag in CLOSES_P and opened.get("p"):
            close("p")
        for limit in CLOSES_SAME.get(tag, ()):
            if opened.get(limit):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == limit:
                        break
                    if stack[i].tag == tag:
                        close(tag)
                        break
                break
        if tag in VOID:
            return
        top = stack[-1]
        attributes = _attributes(raw)
        dropped = top.dropped or _is_dropped(tag, attributes, top.inside)
        mark = top.mark
        says = 0 if dropped else _mark(tag, attributes, top.inside)
        if says:
            marks.append((mark, says))
            mark = len(marks) - 1
        elif not dropped and mark >= 0 and _is_heart(tag, attributes):
            hearts.add(mark)
        path, container = top.path, top.container
        if tag in CONTAINERS:
            name = attributes.get("class", "").split()
            step = tag + ("." + _DIGITS.sub("N", name[0]) if name else "")
            path = f"{path}/{step}"
            if len(path) > PATH_CHARS:
                path = "#" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()
            containers.append((path, container, tag))
            container = len(containers) - 1
        stack.append(Element(tag, path, container, dropped, mark, top.inside or tag in ("article", "main")))
        opened[tag] = opened.get(tag, 0) + 1

    for m in _TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS or tag in DROPPED:
            flush()
        if not m[2]:
            enter(tag, m[4])
        elif opened.get(tag):
            close(tag)
        elif tag == "p":
            flush()
    say(html[at:])
    flush()
    out = _left_out(marks, hearts, (p for _, _, run in runs for p in run)) if marks else []
    blocks: list[Block] = []
    for container, heading, run in runs:
        if out:
            run = [p for p in run if p[0] < 0 or not out[p[0]]]
        text = " ".join("".join([p[1] for p in run]).split())
        if text:
            blocks.append(Block(container, text, sum([p[2] for p in run]), heading, any([p[0] >= 0 for p in run])))
    return Page(containers, blocks)


def whole_articles(page: Page) -> list[int]:
    """For each container the one that holds the whole article if the container holds most of it.

    In an article that is the outermost one; in a main without articles that is the main. Elsewhere, and from an article
    to what it stands in, a container gives way to the one above if that holds further text of the same kind: blocks of
    its own, or sections beside a section, and not more text of other kinds. Right below the body a heading or a fair
    share of text is asked for. Containers on the same path need no common one, as they are elected together.
    """
    size = len(page.containers)
    direct, below, headed = [0] * size, [0] * size, [False] * size
    for block in page.blocks:
        value = max(len(block.text) - 2 * block.links, 0)
        direct[block.container] += value
        below[block.container] += value
        headed[block.container] |= block.heading
    has_article = [tag == "article" for _, _, tag in page.containers]
    sections: dict[int, int] = {}
    alike: dict[tuple[int, str], int] = {}
    for c in range(size - 1, 0, -1):
        path, above, tag = page.containers[c]
        below[above] += below[c]
        has_article[above] |= has_article[c]
        alike[above, path] = alike.get((above, path), 0) + below[c]
        if tag == "section":
            sections[above] = sections.get(above, 0) + below[c]
    target, in_article, in_main = [0] * size, [False] * size, [False] * size
    for c in range(1, size):
        path, above, tag = page.containers[c]
        in_article[c], in_main[c] = in_article[above] or tag == "article", in_main[above] or tag == "main"
        same = alike[above, path]
        own = direct[above]
        if page.containers[above][2] in ("", "html", "body") and not headed[above] and own < TOP_SHARE * below[c]:
            own = 0
        like = own + (sections[above] - same if tag == "section" else 0)
        unlike = below[above] - same - like
        climbs = in_article[above] or (in_main[above] and not has_article[c]) or (like > 0 and like >= unlike)
        target[c] = target[above] if climbs and tag != "body" else c
    return target


def candidates(page: Page) -> list[tuple[str, float]]:
    """The paths of a page's articles with their scores, best first.

    A container scores by its text outside links, passed up with a decay, and gives its score to the container of the
    whole article; of several on one path the best counts.
    """
    scores: dict[int, float] = {}
    for container, text, links, _, doubted in page.blocks:
        value = (max(len(text) - 2 * links, 0) + min(text.count(","), 10)) * (DOUBTFUL if doubted else 1)
        while container > 0 and value >= 1:
            _, above, tag = page.containers[container]
            scores[container] = scores.get(container, 0.0) + value * (SEMANTIC if tag in ("article", "main") else 1)
            container, value = above, value * DECAY
    whole = whole_articles(page)
    paths: dict[str, tuple[float, int]] = {}
    for container, score in scores.items():
        path = page.containers[whole[container]][0]
        paths[path] = max(paths.get(path, (0.0, 0)), (score, -container))
    return [(path, score) for path, (score, _) in sorted(paths.items(), key=lambda x: (-x[1][0], -x[1][1]))]


def text_below(page: Page, path: str | None) -> str | None:
    """The blocks in containers of that path, one a line; None if the page has no such text."""
    if path is None:
        return None
    inside = [False] * len(page.containers)
    for i, (own, above, _) in enumerate(page.containers):
        inside[i] = own == path or (above >= 0 and inside[above])
    lines = [block.text for block in page.blocks if inside[block.container]]
    return "\n".join(lines) if lines else None


def extracted(html: str | None, path: str | None) -> str:
    """The main text by the path of the host, or by the page's own best container where that path holds nothing."""
    if not html:
        return ""
    page = parsed(html)
    text = text_below(page, path)
    if text is None:
        own = candidates(page)
        text = text_below(page, own[0][0]) if own else None
    return text if text is not None else "\n".join(block.text for block in page.blocks)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning path of each host: columns host, path, votes, pages.

    Each page gives its scores, as shares of its best one, to the paths of its containers. Votes are added in the
    tasks before they are shuffled, so a host with most of the pages is no larger a group than any other.
    """

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, votes = [], [], []
            for host, html in zip(batch["host"].to_pylist(), batch["html"]):
                found = candidates(parsed(html.as_py() or ""))
                for path, score in found:
                    hosts.append(host)
                    paths.append(path)
                    votes.append(round(1000 * score / found[0][1]))
            yield pa.RecordBatch.from_pydict(
                {"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "vote": pa.array(votes, pa.int64())}
            )

    votes = (
        pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))
        .mapInArrow(vote, "host string, path string, vote bigint")
        .groupBy("host", "path")
        .agg(F.sum("vote").alias("votes"), F.count(F.lit(1)).alias("pages"))
    )
    best = F.max_by(F.struct("path", "votes"), F.struct("votes", "path"))  # of equal votes the later path in order
    return votes.groupBy("host").agg(best.alias("best"), F.max("pages").alias("pages")).select("host", "best.*", "pages")


def host_of(url_col: str):
    """Lower-case host of a URL, the empty text if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def extract_pages(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    out_col: str = "text",
    broadcast_hosts: int = BROADCAST_HOSTS,
) -> DataFrame:
    """``pages`` with the main text of each page; a column of that name is replaced, all others stay.

    The first pass lets pages vote on a path per host, the second reads each page again with the path of its host. A
    page without text on that path goes by its own best container. Character references are decoded, white space in a
    block becomes one blank, blocks are joined by line feeds. Null and empty pages give the empty text, a null or
    hostless URL shares the host ``""``; repeated pages vote and are extracted each; an empty table gives no rows.

    The paths of the ``broadcast_hosts`` hosts with the most pages are broadcast. Pages of other hosts, each of which
    then has a small share of all pages, meet their path in a shuffle.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def extract(htmls: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([extracted(h.as_py(), p.as_py()) for h, p in zip(htmls, paths)], type=pa.string())

    host, path, large = free_names(pages, "host", "path", "large")
    winners = stored(host_paths(pages, url_col, html_col), "host-paths")
    paths = winners.select(F.col("host").alias(host), F.col("path").alias(path))
    rows = pages.withColumn(host, host_of(url_col))
    if winners.count() <= broadcast_hosts:
        known = rows.join(F.broadcast(paths), host, "left")
    else:
        first = winners.orderBy(F.desc("pages"), "host").limit(broadcast_hosts)
        first = first.select(F.col("host").alias(host), F.col("path").alias(path), F.lit(True).alias(large))
        tagged = rows.join(F.broadcast(stored(first, "large-hosts")), host, "left")
        rest = tagged.where(F.col(large).isNull()).drop(path).join(paths, host, "left")
        known = tagged.where(F.col(large)).unionByName(rest)
    return known.withColumn(out_col, extract(F.col(html_col), F.col(path))).drop(host, path, large)
