"""Main text of web pages by consensus paths of their hosts.

Every page is parsed once to score its containers: text outside links counts
for a container, link text against it, less with each level of depth; words in
class names are one sign among these and never decide against an element that
holds the article. The page's best containers vote with their generalised path (tags and classes
without digits). Votes are summed per host in Spark, and every page is then
extracted again with its host's leading path that it has; a page that has none
of them falls back to its own best container. The container may be an inner part
of the article: what is taken is the article around it.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import materialise

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped up to their end tag or the end of the page, as HTML does.
RAW = "script|style|title|textarea|noscript|template|iframe|select|object"
#: Skipped as elements: they may be self-closed, or end with what is around them.
INERT = frozenset("svg button canvas annotation annotation-xml".split())
FOREIGN = frozenset("svg math".split())
#: Elements of svg and math that hold HTML, and tags that end svg and math anywhere else.
HOLDS_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: An open paragraph, list item or text element around these isn't ended from inside.
SCOPE = frozenset("button foreignobject annotation-xml".split())
#: Elements that opening tags end, and what these stand in.
ENDING = frozenset("li ul ol menu dt dd dl tr td th table".split())
#: Never the article, wherever they stand; header only outside an article.
DROPPED = frozenset("nav footer aside menu dialog header head".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body center blockquote figure fieldset".split())
#: Containers that are left out if they are lists of links.
LISTS = frozenset("ul ol dl div section table".split())
#: Words in class, id or role that speak against an element; evidence inside it can outweigh them, see Page.judge().
JUNK = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar rail widget widgets menu menus nav navbar navigation navi breadcrumb breadcrumbs toc pagination pager footer header masthead topbar toolbar share sharing social related "
    "recommended recommendations comment comments commentlist disqus discussion reply replies respond form search searchbox complementary contentinfo skip copyright disclaimer".split()
)
#: Of these, readers' comments, and what never is a part of an article, whatever its share of the text.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
ADVERTS = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay".split())
#: Words beside which the ones above keep their meaning in a compound class or id; beside others ("related-work") they are subjects.
NEUTRAL = frozenset(
    "area areas aside author bar block blocks body bottom box boxes btn button buttons card cards col column container content count depth desktop div even feed grid group head heading html icon icons inline inner item items js label "
    "large left li link links list lists main meta mobile module odd one outer page parent pane panel post posts region right row section slot small square story stories text thread title top two ul unit wrap wrapper zone".split()
)
#: Their ids are anchors of the text's own headings.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
GOOD = frozenset("article articlebody content entry story post main maincontent text body".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
START = re.compile(r"<[a-z]+(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", re.S | re.I)
ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
#: A class name that begins so speaks of what is absent or stands beside.
BESIDE = frozenset("has no non not with without hide hides show shows enable enables is".split())
#: A heading's own words, which are no sign against it inside an article.
OWN = frozenset("header masthead".split())
DECAY = 0.9
TOP = 3
#: Links and the share of linked text from which a container is a list of links.
LINKS, LINKED = 3, 0.75
#: Shares of the page's text at which a marked element is no side matter: with an article, main or h1 in it; on a page without.
PROVEN, MOST = 0.3, 0.7
#: The share of linked text up to which a marked part of an article may be told.
FEW = 0.2
#: Attributes of up to so many characters are remembered, and of so many elements (20 MB a worker at most).
REMEMBERED, ELEMENTS = 200, 20_000
#: Characters of hosts and paths that are broadcast at most.
BROADCAST = 20_000_000


class Signs(NamedTuple):
    """What an element's attributes say."""

    hidden: bool = False
    good: bool = False
    junk: bool = False  # a word of class or role that speaks against it
    junk_id: bool = False  # one of the id
    inner: bool = False  # a word of class or role, or a compound of such, that does so inside an article too
    inner_id: bool = False
    comment: bool = False  # readers' comments
    advert: bool = False
    name: str = ""  # its classes without digits


PLAIN = Signs()


def signs_of(attrs: str) -> Signs:
    found = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
    classes = found.get("class", "").lower().split()
    words: set[str] = set()
    sets: list[tuple[set[str], set[str]]] = []  # of class and role, then of the id: junk words anywhere, those of tokens that mean nothing else
    for tokens in ([*classes, *found.get("role", "").lower().split()], [found.get("id", "").lower()]):
        some: set[str] = set()
        only: set[str] = set()
        for token in tokens:
            parts = PARTS.findall(token)
            if parts and parts[0] not in BESIDE:
                words.update(parts)
                some.update(JUNK.intersection(parts))
                if all(p in JUNK or p in NEUTRAL for p in parts):
                    only.update(JUNK.intersection(parts))
        sets.append((some, only))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    good = not words.isdisjoint(GOOD) or "articlebody" in found.get("itemprop", "").lower()
    (junk, inner), (junk_id, inner_id) = sets
    both = inner | inner_id
    name = "." + ".".join(sorted({DIGITS.sub("", c).replace("/", "_") for c in classes})) if classes else ""
    return Signs(hidden, good, bool(junk), bool(junk_id), bool(inner - OWN), bool(inner_id - OWN), not both.isdisjoint(COMMENTS), not both.isdisjoint(ADVERTS), name)


remembered = lru_cache(ELEMENTS)(signs_of)


class Node:
    __slots__ = ("tag", "name", "pid", "up", "place", "hard", "mark", "comment", "advert", "good", "article", "inert", "foreign", "linked", "holder", "scope", "open", "li", "dd", "row", "cell")

    def __init__(self, tag: str, up: Node | None) -> None:
        self.tag, self.up, self.name, self.pid, self.place = tag, up, tag, 0, 0
        self.hard = self.mark = self.comment = self.advert = self.good = False
        self.li: Node | None = None
        self.dd = self.row = self.cell = self.li
        block = tag in BLOCK
        if up is None:
            self.article = self.inert = self.linked = False
            self.foreign: Node | None = None
            self.holder, self.scope, self.open = self, self, dict[str, int]()
            return
        self.article, self.inert, self.linked = up.article, up.inert or tag in INERT, up.linked or tag == "a"
        self.foreign = None if tag in HOLDS_HTML else self if tag in FOREIGN else up.foreign
        self.holder = self if block else up.holder
        if block or tag in SCOPE:
            self.scope, self.open = self, {}
        else:
            self.scope = up.scope
        if tag not in SCOPE:  # the nearest element that an opening tag of each kind ends, if no barrier stands between
            self.li, self.dd, self.row, self.cell = up.li, up.dd, up.row, up.cell
            if tag in ENDING:
                self.li = self if tag == "li" else None if tag in ("ul", "ol", "menu") else up.li
                self.dd = self if tag in ("dt", "dd") else None if tag == "dl" else up.dd
                self.row = self if tag in ("tr", "td", "th") else None if tag == "table" else up.row
                self.cell = self if tag in ("td", "th") else None if tag in ("tr", "table") else up.cell


class Block(NamedTuple):
    holder: Node
    text: str
    linked: int  # characters in links
    links: int


class Page:
    """The elements of a page in order of their start, and the blocks that aren't side matter.

    One pass; each element knows what it needs of those around it, so no step walks
    to the root and time is linear in the page's size, however deep it nests.
    """

    def __init__(self, page: str) -> None:
        self.nodes = [Node("", None)]
        self.names: list[tuple[int, str]] = [(0, "")]
        self.paths: dict[tuple[int, str], int] = {}
        self.total: dict[str, int] = {}  # open elements by tag
        self.blocks: list[Block] = []
        self.parse(page)
        self.judge()

    def opened(self, tag: str, attrs: str, up: Node) -> Node:
        node = Node(tag, up)
        signs = PLAIN if not attrs or attrs.isspace() else remembered(attrs) if len(attrs) <= REMEMBERED else signs_of(attrs)
        node.good = signs.good or tag in ("article", "main")
        node.hard = up.hard or signs.hidden or node.inert or tag in DROPPED and not (tag == "header" and up.article)
        by_id = tag not in ANCHORED and (signs.inner_id if up.article else signs.junk_id)
        node.mark = tag == "form" or tag not in ("html", "body", "article", "main") and (by_id or (signs.inner if up.article else signs.junk)) or signs.comment and tag not in ("html", "body", "main")
        node.comment, node.advert = signs.comment, signs.advert
        node.article = up.article or node.good and (tag in ("article", "main") or tag in CONTAINER and tag != "body" and not node.mark)
        node.pid = up.pid
        if tag in BLOCK:
            node.name = tag + signs.name
            node.pid = self.paths.setdefault((up.pid, node.name), len(self.names))
            if node.pid == len(self.names):
                self.names.append((up.pid, node.name))
        node.place = len(self.nodes)
        self.nodes.append(node)
        return node

    def parse(self, page: str) -> None:
        top = holder = self.nodes[0]
        text: list[str] = []
        linked = links = at = 0

        def flush() -> None:
            nonlocal linked, links
            if text and (joined := " ".join("".join(text).split())):
                self.blocks.append(Block(holder, joined, min(linked, len(joined)), max(links, linked > 0)))
            text.clear()
            linked = links = 0

        def shut(node: Node) -> None:
            """Ends node and all that is open inside it."""
            nonlocal top
            end = node.up
            while top is not end and top.up:
                self.total[top.tag] -= 1
                if top.tag not in BLOCK:
                    top.up.scope.open[top.tag] -= 1
                top = top.up

        def nearest(tag: str) -> Node:
            node = top
            while node.tag != tag and node.up:
                node = node.up
            return node

        while True:
            m = TOKEN.search(page, at)
            said = page[at : m.start() if m else len(page)]
            if said and not top.hard:
                if not text:
                    holder = top.holder
                if "&" in said:  # here, as a reference doesn't go on behind a tag
                    said = entities.unescape(said)
                text.append(said)
                if top.linked:
                    linked += len(said)
            if m is None:
                break
            at = m.end()
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                if top.foreign:
                    if m[1] and (start := START.match(page, m.start())) and start[0].endswith("/>"):
                        at = start.end()  # a self-closed title, style or script of svg
                    elif m[0].startswith("<![CDATA["):
                        at = end + 3 if (end := page.find("]]>", m.start())) >= 0 else len(page)
                continue
            closing = m[2] or m[5]
            was = top
            if tag in BREAKS and not closing or tag in ("p", "br") and closing:
                while top.foreign:
                    shut(top.foreign)
            if tag == "br":
                text.append(" ")
                continue
            if tag in VOID:
                if tag == "hr" and not top.inert:
                    flush()
                continue
            if closing:
                if tag in BLOCK and tag != "p" or tag in INERT:
                    if self.total.get(tag):
                        shut(nearest(tag))
                elif top.scope.tag == tag:
                    shut(top.scope)
                elif tag != "p" and top.scope.open.get(tag):  # the end of a text element doesn't reach past its block
                    shut(nearest(tag))
            elif not (m[4] or m[7] or "").endswith("/") or not (tag in FOREIGN or top.foreign):
                if tag in BLOCK and top.scope.tag == "p":  # ends an open paragraph, with what is open inside it
                    shut(top.scope)
                ended = top.li if tag == "li" else top.dd if tag in ("dt", "dd") else top.row if tag == "tr" else top.cell if tag in ("td", "th") else None
                if ended is not None:
                    shut(ended)
                if tag == "button" and top.inert and self.total.get("button"):
                    shut(nearest("button"))
                if tag not in BLOCK:
                    top.scope.open[tag] = top.scope.open.get(tag, 0) + 1
                self.total[tag] = self.total.get(tag, 0) + 1
                top = self.opened(tag, m[4] or m[7] or "", top)
                links += tag == "a"
            if tag in BLOCK and not (was.inert and top.inert):
                flush()
        flush()

    def judge(self) -> None:
        """Leaves out side matter: what is hidden or of such a kind, what marks and evidence speak against, and lists of links.

        A marked element stays if it holds an article, main or h1 and a good share of
        the page's text and no unmarked article or main stands beside it, or if it
        holds most of the text of a page that has none of these. Inside an article it
        stays if it is no advert and a good share of the page's text with few links.
        Readers' comments go wherever an unmarked article or main is on the page.
        """
        n = len(self.nodes)
        plain, size, linked, links, proof = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for b in self.blocks:
            i = b.holder.place
            plain[i] += len(b.text) - b.linked
            size[i] += len(b.text)
            linked[i] += b.linked
            links[i] += b.links
        for i in range(n - 1, 0, -1):
            node = self.nodes[i]
            up = node.up.place  # type: ignore[union-attr]
            proof[i] = proof[i] or node.tag in ("article", "main", "h1") and not node.hard and not node.mark
            for sums in (plain, size, linked, links):
                sums[up] += sums[i]
            proof[up] = proof[up] or proof[i]
        marked, above, free = [False] * n, [0] * n, 0  # above: unmarked articles around each element
        for i, node in enumerate(self.nodes[1:], 1):
            up = node.up.place  # type: ignore[union-attr]
            marked[i] = marked[up] or node.mark
            own = node.tag in ("article", "main") and not marked[i] and not node.hard and plain[i] > 0
            above[i], free = above[up] + own, free + own
        for i, node in enumerate(self.nodes[1:], 1):
            node.hard = node.hard or node.up.hard  # type: ignore[union-attr]
            if node.mark and not node.hard:
                told = node.up.article and not node.advert and not node.comment and node.tag != "form" and plain[i] >= PROVEN * plain[0] and linked[i] <= FEW * size[i]  # type: ignore[union-attr]
                node.hard = node.comment and free > 0 or not (told or proof[i] and free == above[i] and plain[i] >= PROVEN * plain[0] or not proof[0] and plain[i] >= MOST * plain[0])
            elif node.tag in LISTS and links[i] >= LINKS and linked[i] >= LINKED * size[i] and not proof[i]:
                node.hard = True
        self.blocks = [b for b in self.blocks if not b.holder.hard]

    def path(self, pid: int) -> str:
        names = []
        while pid:
            pid, name = self.names[pid]
            names.append(f"/{name}")
        return "".join(reversed(names))

    def find(self, path: str) -> int | None:
        pid: int | None = 0
        for name in path.split("/")[1:]:
            if (pid := self.paths.get((pid, name))) is None:  # type: ignore[arg-type]
                return None
        return pid

    def below(self, chosen: Callable[[Node], bool]) -> list[Node | None]:
        """For each element the nearest chosen one that it is or that is around it."""
        out: list[Node | None] = []
        for node in self.nodes:
            out.append(node if chosen(node) else out[node.up.place] if node.up else None)
        return out

    def inside(self, pid: int) -> list[Node | None]:
        """For each block the container of this path that holds it."""
        of = self.below(lambda node: node.pid == pid and node.tag in CONTAINER)
        return [of[b.holder.place] for b in self.blocks]

    def ranked(self, top: int = TOP) -> list[tuple[int, str, float]]:
        """The best container paths (number, path, score); of equal ones the first on the page."""
        worth = [0.0] * len(self.nodes)
        for b in self.blocks:
            worth[b.holder.place] += len(b.text) - 2 * b.linked
        best: dict[int, float] = {}
        for node in reversed(self.nodes[1:]):
            score = worth[node.place]
            up = node.up.place  # type: ignore[union-attr]
            if node.tag in CONTAINER:
                worth[up] += score * DECAY
                score *= (1.25 if node.good else 1.0) * (0.5 if node.tag == "body" else 1.0)
                best[node.pid] = max(best.get(node.pid, 0.0), score)
            else:
                worth[up] += score
        leading = sorted(((p, s) for p, s in best.items() if s > 0), key=lambda x: (-x[1], x[0]))[:top]
        return [(p, self.path(p), s) for p, s in leading]

    def around(self, won: list[Node]) -> set[int]:
        """Places of what the containers are parts of: the outermost article element around each, else main, else the nearest marked container with more text than links besides."""
        outer: list[list[Node | None]] = []
        for tag in ("article", "main"):
            if tag in self.total:
                of: list[Node | None] = []
                for node in self.nodes:
                    of.append((of[node.up.place] if node.up else None) or (node if node.tag == tag else None))
                outer.append(of)
        good = self.below(lambda node: node.good and node.tag in CONTAINER and node.tag != "body")
        texts = [0] * len(self.nodes)
        for b in self.blocks:
            texts[b.holder.place] += 2 * b.linked < len(b.text)
        for node in reversed(self.nodes[1:]):
            texts[node.up.place] += texts[node.place]  # type: ignore[union-attr]
        wider = set()
        for node in won:
            whole = next((of[node.place] for of in outer if of[node.place]), None)
            if whole is None:
                up = good[node.up.place] if node.up else None
                while up and texts[up.place] <= texts[node.place]:
                    up = good[up.up.place] if up.up else None
                whole = up or node
            wider.add(whole.place)
        return wider


def extract(page: str | None, paths: list[str]) -> str:
    """Blocks of the article that the first of `paths` on the page is a part of; else that its own best container is; else all of them.

    An article element gives all its blocks. From main, and from a container that
    is only marked, blocks outside the path come if they aren't mostly links.
    """
    found = Page(page or "")
    for pid in chain(map(found.find, paths), (p for p, _, _ in found.ranked(1))):
        held = found.inside(pid) if pid is not None else []
        if won := list({c.place: c for c in held if c}.values()):
            wider = found.around(won)
            of = found.below(lambda node: node.place in wider)
            got = []
            for b, c in zip(found.blocks, held, strict=True):
                whole = of[b.holder.place]
                if c or whole and (whole.tag == "article" or 2 * b.linked < len(b.text)):
                    got.append(b.text)
            return "\n\n".join(got)
    return "\n\n".join(b.text for b in found.blocks)


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def consensus(pages: DataFrame, per_host: int = 4) -> DataFrame:
    """host, paths: the leading container paths by summed votes; a page has one vote in all.

    A path whose text is the same on most of a host's pages that have it is a
    template's, not an article's: its votes count by the share of distinct texts.
    """

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            votes: dict[tuple[str, str, int], list[float]] = {}
            for host, page in zip(frame["host"].tolist(), frame["html"].tolist(), strict=True):
                found = Page(page or "")
                best = found.ranked()
                total = sum(s for _, _, s in best)
                for pid, path, score in best:
                    text = "\n".join(b.text for b, c in zip(found.blocks, found.inside(pid), strict=True) if c)
                    sums = votes.setdefault((host, path, zlib.crc32(text.encode("utf-8", "replace"))), [0.0, 0])
                    sums[0] += score / total * (2.0 if pid == best[0][0] else 0.5)
                    sums[1] += 1
            yield pd.DataFrame([(*k, *v) for k, v in votes.items()], columns=["host", "path", "digest", "vote", "n"])

    rows = pages.select("host", "html").mapInPandas(vote, "host string, path string, digest long, vote double, n long")
    sums = rows.groupBy("host", "path").agg(F.sum(F.round("vote", 6).cast("decimal(28,6)")).alias("vote"), F.sum("n").alias("n"), F.approx_count_distinct("digest").alias("texts"))
    weight = F.col("vote") * F.when(2 * F.col("texts") >= F.col("n"), 1.0).otherwise(F.col("texts") / F.col("n"))
    leading = sums.withColumn("place", F.row_number().over(W.partitionBy("host").orderBy(F.desc(weight), F.length("path"), "path"))).filter(F.col("place") <= per_host)
    return leading.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("p")).select("host", F.col("p.path").alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 50_000, salts: int = 32) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Null or empty html gives an empty text; a null url counts as a host of its own
    kind. Repeated rows are extracted alike. Hosts' paths are broadcast up to
    broadcast_hosts hosts and BROADCAST characters; beyond, they are joined with
    salts, so that a host of any size is spread. No rows in, none out; only the
    three named columns are read.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    kind = dict(base.dtypes)["id"]
    winners = materialise(consensus(base), "paths")
    hosts, characters = winners.agg(F.count("*"), F.sum(F.length("host") + F.length(F.array_join("paths", "/")))).first()
    if hosts <= broadcast_hosts and (characters or 0) <= BROADCAST:
        joined = base.join(F.broadcast(winners), "host", "left")
    else:
        spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [extract(page, list(paths) if paths is not None else []) for page, paths in zip(frame["html"].tolist(), frame["paths"].tolist(), strict=True)]
            yield pd.DataFrame({"id": frame["id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.select("id", "url", "html", "paths").mapInPandas(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
