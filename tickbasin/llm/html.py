"""HTML extraction by consensus host paths.

First pass: every page is parsed, its containers get a score from the text of
the blocks they hold, and each container's path of tags and generalised
classes is a candidate.  Scores are summed by host and path (map-side combined,
so a hot host costs little), and each host's best path wins.  Second pass: the
pages are parsed again and their text is taken from the nodes on the winning
path, or from the page's own best container where the page lacks that path.

A container whose text is mostly in parts of it can lose to those parts, so the
winner is lifted to the outermost container above it that holds headings or
paragraphs of its own, unless these are the same on all pages of the host.

A path is known by a hash of its steps.  Containers nested deeper than DEPTH
count as part of the one at that depth, and tags are read in time linear in the
page's length, so no page makes more than its size in nodes or votes.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from hashlib import blake2b
from html import unescape
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, kept, workspace, written
from .urls import host_and_path

# Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg title textarea".split())
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body main article section div td blockquote center".split())
ARTICLES = frozenset("article main".split())
DROPPED = frozenset("nav footer aside form head menu button select dialog".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies notice notices consent gdpr popup modal overlay alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus respond replies reply share sharing social related recommended newsletter subscribe signup footer masthead pagination pager toolbar widget hidden".split())
# Of these also inside a line: adverts. Other words there name parts of a text, as comments in listings.
INLINE_BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo hidden".split())
#: A word of a class after which the one before says the opposite or something else, as in ad-free and ad-hoc.
OTHERWISE = frozenset("free hoc less".split())
#: Levels of containers that are told apart.
DEPTH = 48
#: Blocks of article text.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figcaption".split())
#: Elements that bound the search for an open element that a start tag closes.
BOUNDS = frozenset("ul ol dl table select article body".split())
#: Start tags that close an open element of the same group.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
#: The rest of a tag with quoted values, and without.
REST, PLAIN_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>"), re.compile(r"[^>]*>")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: One of these is in the attributes of inline boilerplate.
INLINE_HINT = re.compile(r"hidden|ad|sponsor|promo", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
NUMBERS = re.compile(r"[0-9]+")
RAW_END = {tag: re.compile(rf"</{tag}(?![A-Za-z0-9-])[^>]*>", re.I) for tag in RAW}


def attributes(text: str) -> dict[str, str]:
    """class, id, role, hidden and aria-label of a start tag."""
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text else {}


def named_so(attrs: dict[str, str], names: frozenset[str]) -> bool:
    """Whether a class or the id of an element has one of the names as a word, neither denied nor turned into another."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in SPLIT.split(name) if w]
        if words and words[0] not in ("has", "with", "no", "without") and any(w in names and after not in OTHERWISE for w, after in zip(words, [*words[1:], ""], strict=True)):
            return True
    return False


def is_boilerplate(tag: str, attrs: dict[str, str]) -> bool:
    """Whether a block is a menu, notice, advert or the like by its tag, class, id or role."""
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "main", "article") or not attrs:
        return False
    if "hidden" in attrs or attrs.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form"):
        return True
    return named_so(attrs, BOILERPLATE)


def is_inline_boilerplate(rest: str) -> bool:
    """Whether an inline tag with these attributes is an advert or hidden."""
    if not rest or not INLINE_HINT.search(rest):
        return False
    attrs = attributes(rest)
    return "hidden" in attrs or named_so(attrs, INLINE_BOILERPLATE)


class Node:
    """A container: its path, the paths above it, its blocks and children in page order."""

    __slots__ = ("tag", "path", "above", "items", "kept", "direct", "prose")

    def __init__(self, tag: str, path: int, above: tuple[int, ...], kept: bool):
        self.tag, self.path, self.above, self.kept = tag, path, above, kept
        self.items: list[str | Node] = []
        self.direct = 0
        self.prose: list[str] = []


def step(path: int, tag: str, classes: str) -> int:
    """The path of a container below a path: a hash of all its tags and generalised classes."""
    names = ".".join([tag, *sorted(NUMBERS.sub("N", c) for c in classes.split())])
    return int.from_bytes(blake2b(f"{path}/{names}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)


def tags(html: str) -> Generator[tuple[int, int, str | None, str], int | None, None]:
    """Start, end, name (/name for end tags, None for comments and declarations) and attributes of every tag.

    A tag ends at the first > outside quotes; once a quote is left open to the
    page's end, at the first > from then on.  A page is read once and, for the
    open quote, once more.  A sent place is where reading goes on.
    """
    at, last, rest = html.find("<"), html.rfind(">"), REST
    while at >= 0 and (at < last or html.startswith("<!--", at)):
        end = at + 1
        if html.startswith("!--", end):
            close = html.find("-->", end + 3)
            end = close + 3 if close >= 0 else len(html)
            yield at, end, None, ""
        elif html[end] in "!?":
            end = html.find(">", end) + 1
            yield at, end, None, ""
        else:
            name = NAME.match(html, end)
            if name:
                found = rest.match(html, name.end())
                if not found:
                    rest = PLAIN_REST
                    found = rest.match(html, name.end())
                sent = yield at, found.end(), name[0].lower(), html[name.end() : found.end() - 1]
                end = sent or found.end()
        at = html.find("<", end)


class Page:
    """The containers and blocks of a page while it is read."""

    def __init__(self):
        self.root = Node("", 0, (), True)
        #: Open block elements: tag, container, whether kept, depth of containers.
        self.stack: list[tuple[str, Node, bool, int]] = [("", self.root, True, 0)]
        #: Places in the stack of the open elements of each tag, and of those that bound lists and tables.
        self.places: dict[str, list[int]] = {}
        self.bounds: list[int] = []
        self.piece: list[str] = []
        #: The open inline advert: its tag, how often that is open, and the height of the stack below which it ends.
        self.advert, self.nested, self.height = "", 0, 0

    def text(self, part: str) -> None:
        """Text between tags; that of an inline advert goes."""
        if not self.advert:
            self.piece.append(part)

    def inline(self, name: str, rest: str) -> None:
        """An inline tag, or the end of one."""
        if not self.advert:
            if name[0] != "/" and name not in VOID and not rest.endswith("/") and is_inline_boilerplate(rest):
                self.advert, self.nested, self.height = name, 1, len(self.stack)
        elif name.lstrip("/") == self.advert:
            self.nested += -1 if name[0] == "/" else 1
            if not self.nested:
                self.advert = ""

    def flush(self) -> None:
        """Ends a block of text."""
        if self.piece:
            tag, node, kept, _ = self.stack[-1]
            text = " ".join(unescape("".join(self.piece)).split())
            if text and kept:
                node.items.append(text)
                node.direct += len(text)
                if tag in PROSE:
                    node.prose.append(text)
            self.piece.clear()

    def pop_to(self, place: int) -> None:
        """Closes the elements from a place in the stack on."""
        self.flush()
        for tag, *_ in self.stack[place:]:
            self.places[tag].pop()
            if tag in BOUNDS:
                self.bounds.pop()
        del self.stack[place:]
        if len(self.stack) < self.height:
            self.advert, self.height = "", 0

    def close(self, tag: str) -> None:
        """An end tag."""
        self.flush()
        if self.places.get(tag):
            self.pop_to(self.places[tag][-1])

    def open(self, tag: str, attributes_text: str) -> None:
        """A start tag of a block."""
        self.flush()
        if tag in VOID:
            return
        same = max((self.places[t][-1] for t in CLOSES.get(tag, ()) if self.places.get(t)), default=0)
        if same > (self.bounds[-1] if self.bounds else 0):
            self.pop_to(same)
        if self.stack[-1][0] == "p":
            self.pop_to(len(self.stack) - 1)
        attrs = attributes(attributes_text)
        _, node, kept, depth = self.stack[-1]
        inside = kept and not self.advert and not is_boilerplate(tag, attrs) and not (tag == "header" and not self.places.get("article") and not self.places.get("main"))
        if tag in CONTAINERS and depth < DEPTH:
            child = Node(tag, step(node.path, tag, attrs.get("class", "")), (*node.above, node.path), inside)
            node.items.append(child)
            node, depth = child, depth + 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BOUNDS:
            self.bounds.append(len(self.stack))
        self.stack.append((tag, node, inside, depth))


def parse(html: str) -> Node:
    """The tree of containers; inline tags leave no trace, dropped elements and inline adverts no text.

    An inline advert that is not closed ends with the block in which it begins.

    Containers become nodes; other blocks only end the text block before them.
    """
    page, at, last = Page(), 0, html.rfind(">") + 1
    found = tags(html)
    skip = None
    while True:
        try:
            start, end, tag, rest = found.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            page.text(html[at:start])
        at = end
        if tag is None:
            continue
        if tag[0] == "/":
            if tag[1:] in BLOCKS:
                page.close(tag[1:])
            else:
                page.inline(tag, "")
        elif tag in RAW:
            if not rest.endswith("/"):
                close = RAW_END[tag].search(html, at, last)
                at = skip = close.end() if close else len(html)
        elif tag in BLOCKS:
            page.open(tag, rest)
        else:
            page.inline(tag, rest)
    page.text(html[at:])
    page.flush()
    return page.root


def in_order(root: Node) -> list[Node]:
    """All containers, parents first."""
    order = [root]
    for node in order:
        order += [x for x in node.items if isinstance(x, Node)]
    return order


def scored(root: Node) -> dict[int, float]:
    """Score by path: a container's own blocks, and four fifths of its children's; articles count half more."""
    order = in_order(root)
    worth: dict[int, float] = {}
    scores: dict[int, float] = {}
    for node in reversed(order):
        value = node.direct + 0.8 * sum(worth[id(x)] for x in node.items if isinstance(x, Node))
        worth[id(node)] = value
        if value > 0 and node.kept:
            scores[node.path] = scores.get(node.path, 0.0) + value * (1.5 if node.tag in ARTICLES else 1.0)
    return scores


def text_of(node: Node) -> list[str]:
    """The blocks under a node in page order."""
    out, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            todo += reversed(item.items)
    return out


def text_on(root: Node, path: int | None) -> str | None:
    """The text of all outermost nodes on the path, or None if the page has none."""
    out, todo, found = [], [root], False
    while todo:
        node = todo.pop()
        if node.path == path and node.kept:
            found = True
            out += text_of(node)
        else:
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    return " ".join(out) if found else None


def levels(root: Node) -> dict[int, tuple[tuple[int, ...], str]]:
    """The paths above each path, outermost first, and its tag."""
    return {node.path: (node.above, node.tag) for node in in_order(root)}


def best(scores: dict[int, float], known: dict[int, tuple[tuple[int, ...], str]]) -> int | None:
    """The path of the highest score; of ties the one of fewest steps, then the least hash."""
    return min(scores, key=lambda p: (-scores[p], len(known[p][0]), p)) if scores else None


def own_prose(root: Node) -> dict[int, int]:
    """Hash of the headings and paragraphs that stand directly in a path's containers, for paths that have some."""
    texts: dict[int, list[str]] = {}
    for node in in_order(root):
        if node.prose and node.kept:
            texts.setdefault(node.path, []).extend(node.prose)
    return {path: crc32("\n".join(t).encode("utf-8", "surrogatepass")) for path, t in texts.items()}


def ceiling(path: int, above: tuple[int, ...], articles: set[int]) -> tuple[int, ...]:
    """The paths to which a path may be lifted, outermost first: those above it, from its outermost article or main on."""
    line = [*above, path]
    first = next((k for k, p in enumerate(line) if p in articles), 0)
    return tuple(line[first:-1])


def lifted(path: int | None, above: tuple[int, ...], articles: set[int], prose: set[int]) -> int | None:
    """The outermost path of prose to which the path may be lifted, or the path."""
    return path if path is None else next((p for p in ceiling(path, above, articles) if p in prose), path)


def extract(html: str, path: int | None) -> str:
    """The main text by the host's path, or by the page's own best container."""
    if not html:
        return ""
    root = parse(html)
    text = text_on(root, path) if path is not None else None
    if text:
        return text
    known = levels(root)
    own = best(scored(root), known)
    if own is None:
        return ""
    return text_on(root, lifted(own, known[own][0], {p for p, (_, tag) in known.items() if tag in ARTICLES}, set(own_prose(root)))) or ""


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's path of the highest score over all its pages (html, url read)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, html in zip(batch["host"], batch["html"], strict=True):
                if not html:
                    continue
                root = parse(html)
                found, prose, known = scored(root), own_prose(root), levels(root)
                total = sum(found.values())
                for path, value in found.items():  # a page's votes add up to one
                    above, tag = known[path]
                    row = sums.setdefault((host, path), [0.0, 0, 0, 1 << 32, -1, list(above), tag in ARTICLES])
                    row[0] += value / total
                    row[1] += 1
                    if path in prose:
                        row[2:5] = row[2] + 1, min(row[3], prose[path]), max(row[4], prose[path])
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "path", "votes", "pages", "prose", "low", "high", "above", "article"])

    schema = "host string, path long, votes double, pages long, prose long, low long, high long, above array<long>, article boolean"
    votes = pages.select("host", "html").mapInPandas(rows, schema)
    # the paths above a path and its tag are the same in all rows
    totals = [F.sum(c).alias(c) for c in ("votes", "pages", "prose")] + [F.min("low").alias("low"), F.max("high").alias("high"), F.max("above").alias("above"), F.max("article").alias("article")]
    sums, _ = written(votes.groupBy("host", "path").agg(*totals), "path-votes")
    # rounding makes the winner independent of the order in which votes are added
    key = F.struct(F.round("votes", 6).alias("v"), (-F.size("above")).alias("n"), (-F.col("path").cast("decimal(20,0)")).alias("tie"), F.col("path"), F.col("pages"), F.col("above"), F.col("article"))
    winners = sums.groupBy("host").agg(F.max(key).alias("best")).select("host", F.col("best.path").alias("won"), F.col("best.pages").alias("of"), F.col("best.above").alias("line"), F.col("best.article").alias("is_article"))
    winners, _ = written(winners, "host-winners")
    # of the paths above the winner: which are articles, and which have prose of their own on half of its pages, not always the same
    own = (2 * F.col("prose") >= F.col("of")) & ((F.col("prose") == 1) | (F.col("low") < F.col("high")))
    line = winners.select("host", "of", F.posexplode("line").alias("at", "path"))
    steps = join_sized(sums, line, ["host", "path"], "inner").select("host", "at", "path", "article", own.alias("own"))
    listed = steps.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "path", "article", "own"))).alias("steps"))
    first = F.get(F.filter("steps", lambda x: x["article"]), F.lit(0))["at"]
    # lifted as in lifted(): not above the outermost article, which may be the winner itself
    floor = F.coalesce(first, F.when(F.col("is_article"), F.size("line")), F.lit(0))
    goal = F.get(F.filter("steps", lambda x: x["own"] & (x["at"] >= F.col("floor"))), F.lit(0))["path"]
    return winners.join(listed, "host", "left").withColumn("floor", floor).select("host", F.coalesce(goal, "won").alias("path"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Extracts the main text of every page from the whole html.

    Returns id, url, text and n_chars (code points).  Null or empty html gives
    an empty text; a null url has the empty host; very long pages and deep
    nesting are read in linear time; of paths with equal votes the one of
    fewest steps wins; repeated rows give repeated rows; null ids stay; other
    columns, whatever their names, are not read; an empty table gives an empty
    table.
    """
    host, _ = host_and_path(F.col("url"))
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host)
    with workspace(pages.sparkSession):
        paths = kept(host_paths(read), "host-paths")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(html, None if missing else path) for html, path, missing in zip(batch["html"], batch["path"], batch["missing"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema[id_col].dataType.simpleString()
    # a null path would turn the others into floats
    joined = join_sized(read, paths, "host", "left").select("id", "url", "html", F.coalesce("path", F.lit(0)).alias("path"), F.col("path").isNull().alias("missing"))
    return joined.mapInPandas(rows, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
