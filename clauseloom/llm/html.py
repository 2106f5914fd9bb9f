"""Main text of web pages by wrapper induction.

A page is parsed into a tree of blocks. Neighbouring siblings with the same label (tag, classes) are one repeated node,
as records of a list are, so trees stay small however long an article is. Every page of a host is aligned with the
host's pilot pages by simple tree matching: equal labels at the root, and the best order-keeping assignment of children,
recursively. A text that stands at the same node in at least half of the host's different articles is template;
what varies is content. Support is counted over all pages of all hosts, and pages with the same longest block count once, so
copies of an article never turn it into template.

What the alignment cannot see, a host with too few pages or a menu that changes from page to page, is decided by what
HTML itself says: elements for navigation, asides, forms, scripts and the like are not main text, nor are elements
whose class, id or role says so. If the page marks its article, only that is looked at: the smallest element that holds
all its articles but teasers, or the main element if most of its text stands outside of them.

Edge cases: null and empty html, and pages without content, give an empty text. Broken markup is read as browsers do
where it matters: a block that begins inside a paragraph ends it, what is never closed ends with the page. A null URL or one without
a host belongs to the host of the empty name. Repeated rows are extracted like any other. Extra columns stay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import small_batches, with_made
from clauseloom.plans.stage import stage

#: Fixed values of HTML: elements without content, and elements whose text is never shown or never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("script style noscript template head title iframe object svg math canvas audio video map".split())
NOT_MAIN = frozenset("nav aside footer form button select textarea datalist dialog menu fieldset search".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark output q ruby rb rt rtc rp s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: A block that starts inside an open paragraph ends it; siblings that end each other.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An end tag never reaches out of these.
SCOPE = frozenset("html body article main section table td th ul ol div".split())

#: Words in a class, id or role that name what is not main text (fixed values).
NAMED_SO = frozenset(
    "ad ads adv advert advertisement advertising adverts sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager "
    "copyright legal disclaimer comment comments commentlist discussion replies reply respond disqus contentinfo complementary "
    "search skip".split()
)
#: Words that name an article as a pointer to another page.
TEASERS = frozenset("card cards teaser teasers preview excerpt snippet tile thumb thumbnail".split())
HIDES = frozenset("comment comments commentlist discussion replies reply respond disqus".split())

#: Pilots per host, and the share of a host's articles, of so many at least, that makes a text template. Inside what
#: a page marks as its article nearly all must have it there, since many articles begin with one phrase.
PILOTS, SUPPORT, INSIDE, LEAST = 3, 0.5, 0.9, 5


#: Elements that are open inside each other; what is nested deeper stands side by side, as in browsers, at a greater depth there.
DEPTH = 200


class Node:
    __slots__ = ("label", "items", "out", "tag", "words")

    def __init__(self, tag: str, label: str, out: bool, words: frozenset):
        # items: nodes and texts in page order; out: not main text by its own name
        self.tag, self.label, self.out, self.words, self.items = tag, label, out, words, []


class Tree(HTMLParser):
    """A page as blocks. Inline elements only add to the text of the block they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", False, frozenset())
        self.open = [self.root]
        self.run = self.run_of = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data(" ")
        hidden = False
        words: frozenset = frozenset()
        if attrs:
            named = dict(attrs)
            words = frozenset(
                w for a in ("class", "id", "role") if named.get(a)
                for w in "".join(c if c.isalnum() else " " for c in named[a].lower()).split()
            )
            hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "")
        says_so = bool(words & NAMED_SO)
        if tag in VOID or tag in INLINE and not (hidden or says_so):
            return
        if tag not in INLINE:
            self._close(("p",), "p")
            if tag in ENDS:
                self._close(ENDS[tag], tag)
        out = hidden or tag in NOT_TEXT or tag in NOT_MAIN or says_so and tag not in ("html", "body", "main")
        label = " ".join([tag, *sorted(w for w in words if not w.isdigit())])
        # Beyond the depth an element is left out with those it stands in, and its texts stand on the deepest node (handle_data).
        deep = len(self.open) > DEPTH
        node = Node(tag, label, out or deep and self.open[-1].out, words)
        if not deep:
            self.open[-1].items.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            super().handle_startendtag(tag, attrs)

    def _close(self, tags: tuple[str, ...], scope: str) -> None:
        """End the innermost open element of ``tags``, if no scope lies between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in SCOPE:
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in SCOPE and (tag in INLINE or tag in ("p", "li", "dt", "dd") or tag[0] == "h" and tag[1:].isdigit()):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in NOT_TEXT:
            items = self.open[-1].items
            if len(self.open) > DEPTH + 1:
                # One node per run of an element's text, so that all texts keep their order.
                own, beside = self.open[-1], self.open[DEPTH].items
                if not beside or beside[-1] is not self.run or self.run_of is not own:
                    self.run, self.run_of = Node(own.tag, own.label, own.out, own.words), own
                    beside.append(self.run)
                items = self.run.items
            if items and type(items[-1]) is str:
                items[-1] += data
            else:
                items.append(data)


def parsed(html: str) -> Node:
    tree = Tree()
    try:
        tree.feed(html)
        tree.close()
    except (AssertionError, ValueError):
        # The parser gives up on some broken declarations; what it has read so far counts.
        pass
    return tree.root


def _length(node: Node, all_of_it: bool = False) -> int:
    return sum(len(" ".join(x.split())) if type(x) is str else _length(x, all_of_it) for x in node.items) if all_of_it or not node.out else 0


def article(root: Node) -> tuple[Node, bool]:
    """The element that holds what the page marks as its article, if anything, and whether it marks it."""
    stories: list[tuple[Node, ...]] = []
    mains: list[tuple[Node, ...]] = []

    def look(node: Node, way: tuple[Node, ...], told: bool, known: bool) -> None:
        for x in node.items:
            if type(x) is not str and not x.out:
                here = (*way, x)
                story = not told and x.tag == "article"
                main = not known and (x.tag == "main" or bool(x.words & {"main"}) and x.tag not in ("html", "body"))
                if story and not x.words & TEASERS and _length(x):
                    stories.append(here)
                if main:
                    mains.append(here)
                look(x, here, told or story, known or main)

    look(root, (root,), False, False)
    best = None
    if stories:
        shared = [same[0] for same in zip(*stories) if all(x is same[0] for x in same)]
        best = shared[-1]
    if mains:
        way = max(mains, key=lambda w: _length(w[-1]))
        told, inside = sum(_length(w[-1]) for w in stories), sum(_length(w[-1]) for w in stories if way[-1] in w)
        if _length(way[-1]) - inside > told:
            # What stands in both is in the smallest element around them.
            best = way[-1] if inside == told else [a for a, *rest in zip(way, *stories) if all(a is x for x in rest)][-1]
    if best is None:
        return root, False
    return best, best is not root and best.tag not in ("html", "body")


def blocks(root: Node) -> list[tuple[str, Node]]:
    """Main-text candidates in page order: text and the node it stands in."""
    top, marked = article(root)
    whole = _length(top, True)
    out: list[tuple[str, Node]] = []

    def walk(node: Node, inside: bool) -> None:
        for x in node.items:
            if type(x) is str:
                if text := " ".join(x.split()):
                    out.append((text, node))
                continue
            if x.tag in NOT_TEXT or x.tag in NOT_MAIN:
                continue
            if x.tag == "header" and not inside and not any(type(y) is not str and y.tag in ("article", "main") for y in x.items):
                continue
            # A container that holds most of the text is not an advert, whatever its class says; comments may be long.
            if x.out and (x.words & HIDES or not x.words & NAMED_SO or 2 * _length(x, True) < whole):
                continue
            walk(x, inside or x.tag in ("article", "main"))

    walk(top, marked)
    return out


# --- alignment -------------------------------------------------------------------------------------------------------
# An outline node is [label, hashes of its own texts, children]; a repeated node stands for a run of siblings.


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


def outline(nodes: list[Node], label: str = "", where: dict[int, list] | None = None) -> list:
    """``where`` takes up the outline node of every node, by identity."""
    texts, runs = [], []
    for node in nodes:
        for x in node.items:
            if type(x) is str:
                if text := " ".join(x.split()):
                    texts.append(_hash(text))
            elif x.tag not in NOT_TEXT:
                if runs and runs[-1][0] == x.label:
                    runs[-1][1].append(x)
                else:
                    runs.append((x.label, [x]))
    made = [label, texts, [outline(run, name, where) for name, run in runs]]
    if where is not None:
        where.update((id(node), made) for node in nodes)
    return made


def match(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching: how many nodes can be paired, and the pairs."""
    if a[0] != b[0]:
        return 0, []
    m, n = len(a[2]), len(b[2])
    size = [[0] * (n + 1) for _ in range(m + 1)]
    kept: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(m):
        for j in range(n):
            if a[2][i][0] == b[2][j][0]:
                kept[i, j] = match(a[2][i], b[2][j])
            size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + (kept[i, j][0] if (i, j) in kept else 0))
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if size[i][j] == size[i - 1][j]:
            i -= 1
        elif size[i][j] == size[i][j - 1]:
            j -= 1
        else:
            pairs += kept[i - 1, j - 1][1]
            i, j = i - 1, j - 1
    return 1 + size[m][n], pairs


def _numbered(tree: list) -> dict[int, int]:
    """Position in page order of every outline node, by identity."""
    order, waiting = {}, [tree]
    while waiting:
        node = waiting.pop()
        order[id(node)] = len(order)
        waiting += node[2][::-1]
    return order


def same_places(page: list, pilot: list) -> Iterator[tuple[int, int, int]]:
    """Texts that both have at aligned nodes: the page's node by identity, the pilot's by number, and the text's hash."""
    order = _numbered(pilot)
    for ours, theirs in match(page, pilot)[1]:
        for text in set(ours[1]) & set(theirs[1]):
            yield id(ours), order[id(theirs)], text


def _host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``df`` without its html, with ``text`` and ``n_chars`` of the main text."""
    spark = df.sparkSession
    small_batches(spark)
    # The table's own columns go by other names until the end, so that none is taken for a helper.
    own = {c: f"_own{i}" for i, c in enumerate(df.columns) if c != html and c.lower() not in ("text", "n_chars")}
    pages = df.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()], _host(url).alias("_host"), F.coalesce(F.col(html), F.lit("")).alias("_html"))

    # The pages with the smallest hash in each third of a host's pages; minima combine before the shuffle.
    place = F.xxhash64("_html", F.col(own[key]).cast("string"))
    chosen = pages.groupBy("_host", F.pmod(place, F.lit(PILOTS)).alias("nth")).agg(F.min(F.struct(place.alias("x"), "_html"))["_html"].alias("_html"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="_html").assign(pilot=[json.dumps(outline([parsed(h)])) for h in batch["_html"]])

    drawn = chosen.mapInPandas(draw, "_host string, nth long, pilot string")
    pilots = stage(drawn.groupBy("_host").agg(F.sort_array(F.collect_list("pilot")).alias("pilots")), "pilots")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = {}
        for batch in batches:
            out = []
            for host, h, pilots in zip(batch["_host"], batch["_html"], batch["pilots"]):
                if host not in known:
                    known = {host: [json.loads(p) for p in pilots]} if len(known) > 100 else known | {host: [json.loads(p) for p in pilots]}
                root = parsed(h)
                texts = [t for t, _ in blocks(root)]
                sign = _hash(max(texts, key=len)) if texts else 0
                page = outline([root])
                out.append((host, -1, -1, 0, sign))
                for nth, pilot in enumerate(known[host]):
                    out += [(host, nth, node, text, sign) for _, node, text in same_places(page, pilot)]
            yield pd.DataFrame(out, columns=["_host", "nth", "node", "text", "sign"])

    seen = pages.select("_host", "_html").join(pilots, "_host").mapInPandas(compare, "_host string, nth int, node int, text long, sign long")
    counts = stage(seen.distinct().groupBy("_host", "nth", "node", "text").agg(F.count(F.lit(1)).alias("n")), "template-counts")
    articles = counts.filter("node = -1").select("_host", F.col("n").alias("articles"))
    template = (
        counts.filter("node >= 0").join(articles, "_host")
        .filter((F.col("articles") >= LEAST) & (F.col("n") >= SUPPORT * F.col("articles")))
        .groupBy("_host").agg(F.collect_list(F.struct("nth", "node", "text", (F.col("n") / F.col("articles")).alias("share"))).alias("template"))
    )
    wrappers = stage(pilots.join(template, "_host"), "wrappers")

    def made() -> Callable:
        known: dict[str, tuple[list, dict]] = {}

        def make(hosts: list, htmls: list, pilots: list, templates: list) -> dict:
            out = []
            for host, h, drawn, template in zip(hosts, htmls, pilots, templates):
                root, fixed, where = parsed(h), set(), {}
                if template is not None:
                    if host not in known:
                        if len(known) > 100:
                            known.clear()
                        known[host] = [json.loads(p) for p in drawn], {(x["nth"], x["node"], x["text"]): x["share"] for x in template}
                    trees, constant = known[host]
                    page, least = outline([root], where=where), INSIDE if article(root)[1] else SUPPORT
                    fixed = {(ours, t) for nth, pilot in enumerate(trees) for ours, node, t in same_places(page, pilot) if constant.get((nth, node, t), 0) >= least}
                out.append("\n".join(t for t, n in blocks(root) if not fixed or (id(where[id(n)]), _hash(t)) not in fixed))
            return {"text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())}

        return make

    whole = pages.join(wrappers, "_host", "left")
    made_of = with_made(whole, ["_host", "_html", "pilots", "template"], made, "text string, n_chars long", ["_host", "_html", "pilots", "template"])
    return made_of.withColumnsRenamed({name: c for c, name in own.items()})
