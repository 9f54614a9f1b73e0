"""Main text of web pages by site style trees.

The pages of a site are merged into one tree: an element's place is the path of
its names (tag, first class or id), and each place carries what its elements look
like on the pages of the site. Two kinds of nodes are weighed, in [0, 1]:

- A place, by two entropies normalised by the number m of its pages: of
  presentation (the sequence of child elements) and of content (the text below).
  A branch both of whose entropies are low says the same on every page.
- A content node (a place with one text, which stands on c of the m pages), by
  ``1 - log c / log m``: nothing if every page has it, all if one page has.

Places of at most ``UNIMPORTANT`` and content nodes of at most ``UNIMPORTANT_CONTENT``
(what many articles quote is not yet furniture) are removed with what is below them. A place seen on
fewer than ``MIN_PAGES`` different pages of its host is not judged there. With
``templates``, pages of all hosts whose outermost places are the same also make one
tree that judges in the same way; so small hosts profit from others.

Some importance is known before any count. Elements whose meaning is given by
HTML or by customary names (``nav``, ``aside``, ``form``, ``class="cookie"`` and
so on; a class or id counts as a whole, never by a piece such as that in
``no-sidebar``) have none. Names never count on the main part itself, and some that an
article's own parts bear too not inside it; a page that names would leave empty is read
without them. Where a page marks its main part (``article``, ``main``), text
outside has none. Inside, the site decides on flow elements as on others, but by
pages of different main text: pages that share all of it count once (a site of
copies must not lose its articles). The main part itself is not judged.

Counting uses map-side combining throughout, exact copies of a page count once,
and only the nodes to remove return to the pages, so a host with a third of all
pages costs no task more than others. Up to ``SHIPPED_NODES`` of them go to the workers
once, as one table of sites; beyond that, rows are joined with those of their site.

Blocks: text between the boundaries of block-level elements; white space in a
block becomes one space, blocks are trimmed and joined by one line feed.

Defined results: a null html is empty and gives an empty text, as does a page
without main text. A null url is the host of no name. Repeated rows each give a
row; null page ids are kept; empty input gives no rows. Unclosed elements end
where HTML says so, an unfinished tag at the end is dropped. Elements may be nested
to any depth. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kantar.llm.shared import cut, table

MIN_PAGES = 8
UNIMPORTANT = 0.2
#: For content nodes: what nearly all pages say (some 83 % of 10,000 pages, 37 of 40).
UNIMPORTANT_CONTENT = 0.02
#: Levels of the tree by which pages of one template know each other.
TEMPLATE_LEVELS = 3
#: Nodes to remove that are shipped to the workers (16 bytes each); beyond, a salted join.
SHIPPED_NODES = 100_000
SALTS = 16

# Element names of HTML, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
    pre search section summary table tbody td tfoot th thead title tr ul""".split()
)
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split()) | {"li", "dd", "dt"}
ENDS_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
NO_TEXT = frozenset("head script style noscript template iframe object svg canvas audio video noembed noframes".split())
UNIMPORTANT_TAGS = frozenset("nav aside form footer menu button select textarea input dialog search fieldset datalist".split())
MAIN_TAGS = frozenset("article main".split())
UNIMPORTANT_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
    gdpr notice notices notification alert popup modal overlay nav navbar navigation menu submenu sidebar aside footer
    masthead topbar toolbar breadcrumb breadcrumbs pagination pager share sharing social related recommended
    recommendations newsletter subscribe subscription signup login comment comments commentlist disqus respond reply
    replies discussion widget searchform copyright skip""".split()
)
#: Of these, names that an article's own parts may have as well: in the main part only the trees decide on them.
OF_ARTICLES_TOO = frozenset("discussion notice notices banner search alert skip signup login reply replies copyright menu sidebar".split())
OUTSIDE_NAMES = frozenset("header head top bottom".split())
#: In names of several words: first words that speak of the element's own state, and last words of containers.
STATES = frozenset("no not non with without has have is hide hides hidden show shows allow enable disable open close closed type format status tag category".split())
CONTAINERS = frozenset("bar block box buttons button container content form inner item items links list panel section area widget widgets wrap wrapper icons unit slot banner text message popup overlay title toggle".split())

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[-_]+")


@dataclass
class Page:
    """Elements in order, and events: (0, element), (1, element) for ends, (2, text)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    zero: list[bool] = field(default_factory=list)
    named: list[frozenset] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    events: list[tuple] = field(default_factory=list)


def named(token: str, names: frozenset) -> str | None:
    """Which of ``names`` a whole class or id says the element is: ``sidebar``, ``site-footer``, ``share-buttons``, but not ``no-sidebar`` or ``comments-open``."""
    first, *rest = [w for w in WORDS.split(token) if w] or [""]
    if not rest:
        return first if first in names else None
    last = rest[-1]
    if last in names and first not in STATES:
        return last
    return first if first in names and (last in CONTAINERS or last.isdigit()) else None


NONE: frozenset = frozenset()


def _meaning(tag: str, attributes: str) -> tuple[str, bool, frozenset, bool]:
    """Label in the tree, unimportant by what HTML says, customary names of unimportant parts, known to be the main part."""
    label, zero, main, names = tag, tag in UNIMPORTANT_TAGS or tag in NO_TEXT, tag in MAIN_TAGS, NONE
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), "").lower(), name.lower()
            if name in ("class", "id"):
                tokens = value.split()
                label += f".{re.sub(r'[0-9]{3,}', '', tokens[0])}" if tokens else ""
                names |= {n for t in tokens if (n := named(t, UNIMPORTANT_NAMES))}
            main |= (name == "role" and value == "main") or (name == "itemprop" and value == "articlebody")
            zero |= name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
    return label, zero, NONE if main or tag in ("html", "body") else names, main


def parse(text: str) -> Page:
    page = Page()
    stack: list[int] = []
    # Where in the stack the elements of each name are.
    opened: dict[str, list[int]] = {}
    at, size = 0, len(text)

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            e = stack.pop()
            opened[page.tags[e]].pop()
            page.events.append((1, e))

    def implied(closes: frozenset | set, within: frozenset | set) -> None:
        last = max((opened[t][-1] for t in closes if opened.get(t)), default=-1)
        if last > max((opened[t][-1] for t in within if opened.get(t)), default=-1):
            close(last)

    while at < size:
        lt = text.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            page.events.append((2, text[at:lt]))
        if lt == size:
            break
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if text.startswith(("<!", "<?"), lt):
            end = text.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        if not (text[lt + 1 : lt + 2].isascii() and text[lt + 1 : lt + 2].isalpha() or text[lt + 1 : lt + 2] == "/"):
            page.events.append((2, "<"))
            at = lt + 1
            continue
        found = TAG.match(text, lt)
        if found is None:  # an odd end tag, or no end of the tag
            end = text.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            if opened.get(tag):
                close(opened[tag][-1])
            elif tag == "br":
                page.events.append((2, " "))
            continue
        if tag in ENDS_P and opened.get("p"):
            implied({"p"}, {"button", "td", "th", "caption", "table"} - {tag})
        if tag in ENDS_SAME:
            implied(*ENDS_SAME[tag])
        if tag == "br":
            page.events.append((2, " "))
            continue
        label, zero, names, main = _meaning(tag, found[3])
        e = len(page.tags)
        page.tags.append(tag)
        page.parents.append(stack[-1] if stack else -1)
        page.labels.append(label)
        page.zero.append(zero)
        page.named.append(names)
        page.main.append(main)
        page.events.append((0, e))
        if tag in VOID or (found[3].endswith("/") and tag not in BLOCK and tag not in RAW):
            page.events.append((1, e))
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            if end is None:
                at = size
            else:
                if tag in ("title", "textarea"):
                    page.events.append((2, text[at : end.start()]))
                gt = text.find(">", end.end())
                at = size if gt < 0 else gt + 1
            page.events.append((1, e))
        else:
            opened.setdefault(tag, []).append(len(stack))
            stack.append(e)
    close(0)
    return page


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _places(page: Page) -> list[int]:
    """The place of each element in the style tree of its site."""
    out: list[int] = []
    for label, parent in zip(page.labels, page.parents):
        out.append(_digest(str(out[parent]) if parent >= 0 else "", label))
    return out


def _judged(page: Page) -> list[bool]:
    """Elements whose importance the site decides: not known before."""
    out, in_main, in_zero = [], [], []
    for e, parent in enumerate(page.parents):
        in_main.append(page.main[e] or (parent >= 0 and in_main[parent]))
        in_zero.append(page.zero[e] or bool(page.named[e] - OF_ARTICLES_TOO if in_main[e] else page.named[e]) or (parent >= 0 and in_zero[parent]))
        tag = page.tags[e]
        out.append(tag in BLOCK and tag not in ("html", "body") and not page.main[e] and not in_zero[e])
    return out


def _main_places(page: Page) -> set[int]:
    """The places that lie in the main part of the page."""
    inside: list[bool] = []
    for e, parent in enumerate(page.parents):
        inside.append(page.main[e] or (parent >= 0 and inside[parent]))
    return {p for p, main in zip(_places(page), inside) if main}


def template(page: Page) -> int:
    """What pages of one template have in common: the places of the outer block elements."""
    depth: list[int] = []
    for parent in page.parents:
        depth.append(depth[parent] + 1 if parent >= 0 else 0)
    places = _places(page)
    return _digest("template", *map(str, sorted({p for e, p in enumerate(places) if depth[e] < TEMPLATE_LEVELS and page.tags[e] in BLOCK})))


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _contents(page: Page) -> list[int]:
    """A digest of the text below each element, from running sums over the page's texts."""
    sums, powers = [0], [1]
    begun, out = [0] * len(page.tags), [0] * len(page.tags)
    for kind, x in page.events:
        if kind == 0:
            begun[x] = len(sums) - 1
        elif kind == 1:
            n = len(sums) - 1 - begun[x]
            out[x] = (sums[-1] - sums[begun[x]] * powers[n]) % _PRIME
        elif words := " ".join(x.split()):
            sums.append((sums[-1] * _BASE + (_digest(words) & _PRIME) + 1) % _PRIME)
            powers.append(powers[-1] * _BASE % _PRIME)
    return out


def node(place: int, content: int) -> int:
    """The content node of a place."""
    return _digest("node", str(place), str(content))


def features(page: Page) -> tuple[dict[int, tuple[int, int]], set[tuple[int, int]]]:
    """Presentation and content of all elements of each judged place, and the page's content nodes as (place, content)."""
    places, judged, contents = _places(page), _judged(page), _contents(page)
    looks: dict[int, list[str]] = {}
    said: dict[int, list[str]] = {}
    nodes: set[tuple[int, int]] = set()
    open_places: list[int] = []
    for kind, x in page.events:
        if kind == 0:
            for p in open_places[-1:]:
                looks[p].append(page.labels[x])
            if judged[x]:
                open_places.append(places[x])
                looks.setdefault(places[x], []).append("^")
                said.setdefault(places[x], []).append(str(contents[x]))
                if contents[x]:
                    nodes.add((places[x], contents[x]))
        elif kind == 1 and judged[x]:
            open_places.pop()
    return {p: (_digest(*looks[p]), _digest(*said[p])) for p in looks}, nodes


def main_text(page: Page, removed: frozenset | set = frozenset()) -> str:
    """The text that is left, by blocks, without unimportant branches. ``removed`` has places and content nodes.

    Names are only customary. Where nothing would be left, they don't count on what the
    main part stands in, and if that isn't enough, nowhere.
    """
    places, judged, contents = (_places(page), _judged(page), _contents(page)) if removed else (None, None, None)
    gone = {e for e in range(len(page.tags)) if removed and judged[e] and (places[e] in removed or node(places[e], contents[e]) in removed)}
    text = _text(page, gone, page.named)
    if not text and any(page.named):
        holds: set[int] = set()
        for e, parent in enumerate(page.parents):
            while page.main[e] and parent >= 0 and parent not in holds:
                holds.add(parent)
                parent = page.parents[parent]
        text = _text(page, gone, [NONE if e in holds else n for e, n in enumerate(page.named)]) or _text(page, gone, [NONE] * len(page.tags))
    return text


def _text(page: Page, gone: set[int], names: list[frozenset]) -> str:
    zeroed: list[bool] = []
    in_main: list[bool] = []
    marked = False
    for e, parent in enumerate(page.parents):
        above = parent >= 0 and zeroed[parent]
        inside = parent >= 0 and in_main[parent]
        tag = page.tags[e]
        zero = page.zero[e] or e in gone or bool(names[e] - OF_ARTICLES_TOO if inside else names[e]) or (not inside and tag == "header")
        if not zero and not inside and tag not in ("html", "body") and not page.main[e]:
            zero = named(page.labels[e].partition(".")[2], OUTSIDE_NAMES) is not None
        zeroed.append(above or zero)
        in_main.append(inside or page.main[e])
        marked |= in_main[-1] and not zeroed[-1]
    blocks: list[str] = []
    now: list[str] = []
    stack: list[int] = []

    def flush() -> None:
        if now:
            if line := " ".join(entities.unescape("".join(now)).split()):
                blocks.append(line)
            now.clear()

    for kind, x in page.events:
        if kind == 2:
            e = stack[-1] if stack else -1
            if (not marked and (e < 0 or not zeroed[e])) or (e >= 0 and in_main[e] and not zeroed[e]):
                now.append(x)
            continue
        if page.tags[x] in BLOCK:
            flush()
        if kind == 0:
            stack.append(x)
        else:
            stack.pop()
    flush()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


TREE = "site string, place long, content long, page long, look long, said long"


def _page_features(templates: bool):
    """Rows of places (without ``content``) and of content nodes, for the host's tree and for the template's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for site, text in zip(batch["host"], batch["html"]):
                text = text or ""
                page = parse(text)
                (found, nodes), mark = features(page), _digest(text)
                inside = _main_places(page)
                main = _digest(main_text(page)) if inside else mark
                for tree in (f"host {site}", f"template {template(page)}")[: 1 + templates]:
                    out += [(tree, p, None, main if p in inside else mark, look, said) for p, (look, said) in found.items()]
                    out += [(tree, p, c, main if p in inside else mark, None, None) for p, c in nodes]
            yield pd.DataFrame(out, columns=["site", "place", "content", "page", "look", "said"], dtype=object).astype({c: "Int64" for c in ("place", "content", "page", "look", "said")})

    return run


def tree_rows(pages: DataFrame, url: str = "url", html: str = "html", templates: bool = False) -> DataFrame:
    """What the pages show at the nodes of their trees; different pages only."""
    found = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).mapInPandas(_page_features(templates), TREE)
    return cut(found.dropDuplicates(["site", "place", "content", "page"]), "html-features")


def style_trees(rows: DataFrame) -> DataFrame:
    """(site, place, pages, presentation, content): the judged places of every tree, with their entropies."""
    once = rows.where("content IS NULL")

    def entropy(by: str, name: str) -> DataFrame:
        n = once.groupBy("site", "place", by).agg(F.count("*").alias("c"))
        total = n.groupBy("site", "place").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("clogc"))
        h = F.log(F.col("pages").cast("double")) - F.col("clogc") / F.col("pages")
        return total.select("site", "place", "pages", F.when(F.col("pages") > 1, h / F.log(F.col("pages").cast("double"))).otherwise(F.lit(1.0)).alias(name))

    return entropy("look", "presentation").join(entropy("said", "content").drop("pages"), ["site", "place"])


def unimportant(rows: DataFrame) -> DataFrame:
    """(site, place, content): nodes to remove; a place as a whole has no content."""
    trees = cut(style_trees(rows).where(F.col("pages") >= MIN_PAGES), "html-trees")
    places = trees.where(F.greatest("presentation", "content") <= UNIMPORTANT).select("site", "place", F.lit(None).cast("long").alias("content"))
    often = rows.where("content IS NOT NULL").groupBy("site", "place", "content").agg(F.count("*").alias("c")).where("c > 1")
    weighed = often.join(trees.select("site", "place", "pages"), ["site", "place"])
    low = 1 - F.log(F.col("c").cast("double")) / F.log(F.col("pages").cast("double")) <= UNIMPORTANT_CONTENT
    return places.unionByName(weighed.where(low).select("site", "place", "content"))


def _key(place: int, content: int | None) -> int:
    return place if content is None or pd.isna(content) else node(place, int(content))


def extract_main(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", templates: bool = False) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``."""
    low = cut(unimportant(tree_rows(pages, url, html, templates)), "html-unimportant")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("host"))
    if low.count() <= SHIPPED_NODES:
        table_of: dict[str, set[int]] = {}
        for r in low.collect():
            table_of.setdefault(r.site, set()).add(_key(r.place, r.content))

        @F.pandas_udf("string")
        def extracted(htmls: pd.Series, hosts: pd.Series) -> pd.Series:
            out = []
            for text, site in zip(htmls, hosts):
                page = parse(text or "")
                gone = table_of.get(f"host {site}", set())
                if templates and table_of:
                    gone = gone | table_of.get(f"template {template(page)}", set())
                out.append(main_text(page, gone))
            return pd.Series(out, dtype=object)

        return rows.select(F.col("page_id").alias(page_id), F.col("url").alias(url), extracted("html", "host").alias("text"))

    @F.pandas_udf("string")
    def site_of(htmls: pd.Series) -> pd.Series:
        return pd.Series([f"template {template(parse(text or ''))}" for text in htmls], dtype=object)

    @F.pandas_udf("string")
    def joined(htmls: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
        keys = lambda found: {_key(x["place"], x["content"]) for x in (() if found is None else found)}
        return pd.Series([main_text(parse(text or ""), keys(a) | keys(b)) for text, a, b in zip(htmls, one, two)], dtype=object)

    gone = low.groupBy("site").agg(F.collect_list(F.struct("place", "content")).alias("removed"))
    salted = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
    for key, by in (("one", F.concat(F.lit("host "), F.col("host"))), ("two", site_of("html"))):
        held = held.withColumn("site", by).join(salted.withColumnRenamed("removed", key), ["site", "salt"], "left").drop("site")
    return held.select(F.col("page_id").alias(page_id), F.col("url").alias(url), joined("html", "one", "two").alias("text"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main(table(spark, sf_dir, "pages"), templates=True)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
