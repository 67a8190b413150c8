"""HTML extraction: templates deduced from tokens that occur alike on a host's pages, and of the slots that remain those with main text."""

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.rows import map_rows
from strandloom.llm.scratch import Scratch

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes if it is open nearest.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, roles, and words of class and id names that mark what is no main text.
ASIDE_TAGS = frozenset("nav footer aside form script style noscript template iframe svg button select textarea dialog menu head title object".split())
ASIDE_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar widget widgets footer comment comments commentlist disqus reply replies respond related recommended recommendations share sharing social newsletter subscribe signup login popup "
    "modal overlay toolbar pagination pager skip".split())
QUALIFIERS = frozenset("has no with without".split())
HEADER_NAMES = frozenset("header masthead banner".split())
MAIN_NAMES = frozenset("main article".split())
#: Elements that are text themselves; others are containers.
TEXTUAL = HEADINGS | frozenset("p ul ol dl li dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption address center".split())

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
#: A path is a template's if so many pages of its host with different texts, and this share of them, have it.
LEAST_PAGES, SHARE = 3, 0.5
#: Of a host's text: the share that the container of its main text has of that of the container around it, the share under
#: which a container beside that one is no main text, and the share of links from which on it is a menu.
MAIN_SHARE, LEAST_SHARE, LINKS = 0.6, 0.1, 0.5


def _tag_end(text: str, at: int) -> int:
    """The place of the > that ends a tag, past quoted values; the text's end if there is none."""
    while True:
        end = text.find(">", at)
        if end < 0:
            return len(text)
        quote = min((q for q in (text.find('"', at, end), text.find("'", at, end)) if q >= 0), default=-1)
        # a quote opens a value only after =
        if quote < 0:
            return end
        if text[at:quote].rstrip()[-1:] != "=":
            at = quote + 1
            if at > end:
                return end
            continue
        close = text.find(text[quote], quote + 1)
        if close < 0:
            return end
        at = close + 1


@dataclass(slots=True)
class Run:
    """Text between tags. path: of the blocks around it. aside: it is no main text. named, headed: the innermost marked block
    around it, or -1; headed ones spare headings of main text. main: the innermost element of main text around it, or -1.
    linked: it is a link's."""

    path: int
    block: int
    aside: bool
    named: int
    headed: int
    main: int
    text: str
    linked: bool


@dataclass
class Page:
    """elements: of each path the path around it, how many elements it has, and whether those are text themselves. Paths are
    64-bit hashes of tags and classes."""

    runs: list[Run] = field(default_factory=list)
    elements: dict[int, list[int]] = field(default_factory=dict)
    #: Marked blocks: the marked block around each, and the innermost element of main text around it.
    marks: list[tuple[int, int]] = field(default_factory=list)
    #: Elements of main text: the one around each.
    mains: list[int] = field(default_factory=list)


@dataclass(slots=True)
class _Open:
    """An open element. nearest: the place in the stack of the innermost block, itself included."""

    tag: str
    path: int
    nearest: int
    aside: bool = False
    heading_only: bool = False
    within_article: bool = False
    named: int = -1
    headed: int = -1
    main: int = -1


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


#: The path of a page itself.
ROOT = 0


def parse(source: str) -> Page:
    """The text runs of a page, however badly it is formed, in one pass over it, and then one over the runs.

    Names of class and id mark a block as aside unless it holds most of the page's text and no main element beside it has
    text; and not if no text would be left. Elements are closed as browsers do it, more or less; time and memory are linear
    in the page's length and don't depend on how deep it nests.
    """
    page = Page()
    page.elements[ROOT] = [ROOT, 1, 0]
    stack, open_ = [_Open("", ROOT, 0)], Counter()
    # a link ends with its block at the latest
    block, linked, at, n = 0, -1, 0, len(source)
    known: dict[tuple[int, str], int] = {}

    def run(text: str) -> None:
        if not text:
            return
        top = stack[-1]
        if not text.isspace():
            text = html.unescape(text)
        elif page.runs and page.runs[-1].block == block:
            text = " "
        else:
            return
        page.runs.append(Run(top.path, block, top.aside or top.heading_only, top.named, top.headed, top.main, text, linked == block))

    def close(k: int) -> None:
        for e in stack[k:]:
            open_[e.tag] -= 1
        del stack[k:]

    start = 0
    while at < n:
        at = source.find("<", at)
        if at < 0:
            break
        closing = source.startswith("/", at + 1)
        name = _NAME.match(source, at + 1 + closing)
        if not name:
            if source.startswith("<!--", at):
                run(source[start:at])
                end = source.find("-->", at + 4)
                at = start = n if end < 0 else end + 3
            elif source[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < n:
                run(source[start:at])
                end = source.find(">", at)
                at = start = n if end < 0 else end + 1
            else:
                at += 1
            continue
        run(source[start:at])
        end = _tag_end(source, name.end())
        tag, inside = name[0].lower(), source[name.end() : end]
        at = start = min(n, end + 1)
        if closing:
            if tag == "a":
                linked = -1
            if open_[tag] > 0:
                k = len(stack) - 1
                # an inline element ends only within the block that it is in
                least = stack[-1].nearest if tag in INLINE else 0
                while k > least and stack[k].tag != tag:
                    k -= 1
                if k > least:
                    close(k)
            if tag not in INLINE:
                block += 1
            continue
        if tag not in INLINE:
            block += 1
            # a block ends a paragraph that is open
            k = stack[-1].nearest
            if k and (stack[k].tag == "p" or stack[k].tag in CLOSES.get(tag, ())):
                close(k)
        if tag in VOID:
            continue
        if tag == "a":
            linked = block
        top = stack[-1]
        attributes = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(inside)} if inside.strip(" /\n") else {}
        role = attributes.get("role", "").lower()
        main = tag in MAIN_NAMES or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
        aside = tag in ASIDE_TAGS or role in ASIDE_ROLES or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        if tag in INLINE and not main and not aside:
            continue  # it changes nothing
        names = set(_WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())) if tag not in ("html", "body") else set()
        article = tag == "article" or role == "article"
        # main text by tag or role is that whatever its names; but an article in another may be a comment on it
        exempt = tag in INLINE or tag == "main" or role == "main" or article and not top.within_article
        # has-sidebar, no-ads: names that tell of something else
        named = not exempt and bool(names & ASIDE_NAMES) and not names & QUALIFIERS
        head = tag == "header" or role == "banner"
        named_head = not head and bool(names & HEADER_NAMES) and tag not in INLINE and not main
        entry = _Open(tag, top.path, top.nearest if tag in INLINE else len(stack), named=top.named, headed=top.headed, main=top.main, within_article=top.within_article or article)
        if tag not in INLINE:
            kinds = ".".join(sorted(_DIGITS.sub("", attributes.get("class", "")).lower().split()))
            step = top.path, f"{tag}.{kinds}"
            if step not in known:
                known[step] = _hash(f"{step[0]}/{step[1]}")
            entry.path = known[step]
            page.elements.setdefault(entry.path, [top.path, 0, int(tag in TEXTUAL)])[1] += 1
        if main and not (aside or top.aside):
            page.mains.append(top.main)
            entry.main = len(page.mains) - 1
        inside_main = entry.main >= 0
        # a page's header is no main text; of an article's, its headings are
        entry.heading_only = (top.heading_only or head) and inside_main and tag not in HEADINGS
        entry.aside = top.aside or aside or head and not inside_main
        if inside_main and tag in HEADINGS:
            entry.headed = -1
        if named or named_head and not inside_main:
            page.marks.append((top.named, top.main))
            entry.named = len(page.marks) - 1
        elif named_head:
            page.marks.append((entry.headed, top.main))
            entry.headed = len(page.marks) - 1
        if inside.endswith("/") and tag in ("svg", "path"):
            continue
        stack.append(entry)
        open_[tag] += 1
        if tag in RAW:
            found = re.compile(rf"</{tag}", re.I).search(source, at)
            at = start = n if not found else found.start()
    run(source[start:])
    if page.marks:
        _settle_names(page)
    return page


def _settle_names(page: Page) -> None:
    """Makes aside what names mark."""
    sizes, total = [0] * len(page.marks), 0
    shown: set[tuple[int, int, int]] = set()
    for r in page.runs:
        if not r.aside and (size := len(r.text.strip())):
            total += size
            for k in (r.named, r.headed):
                if k >= 0:
                    sizes[k] += size
            if r.main >= 0:
                shown.add((r.main, r.named, r.headed))
    # a block's size counts in those around it, which have lower numbers
    for k in range(len(sizes) - 1, -1, -1):
        if page.marks[k][0] >= 0:
            sizes[page.marks[k][0]] += sizes[k]
    # large blocks lie in each other; so the innermost mark tells of all
    large = [2 * size > total for size in sizes]
    kept = list(large)
    shown = {(m, a, b) for m, a, b in shown if (a < 0 or large[a]) and (b < 0 or large[b])}
    last = list(range(len(page.mains)))
    for k in range(len(last) - 1, -1, -1):
        if page.mains[k] >= 0:
            last[page.mains[k]] = max(last[page.mains[k]], last[k])
    for m, *chains in shown:
        around: set[int] = set()
        for k in chains:
            while k >= 0 and k not in around:
                around.add(k)
                k = page.marks[k][0]
        for k, (_, main) in enumerate(page.marks):
            # main text outside this block, in an element of main text that isn't around it
            if kept[k] and k not in around and not m <= main <= last[m]:
                kept[k] = False
    # a block stays if all marked ones around it do
    stays = [False] * len(kept)
    for k, (up, _) in enumerate(page.marks):
        stays[k] = kept[k] and (up < 0 or stays[up])
    rest = [r for r in page.runs if not r.aside and not ((r.named < 0 or stays[r.named]) and (r.headed < 0 or stays[r.headed]))]
    if sum(len(r.text.strip()) for r in rest) < total:
        for r in rest:
            r.aside = True


@dataclass(frozen=True)
class Token:
    """Of a host's pages: an element path, or a block of text on a path (text then is its hash, else 0).

    vector: stands for the occurrences on each page, alike for tokens that occur alike. support, times: pages with it, and
    occurrences. constant: whether an element path has the same text on all its pages. chars: of that text on all pages, and
    links: of those the links'. textual: whether the path's elements are text themselves.
    """

    path: int
    above: int
    text: int
    vector: str
    support: int
    times: int
    constant: bool
    chars: int
    links: int = 0
    textual: int = 1


@dataclass(frozen=True)
class Template:
    """A host's template: paths, and (path, text) of blocks, whose text is its own, and paths under which slots hold no main text."""

    own: frozenset[int | tuple[int, int]] = frozenset()
    beside: frozenset[int] = frozenset()


def template_of(tokens: list[Token], pages: int) -> Template:
    return Template(deduce(tokens, pages), beside(tokens, pages))


def _valid(elements: dict[int, Token], pages: int) -> tuple[set[int], dict[int, list[Token]]]:
    """Paths whose class has support and lies under valid ones, from the root down; and elements by the path around them."""
    support = max(LEAST_PAGES, SHARE * pages)
    below: dict[int, list[Token]] = defaultdict(list)
    for t in elements.values():
        below[t.above].append(t)
    valid, todo = set(), [t for t in elements.values() if t.path == ROOT]
    while todo:
        t = todo.pop()
        if t.path not in valid and t.support >= support:
            valid.add(t.path)
            todo += below[t.path]
    return valid, below


def beside(tokens: list[Token], pages: int) -> frozenset[int]:
    """Paths of a host's template under which its slots hold no main text, by what the slots hold on all pages.

    From the root down, the container that has most of the text of the one around it, links apart, is the main one's. What lies
    beside these is no main text if it is mostly links, or if it is a container with a small share of the host's text; headings,
    paragraphs, lists and tables beside them stay.
    """
    elements = {t.path: t for t in tokens if not t.text}
    valid, below = _valid(elements, pages)
    if ROOT not in valid:
        return frozenset()
    # text under a path, all of it and that of links; paths above come first
    order, at = [ROOT], 0
    while at < len(order):
        order += [t.path for t in below[order[at]] if t.path != ROOT and t.path in valid]
        at += 1
    text = {p: elements[p].chars for p in order}
    links = {p: elements[p].links for p in order}
    for p in reversed(order[1:]):
        above = elements[p].above
        text[above], links[above] = text[above] + text[p], links[above] + links[p]
    plain = lambda p: text[p] - links[p]
    main, out = ROOT, set()
    while True:
        children = [t for t in below[main] if t.path != ROOT and t.path in valid]
        inner = next((t.path for t in children if not t.textual and plain(t.path) > MAIN_SHARE * plain(main)), None)
        for t in children:
            if t.path != inner and text[t.path]:
                menu = links[t.path] > LINKS * text[t.path]
                small = not t.textual and inner is not None and plain(t.path) < LEAST_SHARE * plain(ROOT)
                if inner is not None and (menu or small):
                    out.add(t.path)
        if inner is None:
            return frozenset(out)
        main = inner


def deduce(tokens: list[Token], pages: int) -> frozenset[int | tuple[int, int]]:
    """A host's template: paths, and (path, text) of blocks, whose text is template text.

    Tokens with equal occurrence vectors form a class. A class is valid if it has support and the path above each of its
    paths lies in a valid class: so classes nest, and the text under their paths is slots. A slot with the same text on all
    pages is template text, and so is a block of text that comes and goes with an element around it, as it is in that
    element's class, whatever other blocks of its path say. All else is data.
    """
    elements = {t.path: t for t in tokens if not t.text}
    support = max(LEAST_PAGES, SHARE * pages)
    valid, _ = _valid(elements, pages)
    out: set[int | tuple[int, int]] = {p for p in valid if elements[p].constant and elements[p].chars}
    # the classes of the elements around a path
    own: dict[int, set[tuple[str, int, int]]] = {}

    def around(path: int) -> set[tuple[str, int, int]]:
        chain = []
        while path not in own and path in elements and path != ROOT:
            chain.append(path)
            path = elements[path].above
        found = own.get(path, {(t.vector, t.support, t.times) for t in [elements.get(path)] if t})
        own[path] = found
        for p in reversed(chain):
            t = elements[p]
            found = own[p] = found | {(t.vector, t.support, t.times)}
        return found

    for t in tokens:
        if t.text and t.support >= support and t.path in valid and (t.vector, t.support, t.times) in around(t.path):
            out.add((t.path, t.text))
    return frozenset(out)


def _blocks(runs: list[Run]) -> dict[int, tuple[int, str]]:
    """Path and text of the blocks of runs, by number: white space in a block is one space."""
    parts: dict[int, tuple[int, list[str]]] = {}
    for r in runs:
        parts.setdefault(r.block, (r.path, []))[1].append(r.text)
    return {k: (path, text) for k, (path, found) in parts.items() if (text := " ".join("".join(found).split()))}


def extract(source: str | None, template: Template = Template()) -> str:
    """The main text: slots that are neither aside nor beside the main text, blocks in page order, joined by one space.

    Template text and what lies beside stays if nothing else is on the page.
    """
    page = parse(source or "")
    blocks = _blocks([r for r in page.runs if not r.aside]).values()
    if not template.own and not template.beside:
        return " ".join(text for _, text in blocks)
    out: dict[int, bool] = {ROOT: False}

    def outside(path: int) -> bool:
        chain = []
        while path not in out:
            chain.append(path)
            if path in template.beside:
                out[path] = True
                break
            path = page.elements[path][0]
        for p in chain:
            out[p] = out[path]
        return out[chain[0]] if chain else out[path]

    slots = [text for path, text in blocks if path not in template.own and (path, _hash(text)) not in template.own and not outside(path)]
    return " ".join(slots or [text for _, text in blocks])


def _tokens() -> Callable[..., Iterator[tuple]]:
    def f(host: str, source: str | None) -> Iterator[tuple]:
        page = parse(source or "")
        texts: dict[int, list[str]] = defaultdict(list)
        links: Counter = Counter()
        for r in page.runs:
            if r.linked and not r.aside:
                links[r.path] += len(r.text)
        blocks = _blocks([r for r in page.runs if not r.aside]).values()
        content = _hash("\n".join(text for _, text in blocks))
        for path, text in blocks:
            texts[path].append(text)
        for path, (above, times, textual) in page.elements.items():
            text = " ".join(texts.get(path, ()))
            yield host, path, above, 0, content, times, len(text), _hash(text), min(links[path], len(text)), textual
        for path, found in texts.items():
            for text, times in Counter(found).items():
                yield host, path, page.elements[path][0], _hash(text), content, times, len(text), 0, 0, 1

    return f


def _extracting() -> Callable[..., Iterator[tuple]]:
    made: dict[str, Template] = {}

    def f(page_id: object, url: str | None, source: str | None, host: str | None, pages: int | None, tokens: list | None) -> Iterator[tuple]:
        template = made.get(host)
        if template is None:
            if len(made) > 500:
                made.clear()
            template = made[host] = template_of([Token(**t) for t in tokens], pages) if tokens else Template()
        text = extract(source, template)
        yield page_id, url, text, len(text)

    return f


def hosts(pages: DataFrame, url_column: str = "url") -> DataFrame:
    """pages as (page_id..., host): host is the lower-case name in the URL, '' for null or odd ones."""
    return pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract(F.col(url_column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, pages, tokens) of pages with host, html: what deduce() takes, for hosts with a few different pages at least.

    Pages of a host with the same text that isn't aside are copies and count once: what only copies share is no template.
    An occurrence vector is the sum of hashes of (content, occurrences): equal sums are equal vectors but for chances of
    2^-64. Tokens of copies meet by host, path and content; sums of contents are partial before they move, so a host with
    most of the pages is no burden. Paths of under half of a host's contents can't be template, so a host's list is at
    most twice as long as its pages have paths and blocks on average.
    """
    found = map_rows(pages.where("host <> ''"), ["host", "html"], "host string, path bigint, above bigint, text bigint, content bigint, times bigint, chars bigint, own bigint, links bigint, textual int", _tokens)
    once = found.groupBy("host", "path", "above", "text", "content").agg(F.max("times").alias("times"), F.max("chars").alias("chars"), F.min("own").alias("least"), F.max("own").alias("most"), F.max("links").alias("links"), F.max("textual").alias("textual"))
    by_path = once.groupBy("host", "path", "above", "text").agg(
        F.sum(F.xxhash64("content", "times").cast("decimal(38,0)")).cast("string").alias("vector"), F.count("*").alias("support"), F.sum("times").alias("times"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("textual").alias("textual"), (F.min("least") == F.max("most")).alias("constant")).where(F.col("support") >= LEAST_PAGES)
    # no class of less support is valid; what one page alone has goes before hosts meet. Written, as it is read twice
    by_path = scratch.keep(by_path, "by-path")
    of_host = by_path.where(F.col("path") == ROOT).where("text = 0").select(F.col("host").alias("own"), F.col("support").alias("pages"))
    kept = by_path.join(of_host, F.col("host") == F.col("own")).where(F.col("support") >= SHARE * F.col("pages"))
    return kept.groupBy("host", "pages").agg(F.sort_array(F.collect_list(F.struct("path", "above", "text", "vector", "support", "times", "constant", "chars", "links", "textual"))).alias("tokens"))


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points of text).

    Null and empty pages have the empty text; so have pages without main text. Pages without a host, and hosts with under
    three pages of different texts, have no template: their elements' names alone tell. Repeated rows get equal texts each. Other columns
    aren't read.

    Pages are parsed twice, once for the tokens of templates and once to extract. Templates, one row a host, meet pages
    by host: broadcast if Spark finds their table small, else by a join that splits hosts with many pages.
    """
    scratch = Scratch(pages.sparkSession, "markup")
    kind = pages.schema[id_column].dataType.simpleString()
    named = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").alias("html"))
    named = hosts(named)
    found = scratch.keep(templates(named, scratch), "templates").withColumnRenamed("host", "of")
    scratch.only("templates")
    joined = named.join(found, F.col("host") == F.col("of"), "left")
    return map_rows(joined, ["page_id", "url", "html", "host", "pages", "tokens"], f"page_id {kind}, url string, text string, n_chars bigint", _extracting)
