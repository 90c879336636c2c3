"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template. In a bounded group of same-host pages every
token (a tag with its path, or a text block with its path) has an occurrence
vector: how often each page of the group has it. Tokens with equal vectors form an
equivalence class. Classes that have tags and keep one order on enough pages are
valid. Text blocks of valid classes (the same words on those pages) are template text;
tags that occur once a page are the frame, whose elements nest and cut pages into slots.

What the template leaves free decides which slots are the article: the words that are
neither template text nor links are summed over the group for each frame element, and the
elements that hold most of them (``HOLDS``) lie inside each other. Of this chain the
innermost one that is an article or main element is the region; if none is, the innermost
one that is no text block itself, or one above it that adds nothing but headings and
paragraphs. Names of elements and classes only break that tie, and take out of the region
what no vector can tell from the article: comments, adverts, notices, forms and so on.
Pages without the region (odd ones, and those of groups with too few different pages) are
read by names alone.

A host with many pages is dealt by hash into groups of about ``group`` pages, so no
task sees a whole host; pages with the same longest text block (20 words at least) are copies
and count as one, so that a much copied article is not taken for a template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.session import small

#: Element names; fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul br".split()
)
#: Elements that are never main text.
APART = frozenset(
    "head nav aside form script style noscript template textarea iframe svg canvas object embed button select menu dialog "
    "datalist audio video".split()
)
#: Words of which names in class, id or role are made that mark other parts of a page.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside header masthead footer cookie cookies consent notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login register search share sharing social comment "
    "comments disqus reply replies respond related recommended pagination pager toolbar widget widgets copyright "
    "complementary contentinfo hidden".split()
)
INSIDE = frozenset({"article", "main"})
#: Elements that hold one block of prose, and the share of the free words that a region holds.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption caption summary address".split())
HOLDS = 0.75
#: Opening one of these ends an open p.
CLOSES_P = BLOCK - {"br", "body", "html", "head", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Za-z0-9]+")


@dataclass
class Paths:
    """Numbers of element paths, shared by the pages of a group: a path is its parent's number
    and a name, so that memory grows with the elements and not with their depth."""

    number: dict[tuple[int, str], int] = field(default_factory=lambda: {(-1, ""): 0})
    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    main: list[bool] = field(default_factory=lambda: [False])

    def child(self, parent: int, tag: str, names: str, main: bool) -> int:
        key = (parent, f"{tag}.{names}*" if main else f"{tag}.{names}")
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.main.append(main or self.main[parent])
        return at


#: A token: kind ("<", "/" or "#"), number of the path, and the words of a text block.
Token = tuple[str, int, str]


@dataclass
class Block:
    path: int
    text: str
    free: int  # words outside links
    apart: bool  # in another part of the page, by names
    inside: bool  # in an article or main element


@dataclass
class Page:
    tokens: list[Token] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _names(attributes: str) -> tuple[str, bool, bool, bool]:
    """The class, id and role names of a tag; whether it is hidden, whether one of the names
    marks another part, and whether its role is main. A name marks if all its words are in
    PARTS (numbers aside): "cookie-banner" does, "has-sidebar" and "article-header" do not."""
    values: dict[str, str] = {}
    for key, *value in _ATTRIBUTE.findall(attributes):
        values.setdefault(key.lower(), "".join(value).lower())
    hidden = "hidden" in values or values.get("aria-hidden", "").strip() == "true"
    names: list[str] = []
    marked = False
    for name in " ".join(v for k, v in values.items() if k in ("class", "id", "role")).split():
        words = _NAME.findall(name)
        names += words
        telling = [w for w in words if not w.isdigit()]
        marked = marked or (bool(telling) and all(w in PARTS for w in telling))
    return ".".join(dict.fromkeys(names)), hidden, marked, "main" in values.get("role", "").split()


@dataclass
class _Open:
    tag: str
    path: int
    block: int  # path of the block element around the text
    apart: bool
    inside: bool
    mark: int
    link: bool


def read_page(source: str, paths: Paths) -> Page:
    """Tokens and text blocks of a page; unclosed and crossing tags are tolerated.

    Marking names hold for the whole element, but never for an article or main element;
    if each of these on the page lies in marked elements, the marks around them do not hold.
    """
    page = Page()
    stack = [_Open("", 0, 0, False, False, 0, False)]
    opened: Counter[str] = Counter()
    marks = [0]  # the mark around each mark; 0 is none
    marks_of: list[int] = []  # the innermost mark of each text block
    around: set[int] = set()  # the innermost mark around each article or main element
    text: list[str] = []
    free = 0
    at, end = 0, len(source)

    def say(words: str) -> None:
        nonlocal free
        text.append(words)
        if not stack[-1].link:
            free += len(words.split())

    def flush() -> None:
        nonlocal free
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            top = stack[-1]
            page.blocks.append(Block(top.block, words, free, top.apart, top.inside))
            marks_of.append(top.mark)
            page.tokens.append(("#", top.block, words))
        free = 0

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def last(*tags: str) -> int:
        """Place of the innermost open element of some names; 0 if none is open."""
        if not any(opened[t] for t in tags):
            return 0
        k = len(stack) - 1
        while stack[k].tag not in tags:
            k -= 1
        return k

    while at < end:
        found = _TOKEN.search(source, at)
        if not found:
            say(entities.unescape(source[at:]))
            break
        if found.start() > at:
            say(entities.unescape(source[at : found.start()]))
        at = found.end()
        closing, opening, attributes = found.groups()
        if closing:
            tag = closing.lower()
            k = last(tag)
            if tag in BLOCK:
                flush()
            if k:
                if any(x.tag in BLOCK for x in stack[k + 1 :]):
                    flush()
                page.tokens.append(("/", stack[k].path, ""))
                close(k)
        elif opening:
            tag = opening.lower()
            if tag in BLOCK:
                flush()
            if tag in CLOSES_P and opened["p"]:
                k = len(stack) - 1
                while k and stack[k].tag != "p" and stack[k].tag not in CLOSES_P:
                    k -= 1
                if stack[k].tag == "p":
                    close(k)
            if tag == "li" and stack[k := last("li", "ul", "ol")].tag == "li":
                close(k)
            if tag in VOID:
                continue
            names, hidden, marked, is_main = _names(attributes)
            top = stack[-1]
            apart = top.apart or (hidden and tag not in ("body", "html", "main")) or tag in APART or (tag in ("header", "footer") and not (top.inside and tag == "header"))
            mark = top.mark
            is_main = tag in INSIDE or is_main
            if is_main and not apart:
                around.add(mark)
            elif marked and tag not in ("body", "html"):
                marks.append(mark)
                mark = len(marks) - 1
            path = paths.child(top.path, tag, names, is_main)
            page.tokens.append(("<", path, ""))
            if tag in RAW:
                ends = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = ends.end() if ends else end
                continue
            if not attributes.rstrip().endswith("/"):
                opened[tag] += 1
                stack.append(_Open(tag, path, path if tag in BLOCK else top.block, apart, top.inside or is_main, mark, top.link or tag == "a"))
    flush()
    void: set[int] = set()
    if 0 not in around:
        for m in around:
            while m and m not in void:
                void.add(m)
                m = marks[m]
    holds = [False] * len(marks)
    for m in range(1, len(marks)):  # outer marks come first
        holds[m] = m not in void or holds[marks[m]]
    for block, m in zip(page.blocks, marks_of, strict=True):
        block.apart = block.apart or holds[m]
    return page


@dataclass
class Template:
    """frame: tags of the valid classes that occur once a page; classes: all valid classes,
    outermost first; text: their text blocks, that is with the same words on those pages,
    outside article and main elements (an article may well quote the same words); region: the path of the element that holds the article, if the pages show one."""

    frame: frozenset[Token]
    classes: list[list[Token]]
    text: frozenset[Token]
    region: int | None = None


def different_pages(pages: list[Page], words: int = 20) -> list[Page]:
    """The first page for each longest text block of ``words`` words or more, and of those
    without such a block the first with the same tokens; pages without tokens show nothing."""
    found: dict = {}
    for p in pages:
        longest = max((b.text for b in p.blocks), key=len, default="")
        if p.tokens:
            found.setdefault(longest if len(longest.split()) >= words else tuple(p.tokens), p)
    return list(found.values())


def deduce(pages: list[Page], paths: Paths, least: int = 4, share: float = 0.5) -> Template:
    """The template of same-host pages.

    Vectors count over different pages only. A class is valid with two tokens at least,
    one of them a tag, in one order on ``share`` of the pages. Text is template on
    ``least`` pages at least, and a region needs as many.
    """
    different = different_pages(pages)
    n = len(different)
    vectors: dict[Token, dict[int, int]] = defaultdict(dict)
    for i, p in enumerate(different):
        for token, count in Counter(p.tokens).items():
            vectors[token][i] = count
    classes: dict[tuple, list[Token]] = defaultdict(list)
    for token, vector in vectors.items():
        if len(vector) >= share * n and (token[0] != "#" or len(vector) >= least):
            classes[tuple(sorted(vector.items()))].append(token)
    frame: set[Token] = set()
    valid: list[list[Token]] = []
    for vector, tokens in sorted(classes.items(), key=lambda c: (-len(c[0]), c[0])):
        if len(tokens) < 2 or all(kind == "#" for kind, _, _ in tokens):
            continue
        members = set(tokens)
        orders = Counter(tuple(dict.fromkeys(t for t in different[i].tokens if t in members)) for i, _ in vector)
        order, times = orders.most_common(1)[0]
        if times >= share * n:
            valid.append(list(order))
            if all(count == 1 for _, count in vector):
                frame.update(t for t in order if t[0] != "#")
    text = frozenset(t for order in valid for t in order if t[0] == "#" and not paths.main[t[1]])
    template = Template(frozenset(frame), valid, text)
    if n >= least:
        template.region = region_of(different, paths, template)
    return template


def region_of(pages: list[Page], paths: Paths, template: Template) -> int | None:
    """The frame element that holds the free words of the pages (see the module)."""
    mass, prose = [0] * len(paths.parent), [0] * len(paths.parent)
    for page in pages:
        for b in page.blocks:
            if b.free and ("#", b.path, b.text) not in template.text:
                mass[b.path] += b.free
                prose[b.path] += b.free * (paths.tag[b.path] in PROSE)
    total = sum(mass)
    for i in range(len(mass) - 1, 0, -1):  # children have larger numbers
        mass[paths.parent[i]] += mass[i]
        prose[paths.parent[i]] += prose[i]
    chain = sorted({path for kind, path, _ in template.frame if kind == "<" and total and mass[path] >= HOLDS * total})
    named = [i for i in chain if paths.main[i] and not paths.main[paths.parent[i]]]
    if named:
        return named[-1]
    boxes = [i for i in chain if paths.tag[i] not in PROSE]
    if not boxes:
        return None
    region = boxes.pop()
    while boxes and mass[boxes[-1]] - mass[region] == prose[boxes[-1]] - prose[region] and paths.tag[boxes[-1]] not in ("html", "body"):
        region = boxes.pop()
    return region


def under(paths: Paths, region: int) -> list[bool]:
    """Whether each path is the region's or lies in it."""
    out = [False] * len(paths.parent)
    for i in range(1, len(out)):
        out[i] = i == region or out[paths.parent[i]]
    return out


def slot_text(page: Page, template: Template, within: list[bool]) -> str:
    """Text of the slots that are the article, in page order: the free blocks in the region,
    or all where the page has none; of these, those in an article or main element, if there
    are any; always without the blocks that names set apart."""
    free = [b for b in page.blocks if not b.apart and ("#", b.path, b.text) not in template.text]
    slots = ([b for b in free if within[b.path]] if within else []) or free
    return " ".join(b.text for b in ([b for b in slots if b.inside] or slots))


def main_text(sources: list[str], least: int = 4) -> list[str]:
    """Main text of same-host pages."""
    paths = Paths()
    pages = [read_page(s, paths) for s in sources]
    template = deduce(pages, paths, least)
    within = under(paths, template.region) if template.region is not None else []
    return [slot_text(p, template, within) for p in pages]


def extract(pages: DataFrame, group: int = 64) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty html give empty text; a null url is a host of its own; an empty table
    gives no rows; other columns are ignored. Repeated rows are extracted each: a page_id
    and url with more than ``group`` rows has equal ones counted before they are dealt, so
    that they do not fill one group.
    """
    host = F.coalesce(F.lower(F.try_parse_url(F.col("url").cast("string"), F.lit("HOST"))), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    often = small(rows.groupBy(F.col("page_id").alias("_i"), F.col("url").alias("_u")).agg(F.count("*").alias("_n")).where(F.col("_n") > group))
    same = F.col("page_id").eqNullSafe(F.col("_i")) & F.col("url").eqNullSafe(F.col("_u"))
    one = rows.join(often, same, "left_anti").withColumn("_copies", F.lit(1).cast("long"))
    many = rows.join(often, same, "left_semi").groupBy("page_id", "url", "html").agg(F.count("*").alias("_copies"))
    rows = one.unionByName(many).withColumn("_host", host)
    counts = rows.groupBy("_host").agg(F.ceil(F.count("*") / F.lit(group)).alias("_groups"))
    dealt = rows.join(small(counts, 50_000), "_host").withColumn("_slot", F.pmod(F.xxhash64("page_id", "url", "html", F.lit(3)), F.col("_groups")))
    kind = dict(pages.dtypes)["page_id"]
    dealt = dealt.drop("_groups").repartition("_host", "_slot").sortWithinPartitions("_host", "_slot", "page_id")
    most = 4 * group

    def done(batch: list[dict]) -> pa.RecordBatch:
        texts = main_text([r["html"] or "" for r in batch])
        columns = [[r["page_id"] for r in batch], [r["url"] for r in batch], texts, [len(t) for t in texts], [r["_copies"] for r in batch]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "url", "text", "n_chars", "_copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) >= most or (row["_host"], row["_slot"]) != (held[0]["_host"], held[0]["_slot"])):
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(pages.schema["page_id"].dataType), pa.string(), pa.string(), pa.int64(), pa.int64()]
    found = dealt.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, _copies long")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("page_id", "url", "text", "n_chars")
