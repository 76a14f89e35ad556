"""Main text of web pages by template deduction over the pages of a host.

Every page is read once into tags and blocks of text. A token is a tag at its path, or a whole block of text at its path; its occurrence vector says how often each page of the host holds it. Tokens with
equal vectors form a class. Vectors are never gathered: an order-free hash over (page, occurrences) stands for each, so classes come from one aggregation of counts, whatever the number of pages.
Classes that many pages hold, of several tokens, which stand in the same order on all of these pages, are valid; those of all tags of a page frame make up the template, into whose slots the others
nest. Texts in the template are the host's, not the page's. Of the slots that remain, those marked as an article hold the main text; where a host marks none, it is the innermost element that holds most of its prose.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed lists of HTML: elements without content, whose content is no markup, that begin a block, and what they end that is still open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
#: Elements whose end tag an open element does not see across.
SCOPE = frozenset("table ul ol dl div section article main body td th blockquote aside nav header footer form".split())
#: Elements that hold a piece of running text, and are no place of a page by themselves.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption address center".split())
#: Elements that never hold main text; ``header`` does within an article.
NOT_TEXT = frozenset("head script style noscript template nav header footer aside form button select option textarea iframe svg canvas object audio video dialog menu math title datalist fieldset label xmp noembed noframes".split())
#: Words in class, id or role that say the same.
NOT_TEXT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar banner footer sidebar side rail widget widgets ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations teaser teasers comment comments commentlist disqus respond replies reply pagination pager copyright legal toolbar skip hidden form complementary contentinfo".split()
)
#: The most certain mark of the main text first.
MARKS = (frozenset({"articlebody"}), frozenset({"main"}), frozenset({"content", "post-content", "post-body", "entry-content", "article-content", "article-body", "article", "story-body", "main-content", "page-content", "maincontent", "post", "entry", "story"}))
#: Open elements beyond which paths grow no longer; what is deeper belongs to the place there.
DEEPEST = 256
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/a-zA-Z][^<>]*\Z", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Pages of a host that a token of its template is on, at least, and the tokens of a class.
LEAST_PAGES, LEAST_TOKENS = 3, 3
#: Share of a host's pages that a token of its template is on, at least.
LEAST_SHARE = 0.001
#: The mark of blocks that nothing marks.
UNMARKED = 9
#: Share of a host's prose that the element with the main text holds, at least, where no element is marked.
MOST = 0.6


@lru_cache(100_000)
def _key(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


@lru_cache(50_000)
def _element(name: str, attributes: str) -> tuple[str, bool, int]:
    """How an element is called in paths, whether it cannot hold main text, and its mark: 0 is the most certain one, 9 none."""
    given = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)}
    names = " ".join(given.get(k, "") for k in ("class", "id", "role")).split()
    shown = ".".join([name, *sorted(re.sub(r"\d+", "#", n) for n in names)])
    if name in ("html", "body"):
        return shown, False, 9
    words = {w for n in names if not re.match(r"(?:no|has|with|without|is)[-_]", n) for w in _WORD.findall(_CAMEL.sub("-", n).lower())}
    barred = name in NOT_TEXT or bool(words & NOT_TEXT_WORDS) or bool(_HIDDEN.search(attributes)) or given.get("aria-hidden") == "true"
    plain = {n.lower().replace("_", "-") for n in names}
    if name == "article" or "articleBody" in given.get("itemprop", ""):
        mark = 0
    elif name == "main" or given.get("role") == "main" or plain & MARKS[1]:
        mark = 1
    else:
        mark = 2 if plain & MARKS[2] else 9
    return shown, barred, mark


class _Open:
    """An open element: name, path, whether text in it is barred, the best mark around it, the keys of its path, and whether an element by its kind bars it, not by a name."""

    __slots__ = ("name", "path", "barred", "mark", "keys", "sealed")

    def __init__(self, name: str, path: str, barred: bool, mark: int, keys: tuple[int, ...], sealed: bool) -> None:
        self.name, self.path, self.barred, self.mark, self.keys, self.sealed = name, path, barred, mark, keys, sealed


def parse(text: str) -> tuple[dict[int, list[int]], list[tuple]]:
    """A page as tokens, key: [occurrences, first place], and blocks of visible text: (text, mark, keys of its path from outside in, words, words in links, key as a token)."""
    tokens: dict[int, list[int]] = {}
    blocks: list[tuple] = []
    stack = [_Open("", "", False, 9, (), False)]
    gathered: list[str] = []
    links = words = 0
    linked = 0
    place = at = 0

    def token(key: int) -> None:
        nonlocal place
        seen = tokens.get(key)
        if seen is None:
            tokens[key] = [1, place]
        else:
            seen[0] += 1
        place += 1

    def flush() -> None:
        nonlocal gathered, links
        if gathered:
            said = " ".join("".join(gathered).split())
            if said:
                here = stack[-1]
                key = _key(f"{here.path}\n{said}") if len(said) < 200 else xxhash.xxh3_64_intdigest(f"{here.path}\n{said}") - (1 << 63)
                token(key)
                blocks.append((said, here.mark, here.keys, said.count(" ") + 1, links, key))
            gathered = []
        links = 0

    def gather(raw: str) -> None:
        nonlocal links
        if raw and not stack[-1].barred:
            said = html.unescape(raw) if "&" in raw else raw
            gathered.append(said)
            if linked:
                links += len(said.split())

    size = len(text)
    while at < size:
        found = _TAG.search(text, at)
        if found is None:
            gather(text[at:])
            break
        gather(text[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                linked = 0 if found.group(1) else 1
            continue
        if name == "br":
            gathered.append(" ")
            continue
        flush()
        linked = 0
        if found.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in SCOPE and name not in SCOPE and name not in ("html", "head"):
                    break
            continue
        ends = CLOSED_BY.get(name, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in ends or stack[k].name == "p" and name not in ("html", "head"):
                del stack[k:]
                if name not in ("tr", "tbody"):
                    break
            elif stack[k].name in SCOPE and stack[k].name not in ends:
                break
        attributes = found.group(3)
        shown, barred, mark = _element(name, attributes if _NAMED.search(attributes) or _HIDDEN.search(attributes) else "")
        above = stack[-1]
        deep = len(stack) > DEEPEST
        path = above.path if deep else f"{above.path}/{shown}"
        token(_key(path))
        if name in VOID:
            continue
        if name == "header" and above.mark < 9 and not above.barred:
            barred = False
        if mark < 2 and name != "article" and not barred and above.barred and not above.sealed:
            above = _Open("", above.path, False, 9, above.keys, False)  # a wrapper's name cannot bar the element that the page itself calls its main one
        mark = above.mark if barred else min(above.mark, mark)
        if name not in RAW and not attributes.endswith("/"):
            stack.append(_Open(name, path, above.barred or barred, mark, above.keys if deep or name in TEXTUAL else (*above.keys, _key(path)), above.sealed or name in NOT_TEXT))
        elif name in RAW:
            closed = re.compile(f"</{name}[\\s/>]", re.I).search(text, at)
            at = closed.start() if closed else size
    flush()
    return tokens, blocks


_PARSED = "row long, tokens array<struct<token:long,n:int,place:int>>, blocks array<struct<text:string,mark:int,path:array<long>,words:int,linked:int,token:long>>"
_TOKENS = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("place", pa.int32())]))
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("mark", pa.int32()), ("path", pa.list_(pa.int64())), ("words", pa.int32()), ("linked", pa.int32()), ("token", pa.int64())]))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 36
    tokens, blocks, rows, begun, size = [], [], [], 0, 0
    for batch in batches:
        pages, begun = batch.column(batch.num_columns - 1), 0
        for at in range(batch.num_rows):
            text = pages[at].as_py() or ""
            seen, said = parse(text)
            tokens.append([{"token": k, "n": n, "place": p} for k, (n, p) in seen.items()])
            blocks.append([{"text": t, "mark": m, "path": list(k), "words": w, "linked": ln, "token": key} for t, m, k, w, ln, key in said])
            rows.append(number)
            number, size = number + 1, size + len(text)
            if size >= 4 << 20 or at == batch.num_rows - 1:
                kept = batch.slice(begun, at + 1 - begun)
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(rows, pa.int64()), pa.array(tokens, _TOKENS), pa.array(blocks, _BLOCKS)], names=[*kept.schema.names[:-1], "row", "tokens", "blocks"])
                tokens, blocks, rows, begun, size = [], [], [], at + 1, 0


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages read into tokens and blocks, written: (page_id, url, host, row, tokens, blocks)."""
    kinds = f"page_id {pages.schema[id_col].dataType.simpleString()}, url {pages.schema[url_col].dataType.simpleString()}, host string"
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    return written(rows.mapInArrow(_parse_batches, f"{kinds}, {_PARSED}"), "pages-parsed")


def classes(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, token, pages, class) of the tokens of valid classes: on enough pages of the host (``sizes``: host, all), of enough tokens, in one order on all pages.

    ``class`` is the hash of an occurrence vector. Tokens that occur once a page have to follow one another in the same order wherever the class is; classes whose pages differ in that are none.
    """
    seen = pages.select("host", "row", F.inline("tokens"))
    vectors = seen.groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("row", "n")).alias("class"), F.max("n").alias("most"), F.avg("place").alias("place")).where(F.col("pages") >= LEAST_PAGES)
    vectors = written(vectors.join(sizes, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all")), "page-vectors")
    valid = vectors.groupBy("host", "class", "pages").agg(F.count("*").alias("tokens")).where(F.col("tokens") >= LEAST_TOKENS)
    members = vectors.join(valid.select("host", "class", "pages"), ["host", "class", "pages"])
    once = members.where("most = 1").select("host", "token", "class", "place")
    on_page = seen.select("host", "row", "token", F.col("place").alias("here")).join(once, ["host", "token"])
    line = on_page.groupBy("host", "row", "class").agg(F.array_sort(F.collect_list(F.struct("place", "token", "here"))).alias("line")).where(F.size("line") > 1)
    rises = F.forall(F.sequence(F.lit(2), F.size("line")), lambda k: F.element_at("line", k)["here"] > F.element_at("line", k - 1)["here"])
    broken = line.where(~rises).select("host", "class").distinct()
    return members.join(broken, ["host", "class"], "left_anti").select("host", "token", "pages", "class")


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots: key of an element of the template and the kind of what stands in its slot, main: key of the innermost element, found once a page, that holds most prose of pages without a mark, texts: tokens of blocks that are the template's) of every host.

    The slot of a block is the innermost element of the template around it, so classes nest as their paths do. Its kind is the mark of most of its words. A template lists no token that is on less than a thousandth of the host's
    pages, so it has at most as many as a thousand pages have.
    """
    sizes = written(pages.groupBy("host").agg(F.count("*").alias("all")), "page-hosts")
    frame = written(classes(pages, sizes).join(sizes, "host"), "page-classes")
    blocks = pages.select("host", F.exists("blocks", lambda b: b["mark"] < UNMARKED).alias("marked"), F.inline("blocks"))
    paths = written(blocks.groupBy("host", "path").agg(*(F.sum(F.when(F.col("mark") == m, F.col("words")).otherwise(0)).alias(f"w{m}") for m in (0, 1, 2, UNMARKED))), "page-paths")
    around = paths.select("host", "path", F.posexplode("path").alias("depth", "token")).join(frame.select("host", "token"), ["host", "token"]).groupBy("host", "path").agg(F.max_by("token", "depth").alias("key"))
    in_slots = paths.join(around, ["host", "path"]).groupBy("host", "key").agg(*(F.sum(f"w{m}").alias(f"w{m}") for m in (0, 1, 2, UNMARKED)))
    most = F.greatest("w0", "w1", "w2", f"w{UNMARKED}")
    kind = F.when(F.col("w0") == most, 0).when(F.col("w1") == most, 1).when(F.col("w2") == most, 2).otherwise(UNMARKED)
    slots = in_slots.groupBy("host").agg(F.collect_list(F.struct("key", kind.alias("kind"))).alias("slots"))
    plain = blocks.where("NOT marked")
    texts = frame.where("2 * pages > all").select("host", "token").join(plain.select("host", "token").distinct(), ["host", "token"], "left_semi").withColumn("frame", F.lit(True))
    texts = written(texts, "page-texts")
    prose = plain.where("2 * linked < words").groupBy("host", "path", "token").agg(F.sum("words").alias("words")).join(texts, ["host", "token"], "left")
    # A host whose template would take most of its prose, such as one of copies of a page, has no template of texts.
    weight = prose.groupBy("host").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("frame").isNull(), F.col("words")).otherwise(0)).alias("left"))
    taken = weight.where("2 * left >= words").select("host", F.lit(True).alias("taken"))
    kept = prose.join(taken, "host", "left").where("frame IS NULL OR taken IS NULL")
    repeated = pages.select("host", F.inline("tokens")).where("n > 1").select("host", F.col("token").alias("key")).distinct()
    held = kept.select("host", "words", F.posexplode("path").alias("depth", "key")).groupBy("host", "key").agg(F.sum("words").alias("words"), F.max("depth").alias("depth")).join(repeated, ["host", "key"], "left_anti")
    whole = kept.groupBy("host").agg(F.sum("words").alias("whole"))
    deepest = held.join(whole, "host").where(F.col("words") >= MOST * F.col("whole")).groupBy("host").agg(F.max_by("key", F.struct("depth", "words", "key")).alias("main"))
    lists = texts.join(taken, "host", "left_semi").groupBy("host").agg(F.collect_list("token").alias("texts"))
    found = sizes.select("host").join(slots, "host", "left").join(deepest, "host", "left").join(lists, "host", "left")
    return written(found, "page-templates")


def extracted(blocks: Column, slots: Column, main: Column, texts: Column) -> Column:
    """The main text of a page, from its blocks and the template of its host.

    A block is of the kind of its slot, or where the template has none for it of its own mark. Blocks without a mark are of kind 3 in the host's main element, 4 elsewhere, 9 if they are the template's own.
    """
    kinds = F.map_from_entries(F.coalesce(slots, F.array().cast("array<struct<key:bigint,kind:int>>")))

    def kind(block):
        around = F.filter(F.transform(F.reverse(block["path"]), lambda key: F.try_element_at(kinds, key)), lambda k: k.isNotNull())
        mark = F.coalesce(F.try_element_at(around, F.lit(1)), block["mark"])
        template = F.coalesce(F.array_contains(texts, block["token"]), F.lit(False))
        inside = F.coalesce(F.array_contains(block["path"], main), F.lit(False))
        return F.when(mark < UNMARKED, mark).when(template, UNMARKED).when(inside, 3).otherwise(4)

    seen = F.transform(blocks, lambda b: F.struct(kind(b).alias("kind"), b["text"].alias("text")))
    best = F.array_min(F.transform(seen, lambda b: b["kind"]))
    return F.array_join(F.transform(F.filter(seen, lambda b: (b["kind"] == best) & (b["kind"] < UNMARKED)), lambda b: b["text"]), "\n\n")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, blocks parted by empty lines; empty if there is none.

    Text in elements that never hold an article (menus, headers, footers, forms and the like, by element or by the words of class, id and role) is none. Of the slots of the host's template, those with the best mark on a page
    (article, main, or a class or id that says so) hold its main text, repeated or not. On pages without a mark it is what stands in the host's main element and is not of its template, or, where a page has no
    such element, all that is not of its template. Null pages are empty, pages without a host share one; rows that share an id are pages of their own; an empty table gives no rows.
    """
    read = parsed(pages, id_col, url_col, html_col)
    found = templates(read)
    joined = read.select("page_id", "url", "host", "blocks").join(found, "host", "left")
    text = extracted(F.col("blocks"), F.col("slots"), F.col("main"), F.col("texts"))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
