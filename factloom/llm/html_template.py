"""HTML extraction by equivalence classes of template tokens.

Tokens are tags with their class and id, and texts, both with their path. Tokens that occur in the same pages of a host
equally often share an occurrence vector and form a class; large classes that nest in each other are the host's
template. What a page has in the slots between template tokens is its content, of which elements that HTML itself sets
apart (menus, forms, footers) are left out. Names of classes decide only for elements that hold no article and not most
of the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, rows_of, text_column
from .urlfilter import host_and_path

#: Different pages of a host below which repeats can't be told from copies, and the share of them that a template token is on.
LEAST_PAGES, SUPPORT = 3, 0.6

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that aren't content, a header only outside of an article.
_FURNITURE = frozenset("head title nav header footer aside form button select option menu dialog".split())
#: Parts of class names of furniture anywhere, and of furniture outside of an article; names that begin with a modifier say nothing.
_ANYWHERE = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu sidebar cookie cookies consent notice gdpr popup modal overlay newsletter "
    "subscribe signup share sharing social related recommend recommended recommendations comment comments disqus reply replies breadcrumb breadcrumbs pagination pager".split()
)
_OUTSIDE = frozenset("header footer masthead side aside legal copyright skip search form login toolbar widget widgets".split())
_MODIFIERS = frozenset("has is with no not without".split())
_CLOSES = {"p": frozenset("p".split()), "li": frozenset("li p".split()), "td": frozenset("td th p".split()), "th": frozenset("td th p".split()), "tr": frozenset("tr td th p".split()), "dt": frozenset("dt dd p".split()), "dd": frozenset("dt dd p".split()), "option": frozenset("option".split())}
_SCOPE = frozenset("ul ol table dl div section article body".split())
_CLOSED_BY_BLOCK = _BLOCK - frozenset("br li td th tr dt dd tbody thead tfoot caption option legend summary figcaption".split())


def _named(names: str) -> tuple[bool, bool]:
    """Whether class names, an id or a role are of furniture anywhere, and outside of an article."""
    anywhere = outside = False
    for name in names.lower().split():
        parts = name.replace("_", "-").split("-")
        if parts[0] not in _MODIFIERS:
            anywhere |= not _ANYWHERE.isdisjoint(parts)
            outside |= not _OUTSIDE.isdisjoint(parts)
    return anywhere, outside


class Page:
    """Tokens of a page: (kind, element, value), with open, close and text as kinds; scripts, styles and comments are skipped.

    Elements are numbered as they open, each with its parent, tag, label (with class, id and role) and a hash of its path, which
    grows from the parent's; so the work is in proportion to the page, however deep it nests. End tags may be missing.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.named = [-1], [""], [0], [(False, False)]
        self.tokens: list[tuple[str, int, str]] = []
        add, stack, count, at = self.tokens.append, [0], Counter(), 0

        def pop() -> str:
            name = self.tag[stack.pop()]
            count[name] -= 1
            return name

        for m in _PIECE.finditer(page):
            if m.start() > at:
                add(("text", stack[-1], page[at : m.start()]))
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[0][1] == "/":
                if count[name]:
                    while pop() != name:
                        pass
                add(("close", stack[-1], name))
                continue
            closes = _CLOSES.get(name) or (_CLOSES["p"] if name in _CLOSED_BY_BLOCK else ())
            if any(count[c] for c in closes):
                for k in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[k]]
                    if tag in closes:
                        while len(stack) > k:
                            pop()
                    elif tag in _SCOPE:
                        break
            names = ""
            if m[3]:
                found = {x.lower(): b or c or d for x, b, c, d in _NAMES.findall(m[3])}
                names = " ".join(found[x] for x in ("class", "id", "role") if found.get(x))
            own = len(self.tag)
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.path.append(xxhash.xxh64_intdigest(f"<{name} {names}", self.path[stack[-1]]))
            self.named.append(_named(names) if names else (False, False))
            add(("open", own, name))
            if name not in _VOID and not m[0].endswith("/>"):
                stack.append(own)
                count[name] += 1
        if at < len(page):
            add(("text", stack[-1], page[at:]))

    def hashes(self) -> Iterator[int | None]:
        """The identity of each token; None for blank texts."""
        for kind, element, value in self.tokens:
            if kind == "text":
                value = " ".join(plain(value).split())
                if not value:
                    yield None
                    continue
            yield xxhash.xxh64_intdigest(f"{kind} {value}", self.path[element]) - (1 << 63)

    def furniture(self) -> tuple[list[bool], list[bool], list[bool]]:
        """For each element whether it is furniture or in it, in an article or main, and in a link."""
        n = len(self.tag)
        holds, chars = [t in ("article", "main") for t in self.tag], [0] * n
        for kind, element, value in self.tokens:
            if kind == "text":
                chars[element] += len(value) if not value.isspace() else 0
        for e in range(n - 1, 0, -1):
            holds[self.parent[e]] |= holds[e]
            chars[self.parent[e]] += chars[e]
        out, inside, link = [False] * n, [False] * n, [False] * n
        for e in range(1, n):
            up, tag = self.parent[e], self.tag[e]
            inside[e], link[e] = inside[up] or tag in ("article", "main"), link[up] or tag == "a"
            anywhere, outside = self.named[e]
            own = tag in _FURNITURE and not (tag == "header" and inside[up])
            if not own and (anywhere or outside and not inside[e]):
                own = tag not in ("html", "body") and not holds[e] and chars[e] * 2 <= chars[0]
            out[e] = out[up] or own
        return out, inside, link


def plain(text: str) -> str:
    """A text with references decoded and white space made one space, its ends kept as a space each."""
    return re.sub(r"\s+", " ", html.unescape(text) if "&" in text else text)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for host, key, page in rows_of(b, "host", "h", "html"):
            count: Counter = Counter()
            first: dict[int, int] = {}
            for k, h in enumerate(Page(page).hashes()):
                if h is not None:
                    count[h] += 1
                    first.setdefault(h, k)
            out += [(host, key, h, n, first[h]) for h, n in count.items()]
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["host", "h", "token", "n", "at"])


def templates(pages: DataFrame, least: int = LEAST_PAGES, support: float = SUPPORT) -> DataFrame:
    """host, template: an array of (class, at, token) of the host's tokens in large classes. `pages` has host, h (hash of the html), html.

    A token's occurrence vector is the exclusive or of hashes of page and count, with the number of pages, so a host of any size
    needs one partial aggregate and no page meets another. Equal pages of a host count once: those that have copies, a small
    table, are told apart first. A token on a share s of a host's pages is one of at most 1/s times a page's tokens, which
    bounds the template whatever the host's size.
    """
    per_page = materialize(pages.groupBy("host", "h").agg(F.count("*").alias("c")), "different-pages")
    per_host = per_page.groupBy(F.col("host").alias("th")).agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    copied = per_page.where("c > 1").select(F.col("host").alias("ch"), F.col("h").alias("hh"))
    copied = F.broadcast(copied) if copied.count() * 300 <= BROADCAST_BYTES else copied
    same = F.col("host").eqNullSafe(F.col("ch")) & (F.col("h") == F.col("hh"))
    schema = "host string, h long, token long, n long, at long"
    seen = pages.join(copied, same, "left_anti").mapInArrow(_occurrences, schema)
    twice = pages.join(copied, same, "left_semi").mapInArrow(_occurrences, schema).distinct()
    vector = F.bit_xor(F.xxhash64("h", "n"))
    per = seen.unionByName(twice).groupBy("host", "token").agg(F.count("*").alias("on"), vector.alias("vector"), F.avg("at").alias("at")).where(F.col("on") >= least * support)
    per = per.join(per_host, F.col("host") == F.col("th")).where(F.col("on") >= support * F.col("pages"))
    classes = per.groupBy("host", "on", "vector").agg(F.collect_list(F.struct("at", "token")).alias("tokens")).where(F.size("tokens") >= 2)
    one = F.transform("tokens", lambda t: F.struct(F.col("vector").alias("c"), t["at"].alias("at"), t["token"].alias("token")))
    return classes.groupBy("host").agg(F.flatten(F.collect_list(one)).alias("template"))


def nested(template: list[tuple[int, float, int]]) -> set[int]:
    """Tokens of the classes that nest: each class stands wholly between two neighbours of a larger one, or apart from it, or
    its neighbours have the larger one wholly between them."""
    classes: dict[int, list[tuple[float, int]]] = {}
    for c, at, token in template:
        classes.setdefault(c, []).append((at, token))
    valid: list[list[float]] = []
    out: set[int] = set()

    def slot(place: float, places: list[float]) -> int:
        return bisect_right(places, place)

    for found in sorted(classes.values(), key=lambda x: (-len(x), min(x))):
        places = sorted(p for p, _ in found)
        if all(slot(places[0], other) == slot(places[-1], other) or slot(other[0], places) == slot(other[-1], places) for other in valid):
            valid.append(places)
            out.update(t for _, t in found)
    return out


def main_text(page: str, template: set[int] | frozenset = frozenset()) -> str:
    """The blocks of the page's content slots, joined by one space."""
    doc = Page(page)
    furniture, inside, link = doc.furniture()
    blocks: list[list] = [["", False, True]]  # text, in an article or main, wholly in links
    for (kind, element, value), h in zip(doc.tokens, doc.hashes() if template else [None] * len(doc.tokens)):
        if kind != "text":
            if value in _BLOCK and blocks[-1][0]:
                blocks.append(["", False, True])
            continue
        if furniture[element] or h in template or not (text := plain(value)):
            continue
        b = blocks[-1]
        b[0] += text
        b[1] |= inside[element]
        b[2] &= link[element] or not text.strip()
    blocks = [[x, i, a] for b, i, a in blocks if (x := re.sub(r"\s+", " ", b).strip())]
    if any(b[1] for b in blocks):
        return " ".join(b[0] for b in blocks if b[1])
    # Without an article, links that follow each other as blocks of their own are a menu.
    alone = [b[2] for b in blocks]
    menu = [x and (k > 0 and alone[k - 1] or k + 1 < len(alone) and alone[k + 1]) for k, x in enumerate(alone)]
    return " ".join(b[0] for b, m in zip(blocks, menu) if not m)


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, set[int]] = {}
    for b in batches:
        text = []
        for (host, page), template in zip(rows_of(b, "host", "html"), b["template"]):
            if template.is_valid and host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = nested([(t["c"], t["at"], t["token"]) for t in template.as_py()])
            text.append(main_text(page, known[host] if template.is_valid else frozenset()))
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, **limits) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars (code points).

    Hosts with fewer than three different pages have no template, nor have pages without a host; elements and names decide
    there alone. A null html is an empty page. Equal pages count once for a template; repeated rows are extracted alike; other
    columns are ignored; pages of any length are read whole, in time that grows with the length; an empty table gives no rows.
    Templates are written first; they are broadcast if their size, checked, is small, else joined by host, where adaptive
    execution splits a hot host.
    """
    host, _ = host_and_path(F.col("url").cast("string"))
    slim = pages.select("page_id", "url", host.alias("host"), text_column("html").alias("html"))
    known = slim.where("host <> ''").select("host", F.xxhash64("html").alias("h"), "html")
    found = materialize(templates(known, **limits), "templates")
    n_bytes = found.agg(F.sum(F.size("template") * 40 + 100)).collect()[0][0] or 0
    found = found.select(F.col("host").alias("th"), "template")
    found = F.broadcast(found) if n_bytes <= BROADCAST_BYTES else found
    kind = slim.schema["page_id"].dataType.simpleString()
    joined = slim.join(found, F.col("host") == F.col("th"), "left").select("page_id", "url", "host", "html", "template")
    return joined.mapInArrow(_extractor, f"page_id {kind}, url {slim.schema['url'].dataType.simpleString()}, text string, n_chars long")
