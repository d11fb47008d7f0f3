"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative;
the weights are log odds of standing inside against outside the main content,
learnt from labelled pages (pages whose markup names the article). One linear
scan finds the contiguous region of the largest total. Blocks that are page
furniture by their own markup (menus, forms, comments, adverts and the like) are
left out of the region.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rentlens.llm.common import map_rows, struct_of

# ---- fixed values of HTML ----------------------------------------------------
#: Elements whose content is text, not markup, up to their own end tag (or, as in browsers, the end of the page).
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "head")
#: Elements whose content is no text of the page, from start to end tag. One that is never closed hides nothing.
HIDDEN = ("noscript", "template", "svg", "object", "canvas", "math", "select", "button")
#: Elements that are page furniture.
FURNITURE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements within a block; all others begin and end blocks.
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr")
#: Words of class, id and role attributes that name page furniture.
NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav
navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices gdpr popup modal overlay
comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe signup login
widget pagination pager toolbar search complementary contentinfo skip""".split())
#: A quote opens a value only behind an equals sign; elsewhere it is a character like others.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Beside a name these say what an element lacks or holds, or in what state it is, not what it is (``no-sidebar``).
NOT_NAMES = frozenset("no not without with has have hide hides layout open closed enabled disabled active".split())
#: Words that name furniture as a name's first word too (``comments-area``), and what they are written together with.
LEADING = frozenset("comment comments sidebar nav cookie cookies related share sharing".split())
RUN_TOGETHER = re.compile("(?:comments?|sidebar|nav|cookies?|related|shar(?:e|ing))(?:list|area|section|box|bar|wrap|wrapper|container|form"
                          "|block|widget|posts|articles|links|buttons|banner|notice|thread|menu|left|right)"
                          "|(?:left|right|main|top|bottom|site|page|primary|secondary|user|reader)(?:comments|sidebar|nav|share)")
#: Elements whose own names say nothing about their text.
PAGE_ELEMENTS = ("html", "body", "main")


def _names(attributes: str) -> frozenset[str]:
    """What every class, id or role says by its last word (``cookie-notice``: notice) or its first one
    (``comments-area``: comments), as far as that names furniture."""
    if "=" not in attributes:
        return frozenset()
    out = set()
    for m in ATTRIBUTE.finditer(attributes):
        for token in " ".join(x for x in m.groups()[1:] if x).split():
            words = [w.lower() for w in NAME_WORD.findall(token)]
            if not words or not NOT_NAMES.isdisjoint(words):
                continue
            if words[-1] in NAMES:
                out.add(words[-1])
            elif words[0] in LEADING:
                out.add(words[0])
            else:
                out.update(w for w in (words[0], words[-1]) if RUN_TOGETHER.fullmatch(w))
    return frozenset(out)


def _visible(parts: list) -> list:
    """Parts outside hidden elements. An end tag belongs to the last open start tag of its name, so elements nest."""
    opened: dict[str, list[int]] = {tag: [] for tag in HIDDEN}
    skip_to: dict[int, int] = {}
    for n, (kind, what, _) in enumerate(parts):
        if kind == "open" and what in opened:
            opened[what].append(n)
        elif kind == "close" and what in opened and opened[what]:
            skip_to[opened[what].pop()] = n
    out, n = [], 0
    while n < len(parts):
        kind, what, _ = parts[n]
        if n in skip_to:
            n = skip_to[n]
        elif kind == "text" or what not in opened:
            out.append(parts[n])
        n += 1
    return out


def tokens(page: str):
    """("text", text) and ("open" | "close", tag, furniture names) in page order.

    Comments, declarations and the content of raw elements are left out; markup
    that the page's end cuts off counts as markup. Hidden elements are still there.
    """
    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            yield "text", page[at:], None
            return
        if m.start() > at:
            yield "text", page[at:m.start()], None
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in HIDDEN and m[3].endswith("/"):
            continue
        if tag in RAW and tag != "head" and not m[1]:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "head":
            if not m[1]:
                end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = (end.end() if end[0][:2] == "</" else end.start()) if end else at
            continue
        yield ("close" if m[1] else "open"), tag, (frozenset() if m[1] else _names(m[3]))


class Page:
    """Tokens with their context: the innermost block element, whether furniture or an article encloses them.

    Every open element carries what its ancestors imply, so a token costs constant time at any depth. Names
    count on no element that holds the article (the first main element, else the first article not named as
    furniture itself), and on none at all if they left the page without a word.
    """

    def __init__(self, page: str):
        parts = _visible(list(tokens(page)))
        mark = next((n for n, (kind, tag, _) in enumerate(parts) if kind == "open" and tag == "main"), None)
        if mark is None:
            mark = next((n for n, (kind, tag, names) in enumerate(parts) if kind == "open" and tag == "article" and not names), 0)
        named = any(names for _, _, names in parts)
        holders = self._read(parts[:mark])[1] if named else frozenset()
        self.items, _ = self._read(parts, holders)
        if named and not any(kind == "text" and not furniture and what.strip() for kind, what, _, furniture, _ in self.items):
            self.items, _ = self._read([(kind, what, frozenset()) for kind, what, _ in parts])

    @staticmethod
    def _read(parts: list, holders: frozenset[int] = frozenset()) -> tuple[list[tuple[str, str, str, bool, bool]], frozenset[int]]:
        """Items (kind, text or tag, context, furniture, labelled), and the numbers of the elements still open."""
        items: list[tuple[str, str, str, bool, bool]] = []
        # tag, furniture, labelled, innermost block, whether a paragraph is open with only inline elements since, number
        stack: list[tuple[str, bool, bool, str, bool, int]] = [("", False, False, "", False, -1)]
        opened: Counter = Counter()

        def close(tag: str) -> None:
            while stack[-1][0] != tag:
                opened[stack.pop()[0]] -= 1
            opened[stack.pop()[0]] -= 1

        for n, (kind, what, names) in enumerate(parts):
            if kind == "open" and what == "p" and stack[-1][4]:
                close("p")
            _, furniture, labelled, block, paragraph, _ = stack[-1]
            if kind == "text":
                items.append((kind, what, block, furniture, labelled))
                continue
            if kind == "open":
                if n in holders or what in PAGE_ELEMENTS or what == "article" and not labelled:
                    names = frozenset()
                elif labelled:  # the article's own heading
                    names -= {"header"}
                furniture = furniture or what in FURNITURE and not (what == "header" and labelled) or bool(names)
                labelled = labelled or what in ("article", "main")
                if what not in VOID:
                    inline = what in INLINE
                    stack.append((what, furniture, labelled, block if inline else what, what == "p" or inline and paragraph, n))
                    opened[what] += 1
            elif opened[what]:
                close(what)
            items.append((kind, what, what, furniture, labelled))
        return items, frozenset(x[5] for x in stack)


def learn(counts: dict[tuple[str, str, bool], int]) -> dict[tuple[str, str], float]:
    """Weights from counts of (kind, context, inside): log odds, words at least 0.05, tags at most -0.05."""
    inside = sum(n for (_, _, x), n in counts.items() if x) + 1
    outside = sum(n for (_, _, x), n in counts.items() if not x) + 1
    out = {}
    for kind, context in {k[:2] for k in counts}:
        odds = math.log((counts.get((kind, context, True), 0) + 0.5) / inside) - math.log(
            (counts.get((kind, context, False), 0) + 0.5) / outside)
        out[kind, context] = max(0.05, odds) if kind == "word" else min(-0.05, odds)
    return out


#: Weights of contexts that no labelled page has.
DEFAULT_WORD, DEFAULT_TAG, FURNITURE_WORD, FURNITURE_TAG = 1.0, -1.0, 0.02, -4.0


def best_region(page: Page, weights: dict[tuple[str, str], float]) -> tuple[int, int]:
    """Bounds of the items of the largest total weight (the first of equal ones); (0, 0) if there are no words."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for n, (kind, what, context, furniture, labelled) in enumerate(page.items):
        if furniture and labelled:
            continue  # left out of the article without a charge
        if kind == "text":
            per = FURNITURE_WORD if furniture else weights.get(("word", context), DEFAULT_WORD)
            total += per * len(what.split())
        else:
            total += FURNITURE_TAG if furniture else weights.get(("tag", what), DEFAULT_TAG)
        if total <= 0:
            total, start = 0.0, n + 1
        elif total > best:
            best, bounds = total, (start, n + 1)
    return bounds


def main_text(source: str, weights: dict[tuple[str, str], float]) -> str:
    """Blocks of the best region, in page order, joined by two line feeds."""
    page = Page(source)
    lo, hi = best_region(page, weights)
    items = page.items
    if lo < hi:  # whole blocks at both ends
        while lo > 0 and (items[lo - 1][0] == "text" or items[lo - 1][1] in INLINE):
            lo -= 1
        while hi < len(items) and (items[hi][0] == "text" or items[hi][1] in INLINE):
            hi += 1
    blocks, now = [], []
    for kind, what, _, furniture, _ in items[lo:hi]:
        if kind == "text":
            if not furniture:
                now.append(entities.unescape(what))
        elif what not in INLINE:
            blocks.append("".join(now))
            now = []
        elif what == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def learn_weights(pages: DataFrame, sample: int = 2000) -> dict[tuple[str, str], float]:
    """Weights from at most ``sample`` labelled pages: those with an article or main element, the
    first by a hash of page_id. No labelled page: no weights (the default ones hold)."""
    ids = (pages.where(F.lower("html").rlike("<(article|main)\\b")).select("page_id")
           .orderBy(F.xxhash64("page_id"), "page_id").limit(sample).toDF("k"))
    chosen = pages.join(F.broadcast(ids), pages["page_id"] == ids["k"], "left_semi")  # at most ``sample`` ids

    def task():
        def each(batch: pa.RecordBatch):
            n: Counter = Counter()
            for source in batch.column(0).to_pylist():
                for kind, what, context, _, labelled in Page(source).items:
                    if kind == "text":
                        n["word", context, labelled] += len(what.split())
                    else:
                        n["tag", what, labelled and what not in ("article", "main")] += 1
            keys = list(n)
            return {"kind": [k[0] for k in keys], "context": [k[1] for k in keys], "inside": [k[2] for k in keys], "n": [n[k] for k in keys]}
        return each

    counts = map_rows(chosen.select("html").where("html IS NOT NULL"), task,
                      struct_of(("kind", "string"), ("context", "string"), ("inside", "boolean"), ("n", "long")))
    total = counts.groupBy("kind", "context", "inside").agg(F.sum("n").alias("n"))  # element names of the sample's pages
    return learn({(r.kind, r.context, r.inside): r.n for r in total.collect()})


def extract(pages: DataFrame, sample: int = 2000) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Null html is empty. Repeated pages give repeated rows; an empty table gives
    an empty result; further columns are ignored.
    """
    weights = learn_weights(pages, sample)

    def task():
        def each(batch: pa.RecordBatch):
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}
        return each

    src = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("h"))
    return map_rows(src, task, struct_of(("page_id", pages.schema["page_id"].dataType), ("url", "string"), ("text", "string"),
                                         ("n_chars", "long")))
