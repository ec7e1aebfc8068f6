"""5. Main text of web pages by minimum-cut labelling.

A page becomes text blocks with their place in the DOM. A linear classifier
gives every block log-odds of being content (tags, class words, length, links);
they are the terminal capacities. Blocks that follow one another, and blocks
with the same parent, are joined by smoothness edges. The minimum cut separates
content from boilerplate, and the content blocks are the text, in page order.

Pages are independent, so this is one narrow pass. Defined cases: null and empty
html give an empty text; open or crossed tags are repaired the way browsers do
for paragraphs, list items and table parts; an unclosed script, style or comment
runs to the end; a tag without its > is text; repeated rows repeat. The work on a page
grows with its length, however its tags are nested.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.mincut import source_side
from plantwatch.llm.rows import append, col, raw, read

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
NAMED = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title template textarea".split())
#: Elements inside a line; text that stands in for pictures, players and formulas is part of it.
INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i iframe img ins kbd mark math "
                   "mfrac mi mn mo mover mroot mrow ms msqrt msub msubsup msup mtext munder munderover noscript object "
                   "q rp rt ruby s samp semantics small span strike strong sub sup svg text time tspan tt u var video wbr".split())
#: Start tags that end an open element of the second set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select div section article body".split())
TAG_SCORE = {"article": 2.0, "main": 1.5, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "header": -6.0,
             "menu": -6.0, "dialog": -6.0, "button": -6.0, "select": -6.0, "label": -4.0, "fieldset": -4.0}
BAD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
                "consent gdpr notice alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb "
                "breadcrumbs topbar footer header masthead comment comments reply replies discussion share sharing "
                "social related recommended newsletter subscribe signup login widget toolbar pagination pager "
                "hidden search complementary contentinfo".split())
GOOD = frozenset("article content entry post story main body text".split())
BLOCK_SCORE = {"p": 0.8, "blockquote": 0.8, "pre": 0.8, "h1": 0.5, "h2": 0.5, "h3": 0.5, "h4": 0.5}
BIAS, LENGTH, LINKS, BAD_NAME, GOOD_NAME = -1.5, 0.5, -4.0, -6.0, 1.0
NEXT_TO, SAME_PARENT = 0.4, 0.6
INSIDE_HEADER = -2.5  # a header inside the article


def context(tag: str, attributes: str, inside: bool) -> float:
    """What an element says about the blocks below it."""
    score = TAG_SCORE.get(tag, 0.0)
    if tag == "header" and inside:
        score = INSIDE_HEADER
    if attributes and tag not in ("html", "body"):
        words: set[str] = set()
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                words.update(w.lower() for w in PART.findall(value))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or \
                    name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                words.add("hidden")
        score += BAD_NAME if words & BAD else GOOD_NAME if words & GOOD else 0.0
    return score


def blocks(page: str) -> list[tuple[str, float, int]]:
    """(text, log-odds of being content, number of the parent element) per block, in page order."""
    out: list[tuple[str, float, int]] = []
    stack = [("", 0.0, False, 0, 0)]  # tag, score of the context, inside an article, number, place of the block it is in
    where: dict[str, list[int]] = {}  # places of the open elements by tag
    scopes: list[int] = []            # places of those that close() stops at
    parts: list[str] = []
    linked, in_link, count, done = 0, 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            depth = stack[-1][4]
            tag, score, _, number, _ = stack[depth]
            n = text.count(" ") + 1
            odds = (BIAS + score + BLOCK_SCORE.get(tag, 0.0) + LENGTH * min(4.0, n.bit_length())
                    + LINKS * min(1.0, linked / len(text)))
            out.append((text, odds, stack[depth - 1][3] if depth and tag in BLOCK_SCORE or tag == "li" else number))
        parts.clear()
        linked = 0

    def say(text: str):
        nonlocal linked
        if "&" in text:
            text = entities.unescape(text)
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    def close(tag: str, scoped: bool = False):
        nonlocal in_link
        places = where.get(tag)
        if not places or scoped and scopes and scopes[-1] > places[-1]:
            return
        for old, *_ in reversed(stack[places[-1]:]):
            where[old].pop()
            if old in SCOPE:
                scopes.pop()
            in_link -= old == "a"
            stack.pop()

    at, last = 0, page.rfind(">") + 1
    while m := MARKUP.search(page, at, last):
        if m.start() > done:
            say(page[done:m.start()])
        at = done = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            done = len(page)
            break
        name = m[2] or m[5]
        if not name:
            continue
        tag, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag not in INLINE:
                flush()
            close(tag)
            continue
        if tag in SILENT:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = done = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            close("p", True)
            for old in CLOSES.get(tag, ()):
                close(old, True)
        _, score, inside, _, block = stack[-1]
        count += 1
        where.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append((tag, score + context(tag, attributes, inside), inside or tag in ("article", "main"), count,
                      block if tag in INLINE else len(stack)))
        in_link += tag == "a"
    rest = page[done:]
    say(rest[:rest.index("<!--")] if "<!--" in rest else rest)
    flush()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    edges, last = [], {}
    for i, (_, _, parent) in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT_TO))
        if parent in last:
            edges.append((last[parent], i, SAME_PARENT))
        last[parent] = i
    keep = source_side([odds for _, odds, _ in found], edges)
    return "\n".join(text for (text, _, _), k in zip(found, keep) if k)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`pages` with `text`, the main text of `html`, and `n_chars`, its code points."""
    def run(sources):
        texts = [main_text(None if s is None else s.decode("utf-8", "replace")) for s in sources]
        return [texts, [len(t) for t in texts]]
    fields = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return append(pages, [raw(col("html"))], fields, run, keep)


@query("op5_pages")
def op5_pages(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), ["page_id", "url"]).select("page_id", "url", "text", "n_chars")
