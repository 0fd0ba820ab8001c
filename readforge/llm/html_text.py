"""Main-text extraction from HTML: flat text blocks, classified by a decision tree.

A page is one flat list of text blocks.  A block's features are its word count, link density, the same of its
neighbours, and what kind of element stands around it.  The tree is trained on the small labelled table below.

Names of elements are read with care: those that tell what an element has, and not what it is, say nothing, and an element
that turns out to hold the article is no menu, advert or form, whatever it is called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)|[^>=]++|=)*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^<]*\Z|[^<]+|<""", re.S)
RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "math", "canvas", "audio", "video", "select"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "ruby", "rt", "rp"}
HOLDERS = {"html", "body", "div", "section", "article", "nav", "aside", "footer", "header", "main", "form", "ul", "ol", "dl", "table", "figure", "dialog", "details", "menu", "head", "fieldset", "button"}
OUT_TAGS = {"nav", "aside", "form", "dialog", "menu", "button", "fieldset", "head", "footer"}
OUT_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar|widget|footer|foot|masthead|topbar|toolbar|header|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|comment-?list|replies|reply|respond|disqus|pager|pagination|search|skip|copyright|legal|disclaimer|hidden|tags?)(?=$|[\s_-]|\d)", re.I)
IN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text|prose)(?=$|[\s_-]|\d)", re.I)
#: Class names that say what a page or an article has, or its topic, and not what the element is; the head of an article.
MODIFIER = re.compile(r"(?:has|no|with|without|category|topic|tag(?!-(?:list|links|cloud)))[-_]", re.I)
ARTICLE_HEAD = re.compile(r"(?:entry|post|article|story)[-_]+header", re.I)
#: Names that hold even for an element with an article in it: each comment or related story may be one.
NEVER = re.compile(r"comment|repl(?:y|ies)|respond|disqus|related|recommend|side-?bar|footer|promo|sponsor|advert|(?:^|[\s_-])(?:ads?|nav|menu|modal|popup|hidden)(?=$|[\s_-])", re.I)
HEADINGS, ITEMS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "td", "th", "dt", "dd"}
ATTR = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Any attribute with its value, and a style that shows nothing.
NAMED = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
NO_SHOW = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?=$|[;\s!])", re.I)
#: Elements that are text themselves: inside an article their class names are about looks.
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "tr", "caption", "figcaption"}
FEATURES = ["words", "links", "before_words", "before_links", "after_words", "after_links", "outside", "inside", "heading", "item", "sentence"]
DEPTH, LEAST = 6, 1


def _outside(tag: str, attrs: str) -> bool:
    """Whether the names of an element say that it is not main text."""
    found = ATTR.findall(attrs)
    names = [x for name, a, b, c in found if name.lower() in ("class", "id") for x in (a or b or c).split()]
    names = [x for x in names if not MODIFIER.match(x) and not ARTICLE_HEAD.fullmatch(x)]
    labels = " ".join(a or b or c for name, a, b, c in found if name.lower() not in ("class", "id"))
    if OUT_WORDS.search(labels):
        return True
    if tag in ("article", "main"):
        return False
    out = [bool(OUT_WORDS.search(x)) for x in names]
    # a name of the article alone speaks for the element, "post-comments" does not
    return any(out) and not any(IN_WORDS.search(x) for x, o in zip(names, out) if not o)


def _hidden(attrs: str) -> bool:
    """Whether an attribute says that the element is not shown; what values of others say does not count."""
    for name, a, b, c in NAMED.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NO_SHOW.search(value):
            return True
    return False


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of the flat blocks of a page, and a row of features for each."""
    texts, rows = [], []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, outside the article, inside it, outside whatever it holds
    part, linked, in_link, tag_now, at = [], 0, 0, "", 0
    seen_outside = seen_inside = False

    def flush() -> None:
        nonlocal part, linked
        if part:
            words = entities.unescape("".join(part)).split()
            if words:
                n, text = len(words), " ".join(words)
                texts.append(text)
                rows.append((n, min(linked / n, 1.0), seen_outside, seen_inside, tag_now in HEADINGS, tag_now in ITEMS, text[-1] in ".!?…:;\"'”»)"))
            part, linked = [], 0

    while at < len(page):
        m = TOKEN.match(page, at)  # some branch fits everywhere
        at = m.end()
        close, tag, attrs = m.groups()
        if tag is None:
            piece = m.group()
            if piece[0] == "<" and len(piece) > 1:
                continue
            part.append(piece)
            if in_link:
                linked += len(piece.split())
            continue
        tag = tag.lower()
        if tag in RAW:
            if not close and not attrs.endswith("/"):
                end = RAW_END[tag].search(page, at)  # the body is not markup
                if end or tag in ("script", "style"):  # others that are not closed are taken for empty ones
                    at = end.start() if end else len(page)
            continue
        if tag == "a":
            in_link = 0 if close else 1
        held = tag in INLINE and any(s[0] == tag for s in stack)  # a hidden one is open, or one in it
        if tag in INLINE and not attrs and not held:
            if tag == "br":
                part.append(" ")
            continue
        if tag not in INLINE:
            flush()
            in_link = in_link if tag == "a" else 0
            tag_now = "" if close else tag
        elif tag == "br":
            part.append(" ")
            continue
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in INLINE and stack[i][1]:
                        flush()
                    del stack[i:]
                    seen_outside, seen_inside = any(s[1] for s in stack), any(s[2] for s in stack)
                    break
        elif tag not in VOID:
            named = " ".join(a or b or c for _, a, b, c in ATTR.findall(attrs)) if attrs else ""
            unseen = bool(attrs) and _hidden(attrs)
            # names of what stands in a line, or is text of the article itself, tell nothing
            telling = bool(named) and tag not in INLINE and not (seen_inside and tag in TEXTS)
            out = tag in OUT_TAGS or telling and _outside(tag, attrs) or unseen
            if tag == "header" and not seen_inside:
                out = True
            if tag == "form" and not texts and all(s[0] in ("html", "body") for s in stack) and not (named and _outside(tag, attrs)):
                out = False  # a form about the whole page
            here = tag in ("article", "main") or bool(named and tag not in INLINE and IN_WORDS.search(named))
            if tag in ("html", "body"):
                out = here = False
            if here and not out and not any(s[3] for s in stack) and not (named and NEVER.search(named) and tag not in ("article", "main")):
                stack = [(t, False, i, False) for t, _, i, _ in stack]  # what holds the article is not outside it
                seen_outside = False
            if tag in HOLDERS or out or held:
                if tag in INLINE and out:
                    flush()
                fixed = out and (tag in OUT_TAGS - {"form", "fieldset"} or bool(named and NEVER.search(named)) or unseen)
                stack.append((tag, out, here, fixed))
                seen_outside, seen_inside = seen_outside or out, seen_inside or here
    flush()
    n = len(texts)
    table = np.zeros((n, len(FEATURES)))
    if n:
        own = np.array(rows, dtype=float)
        table[:, 0], table[:, 1], table[:, 6:] = own[:, 0], own[:, 1], own[:, 2:]
        table[1:, 2:4], table[:-1, 4:6] = own[:-1, :2], own[1:, :2]
    return texts, table


class Tree:
    """A binary tree of threshold tests, grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
        self.value, self.at = bool(y.mean() > 0.5) if len(y) else True, -1
        best = 1e-9
        gini = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
        if depth:
            for j in range(x.shape[1]):
                levels = np.unique(x[:, j])
                for cut in (levels[:-1] + levels[1:]) / 2:
                    left = x[:, j] <= cut
                    gain = gini(y) - gini(y[left]) - gini(y[~left])
                    if gain > best and min(left.sum(), (~left).sum()) >= LEAST:
                        best, self.at, self.cut = gain, j, cut
        if self.at >= 0:
            left = x[:, self.at] <= self.cut
            self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.at < 0:
            return np.full(len(x), self.value)
        left = x[:, self.at] <= self.cut
        out = np.empty(len(x), dtype=bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


#: Pages with, for each text block in order, 1 for main text and 0 for the rest.
LABELLED = [
    ("<nav><ul><li><a href=x>Home</a></li><li><a href=y>News today</a></li></ul></nav><article><h1>A short title</h1><p>First paragraph of the article goes here.</p><p>Yes.</p><p>The second one has <a href=z>a link</a> and more words after it.</p></article><footer>&copy; Site. All rights reserved by somebody.</footer>", "0011110"),
    ("<div class=ad>Buy one and get the second for free.</div><article><h1>Words</h1><p>One</p><p>Two short lines</p></article><footer>Imprint. Contact us and write a letter.</footer>", "01110"),
    ("<header><h1>The Daily Site</h1><p>News for all of us, each day.</p></header><main><h2>Heading</h2><p>Text of the story, long enough to be read as a sentence.</p><ul><li>first point of a list</li><li>second point</li></ul></main><aside><h3>Most read</h3><p>Another story that you may like to read now.</p></aside>", "00111100"),
    ("<article><header><h1>Title inside</h1></header><p>A paragraph in an article that says something.</p><section class=comments><h3>Comments</h3><p>I do not agree with this text at all, it is quite wrong.</p></section></article>", "1100"),
    ("<div id=cookie-notice><p>We use cookies to make this site work. Accept them all?</p></div><div class=content><p>The body of this page is held by a plain division element.</p><p>Short end.</p></div><form><label>Your name</label><p>Send us your message with this form.</p></form>", "01100"),
    ("<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><p>This page has no article element, yet it holds a long paragraph of plain text, with many words and few links, so it is the main text of the page.</p><p>Then a second paragraph follows it with many words of the same kind and again no links at all in it.</p></div><div><a href=4>Terms</a> | <a href=5>Privacy</a></div>", "0110"),
    ("<article><div class=ad>Sale ends soon, so buy it now.</div><p>The article goes on after an advert in its middle.</p><div class='related'><a href=q>Read also this</a></div><blockquote>A quotation in the text.</blockquote></article>", "0101"),
    ("<article><h2>List of links</h2><p><a href=1>A paragraph that is one link</a></p><p>Text.</p><table><tr><td>cell one</td><td>cell two</td></tr></table></article><div class=sidebar><p>About the author of these pages and some more words.</p></div>", "111110"),
    ("<p>A bare paragraph without any container, but with quite enough words to be the main text here.</p><p>And one more such paragraph, which also has quite a few words in it.</p><ul><li><a href=a>Next</a></li><li><a href=b>Previous page</a></li></ul>", "1100"),
    ("<div><h1>Heading of a page</h1></div><div><p>Text in a division comes after its heading and has a good number of words in one block.</p></div><div>Tags: <a href=t>one</a> <a href=u>two</a> <a href=v>three</a></div>", "110"),
    ("<p>Short text.</p>", "1"),
    ("<p>Just one plain line of text</p>", "1"),
    ("<article><p>One.</p></article>", "1"),
    ("<div class='site-content has-sidebar'><article class='post hentry category-news tag-economy'><div class='entry-header'><h1>Prices rise again</h1></div><p>Prices rose in the last month, says the office that counts them.</p><p>Less so in the south.</p><div class='post-comments'><p>I have not seen any of this where I live.</p></div></article></div><div class='sidebar'><p>Most read stories of this week.</p></div>", "11100"),
    ("<div class='content no-sidebar'><main class='main with-comments'><h2>A walk</h2><p>We set out early, and the rain had stopped by then.</p></main><div class=comments><p>Thank you for this walk, we liked it.</p></div><div class='tag-cloud'><a href=w>walks</a> <a href=r>rain</a></div></div>", "1100"),
    ("<div><a href=1>Home</a></div><div><a href=2>Sport</a></div><div><a href=3>Culture</a></div><div><h1>A river rises</h1></div><div><p>The river has risen by two feet since the rain began on Monday, and people on both banks carry their things upstairs.</p></div><div><p>Nobody was hurt.</p></div><div><p>The town expects the water to go down again before the week is over, if the weather holds as the office says it will.</p></div><div><a href=4>More on this</a></div><div>Copyright by the makers of this page</div><div><a href=5>Imprint</a></div>", "0001111000"),
    ("<ul><li><a href=a>Start</a></li><li><a href=b>About us</a></li></ul><p>Call now</p><ul><li><a href=c>Contact</a></li></ul><h2>How to plant a tree</h2><p>Dig a hole that is twice as wide as the roots and no deeper than they are, and loosen the ground all around it.</p><ul><li>a spade</li><li>some water</li></ul><p>Set the tree upright, fill in the earth, press it down with care and water it well for some weeks after.</p><ul><li><a href=d>Back</a></li></ul><p>All rights reserved</p><ul><li><a href=e>Terms of use</a></li></ul>", "00001111" + "1000"),
    ("<form action=page.aspx><div class=header-fixed><article><h1>Held by a form</h1><p>Old pages of some makers stand in one form as a whole, and so does this one.</p></article></div><div class=search>Find on this site</div></form>", "110"),
    ("<div class=comments><article class=comment-body><p>I was there too, and it was quite another thing that I saw.</p></article></div>", "0"),
    ("<nav><a href=1>Home</a></nav><article><p>Only one paragraph of text.</p></article><div><a href=2>Next page</a></div>", "010"),
    ("<div><a href=1>Home</a></div><p>A page may have a single paragraph between its links, and when it has as many words as this one it is the text of the page.</p><div><a href=2>Next page</a></div>", "010"),
    ("<div><a href=1>Home</a></div><div class=entry><h1>Rain</h1></div><div><a href=2>Tags</a></div><div class=text><p>Yes.</p></div><div><a href=3>Next</a></div>", "01010"),
    ("<nav>Menu of this site</nav><article><p>Reader text stands here, and it is followed by menus.</p></article><nav><a href=m>More</a></nav>", "010"),
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for page, labels in LABELLED:
        texts, x = blocks(page)
        if len(texts) != len(labels):
            raise ValueError(f"{len(texts)} blocks and {len(labels)} labels: {texts}")
        xs.append(x)
        ys.extend(c == "1" for c in labels)
    return np.vstack(xs), np.array(ys)


def train() -> Tree:
    return Tree(*labelled_table())


def main_text(page: str, tree: Tree) -> str:
    texts, x = blocks(page)
    return "\n".join(t for t, keep in zip(texts, tree.predict(x)) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    The text is the main blocks in page order, joined by line ends; character references are decoded and white space
    inside a block is one space.  Null, empty and text-free pages give an empty text.  Markup that is cut off or not
    closed is read as far as it goes.  Repeated rows give repeated results; other columns are not read.
    """
    tree = train()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(h, tree) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].to_numpy(), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema[key].dataType.simpleString()
    side = pages.select(F.col(key).cast("string").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return side.mapInPandas(run, "page_id string, url string, text string, n_chars bigint").withColumn("page_id", F.col("page_id").cast(kind))
