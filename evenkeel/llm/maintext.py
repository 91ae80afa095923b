"""The main text of web pages, by the marginals of a tree model over their elements that is trained on labelled pages."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evenkeel.llm import treecrf
from evenkeel.llm.domtree import KINDS, Tree, features, kinds, parse

#: Made-up labelled pages that the model is trained on.
TRAINING_PAGES = 1000
#: Characters of pages whose trees go through the model together.
SLICE_CHARS = 1_000_000
#: Marks around what is main text in a labelled page. No page may hold them.
BEGIN, END = "", ""

_CONTENT_NAMES = "article content main post entry body story text page prose copy".split()
_CONTENT_FORMS = ("article", "content", "main-content", "mainContent", "post", "post-content", "post-body", "entry-content", "entry", "story", "story-body", "article-body", "articleBody", "article__content", "page-content", "body-text", "text", "prose", "copy", "blog-post", "main", "single-post", "richtext", "markdown-body")
_BOX_NAMES = ("container", "wrapper", "row", "col", "inner", "grid", "layout", "section", "box", "block", "wrap", "outer", "site", "content", "page", "main", "clearfix")
_NAMES = {
    "nav": "nav menu navbar navigation main-nav topnav menu-bar breadcrumb breadcrumbs pagination pager toc tabs site-nav main-menu mobile-menu".split(),
    "header": "header site-header masthead top topbar banner page-header branding logo hero-header main-header".split(),
    "footer": "footer site-footer page-footer colophon bottom copyright legal footer-content footer-text".split(),
    "aside": "sidebar side aside widget widgets rail right-rail related related-posts recommended trending teaser teasers more-stories popular sidebar-content sidebar-text".split(),
    "ad": "ad ads advert advertisement advertising ad-slot adbox sponsored sponsor promo promotion banner-ad ad-text ad-content".split(),
    "notice": "notice cookie cookie-notice cookies consent gdpr alert popup modal overlay disclaimer notification paywall cookie-text notice-content message warning".split(),
    "comments": "comments comment comment-list commentlist discussion responses replies reply disqus reader-comments comment-body comment-content user-comments feedback".split(),
    "form": "form newsletter subscribe signup search login search-form newsletter-signup contact-form subscription".split(),
    "share": "share social share-buttons sharing social-links follow tools toolbar actions share-bar".split(),
}


class PageMaker:
    """Invents pages whose main text stands between marks."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.junk = 0.04  # share of texts that are one word again and again, or have no sentence ends
        self.syllables = ["".join(self.rng.choice("bcdfghklmnprstvwz") + self.rng.choice("aeiouäéö") for _ in range(1)) + self.rng.choice(["", "n", "r", "s", "t", "ch"]) for _ in range(90)]

    def words(self, least: int, most: int) -> str:
        words = ["".join(self.rng.choices(self.syllables, k=self.rng.choice((1, 1, 2, 2, 3)))) for _ in range(self.rng.randint(least, most))]
        return " ".join(words).capitalize()

    def sentences(self, least: int, most: int) -> str:
        if self.chance(self.junk):
            return self.some((self.words(1, 1) + self.some(" ", ", ", ". ")) * self.rng.randint(1, 90), self.words(1, 90) + self.some("", ",", "###"))
        end = self.rng.choice((".", ".", ".", "!", "?", "", " ###", "&amp;&amp;"))
        return " ".join(self.words(1, 18) + (end if self.chance(0.2) else ".") for _ in range(self.rng.randint(least, most)))

    def some(self, *choices):
        return self.rng.choice(choices)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def named(self, names, spare: float = 0.1) -> str:
        """Class or id attributes of these names, or with the chance ``spare`` none."""
        if self.chance(spare):
            return ""
        own = [self.rng.choice(names)]
        if self.chance(0.2):
            own.append(self.rng.choice(_BOX_NAMES))
        return f' {self.some("class", "class", "class", "id")}="{" ".join(own)}"'

    def link(self) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.words(1, 4)}</a>'

    def links(self) -> str:
        n = self.rng.randint(2, 9)
        if self.chance(0.2):
            return self.some(" | ", " ", " &middot; ").join(self.link() for _ in range(n))
        list_ = self.some("ul", "ul", "ol")
        return f"<{list_}>" + "".join(f"<li>{self.link()}" + self.some("</li>", "</li>", "") for _ in range(n)) + f"</{list_}>"

    def boxed(self, tag: str, names, inner: str, spare: float = 0.1) -> str:
        return f"<{tag}{self.named(names, spare)}>{inner}</{tag}>"

    def prose(self, most: int = 2) -> str:
        """Sentences in a paragraph, or bare."""
        return f"<p>{self.sentences(1, most)}</p>" if self.chance(0.6) else self.sentences(1, most)

    def noise(self, kind: str) -> str:
        if kind == "nav":
            return self.boxed("nav", _NAMES["nav"], self.links(), 0.5) if self.chance(0.6) else self.boxed("div", _NAMES["nav"], self.links(), 0)
        if kind == "header":
            title = self.some(f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 6)}</p>", self.link(), f'<a href="/"><img alt="x"></a>{self.words(1, 5)}')
            inner = title + (self.noise("nav") if self.chance(0.5) else "")
            return self.boxed("header", _NAMES["header"], inner, 0.5) if self.chance(0.6) else self.boxed("div", _NAMES["header"], inner, 0)
        if kind == "footer":
            inner = self.some(f"&copy; {self.words(1, 4)} &middot; {self.sentences(1, 2)}", f"<p>{self.sentences(1, 2)}</p>{self.links()}", self.links(), f"<p>&copy; 20{self.rng.randint(10, 26)} {self.words(1, 3)}. {self.sentences(1, 2)}</p>", self.sentences(1, 4))
            return self.boxed("footer", _NAMES["footer"], inner, 0.6) if self.chance(0.7) else self.boxed("div", _NAMES["footer"], inner, 0)
        if kind == "aside":
            inner = (f"<h{self.some(2, 3)}>{self.words(1, 4)}</h3>" if self.chance(0.6) else "") + self.some(self.links(), self.links() + self.prose(), "".join(f"<div><h4>{self.link()}</h4><p>{self.sentences(1, 3)}</p></div>" for _ in range(self.rng.randint(1, 5))), self.prose(4))
            return self.boxed("aside", _NAMES["aside"], inner, 0.5) if self.chance(0.5) else self.boxed(self.some("div", "section"), _NAMES["aside"], inner, 0)
        if kind == "ad":
            inner = self.some(self.sentences(1, 2), self.prose(3), self.link(), f"<p>{self.words(2, 8)}</p>{self.link()}", self.sentences(1, 3) + self.link())
            return self.boxed("p", _NAMES["ad"], self.sentences(1, 2), 0) if self.chance(0.3) else self.boxed(self.some("div", "div", "div", "aside", "section"), _NAMES["ad"], inner, 0)
        if kind == "notice":
            inner = self.some(self.sentences(1, 3), self.prose(4) + f"<button>{self.words(1, 2)}</button>", f"<p>{self.sentences(1, 2)} {self.link()}</p>")
            return self.some(f'<div role="{self.some("alert", "dialog", "status")}"{self.named(_NAMES["notice"], 0.3)}>{inner}</div>', self.boxed(self.some("div", "div", "section"), _NAMES["notice"], inner, 0), self.boxed("p", _NAMES["notice"], self.sentences(1, 2), 0), self.boxed("dialog", _NAMES["notice"], inner, 0.4))
        if kind == "comments":
            one = lambda: f"<p>{self.sentences(1, 4)}</p>" if self.chance(0.7) else self.sentences(1, 3)
            item = self.some(lambda: f'<li{self.named(_NAMES["comments"], 0.4)}>{one()}</li>', lambda: self.boxed("div", _NAMES["comments"], (f"<b>{self.words(1, 2)}</b>" if self.chance(0.4) else "") + one(), 0), lambda: self.boxed("article", _NAMES["comments"], f"<h4>{self.words(1, 2)}</h4>{one()}", 0))
            inner = (f"<h{self.some(2, 3)}>{self.words(1, 3)}</h2>" if self.chance(0.6) else "") + "".join(item() for _ in range(self.rng.randint(1, 7)))
            return self.boxed(self.some("div", "section", "section", "aside", "ol", "ul"), _NAMES["comments"], inner, 0)
        if kind == "form":
            inner = (f"<label>{self.words(1, 4)}</label>" if self.chance(0.6) else f"<p>{self.sentences(1, 2)}</p>") + '<input name="q">' + (f"<textarea>{self.words(1, 6)}</textarea>" if self.chance(0.2) else "") + self.some(f"<button>{self.words(1, 2)}</button>", f"<select><option>{self.words(1, 1)}<option>{self.words(1, 1)}</select>", "")
            form = self.boxed("form", _NAMES["form"], inner, 0.6)
            return form if self.chance(0.7) else self.boxed(self.some("div", "section"), _NAMES["form"], f"<h3>{self.words(1, 4)}</h3>{form}", 0)
        inner = self.some(self.links(), " ".join(f'<a href="#">{self.words(1, 1)}</a>' for _ in range(4)))
        return self.boxed(self.some("div", "ul", "section"), _NAMES["share"], inner, 0)

    def hidden(self) -> str:
        return self.some('<script>var t="</p>";</script>', "<style>p{margin:0}</style>", "<!-- x -->", "<noscript><p>x</p></noscript>", "")

    def marked(self, text: str) -> str:
        return BEGIN + text + END

    def paragraph(self) -> str:
        t = self.sentences(1, self.some(1, 2, 4, 9))
        if self.chance(0.15):
            t += " " + self.link() + " " + self.words(1, 6) + "."
        return self.some(f"<p>{self.marked(t)}</p>", f"<p>{self.marked(t)}</p>", f"<p>{self.marked(t)}", f"<p><b>{self.marked(t)}<br>", f"<p><b>{self.marked(t)}<br>", f"<p>{self.marked(t)}</p>", f"<p class=\"{self.some('lead', 'intro', 'x1', 'para', 'text')}\">{self.marked(t)}</p>")

    def passage(self) -> str:
        """Something that isn't a plain paragraph."""
        m = self.marked
        list_ = self.some("ul", "ol")
        return self.some(
            f"<h{(h := self.some(2, 2, 3, 4))}>{m(self.words(1, 8))}</h{h}>", f"<{list_}>" + "".join(f"<li>{m(self.words(1, 15) + self.some('', '.'))}" for _ in range(self.rng.randint(1, 6))) + f"</{list_}>",
            f"<blockquote>{m(self.sentences(1, 3))}</blockquote>", f"<blockquote><p>{m(self.sentences(1, 3))}</p></blockquote>", f"<pre>{m(self.words(3, 30))}</pre>",
            "<table>" + "".join("<tr>" + "".join(f"<td>{m(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.rng.randint(1, 4))) + "</table>",
            f'<figure><img src="x"><figcaption>{m(self.words(2, 12) + ".")}</figcaption></figure>', f"<dl><dt>{m(self.words(1, 3))}<dd>{m(self.sentences(1, 2))}</dl>", m(self.sentences(1, 3)),
            f"<section><h3>{m(self.words(1, 5))}</h3><p>{m(self.sentences(1, 4))}</p></section>", f"<div>{m(self.sentences(1, 4))}</div>", f"<div><p>{m(self.sentences(1, 4))}</p></div>",
        )

    def article(self) -> str:
        head = f"<h1>{self.marked(self.words(1, 12))}</h1>" if self.chance(0.85) else ""
        if head and self.chance(0.08):
            head = f"<header>{head}</header>"
        plain = self.some(0.85, 0.85, 1.0)
        self.junk = 0.95 if self.chance(0.06) else 0.04
        parts = [self.paragraph() if self.chance(plain) else self.passage() for _ in range(self.some(0, 1, 1, 2, 3, 5, 8, 14, 25, 25, 80) or (not head))]
        self.junk = 0.04
        for kind, p in (("ad", 0.1), ("share", 0.06), ("aside", 0.06), ("form", 0.04), ("notice", 0.04), ("nav", 0.03)):
            if self.chance(p):
                parts.insert(self.rng.randint(0, len(parts)), self.noise(kind))
        if self.chance(0.1):
            parts.append(self.noise("comments"))
        if self.chance(0.05):
            parts.append(self.boxed("footer", _NAMES["footer"], self.some(self.links(), self.prose()), 0.7))
        if self.chance(0.05):
            parts.insert(self.rng.randint(0, len(parts)), self.hidden())
        body = "".join(parts)
        if self.chance(0.15):
            body = self.boxed("div", _CONTENT_FORMS, body, 0.2)
        inner = head + body
        form = self.rng.random()
        if form < 0.5:
            return self.boxed("article", _CONTENT_FORMS, inner, 0.7)
        if form < 0.62:
            return self.boxed("main", _CONTENT_FORMS, inner if self.chance(0.5) else self.boxed("article", _CONTENT_FORMS, inner, 0.6), 0.6)
        if form < 0.9:
            return self.boxed(self.some("div", "div", "section"), _CONTENT_FORMS, inner, 0)
        if form < 0.94:
            return f'<div role="{self.some("main", "article")}">{inner}</div>'
        return f'<div class="x{self.rng.randrange(99)}">{inner}</div>' if len(parts) > 2 else f"<article>{inner}</article>"

    def page(self) -> str:
        """A page with marks; some have no main text."""
        before = [self.noise(k) for k, p in (("header", 0.35), ("nav", 0.6), ("notice", 0.2), ("ad", 0.45), ("form", 0.1), ("share", 0.05), ("aside", 0.08)) if self.chance(p)]
        after = [self.noise(k) for k, p in (("comments", 0.3), ("aside", 0.3), ("share", 0.15), ("ad", 0.25), ("form", 0.15), ("notice", 0.12), ("nav", 0.1), ("footer", 0.75)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(before)
        body = before + ([self.article()] if self.chance(0.96) else []) + after
        if self.chance(0.25):
            at = self.rng.randint(0, len(before))
            body[at:] = [self.boxed("div", _BOX_NAMES, "".join(body[at:]), 0.2)]
        for _ in range(self.rng.randint(0, 2)):
            body.insert(self.rng.randint(0, len(body)), self.hidden())
        head = f"<head><title>{self.words(1, 8)}</title>{self.hidden()}</head>" if self.chance(0.9) else ""
        close = "</body></html>" if self.chance(0.8) else ""
        return f"<!DOCTYPE html><html>{head}<body{self.named(_BOX_NAMES, 0.8)}>{self.some('', chr(10)).join(body)}{close}"


def labelled(page: str) -> tuple[Tree, list[int]]:
    """The tree of a page with marks, without them, and the labels: 1 for marked text and for elements that hold some."""
    tree = parse(page)
    labels = [0] * len(tree.tag)
    for i in range(len(tree.tag) - 1, -1, -1):
        if BEGIN in tree.text[i]:
            labels[i] = 1
            tree.text[i] = tree.text[i].replace(BEGIN, "").replace(END, "")
        if labels[i] and tree.parent[i] >= 0:
            labels[tree.parent[i]] = 1
    return tree, labels


@lru_cache(maxsize=4)
def model(pages: int = TRAINING_PAGES, seed: int = 7) -> treecrf.TreeModel:
    """The model, trained once a session."""
    maker, trees = PageMaker(seed), []
    for _ in range(pages):
        tree, labels = labelled(maker.page())
        trees.append((tree.parent, kinds(tree), features(tree), labels))
    return treecrf.fit(trees, KINDS)


def main_texts(trained: treecrf.TreeModel, pages: list[str]) -> list[str]:
    """Of each page the blocks whose marginal is above a half, in page order, with two line ends between them."""
    trees = [parse(p) for p in pages]
    belief, _ = trained.beliefs(trained.forest([(t.parent, kinds(t), features(t)) for t in trees]))
    out, at = [], 0
    for t in trees:
        own = belief[at : at + len(t.tag)] > 0.5
        out.append("\n\n".join(x for x, keep in zip(t.text, own) if keep and x))
        at += len(t.tag)
    return out


def extract(df: DataFrame, key: str, url: str, html: str, trained: treecrf.TreeModel | None = None) -> DataFrame:
    """One row per row of df: key, url, text (the main text, empty if there is none), n_chars.

    Null and empty pages have no text; text without any element is judged like other text; long pages are parsed
    whole, in time and memory that grow with them; pages are judged one by one, so ties, repeats and other columns change
    nothing; null keys and urls are kept; an empty df gives no rows.
    """
    trained = trained or model()
    schema = StructType([StructField(key, df.schema[key].dataType), StructField(url, df.schema[url].dataType), StructField("text", StringType()), StructField("n_chars", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held = 0, []
            for row in range(batch.num_rows + 1):
                if row == batch.num_rows or sum(map(len, held[-1:])) > SLICE_CHARS or len(held) >= 500:
                    texts = main_texts(trained, held)
                    part = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)
                    first, held = row, []
                if row < batch.num_rows:
                    held.append(batch.column(2)[row].as_py() or "")

    return df.select(key, url, html).mapInArrow(rows, schema)
