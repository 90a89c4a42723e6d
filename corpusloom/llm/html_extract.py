"""Main text of web pages: boosted trees score the page's blocks, and a choice over the whole tree
keeps or drops them.

The trees are fitted on pages made up here, with layouts and names drawn at random, where it is
known what belongs to the article. They see a node's tag, words of its attributes and of those
above it, its subtree's text, links and density, its depth and its place among siblings.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.llm.boosted_trees import Trees, fit
from corpusloom.llm.common import small_slices
from corpusloom.llm.dom import Page, keep_nodes

#: Made-up pages that the trees are fitted on.
TRAINING_PAGES = 500
_SYLLABLES = "the an er on re in ti st of and ou en ea sh ha ly wh ble ing tion ed or th it".split()


class PageMaker:
    """Random pages whose elements say whether they belong to the article.

    data-keep is "1" in the article, "0" outside, "w" for what holds both.
    """

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, n: int) -> str:
        r = self.rng
        style = r.random()
        made = []
        for _ in range(max(1, n)):
            word = "".join(r.choice(_SYLLABLES) for _ in range(r.randrange(1, 4)))
            if style < 0.06:
                word += r.choice(["***", "%%%", "$$$", "&amp;&amp;", "###"])
            elif style < 0.1:
                word = word.upper() + "!!"
            elif style < 0.14:
                word += " |"
            elif r.random() < 0.12:
                word += r.choice([".", ",", ". "])
            made.append(word)
        return " ".join(made).capitalize()

    def element(self, tag: str, inside: str, keep: str, names: str = "") -> str:
        close = "" if tag in ("p", "li") and self.rng.random() < 0.2 else f"</{tag}>"
        name = f' {self.rng.choice(["class", "id"])}="{names}"' if names else ""
        return f'<{tag}{name} data-keep="{keep}">{inside}{close}'

    def links(self, keep: str, n: int) -> str:
        items = "".join(self.element("li", f'<a href="/x">{self.words(self.rng.randrange(1, 3))}</a>', keep)
                        for _ in range(n))
        return self.element("ul", items, keep)

    def outside(self) -> str:
        """A part of a page that is not its article."""
        r = self.rng
        kind = r.choice(["nav", "head", "foot", "side", "ad", "notice", "form", "comments", "related"])
        text = self.words(r.randrange(3, 30))
        div = r.choice(["div", "section"])
        if kind == "nav":
            tag, names = r.choice([("nav", ""), (div, "nav"), (div, "main-menu"), (div, "breadcrumbs")])
            return self.element(tag, self.links("0", r.randrange(2, 9)), "0", names)
        if kind == "head":
            tag, names = r.choice([("header", ""), (div, "site-header"), (div, "masthead")])
            inside = self.element("h1", self.words(3), "0") if r.random() < 0.3 else self.element("div", text, "0")
            return self.element(tag, inside + self.links("0", r.randrange(0, 5)), "0", names)
        if kind == "foot":
            tag, names = r.choice([("footer", ""), (div, "footer"), (div, "page-footer")])
            return self.element(tag, r.choice([f"&copy; site &middot; {text}", self.element("p", text, "0")]), "0", names)
        if kind == "side":
            tag, names = r.choice([("aside", ""), ("aside", "sidebar"), (div, "sidebar"), (div, "widget")])
            return self.element(tag, self.element("h3", self.words(2), "0") + r.choice(
                [self.links("0", 4), self.element("p", text, "0")]), "0", names)
        if kind == "ad":
            return self.element(r.choice(["div", "aside"]), r.choice(
                [text, self.element("p", text, "0")]), "0", r.choice(["ad", "ads", "advert", "sponsored", "promo-box"]))
        if kind == "notice":
            return self.element("div", self.element("p", text, "0"), "0", r.choice(
                ["cookie-notice", "consent", "newsletter", "alert", "popup"]))
        if kind == "form":
            return self.element("form", f'<label>{self.words(2)}</label><input name="q">' + self.element(
                "button", self.words(1), "0"), "0", r.choice(["", "search-form", "login"]))
        if kind == "comments":
            each = "".join(self.element(r.choice(["div", "li", "article"]), self.element(
                "p", self.words(r.randrange(3, 60)), "0"), "0", r.choice(["comment", "reply"]))
                for _ in range(r.randrange(1, 6)))
            return self.element(r.choice(["section", "div"]), self.element("h3", self.words(2), "0") + each,
                                "0", r.choice(["comments", "discussion"]))
        return self.element(r.choice(["div", "section", "aside"]), self.element(
            "h4", self.words(2), "0") + self.links("0", r.randrange(2, 6)), "0", r.choice(
                ["related", "share", "social-links", "recommended"]))

    def block(self) -> str:
        """A part of an article."""
        r = self.rng
        length = r.choice([1, 2, 4, 12, 30, 60, 120, 200])
        if r.random() < 0.12:
            return self.rare_block(length)
        kind = r.random()
        if kind < 0.68:
            text = self.words(length)
            if r.random() < 0.15:
                text = f"<b>{text}" + r.choice(["</b>", "<br>"])
            if r.random() < 0.15:
                text += f' <a href="/y">{self.words(2)}</a> {self.words(3)}'
            return self.element("p", text, "1")
        if kind < 0.76:
            return self.element(r.choice(["h2", "h3"]), self.words(r.randrange(1, 8)), "1")
        if kind < 0.84:
            items = "".join(self.element("li", self.words(r.randrange(2, 25)), "1") for _ in range(r.randrange(1, 6)))
            return self.element(r.choice(["ul", "ol"]), items, "1")
        if kind < 0.9:
            return self.element("blockquote", self.element("p", self.words(length), "1"), "1")
        if kind < 0.95:
            rows = "".join(self.element("tr", "".join(self.element("td", self.words(r.randrange(1, 4)), "1")
                                                      for _ in range(3)), "1") for _ in range(r.randrange(1, 5)))
            return self.element("table", rows, "1")
        return self.element(r.choice(["figure", "pre", "div"]), self.words(length), "1")

    def rare_block(self, length: int) -> str:
        """A part of an article that few have: folded text, terms, parts with headings, captions, and
        elements that HTML does not know."""
        r = self.rng
        text = self.element("p", self.words(length), "1")
        kind = r.choice(["details", "dl", "section", "address", "figure", "own", "own"])
        if kind == "details":
            return self.element("details", self.element("summary", self.words(r.randrange(1, 6)), "1") + text, "1")
        if kind == "dl":
            return self.element("dl", "".join(self.element("dt", self.words(2), "1") + self.element(
                "dd", self.words(r.randrange(2, 30)), "1") for _ in range(r.randrange(1, 5))), "1")
        if kind == "section":
            return self.element(r.choice(["section", "div"]), self.element("h2", self.words(3), "1") + text * r.randrange(1, 4), "1")
        if kind == "address":
            return self.element("address", self.words(r.randrange(2, 12)), "1")
        if kind == "figure":
            return self.element("figure", self.element("figcaption", self.words(r.randrange(2, 20)), "1"), "1")
        return self.element(r.choice(["x-block", "my-note", "doc-part"]), text + self.element("p", self.words(3), "1"), "1")

    def article(self) -> str:
        r = self.rng
        parts = [self.block() for _ in range(r.choice([0, 1, 2, 4, 8, 15, 25]))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randrange(len(parts) + 1), self.outside())
        title = self.element("h1", self.words(r.randrange(1, 9)), "1")
        if r.random() < 0.2:
            title = self.element("header", title, "1")
        tag, names = r.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"),
                               ("div", "post-body"), ("section", "article-text"), ("div", "story"), ("div", "")])
        body = title * (r.random() < 0.85) + "".join(parts)
        return self.element(tag, body or self.element("p", self.words(5), "1"), "1", names)

    def page(self) -> str:
        r = self.rng
        before = "".join(self.outside() for _ in range(r.randrange(0, 4)))
        after = "".join(self.outside() for _ in range(r.randrange(0, 4)))
        inside = before + self.article() + after
        for _ in range(r.choice([0, 0, 1, 2])):
            inside = self.element(r.choice(["div", "div", "main"]), inside, "w", r.choice(["", "page", "wrapper", "container"]))
            if r.random() < 0.5:
                inside = self.outside() + inside + self.outside()
        if r.random() < 0.1:
            inside = self.words(3) + inside
        return (f'<!DOCTYPE html><html data-keep="w"><head data-keep="0"><title>{self.words(4)}</title></head>'
                f'<body data-keep="w">{inside}</body></html>')


@lru_cache(maxsize=1)
def trained_trees() -> Trees:
    maker = PageMaker(random.Random(11))
    rows, labels = [], []
    for _ in range(TRAINING_PAGES):
        page = Page(maker.page())
        known = [i for i, label in enumerate(page.label) if label]
        rows.append(page.features()[known])
        labels += [page.label[i] != "0" for i in known]
    return fit(np.concatenate(rows), np.array(labels, np.float64))


def main_blocks(pages: list[str], trees: Trees) -> list[list[str]]:
    """The blocks of each page's main text, in page order."""
    read = [Page(p) for p in pages]
    features = [p.features() for p in read]
    odds = trees.log_odds(np.concatenate(features)) if read else np.zeros(0)
    out, at = [], 0
    for page in read:
        kept = keep_nodes(page, odds[at:at + len(page.tag)])
        at += len(page.tag)
        out.append([text for node, text, _ in page.runs if kept[node]])
    return out


def _extract(trees: Trees, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in small_slices(batch, column=2, size=256 << 10):
                texts = ["\n\n".join(x) for x in main_blocks(
                    [v or "" for v in rows.column(2).to_pylist()], trees)]
                # A lone surrogate from a character reference cannot be written as UTF-8.
                texts = [t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64())], schema=out)

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    ``text`` holds the main text's blocks with an empty line between; inside a block white space
    is one blank. Null and empty pages and pages without a main text give "". Ids and URLs are passed on, null or
    repeated. Other columns are not looked at; an empty table gives an empty result. The trees
    are a few thousand numbers, the same for every size of input.
    """
    schema = StructType([
        StructField(id_col, pages.schema[id_col].dataType), StructField(url_col, StringType()),
        StructField("text", StringType()), StructField("n_chars", LongType())])
    arrow = pages.sparkSession.createDataFrame([], schema).toArrow().schema
    return pages.select(id_col, F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(
        _extract(trained_trees(), arrow), schema)
