"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Block elements are the nodes. Trees give each the odds that it belongs to the article; the
decoder picks the labelling of the whole page that is likeliest among those in which no
dropped node has a kept descendant. The trees are trained on layouts drawn at random and
filled with text runs of a bounded sample of the corpus, so what is learnt is structure:
tags, attribute tokens, densities, depth and siblings.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, boost
from .common import _quoted, lean, replaced, slices

#: Pages whose text runs fill the training layouts, the most runs of each (evenly over the page), code points of a run, layouts drawn.
SAMPLE_PAGES, SAMPLE_RUNS, RUN_CHARS, LAYOUTS = 200, 64, 4000, 700

# Elements of HTML by what they are to the extractor.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
KINDS = (
    ("article",), ("main",), ("section",), ("div",), ("p",), HEADINGS, ("li", "dt", "dd"), ("ul", "ol", "dl", "menu"), ("nav",), ("header",), ("footer",), ("aside",),
    ("form", "fieldset", "label", "legend"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("blockquote", "pre"),
    ("body", "html"), ("figure", "figcaption", "details", "summary", "address", "dialog", "center", "hgroup", "search"),
)
BLOCKS = {tag: k for k, tags in enumerate(KINDS) for tag in tags}
HIDDEN = frozenset(("script", "style", "template", "noscript", "iframe", "svg", "math", "object", "select", "button", "textarea", "canvas", "audio", "video", "datalist", "title"))
RAW = frozenset(("script", "style", "textarea", "title", "iframe"))
VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset(("ul", "ol", "dl", "table", "body", "html"))
TOKENS = (
    "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs",
    "header masthead topbar top logo branding hero",
    "footer bottom copyright legal colophon foot",
    "sidebar side aside widget rail related recommended popular trending more",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "cookie cookies consent notice gdpr popup modal newsletter alert privacy overlay toast",
    "form search login signin signup subscribe contact poll",
    "comment comments disqus reply replies discussion respond commentlist",
    "share sharing social follow tools",
    "article content main post entry story text body prose",
    "byline author date meta tags tag category",
)
GROUP = {word: k for k, words in enumerate(TOKENS) for word in words.split()}
INSIDE = tuple(BLOCKS[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form"))

#: Possessive, so that no part is read twice: a quote counts after an equals sign only.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+")
_CLOSING = re.compile("</(" + "|".join(sorted(HIDDEN)) + r")(?=[\s/>])", re.I | re.A)
_WORD = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?]")


class Page:
    """Nodes of one page in document order, and its text runs with the node each belongs to.

    Read in one pass whose time grows with the length alone, whatever the markup. ``marked``:
    attributes data-k hold labels of training layouts; real pages' are not looked at.
    """

    def __init__(self, source: str, marked: bool = False):
        self.parent, self.kind, self.depth, self.groups, self.hidden, self.label = [-1], [BLOCKS["body"]], [0], [0], [0], [None]
        self.tags, self.runs, self.owner = ["body"], [], []
        self.text, self.linked, self.marks, self.inner = [0], [0], [0], [0]
        self._marked = marked
        self._parse(source)

    def _flush(self, parts: list[str], links: int, node: int) -> None:
        run = " ".join("".join(parts).split())
        if run:
            self.runs.append(run)
            self.owner.append(node)
            self.text[node] += len(run)
            self.linked[node] += min(links, len(run))
            self.marks[node] += len(_MARKS.findall(run))

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        groups, hidden, label = 0, 0, None
        for name, value in _ATTR.findall(attributes) if attributes.strip() else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "data-k" and self._marked:
                label = int(value)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = 1
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif name in ("class", "id", "role", "itemprop"):
                for word in _WORD.findall(value):
                    if word in GROUP:
                        groups |= 1 << GROUP[word]
        for held, value in (
            (self.parent, parent), (self.kind, BLOCKS[tag]), (self.depth, self.depth[parent] + 1), (self.groups, groups), (self.hidden, hidden),
            (self.label, label), (self.tags, tag), (self.text, 0), (self.linked, 0), (self.marks, 0), (self.inner, 0),
        ):
            held.append(value)
        return len(self.parent) - 1

    @staticmethod
    def _tag_at(source: str, at: int) -> re.Match | None:
        """The tag that begins there; one with a quote that nothing closes ends at the next >."""
        return _TAG.match(source, at) or _NAME.match(source, at)

    @staticmethod
    def _behind(source: str, at: int) -> int:
        """Past the comment or declaration that begins there."""
        if source.startswith("<!--", at):
            if source.startswith((">", "->"), at + 4):
                return source.index(">", at) + 1
            end = source.find("-->", at + 4)
            return len(source) if end < 0 else end + 3
        end = source.find(">", at)
        return len(source) if end < 0 else end + 1

    def _parse(self, source: str) -> None:
        stack, open_at, scopes = [0], {}, [0]  # open nodes; for each tag and for the scopes their places in the stack
        parts, links, link, at, end = [], 0, 0, 0, len(source)
        hidden, hiding, last = [], {}, None  # open hidden elements, how many of each, where each is closed for the last time

        def pop() -> str:
            tag = self.tags[stack.pop()]
            open_at[tag].pop()
            if tag in SCOPES:
                scopes.pop()
            return tag

        def flush() -> None:
            nonlocal parts, links
            self._flush(parts, links, stack[-1])
            parts, links = [], 0

        while at < end:
            begin = source.find("<", at)
            sign = source[begin + 1 : begin + 3] if begin >= 0 else ""
            tagged = sign[:1].isalpha() if sign[:1] != "/" else sign[1:].isalpha()
            markup = begin >= 0 and (tagged or sign[:1] in ("!", "?", "/"))
            stop = end if begin < 0 else begin if markup else begin + 1
            if stop > at and not hidden:
                piece = html.unescape(source[at:stop])
                parts.append(piece)
                links += len(piece) * (link > 0)
            at = stop
            if not markup:
                continue
            found = self._tag_at(source, begin) if tagged else None
            if found is None:
                at = end if tagged and source.find(">", begin) < 0 else begin + 1 if tagged else self._behind(source, begin)
                continue
            at = found.end()
            tag, closing = found[2].lower(), bool(found[1])
            if tag in HIDDEN:
                if closing:
                    while hiding.get(tag):
                        inner = hidden.pop()
                        hiding[inner] -= 1
                        if inner == tag:
                            break
                    continue
                if tag in RAW:
                    close = re.compile(f"</{tag}(?=[\\s/>])", re.I | re.A).search(source, at)
                    stop = source.find(">", close.end()) if close else -1
                    at = end if stop < 0 else stop + 1
                    continue
                if last is None:
                    last = {m[1].lower(): m.start() for m in _CLOSING.finditer(source)}
                # one that nothing closes hides nothing
                if not found[3].rstrip().endswith("/") and last.get(tag, -1) >= at:
                    hidden.append(tag)
                    hiding[tag] = hiding.get(tag, 0) + 1
                continue
            if tag == "body":
                hidden.clear()
                hiding.clear()
                continue
            if hidden or tag in ("html", "head"):
                continue
            if tag == "a":
                link = max(0, link - 1) if closing else link + 1
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            if tag not in BLOCKS:
                self.inner[stack[-1]] += not closing
                continue
            flush()
            if closing:
                if open_at.get(tag):
                    while pop() != tag:
                        pass
                continue
            if tag in CLOSED_BY:
                above = [x[-1] for t in CLOSED_BY[tag] if (x := open_at.get(t)) and x[-1] > scopes[-1]]
                while above and len(stack) > min(above):
                    pop()
            elif len(stack) > 1 and (self.tags[stack[-1]] == "p" or (self.tags[stack[-1]] in HEADINGS and tag in HEADINGS)):
                pop()
            open_at.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append(self._open(tag, found[3], stack[-1]))
        flush()

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent = np.array(self.parent)
        text, linked, marks, inner, size = (np.array(x, float) for x in (self.text, self.linked, self.marks, self.inner, np.ones(n)))
        own = text.copy()
        nearby = np.array(self.groups)
        around = np.zeros(n, np.int64)
        above = np.zeros(n, np.int64)
        kinds = np.array(self.kind)
        counts: dict = {}
        order, same = np.zeros(n), np.zeros(n)
        for k in range(1, n):
            p = self.parent[k]
            around[k] = around[p] | self.groups[p]
            above[k] = above[p] | (1 << self.kind[p])
            order[k] = counts[p] = counts.get(p, 0) + 1
            counts[p, self.kind[k]] = counts.get((p, self.kind[k]), 0) + 1
        before = np.concatenate([[0], np.cumsum(own)[:-1]])
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            text[p] += text[k]
            linked[p] += linked[k]
            marks[p] += marks[k]
            inner[p] += inner[k] + 1
            size[p] += size[k]
            same[k] = counts[p, self.kind[k]]
        siblings = np.array([counts.get(p, 1) for p in self.parent], float)
        whole = max(1.0, text[0])
        columns = [kinds == k for k in range(len(KINDS))]
        columns += [(nearby >> k) & 1 for k in range(len(TOKENS))] + [(around >> k) & 1 for k in range(len(TOKENS))]
        columns += [(above >> k) & 1 for k in INSIDE]
        columns += [
            np.array(self.depth), np.log1p(siblings), order / siblings, np.log1p(same), np.log1p(text), np.log1p(own), linked / np.maximum(text, 1),
            np.log1p(text / (1 + inner)), marks / np.maximum(text, 1), text / whole, before / whole, np.log1p(size), np.array(self.hidden), text[parent] / whole,
        ]
        return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """The likeliest labelling without a kept node under a dropped one."""
        n = len(self.parent)
        keep = -np.logaddexp(0, -margin)
        drop = -np.logaddexp(0, margin)
        keep[0] = 0.0
        keep, drop = keep.tolist(), drop.tolist()
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            keep[p] += max(keep[k], drop[k])
            drop[p] += drop[k]
        kept = [True] * n
        for k in range(1, n):
            kept[k] = kept[self.parent[k]] and keep[k] >= drop[k]
        return np.array(kept)

    def extract(self, kept: np.ndarray) -> str:
        return "\n".join(run for run, node in zip(self.runs, self.owner, strict=True) if kept[node])


# ------------------------------------------------------------------ training layouts


def _layout(random: np.random.Generator, runs: list[str]) -> str:
    """One page, its nodes marked with data-k: 1 belongs to the article, 0 does not."""
    pick = lambda *xs: xs[random.integers(len(xs))]
    chance = lambda p: random.random() < p
    run = lambda most=10**6: html.escape(runs[random.integers(len(runs))][:most])
    words = lambda n: " ".join(run(200).split()[:n])

    def named(group: int) -> str:
        word = pick(*TOKENS[group].split())
        name = pick(word, f"site-{word}", f"{word}-wrap", f"c-{word}__inner", f"{word} block", f"page_{word}")
        return f' {pick("class", "class", "id")}="{name}"'

    def block(tag: str, inner: str, attributes: str = "", label: int | None = None) -> str:
        mark = "" if label is None else f' data-k="{label}"'
        return f"<{tag}{attributes}{mark}>{inner}</{tag}>"

    def links(n: int) -> str:
        rows = "".join(f'<li><a href="/{k}">{words(random.integers(1, 5))}</a></li>' for k in range(n))
        return f"<ul>{rows}</ul>" if chance(0.8) else re.sub("</?li>", " ", rows)

    def boilerplate(kind: str) -> str:
        tag, group, inner = {
            "nav": ("nav", 0, links(random.integers(2, 9))),
            "header": ("header", 1, f"<div>{words(4)}</div>" + (links(4) if chance(0.5) else f"<p>{words(9)}</p>")),
            "footer": ("footer", 2, pick(f"&copy; {words(2)} &middot; {run()}", f"<p>&copy; {words(5)}</p>" + links(3), f"<div><p>{run()}</p></div>", run(), f"<p>{run(150)}</p><p>{run(60)}</p>")),
            "side": ("aside", 3, pick(f"<h3>{words(2)}</h3>" + links(5), f"<p>{run()}</p>", f"<h4>{words(3)}</h4><p>{run()}</p><p>{run()}</p>", f"<div>{run()}</div>")),
            "ad": ("div", 4, pick(run(), f"<p>{run()}</p>", f'<a href="/x">{words(9)}</a>', f"<span>{run()}</span>")),
            "notice": ("div", 5, pick(f"<p>{run()}</p><button>{words(1)}</button>", run(), f"<p>{run(120)}</p>")),
            "form": ("form", 6, pick(f"<label>{words(3)}</label><input><p>{run(90)}</p>", f"<p>{run()}</p><input type=submit>", f"{words(6)}<select><option>{words(1)}</select>")),
            "comments": ("section", 7, f"<h3>{words(2)}</h3>" * chance(0.5) + "".join(pick(f"<div{named(7)}><b>{words(1)}</b><p>{run()}</p></div>", f"<p>{run()}</p>", f"<li><p>{run()}</p></li>") for _ in range(random.integers(1, 6)))),
            "share": ("div", 8, pick(links(3), f"<span>{words(3)}</span>")),
            "related": ("section", 3, f"<h2>{words(2)}</h2>" * chance(0.6) + pick(links(4), "".join(f'<div><a href="/r">{words(8)}</a><p>{run(150)}</p></div>' for _ in range(3)))),
        }[kind]
        semantic = chance(0.6) and tag not in ("div", "section")
        attributes = named(group) if not semantic or chance(0.4) else ""
        return block(tag if semantic or tag == "form" else pick("div", "div", "section", "ul" if kind == "comments" else "div"), inner, attributes, 0)

    def paragraph() -> str:
        kind = random.random()
        if kind < 0.68:
            inner = run() if chance(0.9) else f'{words(6)} <a href="/l">{words(2)}</a> {run()}'
            return pick(f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<p><b>{inner}<br>", f"<p>{words(1)}</p>")
        if kind < 0.76:
            return f"<h{random.integers(2, 5)}>{words(6)}</h2>".replace("</h2>", "</h4>")
        if kind < 0.83:
            return block(pick("ul", "ol"), "".join(f"<li>{run(160)}</li>" for _ in range(random.integers(2, 6))))
        if kind < 0.88:
            return block("blockquote", f"<p>{run()}</p>")
        if kind < 0.91:
            return block("table", "".join(f"<tr><td>{words(2)}</td><td>{words(4)}</td></tr>" for _ in range(3)))
        if kind < 0.94:
            return block("pre", run())
        return block("div", run())

    body = [f"<h1>{words(9)}</h1>"] * chance(0.85) + [paragraph() for _ in range(1 + int(random.exponential(6)))]
    for kind in ("ad", "share", "side", "notice", "related", "comments", "form", "nav"):
        if chance(0.1):
            body.insert(int(random.integers(1, len(body) + 1)), boilerplate(kind))
    if chance(0.12):
        body.append(boilerplate("comments"))
    inner = "".join(body)
    for _ in range(int(random.integers(0, 3)) * chance(0.4)):
        inner = block("div", inner, named(9) if chance(0.4) else "", 1)
    shell = pick("article", "article", "article", "main", "div", "section", "")
    if shell:
        inner = block(shell, inner, named(9) if shell == "div" or chance(0.3) else "", 1)
    before = [boilerplate(k) for k in ("nav", "header", "notice", "ad", "form", "side", "share") if chance(0.35)]
    after = [boilerplate(k) for k in ("side", "related", "comments", "ad", "share", "form", "notice", "nav", "footer") if chance(0.35)]
    random.shuffle(before)
    page = "".join(before) + inner + "".join(after)
    if chance(0.3):
        page = block("div", page, pick("", ' id="page"', ' class="container"', ' class="wrapper"'), 1)
    return f"<!DOCTYPE html><html><head><title>{words(5)}</title></head><body>{page}"


def train(runs: list[str], layouts: int = LAYOUTS, seed: int = 5) -> Trees:
    """Trees over the nodes of random layouts that the runs fill."""
    random = np.random.default_rng(seed)
    runs = runs or ["word " * 12]
    xs, ys = [], []
    for _ in range(layouts):
        page = Page(_layout(random, runs), marked=True)
        labels = [1.0]
        for k in range(1, len(page.parent)):
            labels.append(labels[page.parent[k]] if page.label[k] is None else float(page.label[k]))
        xs.append(page.features()[1:])
        ys.append(np.array(labels[1:]))
    return boost(np.concatenate(xs), np.concatenate(ys))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = SAMPLE_PAGES, runs: int = SAMPLE_RUNS, chars: int = RUN_CHARS) -> Trees:
    """Trees trained with text runs of at most ``rows`` pages of any length, taken by hash.

    Tasks parse the pages; of each at most ``runs`` runs, evenly over the page, of ``chars``
    code points at most come to the driver. Without pages the layouts hold a filler.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Page(source or "").runs
                found = [x[:chars] for x in found[:: max(1, -(-len(found) // runs))]]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found, pa.string())], ["key", "run"])

    keyed = pages.select(_quoted(id_col).alias("id"), F.xxhash64(_quoted(id_col)).alias("key"), _quoted(html_col).alias("html"))
    ids = keyed.select("id", "key").orderBy("key", "id").limit(rows)  # ids alone are sorted, then their pages read
    picked = keyed.join(F.broadcast(ids.select("key").distinct()), "key").select("key", "html").mapInArrow(lean(sample), "key long, run string")
    return train([row["run"] for row in picked.orderBy("key", "run").limit(rows * runs).collect()])


def extract_text(pages: DataFrame, trees: Trees, html_col: str = "html") -> DataFrame:
    """All columns of pages with text and n_chars.

    Blocks of kept nodes in page order, joined by a line end; white space inside a block is
    one space, character references are decoded. Null and empty pages, and pages of
    boilerplate alone, have an empty text. Broken markup is read as browsers do, roughly: open elements
    end with what holds them, an unclosed script runs to the end of the page; but a hidden element
    that nothing closes hides nothing, and a tag with an unclosed quote ends at the next >.
    Each page is read whole. Repeated rows are extracted each. Input columns called text or n_chars
    are replaced; an empty table gives an empty result.
    """
    pages = replaced(pages, ["text", "n_chars"])
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            made = [Page(x or "") for x in batch.column(batch.schema.names.index(html_col)).to_pylist()]
            margin = shared.value.margin(np.concatenate([p.features() for p in made]))
            cuts = np.cumsum([len(p.parent) for p in made])[:-1]
            texts = [p.extract(p.decode(m)) for p, m in zip(made, np.split(margin, cuts), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return pages.mapInArrow(lean(run), schema)
