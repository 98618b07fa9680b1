"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

Pages are cut into leaf blocks (runs of text between block-level tags) with their ancestors. Each block has binary
features: its own tag, ancestors' tags, words of ancestors' class, id and role attributes, text length, link and
punctuation density, place. Weights are trained by full-likelihood gradient steps on labelled pages: pages whose blocks
are marked as article text or not. A default set of labelled pages is generated from layouts that vary wrappers, menus,
sidebars, notices, adverts, forms, comments and footers; callers may pass their own.

Scripts, styles, comments and the head never make blocks. A head ends at its end tag or at the first tag or text that can't
stand in it; scripts, styles, titles, frames and text areas without an end last to the page's end; other hidden elements
without an end hide nothing. Character references are decoded, each text between two tags on its own; white space inside a
block becomes one space. Null and empty html, and pages without article text, give the empty string. Unclosed tags, cut-off
tags and cut-off references at the end are taken as they stand. Repeated rows each give a row; null ids pass through;
further columns are not read.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, read, steps

#: Elements whose tags end a block; fixed values.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
#: Elements whose content is no text of the page.
SILENT = set("script style noscript template head title svg math iframe object canvas audio video select datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag closes, where they are the innermost ones.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose content has no tags: it lasts to their end tag, or to the end of the page.
RAW = set("script style textarea title iframe".split())
#: Start tags that can stand in a head; any other one, and text, ends it.
IN_HEAD = set("base link meta noscript script style template title".split())
#: Start tags besides blocks that end drawings and formulas which are still open.
BREAKOUT = set("b big br code em embed font head i img nobr ruby s small span strike strong sub sup tt u var".split())
#: A tag's attributes: quoted values hold any sign, values without quotes last to white space or the tag's end.
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|=)*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    tag: str
    ancestors: tuple[str, ...]
    names: frozenset[str]
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Open:
    """An open element, with what holds of it and of all around it."""

    tag: str
    blocks: tuple[str, ...] = ()
    names: frozenset[str] = frozenset()
    silent: bool = False
    link: bool = False


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks that have text, in page order."""
    stack = [Open("")]
    count: Counter = Counter()  # open elements by tag
    inner = [0]  # places of open blocks
    out: list[Block] = []
    now: list[Block | None] = [None]

    def close() -> None:
        b = now[0]
        if b is not None:
            b.text = " ".join("".join(b.parts).split())
            if b.text:
                out.append(b)
        now[0] = None

    def cut(n: int) -> None:
        """Ends all elements but the n outermost."""
        while len(stack) > n:
            count[stack.pop().tag] -= 1
        while inner[-1] >= n:
            inner.pop()

    def text(s: str) -> None:
        if not s:
            return
        if stack[-1].tag == "head" and not s.isspace():
            cut(len(stack) - 1)
        top = stack[-1]
        if top.silent or now[0] is None and s.isspace():
            return
        if now[0] is None:
            now[0] = Block(top.blocks[-1] if top.blocks else "body", top.blocks, top.names)
        now[0].parts.append(htmllib.unescape(s))
        if top.link:
            now[0].linked += len(s)

    at, low = 0, None
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag closes its element and what is open within; without one it's ignored
            if count[tag]:
                if tag in BLOCK:
                    close()
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag == "p":
                close()
            continue
        if count["head"] and tag not in IN_HEAD and stack[-1].tag == "head":
            cut(len(stack) - 1)
        if tag in BLOCK or tag in BREAKOUT:
            drawing = next((i for i in range(1, len(stack)) if stack[i].tag in ("svg", "math")), None) if count["svg"] or count["math"] else None
            if drawing is not None and not count["foreignobject"]:
                cut(drawing)
        if tag in BLOCK:
            close()
            # a block start ends an open paragraph, with the inline elements left open in it
            if inner[-1] and stack[inner[-1]].tag in ({"p"} | CLOSES.get(tag, set())):
                cut(inner[-1])
        if tag == "br":
            text(" ")
        if tag in VOID or tag == "head" and (out or now[0] is not None or count["body"]):
            continue
        top = stack[-1]
        names = top.names.union(w for a in ATTRIBUTE.finditer(m[3] or "") for w in SPLIT.split((a[2] or a[3] or a[4] or "").lower()) if w)
        if tag in RAW or tag in ("noscript", "template"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag == "textarea":
                stack.append(Open(tag, (*top.blocks, tag), names, top.silent, top.link))
                text(page[at : end.start() if end else len(page)])
                stack.pop()
                close()
            if end or tag in RAW:
                at = end.end() if end else len(page)
            continue
        if (m[3] or "").rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in SILENT and tag != "head":
            low = page.lower() if low is None else low
            if low.find(f"</{tag}", at) < 0:  # one that never ends hides nothing
                continue
        if tag in BLOCK:
            inner.append(len(stack))
        count[tag] += 1
        stack.append(Open(tag, (*top.blocks, tag) if tag in BLOCK else top.blocks, names if len(names) > len(top.names) else top.names, top.silent or tag in SILENT, top.link or tag == "a"))
    text(page[at:])
    close()
    return out


HINTS = ("ad ads advert advertisement sponsor sponsored promo banner comment comments reply replies discussion respond menu nav navigation navbar breadcrumb breadcrumbs sidebar side widget related recommended cookie consent notice alert modal popup newsletter subscribe signup login form search share social footer foot copyright legal header head masthead top article content main post entry story body text page author byline meta date tags tag caption").split()
HINT_SET = set(HINTS)
TAG_SET = set("article main section nav header footer aside form ul ol li table td th h1 h2 h3 h4 h5 h6 p div blockquote pre figure figcaption button label dl dt dd dialog details fieldset legend menu summary address".split())
FEATURES = ["bias", "first", "after_h1", *(f"tag:{t}" for t in sorted(TAG_SET)), *(f"in:{t}" for t in sorted(TAG_SET)), *(f"name:{h}" for h in HINTS), *(f"len:{i}" for i in range(7)), *(f"link:{i}" for i in range(4)), *(f"stop:{i}" for i in range(3)), "ends", "copyright", "in_content_in_aside"]
AT = {f: i for i, f in enumerate(FEATURES)}
STOP = re.compile(r"[.!?,;:]")


def features(blocks: list[Block]) -> list[list[int]]:
    out, h1 = [], False
    for i, b in enumerate(blocks):
        n = len(b.text)
        f = ["bias", f"len:{min(6, int(np.log2(n + 1)) // 2)}", f"link:{min(3, int(4 * b.linked / (sum(map(len, b.parts)) or 1)))}", f"stop:{min(2, len(STOP.findall(b.text)))}"]
        f += ["first"] * (i == 0) + ["after_h1"] * h1 + ["ends"] * (b.text[-1] in ".!?") + ["copyright"] * ("©" in b.text)
        f += [f"tag:{b.tag}"] * (b.tag in TAG_SET) + [f"in:{t}" for t in set(b.ancestors) & TAG_SET] + [f"name:{w}" for w in b.names & HINT_SET]
        out.append([AT[x] for x in f])
        h1 = h1 or b.tag == "h1"
    return out


class Crf:
    """Labels 0 (other) and 1 (article text)."""

    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.w, self.trans = w, trans  # features x 2, 2 x 2

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.w[r].sum(0) for r in rows])

    def decode(self, rows: list[list[int]]) -> list[int]:
        e = self.scores(rows).tolist()
        t = self.trans.tolist()
        best, back = e[0], []
        for s in e[1:]:
            a = [max((best[i] + t[i][j], i) for i in (0, 1)) for j in (0, 1)]
            back.append((a[0][1], a[1][1]))
            best = [a[0][0] + s[0], a[1][0] + s[1]]
        y = [int(best[1] > best[0])]
        for b in reversed(back):
            y.append(b[y[-1]])
        return y[::-1]


def marginals(e: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log of the sum over all labellings, probabilities of each label, of each pair of neighbouring labels)."""
    n = len(e)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    fwd[0] = e[0]
    for i in range(1, n):
        fwd[i] = e[i] + np.logaddexp(fwd[i - 1][0] + trans[0], fwd[i - 1][1] + trans[1])
    for i in range(n - 2, -1, -1):
        x = e[i + 1] + bwd[i + 1]
        bwd[i] = np.logaddexp(trans[:, 0] + x[0], trans[:, 1] + x[1])
    z = float(np.logaddexp(*fwd[-1]))
    return z, np.exp(fwd + bwd - z), np.exp(fwd[:-1, :, None] + trans + (e + bwd)[1:, None, :] - z)


def gradients(w: np.ndarray, trans: np.ndarray, rows: list[list[int]], y: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood of labels y, its gradients by block, n x 2, and by transition)."""
    e = np.array([w[r].sum(0) for r in rows])
    z, p, q = marginals(e, trans)
    at, n = np.array(y), np.arange(len(y))
    loss = z - e[n, at].sum() - trans[at[:-1], at[1:]].sum()
    p[n, at] -= 1
    gt = q.sum(0)
    np.subtract.at(gt, (at[:-1], at[1:]), 1)
    return float(loss), p, gt


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 30, rate: float = 0.5, ridge: float = 1e-3) -> Crf:
    """Adagrad on the negative log-likelihood, by forward and backward sums."""
    w, trans = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    gw2, gt2 = np.full_like(w, 1e-2), np.full_like(trans, 1e-2)
    total = sum(len(y) for _, y in pages)
    for _ in range(rounds):
        gw, gt = ridge * w, ridge * trans
        for rows, y in pages:
            _, by_block, by_step = gradients(w, trans, rows, y)
            for r, d in zip(rows, by_block, strict=True):
                gw[r] += d / total
            gt += by_step / total
        gw2 += gw**2
        gt2 += gt**2
        w -= rate * gw / np.sqrt(gw2)
        trans -= rate * gt / np.sqrt(gt2)
    return Crf(w, trans)


def labelled_pages(n: int = 200, seed: int = 5) -> Iterator[tuple[str, list[bool]]]:
    """Generated pages with, for each of their blocks, whether it is article text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "stu", "en", "la", "mo", "ter", "vi", "sha"]) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + rng.choice(".....!?")
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    for _ in range(n):
        out: list[str] = []
        marks: list[bool] = []

        def put(tag: str, text: str, good: bool, attrs: str = "", closed: bool = True) -> None:
            out.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if closed else ""))
            marks.append(good)

        def links(k: int) -> None:
            out.append("<ul>")
            for _ in range(k):
                put("li", f'<a href="/{word()}">{words(1, 4)}</a>', False)
            out.append("</ul>")

        def boiler(kind: str) -> None:
            name = rng.choice({"ad": ["ad", "ads", "advert", "sponsored", "promo", "banner-ad"], "side": ["sidebar", "widget", "related", "recommended"], "notice": ["cookie-notice", "consent", "alert", "notice", "popup", "modal"], "form": ["newsletter", "subscribe", "search", "login"], "comments": ["comments", "comment-list", "replies", "discussion"], "menu": ["menu", "navbar", "breadcrumb", "navigation"], "share": ["share", "social", "tags", "meta"]}[kind])
            attr = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"'])
            if kind == "form":
                out.append(f"<form{attr}>")
                put("label", words(1, 4), False)
                if rng.random() < 0.5:
                    put("p", prose(1, 2), False)
                put("button", words(1, 2), False)
                out.append("</form>")
            elif kind == "comments":
                tag = rng.choice(["section", "div", "ol"])
                out.append(f"<{tag}{attr}>")
                put("h3", words(1, 3), False)
                for _ in range(rng.randint(1, 5)):
                    put(rng.choice(["p", "div", "li"]), prose(1, 4), False, rng.choice(["", ' class="comment"']))
                out.append(f"</{tag}>")
            elif kind in ("side", "menu"):
                tag = {"side": rng.choice(["aside", "div", "aside"]), "menu": rng.choice(["nav", "div", "nav"])}[kind]
                out.append(f"<{tag}{attr if tag == 'div' or rng.random() < 0.5 else ''}>")
                if rng.random() < 0.4:
                    put("h3", words(1, 3), False)
                if kind == "side" and rng.random() < 0.5:
                    put("p", prose(1, 3), False)
                links(rng.randint(2, 7))
                out.append(f"</{tag}>")
            else:
                if rng.random() < 0.5:
                    put("div", prose(1, 3), False, attr)
                else:
                    out.append(f"<div{attr}>")
                    put("p", prose(1, 3), False)
                    out.append("</div>")

        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>")
        for kind in rng.sample(["menu", "ad", "notice", "form", "side", "share"], rng.randint(1, 4)):
            boiler(kind)
        if rng.random() < 0.4:
            out.append("<header>")
            put(rng.choice(["h1", "div", "p"]), words(1, 4), False)
            out.append("</header>")
        wrap = rng.choice(["article", "article", "main", 'div class="content"', 'div class="post"', 'div id="article-body"', 'section class="story"', 'div class="entry-content"', "div"])
        outer = rng.choice(["", "", "main", 'div class="page"'])
        out.append(f"<{outer}>" if outer else "")
        out.append(f"<{wrap}>")
        short = rng.random() < 0.35
        put("h1", words(1, 3).capitalize() + "." if short else words(2, 8), True)
        for _ in range(1 if short else rng.randint(1, 9)):
            x = rng.random()
            if short:
                put("p", rng.choice(["", "<b>"]) + words(1, 4).capitalize() + rng.choice([".", "", ".<br>"]), True, closed=rng.random() < 0.5)
            elif x < 0.7:
                put("p", rng.choice(["", "", "<b>"]) + prose() + rng.choice(["", "<br>"]), True, closed=rng.random() < 0.85)
            elif x < 0.78:
                put(rng.choice(["h2", "h3"]), words(1, 6), True)
            elif x < 0.84:
                put("blockquote", prose(1, 2), True)
            elif x < 0.89:
                out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    put("li", words(2, 12), True)
                out.append("</ul>")
            elif x < 0.94:
                put("p", f'{words(2, 9)} <a href="/{word()}">{words(1, 3)}</a> {words(1, 9)}.', True)
            else:
                boiler(rng.choice(["ad", "share", "form"]))
        if rng.random() < 0.2:
            boiler("comments")
        out.append(f"</{wrap.split()[0]}>")
        if rng.random() < 0.4:
            boiler("comments")
        out.append(f"</{outer.split()[0]}>" if outer else "")
        for kind in rng.sample(["side", "form", "ad", "share", "notice"], rng.randint(0, 2)):
            boiler(kind)
        if rng.random() < 0.9:
            put("footer", rng.choice(["&copy; ", "", "Copyright "]) + words(1, 4) + " &middot; " + prose(1, 2), False)
        out.append("</body></html>")
        yield "".join(out), marks


def default_model() -> Crf:
    return trained(labelled_pages())


def trained(pages) -> Crf:
    """pages: (html, one mark for each of its blocks)."""
    rows = []
    for page, marks in pages:
        found = blocks_of(page)
        if len(found) != len(marks):
            raise ValueError(f"{len(marks)} marks for {len(found)} blocks")
        if found:
            rows.append((features(found), [int(m) for m in marks]))
    return train(rows)


def main_text(model: Crf, page: str) -> str:
    found = blocks_of(page)
    return "\n".join(b.text for b, y in zip(found, model.decode(features(found)), strict=True) if y) if found else ""


def extract(df: DataFrame, model: Crf, html: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    w, trans = model.w, model.trans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(w, trans)
        for batch in batches:
            for part in steps(batch, STEP, 2):
                got = [main_text(own, x or "") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    base = df.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_h"))
    return base.mapInArrow(run, base.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), default_model())
