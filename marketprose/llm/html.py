"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is a run of text that no block-level tag interrupts. Its features come from the tags, class names, ids and
roles of its ancestors and from the text itself (length, share of links, marks), never from particular words. The
field is trained on labelled pages by maximum likelihood and decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketprose.llm.common import keyed

# Fixed values of HTML: tags by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var object math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded "
    "mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
SILENT = set(
    "script style noscript template head title svg annotation annotation-xml iframe canvas audio video select option button "
    "textarea".split()
)
WALLS = set("script style noscript template title iframe select textarea".split())  # end tags of ancestors do not end them
HEAD = set("base basefont bgsound link meta title noscript noframes style script template".split())  # any other tag ends a head
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"},
}
SCOPES = set("ul ol dl table article section div aside nav main body td th blockquote form header footer object".split())

#: Groups of names that pages use for their parts.
NAMES = {
    "menu": "nav menu menubar navbar navigation breadcrumb breadcrumbs toc tabs pager pagination toolbar skip",
    "top": "header masthead banner topbar hero logo branding",
    "bottom": "footer foot colophon contentinfo copyright legal bottom",
    "side": "sidebar side aside rail widget widgets complementary column",
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner-ad",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription signup paywall",
    "comment": "comment comments commentlist respond reply replies disqus discussion reviews review",
    "share": "share sharing social follow",
    "related": "related recommended recommendation recommendations more popular trending also teaser teasers links",
    "form": "form search login contact register",
    "meta": "meta byline date author tags tag categories category info",
    "content": "content article post entry story main maincontent body text page-content articlebody bodytext document prose",
}
_GROUP = {name: group for group, names in NAMES.items() for name in names.split()}
_TAGS = set("article main section aside nav header footer form ul ol dl table figure blockquote pre details dialog address".split())


#: Parts of a name that tell a state of the page, not what an element is.
STATES = set("has no not with without is show hide on off open closed fixed enabled disabled active".split())
NEAR = 2  # elements down to which a name speaks of the blocks inside


def name_group(name: str) -> str | None:
    """The group of a class name, id or role: by the whole name, or by its last part where no part tells a state."""
    name = name.rstrip("0123456789").strip("-_")
    if name in _GROUP:
        return _GROUP[name]
    parts = [p for p in re.split(r"[-_]+", name) if p]
    return _GROUP.get(parts[-1]) if parts and STATES.isdisjoint(parts) else None


@dataclass
class Node:
    tag: str
    marks: dict[str, int]  # groups of names above, and how many elements above
    under: frozenset[str]  # tags above
    main: bool
    silent: bool = False
    apart: bool = False  # a formula in its own block


@dataclass
class Block:
    """A leaf block: its text, features, and the label that a training page gives it."""

    text: str
    features: list[str]
    main: bool


@dataclass
class _Run:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


class BlockParser(HTMLParser):
    """Cuts a page into leaf blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[Node] = [Node("", {}, frozenset(), False)]
        self.blocks: list[tuple[str, Node, list[str], int]] = []
        self.run = _Run()
        self.links = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.run.parts).split())
        if text:
            tags = [n.tag for n in self.path if n.tag and n.tag not in INLINE]
            self.blocks.append((text, self.path[-1], tags, self.run.linked))
        self.run = _Run()

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "html" or tag == "head" and any(n.tag not in ("", "html") for n in self.path):
            if tag == "html" and len(self.path) == 1:
                self.path.append(Node(tag, {}, frozenset(), "data-main" in dict(attrs)))
            return
        if self.path[-1].tag == "head" and tag not in HEAD or tag == "body":
            self._end_head()
        if tag in VOID:
            if tag == "br" and not self.path[-1].silent:
                self.run.parts.append(" ")
            elif tag == "hr" and not self.path[-1].silent:
                self._flush()
            return
        if self.path[-1].silent or tag in SILENT:
            if tag in ("option", "optgroup"):
                self._close(tag)
            up = self.path[-1]
            self.path.append(Node(tag, up.marks, up.under, up.main, True))
            return
        found = dict(attrs)
        if tag not in INLINE:
            self._flush()
            self._close(tag)
        elif tag == "math" and found.get("display") == "block":
            self._flush()
        up = self.path[-1]
        names = " ".join(str(found.get(k) or "") for k in ("class", "id", "role")).lower().split() if tag != "body" else []
        own = {g for g in map(name_group, names) if g}
        if "content" in own and len(own) > 1:  # an article that is said to have something
            own = {"content"} if names and name_group(names[0]) == "content" else own - {"content"}
        step = 0 if tag in INLINE else NEAR + 1 if tag in ("article", "main") and own <= {"content"} else 1
        marks = {g: far + step for g, far in up.marks.items()} | dict.fromkeys(own, 0)
        if tag == "a":
            self.links += 1
        apart = tag == "math" and found.get("display") == "block"
        main = (up.main or "data-main" in found) and "data-off" not in found
        self.path.append(Node(tag, marks, up.under | {tag} if tag in _TAGS else up.under, main, apart=apart))

    def _close(self, tag: str) -> None:
        """Cut at an open p, li, td, option ... that the start of this tag ends."""
        for at in range(len(self.path) - 1, 0, -1):
            if self.path[at].tag in CLOSES.get(tag, {"p"}):
                self._cut(at)
                break
            if self.path[at].tag in SCOPES:
                break

    def _end_head(self) -> None:
        for at in range(1, len(self.path)):
            if self.path[at].tag == "head":
                self._cut(at)
                break

    def _cut(self, at: int) -> None:
        self.links -= sum(n.tag == "a" and not n.silent for n in self.path[at:])
        del self.path[at:]

    def handle_endtag(self, tag: str) -> None:
        if not self.path[-1].silent and tag not in INLINE:
            self._flush()
        for at in range(len(self.path) - 1, 0, -1):
            node = self.path[at]
            if node.tag == tag:
                if self.path[-1].silent and not node.silent and tag not in INLINE or node.apart:
                    self._flush()
                self._cut(at)
                return
            if node.tag in WALLS and tag != "head":
                return

    def handle_data(self, data: str) -> None:
        if self.path[-1].tag == "head" and data.strip():
            self._end_head()
        if not self.path[-1].silent:
            self.run.parts.append(data)
            if self.links:
                self.run.linked += len("".join(data.split()))

    def finish(self) -> list[Block]:
        self.close()
        self._flush()
        out, total = [], len(self.blocks)
        last_tags: list[str] = []
        for i, (text, node, tags, linked) in enumerate(self.blocks):
            out.append(Block(text, block_features(text, node, tags, linked, i, total, tags == last_tags), node.main))
            last_tags = tags
        return out


def block_features(text: str, node: Node, tags: list[str], linked: int, i: int, total: int, same: bool) -> list[str]:
    words = text.split()
    letters = len("".join(words))
    length = next(k for k, most in enumerate((2, 5, 10, 20, 40, 10**9)) if len(words) <= most)
    share = linked / max(1, letters)
    links = 0 if not linked else 1 if share < 0.3 else 2 if share < 0.8 else 3
    ends = text[-1] in ".!?…。！？:;\"'»”)"
    found = sorted(f"{'in' if far <= NEAR else 'far'}:{group}" for group, far in node.marks.items())
    inside = "content" in node.marks or "article" in node.under or "main" in node.under
    tops = [f"under:{t}" for t in sorted(node.under)]
    tag = tags[-1] if tags else "none"
    out = ["all", f"tag:{tag}", f"long:{length}", f"links:{links}", f"long:{length}+links:{links}", f"ends:{ends}", f"same:{same}"]
    out += found + tops
    out += [f"{m}+inside:{inside}" for m in found]
    out += [f"{m}+long:{length}" for m in found if m.startswith("far:")]
    out += [f"inside:{inside}", f"inside:{inside}+long:{length}", f"inside:{inside}+links:{links}", f"inside:{inside}+tag:{tag}"]
    if total == 1:
        out.append("only")
    elif i == 0:
        out.append("first")
    if total > 1 and i == total - 1:
        out.append("last")
    if re.search(r"[©®]|\(c\)", text):
        out.append("rights")
    if re.search(r"[|·•›»→]", text):
        out.append(f"bars+inside:{inside}")
    if sum(c.isdigit() for c in text) * 3 > letters:
        out.append("digits")
    if tag in ("h1", "h2", "h3", "h4"):
        out.append(f"head+inside:{inside}")
    return out


def blocks_of(html: str) -> list[Block]:
    parser = BlockParser()
    parser.feed(html)
    return parser.finish()


@dataclass
class Field:
    """Weights of features per label and of label pairs; labels are 0 (other) and 1 (main text)."""

    names: dict[str, int]
    weight: np.ndarray  # features x 2
    move: np.ndarray  # from x to
    start: np.ndarray

    def emissions(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for i, block in enumerate(blocks):
            at = [self.names[f] for f in block.features if f in self.names]
            out[i] = self.weight[at].sum(0)
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best labels of all blocks together (Viterbi)."""
        if not blocks:
            return []
        emit = self.emissions(blocks)
        score, back = self.start + emit[0], []
        for e in emit[1:]:
            ways = score[:, None] + self.move
            back.append(ways.argmax(0))
            score = ways.max(0) + e
        labels = [int(score.argmax())]
        for came in reversed(back):
            labels.append(int(came[labels[-1]]))
        return labels[::-1]

    def text(self, html: str) -> str:
        blocks = blocks_of(html)
        return "\n".join(b.text for b, label in zip(blocks, self.decode(blocks), strict=True) if label)


def train(pages: Iterable[str], steps: int = 150, rate: float = 0.5, decay: float = 2e-4) -> Field:
    """Maximum likelihood on labelled pages: text inside an element with the attribute ``data-main`` is main text.

    Gradients from forward and backward sums over whole pages; steps scaled by the past gradients of each weight.
    """
    examples = [b for b in map(blocks_of, pages) if b]
    names = {f: k for k, f in enumerate(sorted({f for page in examples for b in page for f in b.features}))}
    longest = max((len(p) for p in examples), default=1)
    real = np.zeros((len(examples), longest), bool)
    gold = np.zeros((len(examples), longest), np.int64)
    rows, columns = [], []
    for p, page in enumerate(examples):
        for i, block in enumerate(page):
            real[p, i], gold[p, i] = True, block.main
            rows += [p * longest + i] * len(block.features)
            columns += [names[f] for f in block.features]
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    weight, move, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    params = [weight, move, start]
    past = [np.full_like(p, 1e-8) for p in params]
    lengths = real.sum(1)
    pages_at, last_at = np.arange(len(examples)), lengths - 1
    eye = np.eye(2)
    for _ in range(steps if len(examples) else 0):
        emit = np.stack([np.bincount(rows, weight[columns, k], real.size) for k in (0, 1)], 1).reshape(*real.shape, 2)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = start + emit[:, 0]
        for i in range(1, longest):
            forward[:, i] = np.logaddexp.reduce(forward[:, i - 1, :, None] + move, axis=1) + emit[:, i]
        for i in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(move + (emit[:, i + 1] + backward[:, i + 1])[:, None, :], axis=2)
            backward[:, i] = np.where((i < last_at)[:, None], step, 0.0)
        whole = np.logaddexp.reduce(forward[pages_at, last_at], axis=1)
        one = np.exp(forward + backward - whole[:, None, None]) * real[..., None]
        wrong = (eye[gold] * real[..., None] - one).reshape(-1, 2)
        gradient = [np.stack([np.bincount(columns, wrong[rows, k], len(names)) for k in (0, 1)], 1)]
        pair = real[:, 1:, None, None]
        both = forward[:, :-1, :, None] + move + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        seen = eye[gold[:, :-1]][..., :, None] * eye[gold[:, 1:]][..., None, :]
        gradient.append(((seen - np.exp(np.minimum(both, 0))) * pair).sum((0, 1)))
        gradient.append((eye[gold[:, 0]] - one[:, 0]).sum(0))
        for value, slope, sums in zip(params, gradient, past, strict=True):
            slope = slope - decay * len(examples) * value
            sums += slope**2
            value += rate * slope / np.sqrt(sums)
    return Field(names, weight, move, start)


class PageWriter:
    """Labelled pages in many layouts, with made-up words. The labels are ``data-main`` attributes.

    Some class names say what a part is, some say nothing, so that no one sign decides.
    """

    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.sure = False  # names tell what a part is; inside an article nothing else would

    def words(self, low: int, high: int) -> str:
        r = self.random
        out = ["".join(r.choice("aeiourstnlmdp") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        return escape(" ".join(out).capitalize())

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high) + self.random.choice([".", ".", ".", "!", "?", "..."])

    def named(self, *names: str) -> str:
        r = self.random
        if r.random() < 0.15 and not self.sure:
            return f' class="c{r.randint(100, 999)}"'
        name = r.choice(names)
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="x1 {name}"', f' class="{name} {name}-inner"'])

    def part(self, tags: str, names: str, body: str) -> str:
        """An element by tag or by a named div."""
        r = self.random
        plain = tags.split()
        if plain and r.random() < 0.6:
            tag = r.choice(plain)
            mark = self.named(*names.split()) if r.random() < 0.4 else ""
            return f"<{tag}{mark}>{body}</{tag}>"
        return f"<div{self.named(*names.split())}>{body}</div>"

    def links(self, low: int, high: int) -> str:
        r = self.random
        items = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(r.randint(low, high))]
        return r.choice([
            lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>",
            lambda: "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>",
            lambda: " | ".join(items),
            lambda: "".join(f"<div>{x}</div>" for x in items),
            lambda: "<p>" + " &middot; ".join(items) + "</p>",
        ])()

    def paragraph(self) -> str:
        r = self.random
        text = " ".join(self.sentence(3, 25) for _ in range(r.choice([1, 1, 2, 4, 8])))
        if r.random() < 0.2:
            text += f' <a href="/x">{self.words(1, 3)}</a> {self.sentence(3, 12)}'
        if r.random() < 0.2:
            text = f"<b>{self.words(1, 4)}</b> {text}"
        if r.random() < 0.1:
            text = text.replace(" ", "<br>", 1)
        if r.random() < 0.08:
            text = text.replace(" ", r.choice([" | ", " · ", " • "])) if "<" not in text else text
        if r.random() < 0.05:
            text = f'<a href="/y">{self.sentence(4, 20)}</a>'
        return text

    def article(self) -> str:
        r = self.random
        out = [f"<h1>{self.words(1, 10)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.68:
                out.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>"]).format(self.paragraph()))
            elif kind < 0.78:
                out.append(f"<{(h := r.choice(['h2', 'h3']))}>{self.words(1, 8)}</{h}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.sentence(1, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote>{self.sentence(5, 30)}</blockquote>")
            elif kind < 0.95:
                cells = "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4)))
                out.append(f"<table>{cells}</table>")
            else:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
        return "".join(out)

    def noise(self, kind: str) -> str:
        r = self.random
        if kind == "advert":
            body = r.choice([self.sentence(3, 15), f'<a href="/buy">{self.words(2, 6)}</a>', f"<p>{self.sentence(3, 20)}</p>"])
            return self.part("", "ad ads advert sponsored promo banner-ad ad-slot", body)
        if kind == "notice":
            return self.part("dialog", "cookie cookie-banner consent notice newsletter subscribe popup alert", f"<p>{self.sentence(6, 30)}</p>")
        if kind == "share":
            return self.part("", "share social share-buttons follow", self.links(2, 5))
        if kind == "related":
            return self.part("aside section", "related recommended more-links popular also-read", f"<h3>{self.words(1, 3)}</h3>" + self.links(2, 8))
        if kind == "comments":
            one = "".join(
                f'<{(t := r.choice(["div", "li", "article"]))} class="comment"><b>{self.words(1, 2)}</b><p>{self.paragraph()}</p></{t}>'
                for _ in range(r.randint(1, 6))
            )
            return self.part("", "comments comment-list commentlist disqus comments-area reader-comments", f"<h3>{self.words(1, 3)}</h3>{one}").replace(
                "<div class=\"c", "<div id=\"comments\" class=\"c", 1
            )
        if kind == "form":
            fields = "".join(f"<label>{self.words(1, 3)}</label><input name=a>" for _ in range(r.randint(1, 4)))
            return f"<form{self.named('search', 'login', 'contact')}><p>{self.words(2, 8)}</p>{fields}<button>{self.words(1, 2)}</button></form>"
        if kind == "side":
            body = r.choice([self.links(3, 9), f"<h3>{self.words(1, 4)}</h3><p>{self.sentence(5, 30)}</p>", f"<p>{self.sentence(8, 40)}</p>"])
            return self.part("aside aside", "sidebar side widget rail", body)
        if kind == "menu":
            return self.part("nav nav", "nav menu navbar navigation breadcrumb", self.links(3, 9))
        if kind == "top":
            return self.part("header header", "header masthead banner topbar", r.choice([self.words(1, 4), f"<h2>{self.words(1, 5)}</h2><p>{self.words(2, 8)}</p>", self.links(2, 5)]))
        body = r.choice(["&copy; " + self.words(1, 4) + " &middot; " + self.sentence(3, 12), self.links(3, 8) + f"<p>&copy; {self.words(2, 6)}</p>", f"<p>{self.sentence(5, 25)}</p>"])
        return self.part("footer footer", "footer foot site-footer copyright", body)

    def page(self) -> str:
        r = self.random
        frame = r.choice(["<article data-main>{}</article>"] * 3 + ["<main data-main>{}</main>", "<div{} data-main>{{}}</div>".format(
            self.named("content", "post", "entry-content", "article-body", "story", "main")), "<section data-main>{}</section>",
            "<table><tr><td data-main>{}</td></tr></table>", "<div data-main>{}</div>"])
        pieces = re.split(r"(?=<p>|<h2>|<h3>)", self.article())
        if r.random() < 0.25:  # the article alone in an element of another name
            inner = self.misleading()
            frame = r.choice([f"<div class='{inner}'>{frame}</div>", frame.replace("<article", f"<article class='post {inner}-on'")])
        self.sure = True
        within = [self.noise(r.choice(["advert", "share", "related", "notice"])) for _ in range(r.choice([0, 0, 0, 1, 2]))]
        self.sure = False
        opening, closing = frame.split("{}")
        plain_close = closing
        text = opening + "".join(pieces) + closing
        if within and r.random() < 0.5:  # a part that interrupts the article is not main text
            quote = f"<aside{self.named('pullquote', 'side')} data-off>{self.sentence(4, 15)}</aside>"
            for part in [re.sub(r"^<(\w+)", r"<\1 data-off", p) for p in [*within, *[quote] * (r.random() < 0.5)]]:
                pieces.insert(r.randint(0, len(pieces)), part)
            text = opening + "".join(pieces) + closing
        elif within and len(pieces) > 2:
            at = r.randint(1, len(pieces) - 1)
            bare = opening.replace(" data-main", "")
            tag = f"<div data-main>{''.join(pieces[:at])}</div>{''.join(within)}<div data-main>{''.join(pieces[at:])}</div>"
            text = bare + tag + plain_close
        if r.random() < 0.25 and "<article" in text:
            text = f"<main>{text}{self.noise('related') if r.random() < 0.5 else ''}</main>"
        quiet = r.random() < 0.2  # nothing comes before the article
        before = [] if quiet else [k for k in ("notice", "top", "menu", "advert", "form", "side") if r.random() < 0.45]
        after = [k for k in ("share", "related", "comments", "form", "side", "advert", "notice", "bottom") if r.random() < 0.45]
        body = "".join(map(self.noise, before)) + text + "".join(map(self.noise, after))
        if r.random() < 0.3:
            body = f"<div class='{r.choice(['wrapper', 'page', 'container', 'c12'])}'>{body}</div>"
        if r.random() < 0.35:  # names that speak of the whole page, around all of it
            body = f"<div class='{self.misleading()}'>{body}</div>"
        mark = f" class='{self.misleading()}'" if r.random() < 0.3 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body{mark}>{body}</body></html>"

    def misleading(self) -> str:
        """A name of a part that the element is not."""
        r = self.random
        name = r.choice([n for names in NAMES.values() for n in names.split()])
        return r.choice(["{}", "{}", "right-{}", "has-{}", "{}-open", "{}-fixed", "{}-results", "page {}", "with-{}", "{}-layout"]).format(name)


def labelled_pages(count: int = 600, seed: int = 7) -> list[str]:
    writer = PageWriter(seed)
    bare = [f"<html><body data-main>{writer.article()}</body></html>" for _ in range(count // 20)]
    tags = ["div", "p", "span", "pre"]
    texts = [writer.paragraph() if k % 2 else writer.words(1, 6) for k in range(count // 20)]
    single = [f"<{tags[k % 4]} data-main>{text}</{tags[k % 4]}>" for k, text in enumerate(texts)]
    return [writer.page() for _ in range(count - len(bare) - len(single))] + bare + single


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Field, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    The text is the blocks of main text, each with its white space turned into single spaces and trimmed, joined by
    line feeds in page order; empty if there are none. Null and empty pages give an empty text. Character references are
    decoded. Rows are independent; nothing is cut off. The model is a few hundred numbers.
    """
    rows = pages.select(F.col(key).cast("string").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [model.text(h) for h in batch.pop("html")]
            yield batch.assign(text=text, n_chars=[len(t) for t in text])

    return keyed(rows.mapInPandas(run, f"page_id string, url {kinds[url]}, text string, n_chars bigint"), "page_id", kinds[key])
