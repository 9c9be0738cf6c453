"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the text runs between block-level tags. Features of a block are its
ancestors' tags and the words of their class and id, and properties of its text. A linear-chain CRF with
the labels *other* and *main* is trained on labelled pages and decoded by Viterbi; the main blocks in
page order are the text.

The labelled pages come from ``labelled_pages``, a seeded rule that composes page layouts (menus,
headers, sidebars, notices, adverts, forms, comments, footers around an article) from invented prose,
so every block's label is known. No table is read for training.

Defined results: a null or empty page and a page without main blocks give an empty text; script, style
and comments never give blocks; unclosed and stray tags are tolerated; elements nested deeper than ``DEPTH`` count as siblings; pages are read whole, in time in proportion to their length; equal
pages give equal texts; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Labelled pages, passes over them, and hashed features of the CRF.
TRAIN_PAGES, EPOCHS, HASHED = 400, 4, 1 << 14
OTHER, MAIN = 0, 1

#: Elements nested deeper become siblings, as in browsers.
DEPTH = 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw up to their own end tag, or else to the page's end.
RAW = frozenset("script style iframe textarea".split())
#: Elements whose content is no text of the page. They end at their own end tag or at that of an element around them; one
#: that has no end tag of its own holds nothing.
HIDDEN = frozenset("noscript template svg select canvas object".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: An open <p> ends where one of these starts.
ENDS_P = BLOCK - {"option", "button", "legend"}
#: A new element of the key's kind closes an open one of these, up to the given scope.
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: A tag with its attributes, in which a quoted value may hold ">". A quote opens a value only right after "="; possessive, so that
#: a failed match is not tried again in another way.
_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>", re.I)
#: The same without regard to quotes, for pages in which one is not closed.
_PLAIN_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)([^>]*+)>", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_HINT = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SUB = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"\d")
_WS = re.compile(r"[\s\x00]+")
_SENTENCE = re.compile(r"[.!?…。]")


def tags(page: str):
    """The tags and other markup of a page: (start, end, tag or None, is it an end tag, attributes), in time in proportion to the page.

    Comments, declarations and whole raw elements have no tag. An unclosed quote makes the rest of the page be read without
    regard to quotes; a "<" that opens nothing is text, as is all after the last ">".
    """
    at, tag, last = 0, _TAG, page.rfind(">")
    absent: set[str] = set()  # raw elements whose end tag does not occur any more
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
            yield at, end, None, False, ""
            at = end
            continue
        if at > last:
            return
        m = tag.match(page, at)
        if m is None and tag is _TAG and page[at + 1 : at + 2].isalpha():
            m = _PLAIN_TAG.match(page, at)
            if m:
                tag = _PLAIN_TAG
        if m is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at) + 1
                yield at, end, None, False, ""
                at = end
            else:
                at += 1
            continue
        name, end = m[2].lower(), m.end()
        if name in RAW and not m[1]:
            # a self-closed one of these is raw text up to its end tag as in browsers, but does not take the page's rest
            stop = None if name in absent else _RAW_END[name].search(page, end)
            if stop is None:
                absent.add(name)
            if stop or not m[3].endswith("/"):
                end = page.find(">", stop.end()) + 1 if stop else 0
                end = end or len(page)
            yield at, end, None, False, ""
        else:
            yield at, end, name, bool(m[1]), m[3]
        at = end


def closed_hidden(found: list[tuple]) -> set[int]:
    """Where those of the ``HIDDEN`` elements start that have an end tag of their own."""
    out, open_ = set(), {name: [] for name in HIDDEN}
    for begin, _, tag, ends, attrs in found:
        if tag in HIDDEN:
            if not ends:
                if not (tag == "svg" and attrs.endswith("/")):
                    open_[tag].append(begin)
            elif open_[tag]:
                out.add(open_[tag].pop())
    return out


class Block:
    __slots__ = ("path", "text", "links", "tags")

    def __init__(self, path: tuple, text: str, links: int, tags: int):
        self.path, self.text, self.links, self.tags = path, text, links, tags


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order. ``path`` has (tag, hints) of the open elements."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links, linked, marks, at = 0, 0, 0, 0
    path: tuple = ()

    def flush():
        nonlocal links, marks
        if parts:
            text = _WS.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(path, text, links, marks))
            parts.clear()
        links = marks = 0

    def close(names, scope=frozenset()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    found = list(tags(page))
    hides, hidden, inner = closed_hidden(found), None, {}
    for begin, end, tag, ends, attrs in found:
        if hidden:
            at = end
            if tag is None:
                continue
            if not ends:
                inner[tag] = inner.get(tag, 0) + 1
                continue
            if inner.get(tag):
                inner[tag] -= 1
                continue
            if tag == hidden:
                hidden = None
                continue
            if not any(s[0] == tag for s in stack):
                continue
            hidden, at = None, begin  # the end of an element around it
        if begin > at:
            if not parts:
                path = tuple(stack)
            piece = page[at:begin]
            parts.append(piece)
            if linked:
                links += len(piece)
        at = end
        if tag is None:
            continue
        if tag in HIDDEN:
            if begin in hides:
                hidden, inner = tag, {}
            continue
        marks += 1
        is_block = tag in BLOCK
        if is_block:
            flush()
        elif tag == "br":
            parts.append("\n")
            continue
        if ends:
            if tag == "a":
                linked = max(0, linked - 1)
            if any(s[0] == tag for s in stack):
                close({tag})
            continue
        if tag in ENDS_P:
            close({"p"}, {"button", "table", "object"})
        if tag in SIBLING:
            close(*SIBLING[tag])
        if tag in VOID or attrs.endswith("/") and not is_block:
            continue
        if tag == "a":
            linked += 1
        if is_block or tag in ("span", "a", "ins", "label"):
            hint = " ".join(h for g in _HINT.findall(attrs) for h in g if h).lower() if attrs else ""
            if is_block or hint:
                if len(stack) >= DEPTH:
                    stack.pop()
                stack.append((tag, hint))
        else:
            continue
    if at < len(page):
        if not parts:
            path = tuple(stack)
        parts.append(page[at:])
    flush()
    return out


@lru_cache(maxsize=100_000)
def _id(name: str) -> int:
    return crc32(name.encode()) % HASHED


@lru_cache(maxsize=50_000)
def path_features(path: tuple) -> tuple[int, ...]:
    found = {f"leaf={path[-1][0]}" if path else "leaf="}
    for tag, hint in path:
        found.add(f"tag={tag}")
        words = _SUB.findall(hint)
        found.update(f"hint={w}" for w in words)
        found.update(f"start={w[:5]}" for w in words if len(w) > 5)
    near = [t for t, _ in path[-3:]]
    found.add("near=" + "/".join(near))
    if path and (hint := path[-1][1]):
        found.update(f"own={w}" for w in _SUB.findall(hint))
    return tuple(sorted({_id(f) for f in found}))


def features(b: Block, place: float) -> list[int]:
    """Indices of the active features of a block; ``place`` is its relative position."""
    text, n = b.text, len(b.text)
    words = text.count(" ") + 1
    dots = len(_SENTENCE.findall(text))
    names = [
        "bias",
        f"words={min(int(math.log2(words) * 2), 16)}",
        f"dots={min(dots, 6)}",
        f"ends={text[-1] if not text[-1].isalnum() else 'w'}",
        f"links={min(4, 5 * b.links // max(n, 1))}",
        f"tags={min(b.tags, 5)}",
        f"place={int(place * 5)}",
        f"upper={text[0].isupper()}",
        f"digits={min(4, 10 * len(_DIGIT.findall(text)) // n)}",
    ]
    low = text.lower()
    names += [f"sign={s}" for s in ("©", "all rights", "cookie", "subscribe", "newsletter", "advert", "sponsored", "login", "log in", "sign", "reply", "comment", "share", "menu", "search", "copyright", "privacy", "|", "»", "→", "·") if s in low]
    leaf = b.path[-1][0] if b.path else ""
    names.append(f"leaf={leaf},words={min(int(math.log2(words)), 6)}")
    return [_id(x) for x in names]


class Crf:
    """Weights of a two-label linear chain: emissions by feature, transitions, start."""

    def __init__(self):
        self.emit, self.move, self.start = np.zeros((HASHED, 2)), np.zeros((2, 2)), np.zeros(2)

    def emissions(self, page: list[Block]) -> tuple[np.ndarray, list[list[int]]]:
        n = len(page)
        found = [[*path_features(b.path), *features(b, i / n)] for i, b in enumerate(page)]
        flat = np.fromiter((i for f in found for i in f), np.int64)
        at = np.cumsum([0, *map(len, found)])[:-1]
        return np.add.reduceat(self.emit[flat], at, axis=0), found

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest label sequence (Viterbi)."""
        if not page:
            return []
        e = self.emissions(page)[0].tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + e[0][0], self.start[1] + e[0][1]
        back = []
        for x, y in e[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 1e-4) -> Crf:
        """Stochastic ascent of the conditional log-likelihood with AdaGrad steps."""
        sq = [np.full_like(w, 1e-2) for w in (self.emit, self.move, self.start)]
        order = random.Random(1)
        for _ in range(epochs):
            for page, gold in order.sample(pages, len(pages)):
                e, found = self.emissions(page)
                n = len(page)
                fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
                fwd[0] = self.start + e[0]
                for i in range(1, n):
                    fwd[i] = e[i] + np.logaddexp(fwd[i - 1, 0] + self.move[0], fwd[i - 1, 1] + self.move[1])
                for i in range(n - 2, -1, -1):
                    t = self.move + e[i + 1] + bwd[i + 1]
                    bwd[i] = np.logaddexp(t[:, 0], t[:, 1])
                z = np.logaddexp(*fwd[-1])
                g = -np.exp(fwd + bwd - z)
                gm = np.zeros((2, 2))
                if n > 1:
                    gm = -np.exp(fwd[:-1, :, None] + self.move + (e[1:] + bwd[1:])[:, None, :] - z).sum(0)
                g[np.arange(n), gold] += 1
                for a, b in zip(gold, gold[1:]):
                    gm[a, b] += 1
                flat = np.fromiter((i for f in found for i in f), np.int64)
                idx, back = np.unique(flat, return_inverse=True)
                ge = np.zeros((len(idx), 2))
                np.add.at(ge, back, np.repeat(g, [len(f) for f in found], axis=0))
                ge -= ridge * self.emit[idx]
                sq[0][idx] += ge**2
                self.emit[idx] += rate * ge / np.sqrt(sq[0][idx])
                for w, s, d in ((self.move, sq[1], gm), (self.start, sq[2], g[0])):
                    s += d**2
                    w += rate * d / np.sqrt(s)
        return self


def labelled_pages(count: int, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Seeded pages with the texts of their main blocks, in order; other blocks' texts are distinct from them."""
    rnd = random.Random(seed)
    syllables = "an the er on re in ed nd ou ea ti or st ar te ng al it as is ha et se ve me de hi ri ro co io ic ne li ra ce ma si om ur le la ch sch ung keit ción mente eau oux ü ö é".split()
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))

    def sentence(lo=4, hi=18):
        s = " ".join(word() for _ in range(rnd.randint(lo, hi)))
        return s[0].upper() + s[1:] + rnd.choice(".....!?")

    prose = lambda lo=1, hi=6: " ".join(sentence() for _ in range(rnd.randint(lo, hi)))
    short = lambda hi=4: " ".join(word() for _ in range(rnd.randint(1, hi))).capitalize()
    pick = rnd.choice
    quote = lambda s: s.replace("&", "&amp;")

    def deco(s: str) -> str:
        if rnd.random() < 0.3:
            w = s.split(" ")
            i = rnd.randrange(len(w))
            w[i] = pick(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<strong>{}</strong>", "<span>{}</span>", "{}<br>"]).format(w[i])
            s = " ".join(w)
        return s

    def main_blocks() -> str:
        out = []
        if rnd.random() < 0.85:
            h = pick(["h1", "h1", "h2"])
            t = pick([short(9), sentence()])
            out.append(pick(["<{h}>{t}</{h}>", "<header><{h}>{t}</{h}></header>", "<{h} class=title>{t}</{h}>"]).format(h=h, t=deco(t)))
        for _ in range(rnd.randint(1, 9)):
            kind = rnd.random()
            end = pick(["</p>", "</p>", "</p>", ""])
            if kind < 0.7:
                t = prose()
                lead = pick(["", "", "", "<b>", ""])
                out.append(f"<p>{lead}{deco(t)}{end}")
            elif kind < 0.8:
                items = [pick([short(8), sentence()]) for _ in range(rnd.randint(2, 5))]
                out.append(f"<{'ul' if rnd.random() < 0.5 else 'ol'}>" + "".join(f"<li>{deco(i)}</li>" for i in items) + "</ul>")
            elif kind < 0.87:
                out.append(f"<h{rnd.randint(2, 4)}>{short(6)}</h3>")
            elif kind < 0.93:
                out.append(f"<blockquote>{pick(['', '<p>'])}{prose(1, 3)}</blockquote>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{short()}</td><td>{sentence()}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f'<figure><img src="x.png"><figcaption>{sentence()}</figcaption></figure>')
        return "".join(out)

    def menu():
        items = "".join(f'<li><a href="/{word()}">{pick([short(2), word() + pick([".", ",", ""])])}</a></li>' for _ in range(rnd.randint(3, 9)))
        return pick(["<nav><ul>{}</ul></nav>", '<ul class="menu">{}</ul>', '<div class="navbar"><ul>{}</ul></div>', '<div id="navigation"><ol>{}</ol></div>', '<nav class="breadcrumb"><ul>{}</ul></nav>', '<div role="navigation" class="topnav"><ul>{}</ul></div>']).format(items)

    wrap = lambda names, body: (lambda n: f'<{n[0]} {pick(["class", "id"])}="{n[1]}">{body}</{n[0]}>' if n[1] else f"<{n[0]}>{body}</{n[0]}>")(pick(names))
    para = lambda: pick([prose(1, 3), f"<p>{prose(1, 4)}</p>", f"<h3>{short()}</h3><p>{prose(1, 3)}</p>", sentence()])
    names = lambda tag, s: [(tag, n) for n in s.split()]

    def advert():
        return wrap(names("div", "ad ads advert advertisement sponsor sponsored promo promotion banner ad-slot adbox advertorial") + names("aside", "ad promo sponsor") + [("ins", "ad")], para())

    def side():
        links = "".join(f'<li><a href="#">{short(6)}</a></li>' for _ in range(rnd.randint(2, 6)))
        return wrap([("aside", ""), ("aside", "sidebar"), *names("div", "sidebar side-bar widget related recommended trending popular rail secondary")], pick([f"<h4>{short()}</h4><ul>{links}</ul>", para(), f"<ul>{links}</ul>{para()}"]))

    def notice():
        return wrap(names("div", "cookie cookie-banner consent notice alert gdpr popup modal newsletter subscribe signup paywall message toast disclaimer") + names("section", "notice cookies newsletter") + [("dialog", "")], pick([para(), para() + f"<button>{short(2)}</button>"]))

    def form():
        return f'<form action="/s">{pick(["", f"<p>{sentence()}</p>", f"<label>{short()}</label>"])}<input name=q><button>{short(2)}</button>{pick(["", f"<select><option>{word()}</option></select>"])}</form>'

    def comments():
        one = lambda: pick([f'<div class="comment"><p class="author">{short(2)}</p><p>{prose(1, 4)}</p></div>', f"<li class=comment><b>{short(2)}</b> <p>{prose(1, 3)}</p></li>", f"<article class=\"comment\"><p>{prose(1, 4)}</p></article>", f"<div class='reply comment-body'>{prose(1, 3)}</div>", f"<p>{prose(1, 3)}</p>"])
        return wrap([*names("section", "comments responses discussion"), *names("div", "comments comment-list disqus reader-comments replies user-comments"), ("ol", "commentlist")], pick(["", f"<h3>{short()}</h3>"]) + "".join(one() for _ in range(rnd.randint(1, 4))))

    def share():
        return wrap(names("div", "share social share-bar tags meta byline pager pagination author-box"), pick([short(5), " ".join(f'<a href="#">{short(1)}</a>' for _ in range(4))]))

    def foot():
        body = pick([f"&copy; {word()}.example.org &middot; {prose(1, 2)}", f"<p>&copy; 20{rnd.randint(10, 29)} {short()}. All rights reserved.</p>", f"<ul><li><a href='/p'>{short()}</a></li><li>{short()}</li></ul><p>{sentence()}</p>", prose(1, 3)])
        return wrap([("footer", ""), ("footer", ""), ("footer", "site-footer"), *names("div", "footer colophon copyright bottom legal")], body)

    def head():
        return wrap([("header", ""), ("header", "site-header"), *names("div", "header masthead topbar logo branding")], pick([short(), f"<h1>{short()}</h1><p>{sentence()}</p>", f"<a href=/>{short(2)}</a>{menu()}"]))

    out = []
    for _ in range(count):
        mark = 0
        body = main_blocks()
        shell = pick([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), *names("div", "content article post entry entry-content article-body story post-content main-content text body-copy page-content markdown"), ("section", "article-text"), ("div", "")])
        inner = f"\x01{body}\x02"
        if rnd.random() < 0.3:
            extra = pick([advert, share, side, notice, form])()
            inner = pick([inner + extra, extra + inner, f"\x01{main_blocks()}\x02{extra}\x01{main_blocks()}\x02"])
        opened = f'<{shell[0]}{" " + pick(["class", "id"]) + chr(61) + chr(34) + shell[1] + chr(34) if shell[1] else ""}>'
        article = f"{opened}{inner}</{shell[0]}>"
        if rnd.random() < 0.3:
            article = wrap([("main", ""), *names("div", "container wrapper page row main site layout")], article)
        before = [f() for f in (head, menu, notice, advert, share) if rnd.random() < 0.45]
        after = [f() for f in (side, comments, share, advert, form, notice, foot, foot) if rnd.random() < 0.45]
        rnd.shuffle(before)
        title = f"<title>{short(8)}</title>"
        page = f'<!DOCTYPE html><html><head><meta charset="utf-8">{title}<style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{"".join(before)}<!-- {word()} -->{article}{"".join(after)}</body></html>'
        marked, texts = page, []
        for part in re.findall("\x01(.*?)\x02", marked, re.S):
            texts += [b.text for b in blocks(part)]
            mark += 1
        out.append((marked.replace("\x01", "").replace("\x02", ""), texts))
    return out


def labels_for(page: list[Block], main: list[str]) -> list[int]:
    """Gold labels: blocks that match the main texts in order."""
    out, at = [], 0
    for b in page:
        hit = at < len(main) and b.text == main[at]
        out.append(MAIN if hit else OTHER)
        at += hit
    return out


@lru_cache(maxsize=4)
def trained(count: int = TRAIN_PAGES, seed: int = 7) -> Crf:
    pages = []
    for page, main in labelled_pages(count, seed):
        found = blocks(page)
        if found:
            pages.append((found, labels_for(found, main)))
    return Crf().train(pages)


def main_text(page: str | None, model: Crf) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, label in zip(found, model.decode(found)) if label == MAIN)


def extract(pages: DataFrame, model: Crf | None = None, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` and ``text``: the main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # weights of fixed size
    return map_texts(pages, column, keep, [T.StructField("text", T.StringType())], lambda texts: [[main_text(t, shared.value) for t in texts]])
