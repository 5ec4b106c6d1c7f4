"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

A tolerant parser makes a tree of the block elements and of inline elements whose class, id or role speaks of adverts, menus, comments,
sharing, teasers, notices or forms; other inline elements only add to their block's statistics. Every node gets features: its tag, words of its class, id and role, the same of its ancestors, depth, sibling statistics, and the
density of text and links in its subtree. The trees give each node probabilities of being a wrapper (around
content and other things), content, or boilerplate. Decoding picks the likeliest labelling of the whole tree in
which wrappers may hold anything, content may hold content or boilerplate, and boilerplate holds only
boilerplate, so that no ancestor and descendant contradict each other.

The trees are fitted on pages composed by ``training_pages`` (a seeded generator of labelled layouts); no table is
used for it. Scripts, styles, templates, form controls and their labels, embedded objects, hidden elements and the head are never
text.

Text: character references are decoded; white space within a block becomes one space; blocks are trimmed and joined in
page order by a line feed; ``<br>`` is white space; text outside all blocks is a paragraph of its own. A link that is not closed before
the next one ends with its block. Defined results: a null or empty page, or one without content,
gives ''; text after an unclosed comment, script or tag is dropped as browsers do; repeated rows get equal values.
"""

from __future__ import annotations

import html
import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees
from .common import quoted, small_batches
from .workers import Memo, kept

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|<)*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
MARK = re.compile(r'data-y="(\d)"')
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of HTML.
RAW = frozenset("script style textarea title noscript iframe noframes xmp noembed".split())
DROPPED = frozenset("head template svg math object canvas audio video select button map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body div section article main nav header footer aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset blockquote pre figure figcaption address details summary dialog center hgroup menu search legend".split())
CLOSES_P = BLOCKS - frozenset("html body li dt dd tr td th thead tbody tfoot caption summary figcaption legend".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
# Beginnings of words in class, id and role that say something about a block, by group.
GROUPS = [
    "ad ads advert advertisement advertorial adsense adslot banner promo promotion sponsor sponsored sponsorship dfp doubleclick outbrain taboola partner",
    "nav navigation navbar menu menubar breadcrumb breadcrumbs crumb pagination pager paging toolbar tabs skip sitemap",
    "comment comments commentlist disqus reply replies respond discussion reader readers feedback review reviews talkback",
    "share sharing social follow like facebook twitter sns",
    "related recommend recommended recommendation more popular trending latest teaser teasers similar also",
    "cookie cookies consent gdpr notice notification alert popup modal overlay warning message dialog announcement disclaimer",
    "form login signin signup register search subscribe subscription newsletter contact input",
    "foot footer bottom copyright colophon legal",
    "head header masthead top topbar logo brand branding site hero",
    "side sidebar aside rail widget widgets secondary complementary column gadget",
    "meta byline author date time tag tags category categories info posted",
    "content contents contentinfo text body copy prose richtext",
    "article story post entry blog news hentry",
    "main primary center",
    "wrap wrapper container page outer inner layout row grid col",
]
_GROUP_OF = {w: 1 << g for g, words in enumerate(GROUPS) for w in words.split()}
INLINE = "span"
TAG_KINDS = ["span", "html body", "div section", "article", "main", "nav menu search", "header hgroup", "footer address", "aside", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table thead tbody tfoot tr", "td th caption", "form fieldset legend", "blockquote pre", "figure figcaption", "details summary dialog center"]
_KIND_OF = {t: k for k, tags in enumerate(TAG_KINDS) for t in tags.split()}
WRAPPER, CONTENT, BOILERPLATE = 0, 1, 2
#: Groups that make an inline element a node of its own.
APART = (1 << 7) - 1
UNSEEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s/>=]|$)(?!\s*=\s*["']?until)|style\s*=\s*(?:"[^"]*|'[^']*|[^\s>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)

HEAD_END = re.compile(r"</head\s*>|<body\b|<(?:div|nav|header|main|article|section|p|h1|table)\b", re.I | re.A)
HIDDEN = re.compile(r"<(script|style|title|noscript)\b.*?</\1\s*>", re.I | re.A | re.S)
CLOSING = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW | DROPPED}

def groups_of(attributes: str) -> int:
    """Bit set of the GROUPS that an element's class, id and role speak of."""
    got = 0
    for _, a, b, c in NAMED.findall(attributes):
        for w in PIECE.findall(a or b or c):
            got |= _GROUP_OF.get(w.lower(), 0)
    return got


class Page:
    """Block nodes in document order, as parallel lists, and the text runs (node, text)."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.depth, self.groups, self.above, self.kinds_above, self.label = ["html"], [-1], [0], [0], [0], [0], [-1]
        self.own, self.linked, self.commas, self.inline = [0], [0], [0], [0]
        self.runs: list[tuple[int, str | list[tuple[int, str]]]] = []  # a block's text, or its pieces with their inline nodes
        self.unseen: list[int] = []
        self.groups_of = kept("html_extract", "groups", lambda: Memo(groups_of, 8 << 20)).__getitem__
        if source:
            self._parse(source)

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        up = stack[-1]
        stack.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.groups.append(self.groups_of(attributes) if attributes else 0)
        if attributes and UNSEEN.search(attributes):
            self.unseen.append(stack[-1])
        self.above.append(self.above[up] | self.groups[up])
        self.kinds_above.append(self.kinds_above[up] | 1 << _KIND_OF[self.tag[up]])
        mark = MARK.search(attributes) if "data-y" in attributes else None
        self.label.append(int(mark[1]) if mark else -1)
        self.own.append(0)
        self.linked.append(0)
        self.commas.append(0)
        self.inline.append(0)

    def _flush(self, node: int, buffer: list[tuple[int, str]]) -> None:
        """End a run of text of a block; ``buffer`` has its pieces with the block or the inline node that each is in."""
        if not buffer:
            return
        apart = any(owner != node for owner, _ in buffer)
        text = " ".join("".join([t for _, t in buffer]).split())
        if text:
            home = node
            if not node:  # text held by the document itself is a paragraph of its own
                self._open([0], "p", "")
                home = len(self.tag) - 1
                for count in (self.linked, self.inline):
                    count[0], count[home] = 0, count[0]
            if not apart:
                self.runs.append((home, text))
                self._count(home, text)
            else:
                pieces = [(home if owner == node else owner, t) for owner, t in buffer]
                self.runs.append((home, pieces))
                for owner in {o for o, _ in pieces}:
                    self._count(owner, " ".join("".join([t for o, t in pieces if o == owner]).split()))
        buffer.clear()

    def _count(self, node: int, text: str) -> None:
        self.own[node] += len(text)
        self.commas[node] += text.count(",") + text.count(".")

    def _apart(self, up: int, name: str, attributes: str) -> int | None:
        """The node of an inline element, if it gets one."""
        unseen = name == "label" or (attributes and UNSEEN.search(attributes))
        if not unseen and not (attributes and self.groups_of(attributes) & APART):
            return None
        self._open([up], INLINE, attributes)
        if name == "label":
            self.unseen.append(len(self.tag) - 1)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack, buffer, at, tags = [0], [], 0, self.tag
        within: list[tuple[str, int]] = []  # open inline elements from the first that is a node: name and node, or the node around it
        in_link = closed = False
        end = len(source)

        def leave() -> None:
            """A block begins or ends: inline elements, and links that are not closed, end with it."""
            nonlocal in_link
            within.clear()
            in_link = in_link and closed

        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                text = source[at:stop]
                if "&" in text:
                    text = html.unescape(text)
                owner = within[-1][1] if within else stack[-1]
                buffer.append((owner, text))
                if in_link:
                    self.linked[owner] += len(text)
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCKS:
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] == name or (name[0] == "h" and name[1:].isdigit() and tags[stack[k]][0] == "h" and tags[stack[k]][1:].isdigit()):
                            self._flush(stack[-1], buffer)
                            leave()
                            del stack[k:]
                            break
                        if name == "p" and tags[stack[k]] != "p":
                            break
                        if name in STOPS and tags[stack[k]] in STOPS[name]:
                            break
                    continue
                if name == "a":
                    in_link = False
                for k in range(len(within) - 1, -1, -1):
                    if within[k][0] == name:
                        del within[k:]
                        break
                continue
            if name in RAW or name in DROPPED:
                if m[3].endswith("/") and name in ("svg", "math"):
                    continue
                if name == "head":
                    close, inner = HEAD_END.search(source, at), at
                    while close and (raw := HIDDEN.search(source, inner)) and raw.start() < close.start():
                        inner = raw.end()
                        close = HEAD_END.search(source, inner)
                    at = close.start() if close else end
                else:
                    close = CLOSING[name].search(source, at)
                    gt = source.find(">", close.start()) if close else -1
                    at = end if gt < 0 else gt + 1
                buffer.append((stack[-1], " "))
                continue
            if name in VOID:
                self.inline[stack[-1]] += 1
                if name == "hr":
                    self._flush(stack[-1], buffer)
                    leave()
                elif name in ("br", "img"):
                    buffer.append((within[-1][1] if within else stack[-1], " "))
                continue
            if name not in BLOCKS:
                self.inline[stack[-1]] += 1
                if name == "a":
                    follows = ANCHOR.search(source, at)
                    in_link, closed = True, bool(follows and follows[1])
                    within = [x for x in within if x[0] != "a"]
                up = within[-1][1] if within else stack[-1]
                node = self._apart(up, name, m[3])
                if node is not None or within:
                    within.append((name, up if node is None else node))
                continue
            self._flush(stack[-1], buffer)
            leave()
            if name in ("html", "body") and len(stack) > 1 and name in (tags[s] for s in stack):
                continue
            if name == "html":
                continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        del stack[k:]
                        break
                    if tags[stack[k]] in ("td", "th", "table", "div", "body", "article", "section", "li"):
                        break
            if name in SIBLINGS:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in SIBLINGS[name]:
                        cut = k
                        while cut > 1 and tags[stack[cut - 1]] in SIBLINGS[name] and tags[stack[cut]] != name:
                            cut -= 1
                        del stack[cut:]
                        break
                    if tags[stack[k]] in STOPS[name]:
                        break
            self._open(stack, name, m[3])
        self._flush(stack[-1], buffer)

    def text(self, label: list[int]) -> str:
        """The text of the content blocks, without their inline nodes that are none."""
        out = []
        for node, run in self.runs:
            if label[node] == CONTENT:
                if not isinstance(run, str):
                    run = " ".join("".join([t if label[owner] == CONTENT else " " for owner, t in run]).split())
                if run:
                    out.append(run)
        return "\n".join(out)

    def numbers(self) -> list[tuple]:
        """Per node: the raw numbers from which ``features`` makes a matrix."""
        n, parent = len(self.tag), self.parent
        text, linked, commas, nodes, paragraphs, inline = self.own[:], self.linked[:], self.commas[:], [1] * n, [int(t == "p") for t in self.tag], self.inline[:]
        kids = [0] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            linked[p] += linked[i]
            commas[p] += commas[i]
            nodes[p] += nodes[i]
            paragraphs[p] += paragraphs[i]
            inline[p] += inline[i]
            kids[p] += 1
        total, before, out, nth, same = max(1, text[0]), 0, [], [0] * n, [0] * n
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            nth[i] = kids_seen = alike.get((parent[i], ""), 0)
            alike[parent[i], ""] = kids_seen + 1
            alike[parent[i], self.tag[i]] = alike.get((parent[i], self.tag[i]), 0) + 1
        for i in range(n):
            p = max(parent[i], 0)
            same[i] = alike.get((p, self.tag[i]), 1)
            out.append((_KIND_OF[self.tag[i]], self.groups[i], self.above[i], self.groups[p], self.kinds_above[i], self.depth[i], text[i], self.own[i], linked[i], commas[i], nodes[i], paragraphs[i], inline[i], kids[i], kids[p], nth[i], same[i], before, total, text[p], linked[p]))
            before += self.own[i]
        return out


def features(rows: list[tuple]) -> np.ndarray:
    """Feature matrix of the nodes of any number of pages."""
    a = np.array(rows, np.float64)
    ints = a[:, :5].astype(np.int64)
    bits = lambda v, n: (v[:, None] >> np.arange(n) & 1).astype(np.float32)
    kind, own_g, above_g, parent_g, kinds_above = ints.T
    depth, text, own, linked, commas, nodes, paragraphs, inline, kids, siblings, nth, same, before, total, parent_text, parent_linked = a[:, 5:].T
    safe = np.maximum(text, 1)
    numeric = np.stack(
        [depth, np.log1p(text), np.log1p(own), np.minimum(linked / safe, 2), commas / safe, np.log1p(text / nodes), np.log1p(nodes), np.log1p(paragraphs), inline / nodes, np.log1p(kids), np.log1p(siblings), nth / np.maximum(siblings, 1), same / np.maximum(siblings, 1), before / total, text / total, text / np.maximum(parent_text, 1), np.minimum(parent_linked / np.maximum(parent_text, 1), 2), own / safe, np.log1p(nth), np.log1p(total)], 1
    )
    return np.concatenate([numeric.astype(np.float32), (kind[:, None] == np.arange(len(TAG_KINDS))).astype(np.float32), bits(own_g, len(GROUPS)), bits(above_g, len(GROUPS)), bits(parent_g, len(GROUPS)), bits(kinds_above, len(TAG_KINDS))], 1)


def decode(parent: list[int], logs: list[list[float]]) -> list[int]:
    """The likeliest labels, given per node log probabilities of (wrapper, content, boilerplate)."""
    n = len(parent)
    in_wrapper, in_content, none = [0.0] * n, [0.0] * n, [0.0] * n  # sums over children of their best under each parent label
    best = [None] * n
    for i in range(n - 1, -1, -1):
        w, c, b = logs[i]
        w, c, b = w + in_wrapper[i], c + in_content[i], b + none[i]
        best[i] = (w, c, b)
        p = parent[i]
        if p >= 0:
            in_wrapper[p] += max(w, c, b)
            in_content[p] += max(c, b)
            none[p] += b
    out = [WRAPPER] * n
    for i in range(n):
        up = out[parent[i]] if parent[i] >= 0 else WRAPPER
        w, c, b = best[i]
        if up == BOILERPLATE:
            out[i] = BOILERPLATE
        elif up == CONTENT:
            out[i] = CONTENT if c >= b else BOILERPLATE
        else:
            out[i] = WRAPPER if w >= c and w >= b else CONTENT if c >= b else BOILERPLATE
    return out


class Model:
    def __init__(self, pages: int = 900, seed: int = 11):
        rows, labels = [], []
        for source in training_pages(pages, seed):
            page = Page(source)
            for r, y in zip(page.numbers(), page.label):
                if y >= 0:
                    rows.append(r)
                    labels.append(y)
        self.trees = Trees().fit(features(rows), np.array(labels), 3)
        self.token = uuid.uuid4().hex

    def extract(self, sources: list[str | None]) -> list[str]:
        """The main texts of some pages."""
        pages = [Page(s) for s in sources]
        rows = [p.numbers() for p in pages]
        logs = self.trees.log_proba(features([r for page in rows for r in page]))
        out, at = [], 0
        for page, r in zip(pages, rows):
            part = logs[at : at + len(r)].tolist()
            part[0] = [0.0, -50.0, -50.0]  # the document itself
            for node in page.unseen:
                part[node] = [-1e3, -1e3, 0.0]
            at += len(r)
            out.append(page.text(decode(page.parent, part)))
        return out


def training_pages(count: int, seed: int) -> Iterator[str]:
    """Composed pages in which every block carries its label in ``data-y``."""
    rng = random.Random(seed)
    parts = "an be co de er fi go ha in ka lo mi no or pu ra se ti un vo wa xi ze sch tion ment".split()

    def words(n: int) -> str:
        out = []
        for k in range(n):
            w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
            out.append((w.capitalize() if not k or rng.random() < 0.1 else w) + ("," if rng.random() < 0.05 else "." if rng.random() < 0.1 else ""))
        return " ".join(out)

    def el(tag: str, y: int, inner: str, attributes: str = "", close: float = 0.0) -> str:
        return f'<{tag} {attributes} data-y="{y}">{inner}' + ("" if rng.random() < close else f"</{tag}>")

    def named(*names: str, odds: float = 0.85) -> str:
        """A class or id made of one of the names, or something that says nothing."""
        if rng.random() > odds:
            return rng.choice(["", f'class="{rng.choice(parts)}{rng.randint(1, 99)}"', f'id="b{rng.randint(1, 999)}"'])
        n = rng.choice(names)
        n = rng.choice([n, n, f"{n}-{rng.choice(['box', 'wrap', 'area', 'block', 'main', 'list', str(rng.randint(1, 9))])}", f"site-{n}", f"{n}_{rng.choice(parts)}"])
        return f'{rng.choice(["class", "class", "id"])}="{n}"' + (' role="' + n + '"' if rng.random() < 0.05 else "")

    def links(n: int) -> str:
        return "".join(f'<a href="/{rng.choice(parts)}">{words(rng.randint(1, 3))}</a> ' for _ in range(n))

    def link_list(y: int, n: int) -> str:
        return el(rng.choice(["ul", "ul", "ol"]), y, "".join(el("li", y, f'<a href="/x">{words(rng.randint(1, 5))}</a>', close=0.1) for _ in range(n)))

    def inline(y: int) -> str:
        """An inline element that is a node: mostly a few words that are no text; now and then text of a weaker name."""
        if y == CONTENT and rng.random() < 0.25:
            return f'<{rng.choice(["span", "em", "strong"])} class="{rng.choice(["message-text", "notice-body", "comment-term", "more-content", "review-title", "search-hit", "message", "followed"])}" data-y="1">{words(rng.randint(2, 40))}</span></em></strong>'
        tag = rng.choice(["span", "span", "a", "em", "small", "b"])
        who = rng.choice(["ad", "ads", "advert", "sponsored", "promo", "banner", "share", "social", "follow", "tweet-share", "nav-link", "menu-item", "breadcrumb", "related", "more", "cookie-notice", "newsletter", "login", "subscribe", "comment-count", "reply"])
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice([who, who, who + "-" + rng.choice(parts)])}" data-y="2">{words(rng.randint(1, 8))}</{tag}>'

    def paragraph(y: int, low: int = 1, high: int = 120) -> str:
        n = rng.choice([rng.randint(low, max(low, 8)), rng.randint(low, high), rng.randint(low, high)])
        text = words(n)
        if rng.random() < 0.06:
            text = rng.choice([f"{text} {inline(y)}", f"{inline(y)} {text}", f"{text} {inline(y)} {words(rng.randint(1, 30))}"])
        if rng.random() < 0.2:
            text = f"<b>{text}" + rng.choice(["</b>", ""]) + rng.choice(["<br>", ""])
        if rng.random() < 0.15:
            text += f' <a href="/z">{words(2)}</a> {words(rng.randint(1, 10))}'
        return el("p", y, text, close=0.15)

    def boiler(kind: str, inside: bool = False) -> str:
        b = BOILERPLATE
        if kind == "nav":
            return el(rng.choice(["nav", "nav", "div"]), b, rng.choice([link_list(b, rng.randint(3, 12)), links(rng.randint(3, 9))]), rng.choice(["", named("nav", "menu", "navbar", "breadcrumbs", "main-nav", "pagination", odds=1)]))
        if kind == "menu":
            return el(rng.choice(["div", "ul", "menu"]), b, "".join(el("li", b, f'<a href="/m">{words(2)}</a>') for _ in range(rng.randint(3, 10))), named("menu", "nav", "navigation", "top-menu"))
        if kind == "ad":
            return el(rng.choice(["div", "div", "section", "aside", "p"]), b, rng.choice([words(rng.randint(3, 30)), paragraph(b, 3, 30), links(2) + words(8)]), named("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", odds=0.97))
        if kind == "notice":
            return el(rng.choice(["div", "div", "section", "p", "aside"]), b, rng.choice([words(rng.randint(5, 40)), paragraph(b, 5, 40)]) + rng.choice(["", "<button>ok</button>"]), named("cookie", "consent", "notice", "gdpr", "alert", "popup", "cookie-notice", "notification", "disclaimer", odds=0.97))
        if kind == "header":
            return el(rng.choice(["header", "header", "div"]), b, rng.choice(["", el(rng.choice(["h1", "h2", "div", "p"]), b, words(rng.randint(1, 6)), rng.choice(["", named("logo", "site-title", "brand")]))]) + rng.choice(["", words(4), paragraph(b, 2, 25), boiler("nav")]), named("header", "masthead", "topbar", "site-header", odds=0.97))
        if kind == "footer":
            return el(rng.choice(["footer", "footer", "div"]), b, rng.choice(["&copy; ", ""]) + words(rng.randint(3, 40)) + rng.choice(["", link_list(b, rng.randint(2, 6)), paragraph(b, 3, 30), links(3)]), rng.choice(["", named("footer", "bottom", "copyright", "colophon", "site-footer", odds=1)]) if rng.random() < 0.7 else named("footer", odds=1))
        if kind == "sidebar":
            return el(rng.choice(["aside", "aside", "div", "section"]), b, "".join(el(rng.choice(["div", "section"]), b, el(rng.choice(["h3", "h4", "h2"]), b, words(2)) + rng.choice([link_list(b, 4), paragraph(b, 4, 60), words(20)]), named("widget", "box", "module", odds=0.6)) for _ in range(rng.randint(1, 4))) if rng.random() < 0.7 else el("h3", b, words(2)) + paragraph(b, 3, 80) + rng.choice(["", link_list(b, 4)]), named("sidebar", "rail", "widget", "secondary", odds=0.97))
        if kind == "related":
            return el(rng.choice(["div", "section", "aside"]), b, el(rng.choice(["h2", "h3"]), b, words(2)) + rng.choice([link_list(b, 5), "".join(el("div", b, f'<a href="/r">{words(6)}</a>' + rng.choice(["", paragraph(b, 3, 20)])) for _ in range(3)), paragraph(b, 3, 40)]), named("related", "recommended", "more", "popular", "teaser", odds=0.97))
        if kind == "social":
            return el(rng.choice(["div", "ul"]), b, "".join(el("li", b, f'<a href="/s">{words(1)}</a>') for _ in range(rng.randint(2, 5))) if rng.random() < 0.5 else links(3), named("share", "social", "follow", odds=0.97))
        if kind == "form":
            return el("form", b, rng.choice(["", el("p", b, words(6)), f"<label>{words(2)}</label>", el("h3", b, words(3))]) + "<input name=q>" + rng.choice(["", words(5), paragraph(b, 3, 40)]) + "<button>go</button>", rng.choice(["", named("search", "login", "newsletter", "subscribe", "contact", odds=1)])) if rng.random() < 0.75 else el(rng.choice(["div", "section"]), b, el("h3", b, words(3)) + el("form", b, paragraph(b, 2, 20) + "<input>"), named("newsletter", "signup", "subscribe", "login", odds=1))
        if kind == "comments":
            one = lambda: el(rng.choice(["div", "li", "article", "section"]), b, rng.choice(["", el(rng.choice(["div", "p", "h4"]), b, words(2), named("author", "meta", odds=0.8))]) + rng.choice([paragraph(b, 3, 90), paragraph(b, 3, 90), words(20), paragraph(b, 3, 60) + paragraph(b, 3, 60)]), rng.choice(["", named("comment", "reply", "review", odds=0.9)]))
            return el(rng.choice(["div", "section", "section", "aside", "ol", "ul"]), b, rng.choice(["", el(rng.choice(["h2", "h3"]), b, words(2))]) + "".join(one() for _ in range(rng.randint(1, 6))) + (boiler("form") if rng.random() < 0.2 else ""), named("comments", "comment-list", "responses-comments", "disqus", "replies", "discussion", "reader-comments", odds=0.98))
        return el("div", b, words(rng.randint(1, 8)), named("meta", "byline", "tags", "date", "author", odds=0.97))

    def content() -> str:
        c, out = CONTENT, []
        if rng.random() < 0.8:
            title = el(rng.choice(["h1", "h1", "h1", "h2"]), c, words(rng.randint(2, 14)))
            out.append(el("header", c, title, "") if rng.random() < 0.05 else title)
        if rng.random() < 0.15:
            out.append(boiler("meta"))
        for _ in range(rng.choice([1, 1, 2, rng.randint(1, 6), rng.randint(3, 25)])):
            r = rng.random()
            if r < 0.7:
                out.append(paragraph(c))
            elif r < 0.78:
                out.append(el(rng.choice(["h2", "h3"]), c, words(rng.randint(1, 8))))
            elif r < 0.83:
                out.append(el(rng.choice(["ul", "ol"]), c, "".join(el("li", c, words(rng.randint(2, 25)), close=0.2) for _ in range(rng.randint(2, 7)))))
            elif r < 0.86:
                out.append(el("blockquote", c, rng.choice([words(20), paragraph(c, 5, 50)])))
            elif r < 0.875:
                out.append(el("pre", c, words(rng.randint(5, 40))))
            elif r < 0.895:
                out.append(el("table", c, "".join(el("tr", c, "".join(el(rng.choice(["td", "td", "th"]), c, words(rng.randint(1, 5))) for _ in range(3))) for _ in range(rng.randint(2, 5)))))
            elif r < 0.91:
                out.append(el("figure", c, '<img src="x">' + el("figcaption", c, words(rng.randint(3, 12)))))
            elif r < 0.93:
                out.append(el("div", c, rng.choice([words(25), paragraph(c) + paragraph(c)])))
            else:
                out.append(boiler(rng.choice(["ad", "ad", "related", "social", "form", "notice", "sidebar", "meta", "nav"])))
        if rng.random() < 0.15:
            out.append(boiler(rng.choice(["comments", "comments", "related", "social", "form", "footer"])))
        return "".join(out)

    def page() -> str:
        r = rng.random()
        if r < 0.45:
            main = el("article", CONTENT, content(), rng.choice(["", "", named("article", "post", "entry", "story")]))
            if rng.random() < 0.3:
                main = el("main", WRAPPER if rng.random() < 0.5 else CONTENT, main)
                if 'main  data-y="0"' in main[:20] and rng.random() < 0.6:
                    main = main[: -len("</main>")] + boiler(rng.choice(["comments", "related", "sidebar"])) if main.endswith("</main>") else main
        elif r < 0.6:
            main = el("main", CONTENT, content(), rng.choice(["", named("main", "content")]))
        elif r < 0.9:
            main = el(rng.choice(["div", "div", "section"]), CONTENT, content(), named("content", "article", "post", "entry", "story", "main", "article-body", "post-content", "text", odds=0.85))
        elif r < 0.95:
            main = el("table", WRAPPER, el("tr", WRAPPER, el("td", BOILERPLATE, links(6)) + el("td", CONTENT, content())))
        else:
            main = content()
        before = [boiler(k) for k in ("header", "nav", "menu", "ad", "notice", "form", "meta") if rng.random() < {"header": 0.5, "nav": 0.6, "menu": 0.15, "ad": 0.35, "notice": 0.2, "form": 0.1, "meta": 0.03}[k]]
        after = [boiler(k) for k in ("comments", "related", "sidebar", "social", "form", "ad", "notice", "nav", "footer") if rng.random() < {"comments": 0.3, "related": 0.2, "sidebar": 0.3, "social": 0.15, "form": 0.15, "ad": 0.2, "notice": 0.08, "nav": 0.1, "footer": 0.8}[k]]
        if rng.random() < 0.15:
            rng.shuffle(before)
        if rng.random() < 0.2:
            main = (boiler("sidebar") if rng.random() < 0.5 else "") + main
            main = el("div", WRAPPER, main + (boiler("sidebar") if rng.random() < 0.5 else ""), named("wrapper", "container", "row", "layout", "main", odds=0.7))
        inner = "".join(before) + main + "".join(after)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            inner = el("div", WRAPPER, inner, named("wrapper", "page", "container", "site", "outer", odds=0.7))
        return f'<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body data-y="0">{inner}' + rng.choice(["</body></html>", "</body></html>", ""])

    for _ in range(count):
        yield page()


_default: list[Model] = []


def default_model() -> Model:
    """The model of the generator's default pages, fitted once in a driver process."""
    if not _default:
        _default.append(Model())
    return _default[0]



def extract_text(pages: DataFrame, html_col: str, keep: list[str], model: Model | None = None, batch: int = 200) -> DataFrame:
    """The columns in ``keep``, then text string (never null), for every row."""
    small_batches(pages.sparkSession)
    model = model or default_model()
    rows = pages.select(*[quoted(k).alias(f"c{i}") for i, k in enumerate(keep)], quoted(html_col).alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                b = whole.slice(k, batch)
                texts = model.extract(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    out = rows.mapInArrow(run, f"{kinds}, text string")
    return out.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], "text")
