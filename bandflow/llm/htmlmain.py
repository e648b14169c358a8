"""Main-text extraction by a tree-structured graphical model over DOM nodes.

Every block element of a page is a binary variable, content or not. A node's
potential comes from its tag (headers and footers inside an article apart from
those of the page), the hints in its class, id and role, the length of its
text and its share of links, and from what it looks like in the tree: words,
link density and sentences of all that it holds, its place in the page, and
whether its siblings repeat it. Training pages also carry neutral and
misleading names, so that no hint alone decides; parent-child potentials depend on the kind
of the parent. Sum-product messages pass from the leaves up to the root and
back down, which gives each node's exact marginal; the text of nodes with a
marginal of at least one half is the main text. Weights are learnt by exact
likelihood gradients from labelled pages: `example_pages` makes them from
varied layouts, and `learn` takes any others whose content elements carry the
attribute `data-main="1"`.

Character references are decoded, white space inside a block becomes one
space, blocks are joined by an empty line in page order. Defined results: null
or empty html has the empty text; html without any tag is one block; unclosed
and stray tags are tolerated; repeated rows give repeated results; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: What may stand between the quoted values of a tag. Quotes count after an equals sign; possessive repeats keep broken tags linear.
BETWEEN = r"""[^<>"'=]++|=(?!\s*["'])|["']"""
#: Comments, declarations and tags. A tag's last group is empty where a quoted value needs `tag_end`.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:""" + BETWEEN + r"""|=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+)(>?)""", re.DOTALL)
OUTSIDE = re.compile(f"(?:{BETWEEN})*+")
OPENING = re.compile(r"""=\s*+(["'])""")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Element kinds of HTML.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template svg math head title iframe object canvas audio video textarea select".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertising promo promoted promotion sponsor sponsored banner dfp outbrain taboola",
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc skip",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer foot copyright legal contentinfo colophon",
    "side": "sidebar aside side widget related recommended trending popular complementary more",
    "comment": "comment comments commentlist reply replies disqus discussion respond reader readers",
    "notice": "cookie cookies consent notice popup modal overlay newsletter subscribe subscription alert gdpr paywall dialog alertdialog",
    "share": "share sharing social follow byline meta tags tag author",
    "form": "form search login signup register contact",
    "main": "article content main post entry story body text page hentry articlebody",
    "hidden": "hidden invisible sr-only visually-hidden",
}
HINT_OF: dict[str, set[str]] = {}
for _kind, _words in HINTS.items():
    for _word in _words.split():
        HINT_OF.setdefault(_word, set()).add(_kind)
BAD = {"ad", "nav", "head", "foot", "side", "comment", "notice", "share", "form", "hidden"}
BAD_TAGS = {"nav", "footer", "aside", "form", "header", "button", "dialog", "fieldset", "menu"}


class Node:
    __slots__ = ("tag", "parent", "fixed", "kind", "gold", "words", "linked", "children", "stops", "shape")

    def __init__(self, tag: str, parent: int, fixed: tuple[str, ...], kind: str, gold: bool):
        self.tag, self.parent, self.fixed, self.kind, self.gold = tag, parent, fixed, kind, gold
        self.words = self.linked = self.children = self.stops = 0
        self.shape: tuple[str, ...] = ()  #: features that the whole tree gives


_described: dict[tuple[str, str], tuple[tuple[str, ...], str, bool]] = {}


def described(tag: str, attributes: str) -> tuple[tuple[str, ...], str, bool]:
    """Features, kind and gold label that an element's tag and attributes give."""
    key = (tag, attributes)
    if key in _described:
        return _described[key]
    hints, gold = set(), False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role", "itemprop"):
            for word in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                hints |= HINT_OF.get(word, set())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hints.add("hidden")
        elif name == "data-main":
            gold = value == "1"
    if tag in ("html", "body"):
        kind = "root"
    elif hints & BAD or tag in BAD_TAGS:
        kind = "bad"
    elif "main" in hints or tag in ("article", "main"):
        kind = "main"
    else:
        kind = "plain" if tag in ("div", "section", "ul", "ol", "table", "tbody", "tr", "dl", "td") else "block"
    # What an element without a telling name is says less than what it is with one.
    out = ((f"tag {tag}", *(f"hint {h}" for h in sorted(hints))) if hints else (f"tag {tag}", f"unnamed {tag}"), kind, gold)
    if len(_described) < 20_000 and len(attributes) < 1000:
        _described[key] = out
    return out


def tag_end(page: str, at: int, last: dict[str, int], failed: set[int]) -> int:
    """Where the tag whose attributes begin at `at` is closed, or -1 if a '<' or the page's end comes first.

    A quoted value goes up to the next such quote, however far; without one
    its quote is a plain character. `last` keeps the page's last quotes and
    `failed` the ends of values after which no tag is closed, so that all
    calls for a page together take linear time.
    """
    passed = []
    while True:
        at = OUTSIDE.match(page, at).end()
        if page[at : at + 1] == ">":
            return at
        opening = OPENING.match(page, at)
        if not opening:
            break
        quote, at = opening[1], opening.end()
        if quote not in last:
            last[quote] = page.rfind(quote)
        if at <= last[quote]:
            at = page.find(quote, at) + 1
            if at in failed:
                break
            passed.append(at)
    failed.update(passed)
    return -1


def parsed(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes of a page, parents first, and its text runs as (node, text) in page order."""
    nodes = [Node("#page", -1, ("tag #page",), "root", False)]
    runs: list[tuple[int, str]] = []
    stack, buffer = [0], []
    opened: Counter[str] = Counter()
    link, skipping, at, look = False, "", 0, 0
    last: dict[str, int] = {}
    failed: set[int] = set()

    def flush() -> None:
        if buffer:
            words = "".join(buffer).split()
            buffer.clear()
            if words:
                runs.append((stack[-1], " ".join(words)))

    def keep(text: str) -> None:
        buffer.append(entities.unescape(text) if "&" in text else text)
        n = len(text.split())
        nodes[stack[-1]].words += n
        nodes[stack[-1]].stops += sum(map(text.count, ".,;!?"))
        if link:
            nodes[stack[-1]].linked += n

    def close(tag: str, within: set[str] = frozenset()) -> None:
        if not opened[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            open_tag = nodes[stack[i]].tag
            if open_tag == tag:
                flush()
                opened.subtract(nodes[j].tag for j in stack[i:])
                del stack[i:]
                return
            if open_tag in within:
                return

    while m := TOKEN.search(page, look):
        tag, attributes, end = m[2], m[3], m.end()
        if tag is not None and not m[4]:
            end = tag_end(page, m.end(2), last, failed) + 1
            if not end:
                look = m.start() + 1
                continue
            attributes = page[m.end(2) : end - 1]
        if not skipping and m.start() > at:
            keep(page[at : m.start()])
        at = look = end
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1] == "/"
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = look = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        if tag in INLINE:
            if tag == "a":
                link = not closing
            elif tag == "br":
                buffer.append(" ")
            continue
        link = False
        if closing:
            close(tag)
            continue
        flush()
        if tag in CLOSES_P:
            close("p", {"td", "th", "button", "object"})
        if tag in SAME:
            close(tag, SAME[tag])
            if tag in ("td", "th"):
                close("th" if tag == "td" else "td", SAME[tag])
            elif tag in ("dt", "dd"):
                close("dd" if tag == "dt" else "dt", SAME[tag])
        if tag in VOID:
            continue
        fixed, kind, gold = described(tag, attributes)
        if tag in ("header", "footer") and (opened["article"] or opened["main"]):
            fixed = (f"tag inner {tag}", *fixed[1:])
            kind = "inner" if tag == "header" and not any(f.startswith("hint") for f in fixed) else kind
        nodes[stack[-1]].children += 1
        nodes.append(Node(tag, stack[-1], fixed, kind, gold))
        if not attributes.endswith("/"):
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    if at < len(page):
        keep(page[at:])
    flush()
    shaped(nodes)
    return nodes, runs


def inside_other(nodes: list[Node], i: int) -> bool:
    """Whether a block or what it stands in is called something else than content by its name or tag."""
    while i > 0:
        if nodes[i].kind == "bad":
            return True
        i = nodes[i].parent
    return False


def is_prose(nodes: list[Node], i: int) -> bool:
    """Whether a block has sentences of its own, few of them linked, outside of all that is called something else."""
    x = nodes[i]
    if x.words < 8 or 2 * x.linked > x.words or x.children > 2 or not x.stops and x.words < 20:
        return False
    return not inside_other(nodes, i)


def level(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def shaped(nodes: list[Node]) -> None:
    """Sets the features that a node's subtree, siblings and place give."""
    n = len(nodes)
    words, linked, stops, blocks = ([getattr(x, c) for x in nodes] for c in ("words", "linked", "stops", "children"))
    before, at = [0] * n, 0
    for i, x in enumerate(nodes):
        before[i], at = at, at + x.words
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        words[p] += words[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        blocks[p] += blocks[i]
    alike: Counter[tuple[int, str]] = Counter((x.parent, x.tag) for x in nodes)
    for i, x in enumerate(nodes):
        w = words[i]
        out = [f"holds {level(w, 1, 4, 12, 40, 150)}", f"place {level(before[i], *(at * f for f in (0.05, 0.25, 0.6, 0.9))) if at else 0}"]
        if w:
            out.append(f"density {level(linked[i] / w, 0.02, 0.25, 0.6)}")
            out.append(f"stops {level(stops[i], 1, 3, 8)} holds {level(w, 12, 60)}")
            out.append(f"blocks {level(w / (blocks[i] + 1), 4, 10, 25)}")
        if alike[x.parent, x.tag] > 2:
            out.append("repeated")
        x.shape = tuple(out)


def features(node: Node) -> list[str]:
    out = [*node.fixed, *node.shape]
    w = node.words
    out.append("words 0" if not w else "words few" if w < 4 else "words some" if w < 12 else "words many" if w < 40 else "words long")
    if w:
        out.append("links none" if not node.linked else "links some" if 2 * node.linked < w else "links most")
    elif node.children:
        out.append("container")
    return out


class TreeModel:
    """Unary weights by feature and parent-child potentials by the parent's kind."""

    def __init__(self, unary: dict[str, float] | None = None, edge: dict[str, list[float]] | None = None):
        self.unary = unary or {}
        self.edge = edge or {}  #: kind -> potentials of (parent, child) = 00, 01, 10, 11

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[list[float]]]:
        """Of each node being content; of each node's (parent, child) states."""
        unary, n = self.unary, len(nodes)
        own = [sum([unary.get(f, 0.0) for f in features(x)]) for x in nodes]  # log-odds of content
        edges = [self.edge.get(nodes[x.parent].kind, ZERO) if x.parent >= 0 else ZERO for x in nodes]
        up = own[:]  # with what has come from the children
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            e, b = edges[i], up[i]
            sent[i] = soft(e[2], e[3] + b) - soft(e[0], e[1] + b)
            up[nodes[i].parent] += sent[i]
        belief = up[:]
        pairs: list[list[float]] = [ZERO] * n
        for i in range(1, n):
            e, b, p = edges[i], up[i], nodes[i].parent
            outside = belief[p] - sent[i]
            belief[i] = b + soft(e[1], e[3] + outside) - soft(e[0], e[2] + outside)
            scores = (e[0], e[1] + b, e[2] + outside, e[3] + b + outside)
            top = max(scores)
            mass = [exp(x - top) for x in scores]
            total = sum(mass)
            pairs[i] = [x / total for x in mass]
        return [logistic(b) for b in belief], pairs

    def fit(self, pages: list[str], epochs: int = 12, rate: float = 0.15, decay: float = 1e-4) -> TreeModel:
        trees = [parsed(p)[0] for p in pages]
        order = random.Random(1)
        for epoch in range(epochs):
            step = rate / (1 + epoch / 3)
            order.shuffle(trees)
            for nodes in trees:
                p, pairs = self.marginals(nodes)
                for i, x in enumerate(nodes):
                    error = float(x.gold) - p[i]
                    if abs(error) > 1e-4:
                        for f in features(x):
                            w = self.unary.get(f, 0.0)
                            self.unary[f] = w + step * (error - decay * w)
                    if i:
                        e = self.edge.setdefault(nodes[x.parent].kind, [0.0] * 4)
                        truth = 2 * nodes[x.parent].gold + x.gold
                        for k in range(4):
                            e[k] += step * ((k == truth) - pairs[i][k] - decay * e[k])
        return self

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, runs = parsed(page)
        if len(nodes) == 1:
            return "\n\n".join(text for _, text in runs)
        content = self.marginals(nodes)[0]
        kept = {i for i, _ in runs if content[i] >= 0.5}
        if not kept and (prose := {i for i, _ in runs if is_prose(nodes, i)}):
            # No page with prose is empty: then half of the likeliest prose's marginal sets the measure.
            least = max(content[i] for i in prose) / 2
            kept = {i for i, _ in runs if content[i] >= least and not inside_other(nodes, i)}
        return "\n\n".join(text for i, text in runs if i in kept)


ZERO = [0.0, 0.0, 0.0, 0.0]


def soft(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))


def logistic(x: float) -> float:
    return 1 / (1 + exp(-x)) if x >= 0 else exp(x) / (1 + exp(x))


#: Names that tell nothing, and names whose words belong to other parts of a page.
NEUTRAL = ["box", "col-2", "block", "c1", "row wide", "inner", "panel", "module x"]
MISLEADING = ["related", "with-sidebar", "widget-area", "post-comments-open", "has-ads", "more", "nav-target", "share-ready", "top-header"]


def example_pages(n: int = 1000, seed: int = 3) -> list[str]:
    """Labelled pages of varied layouts; content elements carry data-main="1"."""
    r = random.Random(seed)
    letters = "etaoinshrdlu"

    def words(low: int, high: int) -> str:
        text = " ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(r.randint(low, high)))
        return text.capitalize() + r.choice(["", ".", ".", "!"])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def block(tag: str, gold: bool, low: int, high: int, attributes: str = "") -> str:
        text = words(low, high)
        if r.random() < 0.2:
            text = f"<b>{text}" + r.choice(["</b>", "<br>"])
        if gold and r.random() < 0.15:
            text += f' <a href="/x">{words(1, 3)}</a> {words(2, 9)}'
        return f"<{tag}{attributes}{' data-main=1' if gold else ''}>{text}" + r.choice([f"</{tag}>", f"</{tag}>", "" if tag in ("p", "li") else f"</{tag}>"])

    def boilerplate(kind: str) -> str:
        tag, name = {
            "nav": (r.choice(["nav", "div", "ul"]), r.choice(["menu", "navbar", "breadcrumb", ""])),
            "ad": ("div", r.choice(["ad", "ads", "advert", "promo-box", "sponsored", "banner"])),
            "head": (r.choice(["header", "div"]), r.choice(["header", "masthead", "topbar"])),
            "foot": (r.choice(["footer", "footer", "div"]), r.choice(["footer", "site-footer", "copyright"])),
            "side": (r.choice(["aside", "div"]), r.choice(["sidebar", "related", "widget", "trending"])),
            "notice": ("div", r.choice(["cookie-notice", "consent", "newsletter", "popup", "alert"])),
            "comment": (r.choice(["section", "div", "ol"]), r.choice(["comments", "comment-list", "replies", "reader-comments"])),
            "form": (r.choice(["form", "form", "div"]), r.choice(["search", "login-form", "signup", "contact-form"])),
            "share": ("div", r.choice(["share", "social", "tags", "byline"])),
        }[kind]
        if r.random() < 0.15:
            name = r.choice(NEUTRAL)
        how = f' class="{name}"' if name and (tag in ("div", "section", "ol", "ul") or r.random() < 0.4) else ""
        if tag in ("div", "ul", "section", "ol") and not how and kind == "nav":
            tag = "nav"
        if kind == "nav":
            inner = links(r.randint(2, 9)) if tag == "ul" else f"<ul>{links(r.randint(2, 9))}</ul>"
        elif kind == "comment":
            child = "li" if tag == "ol" else r.choice(["p", "div", "article"])
            inner = "".join(r.choice(["<h2>Comments</h2>", ""]) + block(child, False, 1, 40, r.choice(["", ' class="comment"'])) for _ in range(r.randint(1, 5)))
        elif kind == "side":
            inner = block("h3", False, 1, 4) + "".join(r.choice([block("p", False, 2, 40), f"<ul>{links(3)}</ul>"]) for _ in range(r.randint(1, 3)))
        elif kind == "foot" and r.random() < 0.4:
            inner = block("p", False, 3, 14) + r.choice(["", f"<ul>{links(r.randint(2, 6))}</ul>"])
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input><p>{words(1, 12)}</p><button>{words(1, 2)}</button>"
        else:
            inner = r.choice([words(1, 30), block("p", False, 1, 30), f"{words(1, 12)} &middot; <a href='/'>{words(1, 3)}</a>", block("h2", False, 1, 6) + words(2, 10)])
        return f"<{tag}{how}>{inner}</{tag}>"

    def prose(low: int, high: int) -> str:
        """A paragraph, now and then with some links or a button between its words."""
        kind = r.random()
        if kind < 0.8:
            return block("p", True, low, high)
        if kind < 0.9:
            return f"<p data-main=1>{words(low, high)}<button>{words(1, 2)}</button> {words(2, 12)}</p>"
        return "<p data-main=1>" + " ".join(f'{words(4, 9)} <a href="/{i}">{words(1, 4)}</a>' for i in range(r.randint(2, 4))) + f" {words(3, 12)}</p>"

    def wrapped(parts: list[str]) -> str:
        """Content inside neutral elements, up to three of them."""
        out = "".join(parts)
        for _ in range(r.choice([1, 1, 2, 3])):
            tag = r.choice(["div", "div", "section"])
            out = f"<{tag}{r.choice(['', '', f' class="{r.choice(NEUTRAL)}"', f' class="{r.choice(MISLEADING)}"'])} data-main=1>{out}</{tag}>"
        return out

    pages = []
    for _ in range(n):
        few = r.random() < 0.4
        body = [block(r.choice(["h1", "h1", "h2"]), True, 1, 14)] if r.random() < (0.4 if few else 0.8) else [prose(12, 60)]
        headed = not body[0].startswith("<p")
        for _ in range(r.randint(headed, 2) if few else r.randint(1, 14)):
            kind = r.random()
            if few and kind < 0.9:
                body.append(prose(10, 60))
            elif kind < 0.7:
                body.append(prose(1, r.choice([3, 12, 60, 120])))
            elif kind < 0.74:
                body.append("<dl data-main=1>" + "".join(block("dt", True, 1, 4) + block("dd", True, 2, 25) for _ in range(r.randint(1, 4))) + "</dl>")
            elif kind < 0.8:
                body.append(block(r.choice(["h2", "h3"]), True, 1, 8))
            elif kind < 0.86:
                body.append("<ul data-main=1>" + "".join(block("li", True, 1, 20) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote data-main=1>{r.choice([words(4, 40), block('p', True, 4, 40)])}</blockquote>")
            elif kind < 0.92:
                body.append("<table data-main=1><tr data-main=1>" + block("td", True, 1, 6) + block("td", True, 1, 6) + "</tr></table>")
            elif kind < 0.94:
                body.append(block("pre", True, 3, 20))
            else:
                body.append(boilerplate(r.choice(["ad", "share", "notice", "side"])))
        if r.random() < 0.4:
            i, j = sorted((r.randint(0, len(body)), r.randint(0, len(body))))
            kept, body = body, body[:i] + ([wrapped(body[i:j])] if i < j else []) + body[j:]
            headed = headed and body[0] == kept[0]
        if r.random() < 0.25:
            body.append(boilerplate("comment"))
        if headed and r.random() < 0.2:
            body[0] = f"<header data-main=1>{body[0]}{r.choice(['', block('p', False, 2, 6), boilerplate('share')])}</header>"
        elif headed and r.random() < 0.15:
            body.insert(0, f"<header>{body.pop(0)}</header>".replace("<header>", "<div data-main=1>").replace("</header>", "</div>"))
        if r.random() < 0.15:
            body.append(f"<footer>{r.choice([words(2, 8), block('p', False, 2, 12)])}</footer>")
        inner = "".join(body)
        wrap = r.random()
        if wrap < 0.45:
            inner = f"<article{r.choice(['', '', f' class={r.choice(MISLEADING)}'])} data-main=1>{inner}</article>"
        elif wrap < 0.6:
            inner = f"<main data-main=1><article data-main=1>{inner}</article></main>"
        elif wrap < 0.8:
            inner = f'<div class="{r.choice(["content", "post", "entry-content", "story", "main-text"])} {r.choice(["", r.choice(MISLEADING)])}" data-main=1>{inner}</div>'
        elif wrap < 0.84:
            inner = wrapped([inner])
        elif wrap < 0.94:
            inner = f'<div{r.choice(["", f' class="{r.choice(NEUTRAL)}"', f' class="article-body {r.choice(MISLEADING)}"', f' class="{r.choice(MISLEADING)}"'])} data-main=1>{inner}</div>'
        before = [boilerplate(k) for k in ("head", "nav", "notice", "ad", "form") if r.random() < 0.55]
        after = [boilerplate(k) for k in ("side", "comment", "ad", "form", "share", "foot", "notice") if r.random() < 0.5]
        pages.append("<html><head><title>x</title></head><body>" + "".join(before) + inner + "".join(after) + "</body></html>")
    return pages


def learn(pages: list[str] | None = None) -> TreeModel:
    """A model trained on labelled pages, by default the examples."""
    return TreeModel().fit(example_pages() if pages is None else pages)


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or learn()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page."""
    return extract(table(spark, sf_dir, "pages"))
