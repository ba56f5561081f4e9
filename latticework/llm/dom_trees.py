"""Main text of web pages: boosted trees over the nodes of a page, decoded from the top down."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is learned from: so many pages, of each so many characters at most, and so many layouts made of their blocks.
SAMPLE, SAMPLE_CHARS, LAYOUTS = 200, 200_000, 1000
#: Trees, their depth and rate, steps of a number's scale, penalty on leaves, seed.
TREES, DEPTH, RATE, STEPS, PENALTY, SEED = 80, 5, 0.25, 24, 2.0, 11
#: A page of more nodes weighs as much as one of so many.
ALIKE = 60
#: Attribute tokens and tags that are features of a node, and of what it stands in.
TOKENS = 184
#: Characters of pages, about, whose nodes are scored at once.
AT_ONCE = 1 << 22
MARK = "\ue000"

#: Elements with a box of their own, those without content, those whose content is never text of a
#: page, and the open elements that a new one ends, up to the elements they can't leave.
BLOCKS = frozenset("html body head div p section article main aside header footer nav ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption form fieldset legend address details summary dialog center menu dir hgroup search".split())
EMPTY = frozenset("br hr img input meta link area base col embed source track wbr".split())
UNREAD = frozenset("script style title textarea noscript template iframe object svg math select button noframes xmp canvas audio video".split())
ENDED = {t: (("li",), ("ul", "ol", "menu", "dir")) for t in ("li",)} | {t: (("dt", "dd"), ("dl",)) for t in ("dt", "dd")} | {"tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def tokens_of(tag: str, attributes: str) -> list[str]:
    """A node's tokens: its tag, and the words of its class, id, role and the like."""
    out = [f"<{tag}>"]
    if "=" in attributes or "hidden" in attributes:
        for name, *values in NAMED.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "style":
                out += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
            elif name == "hidden":
                out.append("hidden")
            else:
                out += [w.lower().rstrip("s") if len(w) > 3 else w.lower() for w in PART.findall(value)]
    return out


class Page:
    """A page's nodes in order: boxes and, as their leaves, runs of text."""

    __slots__ = ("parent", "end", "depth", "own", "within", "texts", "linked", "inputs", "images")

    def __init__(self):
        self.parent, self.end, self.depth, self.own, self.within, self.texts, self.linked = [], [], [], [], [], [], []
        self.inputs, self.images = Counter(), Counter()


def parse(html: str, bits: dict[str, int], seen: Counter | None = None) -> Page:
    """The nodes of a page. Open elements end as browsers end them; comments, scripts, styles and
    controls are left out; a page may stop anywhere. Texts have references decoded and white
    space as one space. seen: counts the tokens of its nodes."""
    page, stack, open_, run, read = Page(), [], Counter(), [], {}
    state = {"a": -1, "linked": 0}

    def add(own: int, text: str | None) -> int:
        i, up = len(page.parent), stack[-1][0] if stack else -1
        page.parent.append(up)
        page.end.append(i + 1)
        page.depth.append(page.depth[up] + 1 if up >= 0 else 0)
        page.own.append(own)
        page.within.append(own | (page.within[up] if up >= 0 else 0))
        page.texts.append(text)
        page.linked.append(0)
        return i

    def flush() -> None:
        if run:
            text = "".join(run)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                i = add(page.own[stack[-1][0]] if stack else 0, text)
                page.linked[i] = state["linked"]
            run.clear()
            state["linked"] = 0

    def leave(k: int) -> None:
        """Ends the open elements from the k-th on."""
        flush()
        while len(stack) > k:
            i, name = stack.pop()
            open_[name] -= 1
            page.end[i] = len(page.parent)
        if state["a"] > len(stack):
            state["a"] = -1

    def said(part: str) -> None:
        if part:
            run.append(part)
            if state["a"] >= 0:
                state["linked"] += len(part)

    at = 0
    while True:
        m = TAG.search(html, at)
        said(html[at : m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if not closing and name in UNREAD:
            if name in ("button", "select", "textarea") and stack:
                page.inputs[stack[-1][0]] += 1
            if not attributes.rstrip().endswith("/"):
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                at = stop.start() if stop else len(html)
                said(" ") if name in ("svg", "math") else None
            continue
        if name in EMPTY:
            if name == "br":
                said(" ")
            elif name == "hr":
                flush()
            elif name == "input" and stack:
                page.inputs[stack[-1][0]] += 1
            elif name == "img" and stack:
                page.images[stack[-1][0]] += 1
        elif name in BLOCKS or "-" in name:
            if closing:
                if open_[name] and name not in ("html", "body"):
                    leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == name))
                elif name != "p":
                    flush()
                continue
            if name in ("html", "body") and open_[name]:
                continue
            flush()
            if stack and stack[-1][1] == "p":
                leave(len(stack) - 1)
            if name in ENDED:
                ends, stays = ENDED[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][1] in ends:
                        leave(k)
                    if k < len(stack) and stack[k][1] in stays:
                        break
            if (name, attributes) not in read:
                read[name, attributes] = tokens_of(name, attributes)
            own = 0
            for t in read[name, attributes]:
                own |= bits.get(t, 0)
            if seen is not None:
                seen.update(set(read[name, attributes]))
            i = add(own, None)
            stack.append((i, name))
            open_[name] += 1
        elif name == "a":
            state["a"] = -1 if closing else len(stack)
    leave(0)
    return page


#: Signs of prose, counted in a run of text.
PROSE, DIGITS = ".,;!?:。、，", "0123456789"
NUMBERS = ("chars", "words", "link_share", "prose", "digits", "leaves", "per_leaf", "nodes", "per_node", "inputs", "images", "depth", "leaf", "nth", "siblings", "last", "share", "place", "up_links", "up_chars", "up_per_leaf", "before_chars", "before_links", "after_chars", "after_links", "holds_sign", "page_chars", "under")


def numbers(pages: list[Page]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The numeric features of all nodes, and the arrays of what decoding needs."""
    sizes = np.array([len(p.parent) for p in pages], np.int64)
    start = np.repeat(sizes.cumsum() - sizes, sizes)
    n = len(start)
    flat = lambda name, kind=np.int64: np.array([x for p in pages for x in getattr(p, name)], kind)
    parent, end, depth = flat("parent"), flat("end") + start, flat("depth")
    root = parent < 0
    parent = np.where(root, np.arange(n), parent + start)
    texts = [t for p in pages for t in p.texts]
    counts = np.array([(len(t), t.count(" ") + 1, sum(map(t.count, PROSE)), sum(map(t[:200].count, DIGITS)), 1, "©" in t or "|" in t) if t is not None else (0, 0, 0, 0, 0, 0) for t in texts], np.float64).reshape(n, 6)
    held = np.zeros((n, 2))
    for p, i in zip(pages, sizes.cumsum() - sizes):
        for k, of in enumerate((p.inputs, p.images)):
            for node, times in of.items():
                held[i + node, k] = times
    counts = np.concatenate((counts, flat("linked", np.float64)[:, None], held, np.ones((n, 1))), axis=1)
    before = np.concatenate((np.zeros((1, 10)), counts.cumsum(axis=0)))
    chars, words, prose, digits, leaves, sign, linked, inputs, images, nodes = (before[end] - before[:-1]).T
    total = (before[np.repeat(sizes.cumsum(), sizes)] - before[start])[:, 0]
    links = linked / np.maximum(chars, 1)
    order = np.lexsort((np.arange(n), np.where(root, -1 - start, parent)))
    family = np.where(root, -1 - start, parent)[order]
    fresh = np.concatenate(([True], family[1:] != family[:-1])) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    many = np.bincount(first, minlength=n)[first]
    nth, siblings = np.empty(n), np.empty(n)
    nth[order], siblings[order] = np.arange(n) - first, many
    beside = {}
    for name, values in (("chars", np.log1p(chars)), ("links", links)):
        lined = values[order]
        prior, later = np.full(n, -1.0), np.full(n, -1.0)
        prior[order[1:]] = np.where(fresh[1:], -1, lined[:-1])
        later[order[:-1]] = np.where(fresh[1:], -1, lined[1:])
        beside |= {f"before_{name}": prior, f"after_{name}": later}
    own = {
        "chars": np.log1p(chars), "words": np.log1p(words), "link_share": links, "prose": prose / np.maximum(words, 1), "digits": digits / np.maximum(np.minimum(chars, 200 * leaves), 1),
        "leaves": np.log1p(leaves), "per_leaf": np.log1p(words / np.maximum(leaves, 1)), "nodes": np.log1p(nodes), "per_node": np.log1p(chars / nodes), "inputs": inputs, "images": images,
        "depth": depth, "leaf": counts[:, 4], "nth": nth, "siblings": np.log1p(siblings), "last": siblings - nth, "share": chars / np.maximum(chars[parent], 1),
        "place": (before[:-1, 0] - before[start, 0]) / np.maximum(total, 1), "up_links": links[parent], "up_chars": np.log1p(chars[parent]), "up_per_leaf": np.log1p(words[parent] / np.maximum(leaves[parent], 1)),
        "holds_sign": sign, "page_chars": np.log1p(total), "under": chars / np.maximum(total, 1),
    } | beside
    return np.stack([own[k] for k in NUMBERS], axis=1).astype(np.float32), {"parent": parent, "root": root, "end": end, "depth": depth}


def masks(pages: list[Page], name: str) -> np.ndarray:
    """Bits of nodes' tokens as bytes, a row a node."""
    size = TOKENS // 8 + 1
    return np.frombuffer(b"".join([x.to_bytes(size, "little") for p in pages for x in getattr(p, name)]), np.uint8).reshape(-1, size)


class Trees:
    """Boosted trees: each a full one of DEPTH levels, of a feature and a step at each node."""

    def __init__(self, bits: dict[str, int]):
        self.bits = bits

    def columns(self, pages: list[Page], x: np.ndarray) -> np.ndarray:
        """Features as small integers: steps of numbers, then bits of own and of enclosing tokens."""
        found = np.empty((len(x), len(NUMBERS)), np.uint8)
        for k, steps in enumerate(self.steps):
            found[:, k] = np.searchsorted(steps, x[:, k])
        parts = [found]
        for name in ("own", "within"):
            parts.append(np.unpackbits(masks(pages, name), axis=1, bitorder="little", count=len(self.bits)))
        return np.concatenate(parts, axis=1)

    def fit(self, pages: list[Page], x: np.ndarray, y: np.ndarray) -> list[float]:
        """Newton boosting of the logistic loss; returns the loss after each tree. Nodes of a page
        with more than ALIKE of them weigh less, so that no page outweighs the rest."""
        sizes = np.array([len(p.parent) for p in pages])
        weight = np.repeat(np.minimum(1, ALIKE / np.maximum(sizes, 1)), sizes)
        self.steps = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, STEPS + 1)[1:-1])).astype(np.float32) for k in range(x.shape[1])]
        data = self.columns(pages, x)
        n, m = len(NUMBERS), data.shape[1]
        binary = data[:, n:].astype(np.float32)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, losses = np.full(len(y), self.base), []
        self.features, self.cuts, self.values = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * p * (1 - p)
            at = np.zeros(len(y), np.int64)
            features, cuts = [], []
            for depth in range(DEPTH):
                k = 1 << depth
                spread = np.zeros((len(y), k), np.float32)
                spread[np.arange(len(y)), at] = 1
                both = np.concatenate((spread * g[:, None].astype(np.float32), spread * h[:, None].astype(np.float32)), axis=1)
                sums = both.sum(axis=0)
                gt, ht = sums[:k, None, None], sums[k:, None, None]
                # Sums over what goes right of each step, for numbers and for bits.
                right = np.zeros((2, k, m, STEPS), np.float32)
                for f in range(n):
                    for j, w in enumerate((g, h)):
                        hist = np.bincount(at * (STEPS + 1) + data[:, f], weights=w, minlength=k * (STEPS + 1)).reshape(k, -1)
                        right[j, :, f] = hist[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
                ones = binary.T @ both
                right[0, :, n:, 0], right[1, :, n:, 0] = ones[:, :k].T, ones[:, k:].T
                gr, hr = right
                gain = gr**2 / (hr + PENALTY) + (gt - gr) ** 2 / (ht - hr + PENALTY)
                gain[(hr < 1) | (ht - hr < 1)] = -1
                best = gain.reshape(k, -1).argmax(axis=1)
                feature, cut = best // STEPS, best % STEPS
                cut[gain.reshape(k, -1).max(axis=1) <= 0] = 255  # nothing goes right
                features.append(feature)
                cuts.append(cut)
                at = 2 * at + (data[np.arange(len(y)), feature[at]] > cut[at])
            gs, hs = (np.bincount(at, weights=w, minlength=1 << DEPTH) for w in (g, h))
            value = -RATE * gs / (hs + PENALTY)
            score = score + value[at]
            self.features.append(features)
            self.cuts.append(cuts)
            self.values.append(value)
            losses.append(float(np.mean(np.logaddexp(0, np.where(y > 0, -score, score)))))
        return losses

    def scores(self, pages: list[Page], x: np.ndarray) -> np.ndarray:
        """Log odds that a node holds main text."""
        data, out = self.columns(pages, x), np.full(len(x), self.base)
        own = np.arange(len(x))
        data, wide = data.ravel(), data.shape[1]
        own = own * wide
        for features, cuts, value in zip(self.features, self.cuts, self.values):
            at = np.zeros(len(x), np.int32)
            for feature, cut in zip(features, cuts):
                at = 2 * at + (data[own + feature[at]] > cut[at])
            out += value[at]
        return out


def decode(odds: np.ndarray, at: dict[str, np.ndarray]) -> np.ndarray:
    """Which nodes hold main text: the likeliest choice in which a node does only if all it
    stands in do. Subtrees are weighed from the deepest level up, then chosen from the top."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    sums = np.concatenate(([0], no.cumsum()))
    none = sums[at["end"]] - sums[:-1]
    order = np.argsort(at["depth"], kind="stable")
    cuts = np.searchsorted(at["depth"][order], np.arange(at["depth"].max() + 2)) if len(odds) else [0]
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    with_ = yes.copy()
    for some in levels[:0:-1]:
        np.add.at(with_, at["parent"][some], np.maximum(with_[some], none[some]))
    kept = with_ > none
    for some in levels[1:]:
        kept[some] &= kept[at["parent"][some]]
    return kept


def kept_texts(pages: list[Page], trees: Trees) -> list[str]:
    x, at = numbers(pages)
    kept, out, i = decode(trees.scores(pages, x), at), [], 0
    for p in pages:
        out.append("\n".join(t for t, k in zip(p.texts, kept[i : i + len(p.texts)].tolist()) if k and t is not None))
        i += len(p.texts)
    return out


#: What layouts call the parts of a page, in words that sites use.
NAMES = {
    "main": "content main main-content post post-body post-content entry entry-content article article-body article-text story story-body text body-text single page-content body prose",
    "nav": "nav navbar menu main-menu navigation site-nav breadcrumb breadcrumbs topnav tabs pagination pager toc skip-links",
    "header": "header site-header masthead topbar top-bar banner brand logo-bar branding",
    "footer": "footer site-footer page-footer copyright legal colophon bottom credits imprint",
    "side": "sidebar side aside widget widgets related related-posts recommended rail secondary popular trending more-stories tag-cloud most-read",
    "ad": "ad ads advert advertisement ad-slot sponsor sponsored promo banner-ad adsbygoogle promotion teaser commercial",
    "notice": "notice cookie cookie-notice cookie-consent consent gdpr alert warning modal popup overlay disclaimer notification announcement paywall banner-message",
    "form": "newsletter subscribe signup login search-form contact-form search poll survey register",
    "share": "share social share-buttons sharing follow social-links tools toolbar print",
    "comments": "comments comment-list discussion responses replies comment-section respond disqus reader-comments reactions feedback user-comments",
}
NAMES = {k: v.split() for k, v in NAMES.items()}


def layout(rnd: random.Random, blocks: list[str]) -> str:
    """A page of some layout made of the given blocks, its main text marked."""
    chosen = lambda part: rnd.choice(NAMES[part])
    text = lambda least=1, most=30: entities.escape(" ".join(rnd.choice(blocks).split()[: rnd.randint(least, most)]) or "-")

    def box(part: str, tags: str, inner: str, always: bool = False) -> str:
        tag = rnd.choice(tags.split())
        bare = tag in ("nav", "footer", "header", "aside", "article", "main", "form") and rnd.random() < 0.5
        named = "" if bare and not always else f' {rnd.choice(("class", "class", "id", "class"))}="{chosen(part)}{rnd.choice(("", "", " col-8", " clearfix", " js-x", "-wrapper", " block"))}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    link = lambda: f'<a href="/{rnd.randint(1, 99)}">{text(1, 5)}</a>'
    listed = lambda n: "<ul>" + "".join(f"<li>{link()}{rnd.choice(('', '</li>'))}" for _ in range(n)) + "</ul>"
    heading = lambda: rnd.choice(("", f"<h3>{text(1, 3)}</h3>", f"<h2>{text(1, 4)}</h2>"))
    form = lambda: box("form", "form div section", f"{rnd.choice((text(1, 12), f'<p>{text(2, 15)}</p>', f'<label>{text(1, 3)}</label>', f'<label>{text(1, 2)}</label><input name=m><label>{text(1, 2)}</label>', f'<div><label>{text(1, 2)}</label></div>'))}<input name=q>{rnd.choice(('', '<button>Go</button>', '<input type=submit>'))}", True)
    ad = lambda: box("ad", "div div section aside p", rnd.choice((text(2, 20), f"<p>{text(2, 25)}</p>", f"{link()} {text(1, 9)}", f"<img src=x>{text(2, 9)}")), True)
    notice = lambda: box("notice", "div div section p aside", rnd.choice((text(3, 30), f"<p>{text(3, 30)}</p>{link()}", f"<p>{text(3, 25)}</p><button>OK</button>")), True)
    share = lambda: box("share", "div ul section", "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 5))), True)
    nav = lambda: box("nav", "nav nav div ul", rnd.choice((listed(rnd.randint(2, 9)), " ".join(link() for _ in range(rnd.randint(2, 8))), " &gt; ".join(link() for _ in range(3)))))
    side = lambda: box("side", "aside aside div section", "".join(heading() + rnd.choice((listed(rnd.randint(2, 8)), f"<p>{text(3, 30)}</p>", f"<div>{text(2, 20)} {link()}</div>")) for _ in range(rnd.randint(1, 3))))

    def comments() -> str:
        outer, inner = rnd.choice((("ol", "li"), ("ul", "li"), ("div", "div"), ("div", "article"), ("section", "div")))
        one = lambda: f"<{inner}{rnd.choice((' class=comment', ' class=\"comment even\"', ' class=reply', ''))}>{rnd.choice((f'<b>{text(1, 2)}</b>', f'<cite>{text(1, 2)}</cite>', f'<div class=author>{text(1, 2)}</div>', ''))}{rnd.choice((f'<p>{text(2, 60)}</p>', f'<p>{text(2, 40)}</p><p>{text(2, 40)}</p>', text(2, 40)))}</{inner}>"
        return f'<{outer} {rnd.choice(("class", "id"))}="{chosen("comments")}">{heading()}{"".join(one() for _ in range(rnd.randint(1, 6)))}</{outer}>' + (form() if rnd.random() < 0.3 else "")

    def main() -> str:
        out = []
        if rnd.random() < 0.8:
            title = f"<h1>{MARK}{text(1, 12)}</h1>"
            out.append(f"<header>{title}</header>" if rnd.random() < 0.15 else title)
        if rnd.random() < 0.2:
            out.append(f"<{(t := rnd.choice(('p', 'div')))} class={rnd.choice(('byline', 'meta', 'dek', 'date', 'lead', 'author'))}>{MARK}{text(2, 9)}</{t}>")
        many = rnd.choice((1, 1, 2, 3, 5, 8, 13, 21))
        style = rnd.choice(("p", "p", "p", "p", "div", "bare", "loose"))
        for _ in range(many):
            said = MARK + text(1, rnd.choice((4, 12, 60, 400)))
            kind = rnd.random()
            if kind < 0.05:
                out.append(f"<h2>{MARK}{text(1, 6)}</h2>")
            elif kind < 0.08:
                out.append("<ul>" + "".join(f"<li>{MARK}{text(1, 15)}</li>" for _ in range(rnd.randint(2, 6))) + "</ul>")
            elif kind < 0.1:
                out.append(f"<blockquote><p>{said}</p></blockquote>")
            elif kind < 0.12:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{text(1, 4)}</td><td>{MARK}{text(1, 8)}</td></tr>" for _ in range(rnd.randint(2, 5))) + "</table>")
            elif kind < 0.14:
                out.append(f"<figure><img src=y><figcaption>{MARK}{text(2, 12)}</figcaption></figure>")
            elif kind < 0.16:
                out.append(f"<pre>{said}</pre>")
            if style == "p":
                out.append(f"<p>{said}</p>")
            elif style == "div":
                out.append(f"<div>{said}</div>")
            elif style == "bare":
                out.append(f"{said}<br><br>")
            else:
                out.append(rnd.choice((f"<p><b>{said}<br>", f"<p>{said}", f"<p>{said} {link()} {text(1, 9)}</p>")))
            if rnd.random() < 0.12:
                out.append(rnd.choice((ad, share, side, form, notice))())
        if rnd.random() < 0.15:
            out.append(box("footer", "footer footer div", rnd.choice((f"{text(1, 3)} {link()}", f"<span>{text(1, 4)}</span>", f"<p>{text(2, 9)}</p>", listed(2)))))
        inner = "".join(out)
        if rnd.random() < 0.3:
            inner = f"<div>{inner}</div>"
        made = box("main", "article article main main div div section td", inner)
        if not made.startswith("<td"):
            return made
        cells = [box("nav", "td", " ".join(link() for _ in range(rnd.randint(2, 6))), True)] * (rnd.random() < 0.5) + [made] + [box("side", "td", text(3, 30), True)] * (rnd.random() < 0.5)
        return f"<table><tr>{''.join(cells)}</tr></table>"

    parts = []
    for chance, part in ((0.5, lambda: box("header", "header div", rnd.choice((text(1, 4), f"<h1>{text(1, 4)}</h1>", f"<p>{text(1, 8)}</p>", nav(), f"{link()}{form()}")))), (0.75, nav), (0.25, notice), (0.4, ad), (0.25, side)):
        parts += [part()] if rnd.random() < chance else []
    own = [main()]
    for chance, part in ((0.25, share), (0.35, comments), (0.2, ad), (0.15, form)):
        own += [part()] if rnd.random() < chance else []
    if rnd.random() < 0.4:
        own = [f"<{(t := rnd.choice(('div', 'main', 'section')))}{rnd.choice(('', ' class=container', ' id=wrapper', ' class=row', ' id=page'))}>{''.join(own)}{side() if rnd.random() < 0.4 else ''}</{t}>"]
    parts += own
    for chance, part in ((0.3, side), (0.15, comments), (0.15, notice), (0.7, lambda: box("footer", "footer div", rnd.choice((f"&copy; {text(1, 9)}", f"<p>{text(2, 14)}</p>", nav(), f"&copy; {link()} | {text(1, 12)}"))))):
        parts += [part()] if rnd.random() < chance else []
    return f"<html><head><title>x</title></head><body>{''.join(parts)}{rnd.choice(('</body></html>', '', '</body></html>'))}"


INSIDE = ("<article>", "<main>")
OUTSIDE = ("<nav>", "<aside>", "<footer>", "<form>")


def learned(sample: list[str], seed: int = SEED) -> Trees | None:
    """Trees from a sample of pages: from layouts made of the pages' own blocks, in which it is
    known what is main text, and from the pages themselves where an article or main element
    tells. None if no page has any text."""
    rnd = random.Random(seed)
    plain = {t: 1 << k for k, t in enumerate((*INSIDE, *OUTSIDE))}
    first = [parse(h, plain) for h in sample]
    blocks = sorted({t for p in first for t, linked in zip(p.texts, p.linked) if t and linked * 2 < len(t)})
    if not blocks:
        return None
    inside, outside = (sum(plain[t] for t in of) for of in (INSIDE, OUTSIDE))
    made = [layout(rnd, blocks) for _ in range(LAYOUTS)]
    told = [(h, p) for h, p in zip(sample, first) if any(w & inside for w in p.within)]
    seen: Counter = Counter()
    for h in [*made, *(h for h, _ in told)]:
        parse(h, {}, seen)
    often = sorted((t for t, n in seen.items() if n >= 5), key=lambda t: (-seen[t], t))[:TOKENS]
    bits = {t: 1 << k for k, t in enumerate(often)}
    pages, labels = [], []
    for h in made:
        pages.append(parse(h, bits))
        labels += marks(pages[-1], [t is not None and MARK in t for t in pages[-1].texts])
    for h, p in told:
        pages.append(parse(h, bits))
        labels += marks(p, [t is not None and bool(w & inside) and not w & outside for t, w in zip(p.texts, p.within)])
    for p in pages:
        p.texts = [t and t.replace(MARK, "") for t in p.texts]
    trees = Trees(bits)
    trees.losses = trees.fit(pages, numbers(pages)[0], np.array(labels, np.float64))
    return trees


def marks(page: Page, leaves: list[bool]) -> list[bool]:
    """Nodes that hold a marked leaf."""
    sums = np.concatenate(([0], np.cumsum(leaves)))
    return (sums[page.end] > sums[:-1]).tolist()


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: (page_id, url, text, n_chars), text being the blocks of the
    article in page order, joined by line feeds.

    Null or empty html, and pages without main text, have an empty text. Null ids and urls and
    repeated rows are kept; an empty table gives an empty result; other columns are ignored.
    Whole pages are read, however long and wherever they stop; nothing is shuffled. Trees are
    learned on the driver from at most SAMPLE pages, the first by a hash of id and url, of each
    at most SAMPLE_CHARS characters; a task needs memory for its longest page.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    by = F.xxhash64("page_id", "url")
    last = rows.where("html <> ''").select(by.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    found = [] if last is None else [r.html for r in rows.where((by <= last) & (F.col("html") != "")).orderBy(by, "html").select(F.substring("html", 1, SAMPLE_CHARS).alias("html")).limit(SAMPLE).collect()]
    shared = spark.sparkContext.broadcast(learned(found))

    def each(parts):
        trees = shared.value
        for part in parts:
            texts, some, size = [], [], 0
            for html in [*part.html, None]:
                html = html if isinstance(html, str) else ""
                some.append(parse(html, trees.bits if trees else {}))
                size += len(html)
                if size > AT_ONCE:
                    texts += kept_texts(some, trees) if trees else [""] * len(some)
                    some, size = [], 0
            texts += kept_texts(some, trees) if trees else [""] * len(some)
            yield pd.DataFrame({"page_id": part.page_id, "url": part.url, "text": texts[: len(part)], "n_chars": [len(t) for t in texts[: len(part)]]})

    return rows.mapInPandas(each, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast(kind)).select("page_id", "url", "text", "n_chars")
