"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks (runs of text between block-level tags). Each has features of its ancestors' tags and
class or id words, and of its text; the chain labels blocks as article or other. The weights are fitted on labelled
pages by gradient ascent on the conditional likelihood (forward-backward), and pages are decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fair_batches

#: Elements without end tag, elements whose text is no text (those of TO_END, where unclosed, to the page's end), inline
#: elements with those of formulas, and ends implied by another start.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
TO_END = frozenset("script style iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object math semantics annotation mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose merror mspace mmultiscripts mprescripts none".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: A tag to its end, where quotes hide a ">" only as the value of an attribute. Nothing is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNQUOTED_SLASH = re.compile(r"=[^\s\"'=]+/$")
#: Start tags of blocks, which close an open paragraph.
_ENDS_P = frozenset("p div ul ol table section article aside nav footer header form h1 h2 h3 h4 h5 h6 pre blockquote".split())

Block = tuple[str, list[str]]


def _named(attributes: str) -> list[str]:
    return [f"word:{w.lower()}" for m in _NAMED.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")]


def _closed(attributes: str) -> bool:
    """Whether a start tag closes itself; the slash at the end of an unquoted value does not."""
    return attributes.endswith("/") and not _UNQUOTED_SLASH.search(attributes)


def _raw_ends(page: str, tag: str) -> dict[int, int]:
    """The end behind each element of a name that is closed, by the place of its start tag; elements may be nested."""
    ends, starts = {}, []
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>", re.I).finditer(page):
        if not m[1]:
            if not _closed(m[2]):
                starts.append(m.start())
        elif starts:
            ends[starts.pop()] = m.end()
    return ends


def blocks(page: str, known: dict[str, int] | None = None) -> list[Block]:
    """(text, features) of the leaf blocks in page order: references decoded, white space as one space, trimmed.

    Of the features of ancestors only those in ``known`` are gathered, if it is given.
    """
    out: list[tuple[str, str, list[str], int, int]] = []
    # open elements with their features, the places of the block-level ones among them, and what is open how often
    stack: list[tuple[str, list[str]]] = [("", [])]
    levels: list[int] = [0]
    within: Counter[str] = Counter()
    around: Counter[str] = Counter()
    text: list[str] = []
    linked, in_link, links = 0, 0, 0
    raw: dict[str, dict[int, int]] = {}

    def enter(tag: str, attributes: str) -> None:
        names = {n for n in (f"in:{tag}", *_named(attributes)) if known is None or n in known}
        if tag not in INLINE:
            levels.append(len(stack))
        stack.append((tag, sorted(names)))
        within[tag] += 1
        around.update(names)

    def leave(i: int) -> None:
        while len(stack) > i:
            tag, names = stack.pop()
            within[tag] -= 1
            for n in names:
                around[n] -= 1
                if not around[n]:
                    del around[n]
            if levels[-1] == len(stack):
                levels.pop()

    def flush() -> None:
        nonlocal linked, links
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words:
            out.append((words, stack[levels[-1]][0], sorted(around), linked, links))
        linked = links = 0

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text.append(page[at:lt])
            linked += (lt - at) * (in_link > 0)
            at = lt
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, at) if at < last else None
        if not m:
            text.append("<")
            at += 1
            continue
        at = m.end()
        ends, tag = bool(m[1]), m[2].lower()
        if tag not in INLINE:
            flush()
        if tag == "br" or tag in VOID:
            continue
        if tag == "a":
            in_link = 0 if ends else 1
            links += not ends
        if ends:
            if within[tag] > 0:
                leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in RAW:
            if _closed(m[3]):
                continue
            if tag in TO_END:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if tag not in raw:
                raw[tag] = _raw_ends(page, tag)
            at = raw[tag].get(m.start(), at)
            continue
        if m[3].endswith("/") and tag not in INLINE and ":" in tag:
            continue
        if tag not in INLINE:
            nearest = stack[levels[-1]][0]
            if nearest in IMPLIED.get(tag, ()) or (nearest == "p" and tag in _ENDS_P):
                leave(levels[-1])
        enter(tag, m[3])
    flush()
    return [(words, _features(words, tag, around, linked, links, i, len(out))) for i, (words, tag, around, linked, links) in enumerate(out)]


def _features(words: str, tag: str, around: list[str], linked: int, links: int, i: int, n: int) -> list[str]:
    count = words.count(" ") + 1
    share = linked / max(1, len(words))
    found = ["bias", f"tag:{tag}", f"words:{min(6, count.bit_length())}", f"linked:{round(4 * min(1, share))}", f"links:{min(3, links)}"]
    if words[-1] in ".!?:\"'”»…":
        found.append("stop")
    if "©" in words or "copyright" in words.lower():
        found.append("copyright")
    if not any(c.isalpha() for c in words):
        found.append("no letters")
    if i == 0:
        found.append("first")
    if i == n - 1:
        found.append("last")
    return found + around


class Chain:
    """Weights: feature x label, and label x label for neighbours. Label 1 is article."""

    def __init__(self, names: list[str]):
        self.index = {name: i for i, name in enumerate(names)}
        self.emit, self.move = np.zeros((len(names), 2)), np.zeros((2, 2))

    def numbers(self, features: list[str]) -> list[int]:
        return [self.index[f] for f in features if f in self.index]

    def padded(self, pages: list[list[list[str]]], labels: list[list[int]]) -> tuple[np.ndarray, ...]:
        """(row, feature) of every feature, rows, the row of each block of each page (-1 beyond its end), and its label as 0 or 1 in two places."""
        n, longest = len(pages), max(map(len, pages))
        flat, col, rows = [], [], 0
        place = np.full((n, longest), -1)
        for i, page in enumerate(pages):
            for t, features in enumerate(page):
                place[i, t] = rows
                ids = self.numbers(features)
                flat += [rows] * len(ids)
                col += ids
                rows += 1
        y = np.zeros((n, longest), int)
        for i, page in enumerate(labels):
            y[i, :len(page)] = page
        return np.array(flat), np.array(col), rows, place, np.eye(2)[y] * (place >= 0)[..., None]

    def gradient(self, flat: np.ndarray, col: np.ndarray, rows: int, place: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The conditional log-likelihood of all pages and its gradient by ``emit`` and ``move``, by forward and backward sums."""
        n, longest = place.shape
        real = place >= 0
        score = np.stack([np.bincount(flat, self.emit[col, k], rows) for k in (0, 1)], 1)[np.maximum(place, 0)] * real[..., None]
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0] = score[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(a[:, t - 1, :1] + self.move[0], a[:, t - 1, 1:] + self.move[1]) + score[:, t]
            a[:, t] = np.where(real[:, t, None], nxt, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = b[:, t + 1] + score[:, t + 1]
            nxt = np.logaddexp(self.move[:, 0] + after[:, :1], self.move[:, 1] + after[:, 1:])
            b[:, t] = np.where(real[:, t + 1, None], nxt, 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - z[:, None, None]) * real[..., None]
        pair = np.exp(a[:, :-1, :, None] + self.move + (b + score)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        both = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
        over = (gold - p)[real]
        by_emit = np.stack([np.bincount(col, over[flat, k], len(self.emit)) for k in (0, 1)], 1)
        return float((gold * score).sum() + (both * self.move).sum() - z.sum()), by_emit, both - pair.sum((0, 1))

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], steps: int = 240, rate: float = 0.2, decay: float = 1e-3) -> None:
        """Adagrad on the conditional log-likelihood of all pages together, padded to the longest."""
        batch = self.padded(pages, labels)
        h_emit, h_move = np.full_like(self.emit, 1e-2), np.full_like(self.move, 1e-2)
        for _ in range(steps):
            _, g_emit, g_move = self.gradient(*batch)
            g_emit, g_move = g_emit / len(pages) - decay * self.emit, g_move / len(pages) - decay * self.move
            h_emit += g_emit**2
            h_move += g_move**2
            self.emit += rate * g_emit / np.sqrt(h_emit)
            self.move += rate * g_move / np.sqrt(h_move)

    def decode(self, page: list[list[str]]) -> list[int]:
        """The most probable labels, by Viterbi."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        back, s0, s1 = [], 0.0, 0.0
        for t, features in enumerate(page):
            e0, e1 = self.emit[self.numbers(features)].sum(0).tolist()
            if not t:
                s0, s1 = e0, e1
                continue
            to0, to1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
            back.append((to0, to1))
            s0, s1 = (s1 + m10 if to0 else s0 + m00) + e0, (s1 + m11 if to1 else s0 + m01) + e1
        labels = [int(s1 > s0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def labelled_pages(count: int = 600, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages in many layouts with the label of each leaf block, made from a seed: what the chain is fitted on."""
    rng = random.Random(seed)
    pages = []

    def say(lo: int, hi: int, stop: bool = True) -> str:
        words = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi))]
        return " ".join(words).capitalize() + (rng.choice("...!?") if stop else "")

    for _ in range(count):
        out: list[str] = []
        labels: list[int] = []

        def put(markup: str, label: int) -> None:
            out.append(markup)
            labels.append(label)

        def links(n: int) -> None:
            out.append("<ul>")
            for _ in range(n):
                put(f'<li><a href="/x">{say(1, 3, False)}</a></li>', 0)
            out.append("</ul>")

        def wrapped(name: str, fill) -> None:
            out.append(f"<{name}>")
            fill()
            out.append(f"</{name.split()[0]}>")

        def noise(inside: bool) -> None:
            kind = rng.choice(["ad", "ad", "aside", "form", "notice", "share", "script"] + ["related", "sidebar", "menu"] * (not inside))
            if kind == "ad":
                wrapped(f'div class="{rng.choice(["ad", "ads", "advert", "advertisement", "ad banner", "sponsored", "promo"])}"', lambda: put(rng.choice(["", "<p>"]) + say(2, 25), 0))
            elif kind == "aside":
                wrapped("aside", lambda: [put(f"<p>{say(3, 30)}</p>", 0) for _ in range(rng.randint(1, 3))])
            elif kind == "form":
                wrapped(f'form class="{rng.choice(["newsletter", "search", "subscribe"])}"', lambda: (put(f"<p>{say(2, 12)}</p>", 0), put(f"<button>{say(1, 2, False)}</button>", 0)))
            elif kind == "notice":
                wrapped(f'div id="{rng.choice(["cookie-notice", "cookie-banner", "consent", "notice", "popup", "gdpr"])}"', lambda: put(f"<p>{say(5, 30)}</p>", 0))
            elif kind == "share":
                wrapped(f'div class="{rng.choice(["share", "social", "tags", "breadcrumb", "pagination", "byline-share"])}"', lambda: [put(f'<div><a href="#">{say(1, 2, False)}</a></div>', 0) for _ in range(2)])
            elif kind == "script":
                out.append('<script>var a = "<p>x</p>";</script><style>p{}</style><!-- x -->')
            else:
                wrapped(f'div class="{rng.choice([kind, "widget", "related-posts", "sidebar"])}"', lambda: links(rng.randint(2, 5)) if rng.random() < 0.6 else [put(f"<p>{say(3, 20)}</p>", 0) for _ in range(2)])

        def comments() -> None:
            def fill() -> None:
                put(f"<h3>{say(1, 2, False)}</h3>", 0)
                for _ in range(rng.randint(1, 4)):
                    wrapped('div class="comment"' if rng.random() < 0.7 else "li", lambda: put(f"<p>{say(3, 50)}</p>", 0))
            wrapped(rng.choice(['section id="comments"', 'div class="comments"', 'div class="user-comments discussion"', 'div id="disqus_thread" class="comment-list"']), fill)

        def name() -> str:
            """A class or id that tells nothing."""
            word = rng.choice(["wrap", "wrapper", "page", "container", "inner", "outer", "row", "col", "box", "grid", "layout", "root", "app", "site", "c", "x", "story", "text", "body", "read"])
            return rng.choice([word, "".join(rng.choice("abcdefghklmnopqrstuvw") for _ in range(rng.randint(2, 8)))])

        def nested(fill) -> None:
            """Within up to three plain elements."""
            depth = rng.choice([0, 0, 1, 1, 2, 3])
            tags = [rng.choice(["div", "div", "section"]) for _ in range(depth)]
            out.extend(f"<{t}>" if rng.random() < 0.4 else f'<{t} {rng.choice(["class", "id"])}="{name()}">' for t in tags)
            fill()
            out.extend(f"</{t}>" for t in reversed(tags))

        def figures() -> None:
            def row() -> None:
                put(f"<td>{say(1, 3, False)}</td>", 1)
                for _ in range(rng.randint(1, 3)):
                    put(f"<td>{rng.choice([str(rng.randint(0, 9999)), f'{rng.random() * 100:.1f} %', f'{rng.randint(1, 99)},{rng.randint(100, 999)}'])}</td>", 1)
            wrapped("table", lambda: [wrapped("tr", row) for _ in range(rng.randint(1, 4))])

        def article() -> None:
            nested(told)

        def told() -> None:
            if rng.random() < 0.55:
                put(f"<h1>{say(2, 14, False)}</h1>", 1)
            for _ in range(rng.randint(1, 9)):
                kind = rng.random()
                if kind < 0.62:
                    text = say(1, 90)
                    if rng.random() < 0.25:
                        text = f'{text} <a href="/y">{say(1, 3, False)}</a> {say(2, 20)}'
                    put(f"<p>{'<b>' if rng.random() < 0.2 else ''}{text}</p>", 1)
                elif kind < 0.7:
                    put(f"<h2>{say(1, 8, False)}</h2>", 1)
                elif kind < 0.76:
                    wrapped("ul", lambda: [put(f"<li>{say(2, 20)}</li>", 1) for _ in range(rng.randint(1, 4))])
                elif kind < 0.8:
                    wrapped("blockquote", lambda: put(f"<p>{say(3, 40)}</p>", 1))
                elif kind < 0.84:
                    wrapped("table", lambda: [put(f"<td>{say(1, 4, False)}</td>", 1) for _ in range(4)])
                elif kind < 0.87:
                    put(f"<pre>{say(3, 20, False)}</pre>", 1)
                elif kind < 0.9:
                    put(f"<div>{say(3, 60)}</div>", 1)
                else:
                    noise(True)
            end = rng.random()
            if end < 0.15:
                figures()
            elif end < 0.3:
                wrapped("aside", lambda: put(f"<p>{say(3, 30)}</p>", 0))
                put(f"<p>{say(4, 60)}</p>", 1)
            if rng.random() < 0.15:
                comments()

        def whole() -> None:
            if rng.random() < 0.5:
                wrapped(rng.choice(["header", 'div id="header"', 'div class="masthead"']), lambda: (put(f"<div>{say(1, 4, False)}</div>", 0), put(f"<p>{say(2, 9)}</p>", 0)))
            if rng.random() < 0.8:
                wrapped(rng.choice(["nav", "nav", 'div class="menu"', 'div id="nav"', 'ul class="navigation"']), lambda: links(rng.randint(2, 8)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                noise(False)
            wrapped(rng.choice(["article", "article", "article", "article", "main", 'div id="content"', 'div class="post-content"', 'div class="article-body"', 'section class="entry"', "div", "section", f'div class="{name()}"', f'div id="{name()}"']), article)
            if rng.random() < 0.3:
                comments()
            for _ in range(rng.choice([0, 0, 1])):
                noise(False)
            if rng.random() < 0.85:
                wrapped(rng.choice(["footer", "footer", 'div id="footer"', 'div class="site-footer"']), lambda: [put(f"<div>{rng.choice(['&copy; ', '', 'Copyright '])}{say(2, 25)}</div>", 0) for _ in range(rng.choice([1, 1, 2]))])
        out.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        nested(whole if rng.random() < 0.88 else lambda: wrapped(rng.choice(["article", "main", "div"]), article))
        out.append("</body></html>")
        pages.append(("".join(out), labels))
    return pages


def fit_chain(pages: list[tuple[str, list[int]]] | None = None) -> Chain:
    """A chain fitted on labelled pages (those of ``labelled_pages`` where none are given); seconds of numpy."""
    seen, labels = [], []
    for page, wanted in pages or labelled_pages():
        found = [features for _, features in blocks(page)]
        if found and len(found) == len(wanted):
            seen.append(found)
            labels.append(wanted)
    chain = Chain(sorted({f for page in seen for features in page for f in features}))
    chain.fit(seen, labels)
    return chain


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "", chain.index)
    return " ".join(text for (text, _), label in zip(found, chain.decode([f for _, f in found])) if label)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; null or empty html gives an empty text.

    Rows that repeat a page are extracted each; null ids and urls are kept; an empty table gives no rows.
    """
    fair_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(chain or fit_chain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), shared.value) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
