"""HTML extraction by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, with the path of open elements (tags,
classes, ids, roles; each name once, however often and however deep it is open). A bidirectional LSTM in numpy reads the sequence of blocks, each as embeddings of its path and of
its hashed words plus a few numbers, and labels every block as main text or not with the whole page as context. It is
trained at first use on synthetic pages from a seeded grammar (articles among menus, headers, footers, sidebars, notices,
adverts, forms and reader comments under many names), once per driver process.

Pages are scanned once, in time proportional to their length whatever they hold: a tag ends at the first ">" outside the
quoted values of its attributes (or at the first of all, where a quote is never closed), what is unfinished at the page's
end is markup, and open elements are found by name without a search. Scripts, styles, titles, templates, frames,
drawings with an end tag and comments are no text, nor is anything else in the head; fallbacks, formulas and objects are
read like other elements, examples (xmp) as they stand. Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one line end; nothing is dropped for its length. Null and empty pages give an empty text; a page
may be of any length. Repeated rows are pages of their own; an empty table gives an empty result. Only the three columns
named are read, so others can't clash.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, named

#: Element names of HTML by how they are read.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title iframe noembed noframes".split())  # what is in them is no markup
SKIPPED = frozenset("template svg".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "thead": {"caption"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "option": {"select"}}

ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACE = re.compile(r"\s+")
PATHS, WORDS = 1 << 12, 1 << 12
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTED = re.compile(r"""=\s*(["'])""")


class Block:
    """A leaf block. moves: slots of names that open (slot + 1) and close (minus it) on the way from the page's block before."""

    __slots__ = ("moves", "last", "depth", "text", "linked")

    def __init__(self, moves: list[int], last: str, depth: int, text: str, linked: float):
        self.moves, self.last, self.depth, self.text, self.linked = moves, last, depth, text, linked


class Tags:
    """The tags of a page, one after another."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.plain = False  # a quote is never closed: from there on quotes mean nothing
        self.endings: dict[str, re.Pattern] = {}
        self.gone: set[str] = set()  # elements of which no end tag is ahead

    def text(self) -> str:
        """What comes before the next "<" that begins markup."""
        page, start = self.page, self.at
        at = start
        while (at := page.find("<", at)) >= 0:
            after = page[at + 1 : at + 2]
            if after.isascii() and after.isalpha() or after and after in "!/?":
                break
            at += 1
        self.at = at if at >= 0 else len(page)
        return page[start : self.at]

    def tag(self) -> tuple[bool, str, str]:
        """Whether the tag here is an end tag, its name in lower case (empty: no element) and what follows the name."""
        page, at = self.page, self.at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            self.at = end + 3 if end >= 0 else len(page)
            return False, "", ""
        close = page.startswith("/", at + 1)
        name = NAME.match(page, at + 1 + close)
        if not name:
            end = page.find(">", at)
            self.at = end + 1 if end >= 0 else len(page)
            return False, "", ""
        end = self._end(name.end())
        self.at = end + 1
        return close, name[0].lower(), page[name.end() : end]

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`."""
        page, start, end = self.page, at, -1
        while True:
            end = end if end >= at else page.find(">", at)
            if end < 0:
                return len(page)
            quote = None if self.plain else QUOTED.search(page, at, end)
            if not quote:
                return end
            close = page.find(quote[1], quote.end())
            if close < 0:
                self.plain = True
                return page.find(">", start)
            at = close + 1

    def skip(self, name: str) -> int:
        """Go behind the next end tag of this name and tell where it begins, -1 if there is none."""
        if name in self.gone:
            return -1
        if name not in self.endings:
            self.endings[name] = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)
        found = self.endings[name].search(self.page, self.at)
        end = self.page.find(">", found.end()) if found else -1
        if end >= 0:
            self.at = end + 1
            return found.start()
        self.gone.add(name)
        return -1


class Elements:
    """The open elements, where those of each name are among them, and what their names changed since the last block."""

    def __init__(self):
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.depth = 0
        self.times: dict[int, int] = {}
        self.pending: dict[int, int] = {}

    def _move(self, names: tuple[str, ...], by: int) -> None:
        """A slot counts while it is open at least once; what opens and closes between two blocks leaves no trace."""
        self.depth += by * len(names)
        for n in names:
            k = slot(n, PATHS)
            before = self.times.get(k, 0)
            self.times[k] = before + by
            if before == 0 or before + by == 0:
                if self.pending.pop(k, 0) == 0:
                    self.pending[k] = by

    def push(self, name: str, own: tuple[str, ...]) -> None:
        self.where.setdefault(name, []).append(len(self.open))
        if name in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((name, own))
        self._move(own, 1)

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost of these names, -1 if none is open."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def pop(self) -> str:
        name, own = self.open.pop()
        self._move(own, -1)
        self.where[name].pop()
        if name in BLOCKS:
            self.blocks.pop()
        return name

    def block(self, text: str, linked: float) -> Block:
        moves, self.pending = [by * (k + 1) for k, by in self.pending.items()], {}
        return Block(moves, self.open[-1][1][-1] if self.open else "", self.depth, text, linked)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    elements, tags = Elements(), Tags(page)
    parts: list[str] = []
    linked = links = 0
    head = False

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(elements.block(text, linked / max(sum(map(len, parts)), 1)))
        parts, linked = [], 0

    def pop_to(k: int) -> None:
        """Close the elements from place k on."""
        nonlocal links
        if elements.blocks and elements.blocks[-1] >= k:
            flush()
        while len(elements.open) > k:
            links -= elements.pop() == "a"

    while tags.at < len(page):
        text = tags.text()
        if text and not head:
            parts.append(text)
            linked += len(text) * (links > 0)
        if tags.at >= len(page):
            break
        close, name, rest = tags.tag()
        if not name:
            continue
        head = head and name != "body" and not (close and name == "head") and (name not in BLOCKS)
        if close:
            k = elements.last((name,))
            if k >= 0 and (name in BLOCKS or not elements.blocks or k > elements.blocks[-1]):
                pop_to(k)
            continue
        empty = rest.rstrip().endswith("/")
        if name in RAW:
            if tags.skip(name) < 0 and name in ("script", "style"):
                break  # unclosed, they reach to the page's end
            continue
        if name in SKIPPED and not empty:
            if tags.skip(name) >= 0:
                continue
        if name == "head":
            flush()
            head = not empty
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if name not in ("button", "option", "select", "textarea", "legend", "summary") and elements.blocks and elements.open[elements.blocks[-1]][0] == "p":
                pop_to(elements.blocks[-1])
            while name in CLOSES and (k := elements.last(CLOSES[name])) > elements.last(SCOPE[name]):
                pop_to(k)
                if name != "tr":
                    break
        if name in VOID or empty and name not in BLOCKS:
            continue
        if name == "xmp":
            start, end = tags.at, tags.skip(name)
            if end < 0:
                end = tags.at = len(page)
            elements.push(name, ("pre",))
            parts.append(html.escape(page[start:end]))  # flush() undoes it
            linked += len(parts[-1]) * (links > 0)
            pop_to(len(elements.open) - 1)
            continue
        own = [name]
        for key, value in ATTRIBUTE.findall(rest) if rest else ():
            own += [f"{key[0].lower()}:{w}" for w in re.split(r"[\s_-]+", value.strip("\"'").lower()) if w]
        elements.push(name, tuple(own))
        links += name == "a"
    flush()
    return out


@lru_cache(1 << 16)
def slot(word: str, size: int) -> int:
    return xxhash.xxh32_intdigest(word) % size


def numbers(b: Block, place: float, depth: int) -> list[float]:
    t = b.text
    n = len(t)
    return [np.log1p(n) / 5, b.linked, (t.count(",") + t.count(".")) / n * 10, min(place, 1.0), min(depth, 12) / 8, float(t[-1] in ".!?…:;\"»”'"), 1.0]


NUMBERS = 7


class Features:
    """Inputs of a set of pages: moves of the paths and word slots of each block in compressed rows, slots of the innermost
    names, numbers, page lengths.
    """

    def __init__(self, pages: list[list[Block]]):
        moves, words, last, rows, left = [], [], [], [], []
        for own in pages:
            for i, b in enumerate(own):
                moves.append(left + b.moves if i == 0 else b.moves)
                words.append([slot(w, WORDS) for w in b.text.lower().split()])
                last.append(slot("last=" + b.last, PATHS))
                rows.append(numbers(b, i / max(len(own) - 1, 1), b.depth))
            if own:
                still: dict[int, None] = {}  # open at the page's last block; the next page closes them
                for b in own:
                    for m in b.moves:
                        if m > 0:
                            still[m] = None
                        else:
                            del still[-m]
                left = [-m for m in still]
        self.lengths = np.array([len(p) for p in pages], np.int64)
        self.last = np.array(last, np.int64)
        self.moves, self.move_at = self._rows(moves)
        self.words, self.word_at = self._rows(words)
        self.rows = np.array(rows, np.float32).reshape(-1, NUMBERS)

    @staticmethod
    def _rows(x: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([v for row in x for v in row], np.int64), np.cumsum([0, *map(len, x)])[:-1].astype(np.int64)


class Labeller:
    """Bidirectional LSTM over blocks, trained by Adam, whose rate falls to zero, on the mean logistic loss."""

    PATH, WORD, HIDDEN = 16, 8, 20

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = self.PATH + self.WORD + NUMBERS, self.HIDDEN
        norm = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"path": (r.standard_normal((PATHS, self.PATH)) * 0.3).astype(np.float32), "word": (r.standard_normal((WORDS, self.WORD)) * 0.1).astype(np.float32), "out": norm(2 * h + d, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w |= {f"x{side}": norm(d, 4 * h), f"h{side}": norm(h, 4 * h), f"c{side}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    PIECE = 1 << 14

    def paths(self, f: Features) -> np.ndarray:
        """Sum of the embeddings of the names open at each block: running sums of moves, piece by piece of the blocks."""
        out = np.empty((len(f.last), self.PATH), np.float32)
        ends = np.append(f.move_at[1:], len(f.moves))
        now, at = np.zeros(self.PATH), 0
        for a in range(0, len(out), self.PIECE):
            own = ends[a : a + self.PIECE]
            moves = f.moves[at : own[-1]]
            steps = np.zeros((len(own), self.PATH))
            np.add.at(steps, np.searchsorted(own, np.arange(at, own[-1]), side="right"), self.w["path"][np.abs(moves) - 1] * np.sign(moves)[:, None])
            total = now + np.cumsum(steps, axis=0)
            out[a : a + self.PIECE] = total
            now, at = total[-1], own[-1]
        return out + self.w["path"][f.last]

    def inputs(self, f: Features) -> np.ndarray:
        path = self.paths(f)
        n = np.diff(np.append(f.word_at, len(f.words)))[:, None].astype(np.float32)
        word = np.add.reduceat(self.w["word"][f.words], f.word_at, axis=0) / n
        return np.concatenate([path, word, f.rows], axis=1)

    def steps(self, f: Features) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For both directions, the blocks that are read together at each step (pages from longest to shortest)."""
        order = np.argsort(-f.lengths, kind="stable")
        size = f.lengths[order]
        begin = (np.cumsum(f.lengths) - f.lengths)[order]
        alive = [int((size > t).sum()) for t in range(int(size[0]) if len(size) else 0)]
        return [begin[:k] + t for t, k in enumerate(alive)], [begin[:k] + size[:k] - 1 - t for t, k in enumerate(alive)]

    def run(self, x: np.ndarray, steps: list[np.ndarray], side: str, keep: list | None = None) -> np.ndarray:
        h = self.HIDDEN
        gates_x = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        out = np.zeros((len(x), h), np.float32)
        if not steps:
            return out
        state = np.zeros((len(steps[0]), h), np.float32)
        cell = state.copy()
        for at in steps:
            k = len(at)
            g = gates_x[at] + state[:k] @ self.w[f"h{side}"]
            s = 1 / (1 + np.exp(-g[:, : 3 * h]))
            i, forget, o, c = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(g[:, 3 * h :])
            new = forget * cell[:k] + i * c
            t = np.tanh(new)
            if keep is not None:
                keep.append((state[:k], cell[:k], i, forget, o, c, t))
            cell, state = new, o * t
            out[at] = state
        return out

    def logits(self, f: Features) -> np.ndarray:
        if not len(f.rows):
            return np.empty(0)
        x = self.inputs(f)
        ahead, back = self.steps(f)
        return (np.concatenate([self.run(x, ahead, "f"), self.run(x, back, "b"), x], axis=1) @ self.w["out"])[:, 0] + self.w["bias"][0]

    def gradients(self, f: Features, y: np.ndarray) -> dict[str, np.ndarray]:
        h, x = self.HIDDEN, self.inputs(f)
        sides = dict(zip("fb", self.steps(f), strict=True))
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = {s: self.run(x, steps, s, kept[s]) for s, steps in sides.items()}
        top = np.concatenate([hidden["f"], hidden["b"], x], axis=1)
        d = (1 / (1 + np.exp(-(top @ self.w["out"] + self.w["bias"]))) - y[:, None]) / len(y)
        grad = {"out": top.T @ d, "bias": d.sum(0)}
        d_top = d @ self.w["out"].T
        d_x = d_top[:, 2 * h :].copy()
        for n, (s, steps) in enumerate(sides.items()):
            d_out, d_gates = d_top[:, n * h : (n + 1) * h], np.zeros((len(x), 4 * h), np.float32)
            d_state = d_cell = np.zeros((0, h), np.float32)
            grad[f"h{s}"] = np.zeros_like(self.w[f"h{s}"])
            for at, (state, cell, i, forget, o, c, t) in zip(reversed(steps), reversed(kept[s]), strict=True):
                ds, dc = d_out[at].copy(), np.zeros((len(at), h), np.float32)
                ds[: len(d_state)] += d_state
                dc[: len(d_cell)] += d_cell
                dc += ds * o * (1 - t * t)
                g = np.concatenate([dc * c * i * (1 - i), dc * cell * forget * (1 - forget), ds * t * o * (1 - o), dc * i * (1 - c * c)], axis=1)
                d_gates[at] = g
                grad[f"h{s}"] += state.T @ g
                d_state, d_cell = g @ self.w[f"h{s}"].T, dc * forget
            grad[f"x{s}"], grad[f"c{s}"] = x.T @ d_gates, d_gates.sum(0)
            d_x += d_gates @ self.w[f"x{s}"].T
        n = np.diff(np.append(f.move_at, len(f.moves)))
        grad["path"] = np.zeros_like(self.w["path"])
        np.add.at(grad["path"], f.last, d_x[:, : self.PATH])
        onwards = np.cumsum(d_x[::-1, : self.PATH].astype(np.float64), axis=0)[::-1]  # a move is felt by all blocks after it
        np.add.at(grad["path"], np.abs(f.moves) - 1, np.repeat(onwards, n, axis=0) * np.sign(f.moves)[:, None])
        n = np.diff(np.append(f.word_at, len(f.words)))
        grad["word"] = np.zeros_like(self.w["word"])
        np.add.at(grad["word"], f.words, np.repeat(d_x[:, self.PATH : self.PATH + self.WORD] / n[:, None], n, axis=0))
        return grad

    def fit(self, pages: list[list[Block]], labels: list[list[int]], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 5) -> "Labeller":
        r, moments, t = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}, 0
        steps = epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for a in range(0, len(pages), batch):
                own = [i for i in order[a : a + batch] if pages[i]]
                y = np.array([v for i in own for v in labels[i]], np.float32)
                t += 1
                for k, g in self.gradients(Features([pages[i] for i in own]), y).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.w[k] -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        f = Features(pages)
        return np.split(self.logits(f) > 0, np.cumsum(f.lengths)[:-1]) if pages else []


#: Names that page authors give to parts of a page, and words found there.
NAMED = {
    "nav": "nav menu navbar navigation topnav breadcrumbs breadcrumb pagination pager toc tabs",
    "header": "header masthead topbar site-header branding logo",
    "footer": "footer site-footer bottom copyright legal colophon",
    "sidebar": "sidebar aside widget related recommended trending rail popular tags",
    "notice": "notice cookie consent banner alert gdpr popup modal message subscribe newsletter disclaimer",
    "ad": "ad ads advert advertisement sponsored promo adsbox commercial",
    "comment": "comments comment comment-list reply replies respond discussion disqus",
    "share": "share social sharing toolbar actions",
}
MAIN = "content main article post entry entry-content article-body post-body story text body page main-content story-body single hentry".split()
TALK = {
    "nav": "home about contact products news sport world politics business login register search accueil startseite inicio next previous",
    "header": "welcome to the site home of your daily news search sign in",
    "footer": "copyright all rights reserved privacy policy terms of use contact imprint sitemap © 2024 impressum",
    "sidebar": "related articles most read popular posts recent archive categories tags trending see also",
    "notice": "we use cookies to improve your experience accept decline subscribe to our newsletter sign up this site notice",
    "ad": "advertisement sponsored buy now save offer click here deal shop free shipping",
    "comment": "posted by says reply great post thanks i disagree agree with you comment report ago user",
    "share": "share tweet email print like follow us",
    "form": "name email message submit search password send your comment required field",
}


def synthetic(r: np.random.Generator) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks."""
    sounds = "a e i o u an er on th st re in or ti es ing tion ou é ñ ü sch que la de".split()
    word = lambda: "".join(r.choice(sounds, r.integers(1, 5)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + r.choice([".", ".", "!", "?", "", ", "])
    prose = lambda: " ".join(sentence(int(r.integers(1, 18))) for _ in range(int(r.choice([1, 1, 2, 3, 6, 12]))))
    parts: list[str] = []
    labels: list[int] = []

    def put(before: str, text: str, after: str, label: int) -> None:
        parts.append(f"{before}{text}{after}")
        labels.append(label)

    def wrapped(tag: str, name: str | None) -> str:
        if not name or r.random() < 0.15:
            return f"<{tag}>"
        attribute = r.choice(["class", "class", "class", "id"])
        extra = f" {r.choice(['block', 'box', 'wrap', 'inner', 'col', 'row'])}" if attribute == "class" and r.random() < 0.3 else ""
        return f'<{tag} {attribute}="{name}{extra}">'

    def boiler(kind: str) -> None:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "comment": "section"}.get(kind, "div")
        name = str(r.choice(NAMED[kind].split()))
        if r.random() < 0.3 or tag == "div":
            tag, start = "div", f'<div class="{name}">' if r.random() < 0.8 else f'<div id="{name}">'
        else:
            start = wrapped(tag, name if r.random() < 0.4 else None)
        parts.append(start)
        say = lambda: " ".join(r.choice(TALK[kind].split(), int(r.integers(1, 7)))) if r.random() < 0.4 else prose() if r.random() < 0.6 else sentence(int(r.integers(1, 5)))
        if kind in ("nav", "share") or kind in ("sidebar", "footer", "header") and r.random() < 0.4:
            parts.append("<ul>")
            for _ in range(int(r.integers(2, 8))):
                put('<li><a href="#">', word(), "</a></li>" if r.random() < 0.9 else "</a>", 0)
            parts.append("</ul>")
        elif kind == "comment":
            for _ in range(int(r.integers(1, 6))):
                inner = str(r.choice(['<div class="comment">', "<article>", '<li class="comment">', "<div>"]))
                parts.append(inner)
                if r.random() < 0.5:
                    put("<p>", say(), "</p>", 0)
                put("<p>", say(), "</p>", 0)
                parts.append(f"</{inner[1:].split('>')[0].split(' ')[0]}>")
        else:
            for _ in range(int(r.choice([1, 1, 1, 2, 3]))):
                before, after = [("", ""), ("<p>", "</p>"), ("<h3>", "</h3>"), ("<div>", "</div>"), ("<p>&copy; ", " &middot; x</p>")][int(r.integers(0, 5))]
                put(before, say(), after, 0)
                if not before:
                    break
        parts.append(f"</{tag}>")

    def form() -> None:
        parts.append("<form>" if r.random() < 0.6 else '<form class="search">')
        for _ in range(int(r.integers(1, 4))):
            put(str(r.choice(["<div>", "<p>", "<fieldset>"])), " ".join(r.choice(TALK["form"].split(), 2)), "", 0)
            if parts[-1].startswith("<div>"):
                parts.append("</div>")
            elif parts[-1].startswith("<fieldset>"):
                parts.append("</fieldset>")
        put("<button>", word(), "</button>", 0)
        parts.append("</form>")

    def article() -> None:
        style = r.random()
        name = str(r.choice(MAIN))
        start, end = ("<article>", "</article>") if style < 0.4 else (f'<div class="{name}">', "</div>") if style < 0.65 else (f'<div id="{name}">', "</div>") if style < 0.75 else ("<main>", "</main>") if style < 0.88 else (f'<article class="{name}">', "</article>")
        parts.append(start)
        if r.random() < 0.85:
            put("<h1>", sentence(int(r.integers(1, 12))), "</h1>", 1)
        loose = r.random() < 0.3
        for _ in range(int(r.choice([1, 2, 3, 5, 8, 14]))):
            x = r.random()
            if x < 0.76:
                put("<p><b>" if r.random() < 0.15 else "<p>", prose(), "<br>" if loose else "</p>", 1)
            elif x < 0.82:
                put(str(r.choice(["<h2>", "<h3>"])), sentence(4), "", 1)
                parts.append("</h2>" if parts[-1].startswith("<h2>") else "</h3>")
            elif x < 0.87:
                parts.append("<ul>")
                for _ in range(int(r.integers(1, 5))):
                    put("<li>", prose(), "</li>", 1)
                parts.append("</ul>")
            elif x < 0.91:
                put("<blockquote>", prose(), "</blockquote>", 1)
            elif x < 0.93:
                parts.append("<table><tr>")
                for _ in range(int(r.integers(1, 4))):
                    put("<td>", sentence(2), "</td>", 1)
                parts.append("</tr></table>")
            elif x < 0.97:
                boiler("ad" if r.random() < 0.6 else str(r.choice(["notice", "share", "sidebar"])))
            else:
                put("<pre>", prose(), "</pre>", 1)
        parts.append(end)

    before = [k for k in ("notice", "header", "nav", "ad", "sidebar") if r.random() < (0.7 if k == "nav" else 0.35)]
    after = [k for k in ("share", "ad", "comment", "sidebar", "notice", "footer") if r.random() < (0.75 if k == "footer" else 0.3)]
    frame = r.random() < 0.3
    parts.append('<html><head><title>x</title></head><body>' + '<div class="wrapper"><div class="container">' * frame)
    for k in before:
        boiler(k)
    if r.random() < 0.15:
        form()
    article()
    for k in after:
        boiler(k)
        if k == "comment" and r.random() < 0.5:
            form()
    parts.append("</div></div>" * frame + "</body></html>")
    return "".join(parts), labels


@lru_cache(2)
def trained(pages: int = 900, seed: int = 7) -> Labeller:
    """The labeller, fitted on `pages` synthetic pages."""
    r = np.random.default_rng(seed)
    read, labels = [], []
    while len(read) < pages:
        page, own = synthetic(r)
        found = blocks(page)
        if len(found) == len(own):  # a rare page whose empty pieces merge is left out
            read.append(found)
            labels.append(own)
    return Labeller().fit(read, labels)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_blocks, kept_blocks."""
    weights = trained().w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller.__new__(Labeller)
        model.w = weights
        for part in chunks(batches, "html", 6 << 20):
            read = [blocks(x or "") for x in part.column("html").to_pylist()]
            texts, kept = [], []
            for own, label in zip(read, model.label(read), strict=True):
                lines = [b.text for b, main in zip(own, label, strict=True) if main]
                texts.append("\n".join(lines))
                kept.append(len(lines))
            yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), part.column("url").combine_chunks(), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in read], pa.int64()), pa.array(kept, pa.int64())], ["id", "url", "text", "n_chars", "n_blocks", "kept_blocks"])

    kind, link = (pages.schema[c].dataType.simpleString() for c in (page_id, url))
    rows = pages.select(named(page_id).alias("id"), named(url).alias("url"), named(markup).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url {link}, text string, n_chars bigint, n_blocks bigint, kept_blocks bigint").withColumnRenamed("id", page_id)
