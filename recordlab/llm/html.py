"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import bisect
import functools
import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlab.session import ship

# Elements by their role in a page's tree.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math select textarea title head canvas audio video".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot td th div section article aside nav main header footer form body html blockquote".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION, _FIGURE, _CAPITAL = re.compile(r"[.,;:!?]"), re.compile(r"[0-9]"), re.compile(r"(?<![^ ])[A-ZÀ-Þ]")


@dataclass(slots=True)
class Block:
    """Text of a leaf block, characters of it inside links, tags and names of the elements around it, the innermost tag."""

    text: str
    linked: int
    path: tuple[str, ...]
    leaf: str


def next_tag(page: str, at: int, quotes: dict[str, int]) -> tuple[int, int, str, str] | None:
    """Start, end, name ("/" first in end tags, "" in comments and declarations) and attributes of the tag after ``at``.

    A ``<`` that begins nothing is text.  A quote that is never closed is an ordinary character, and a tag or comment
    that is never closed ends with the page.  ``quotes`` remembers where quotes come next, so that a page is walked
    through in time that grows with its length.
    """
    size = len(page)
    while (lt := page.find("<", at)) >= 0:
        follows = page[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            stop = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(stop, lt + 2)
            return lt, size if end < 0 else end + len(stop), "", ""
        close = follows == "/"
        name = _NAME.match(page, lt + 1 + close)
        if name is None:
            at = lt + 1
            continue
        at = name.end()
        if page.startswith(">", at):
            return lt, at + 1, "/" * close + name[0].lower(), ""
        while (stop := _STOP.search(page, at)) is not None:
            at, quote = stop.end(), stop[0]
            if quote == ">":
                return lt, at, "/" * close + name[0].lower(), page[name.end() : at - 1]
            if quotes.get(quote, -1) < at:
                found = page.find(quote, at)
                quotes[quote] = size if found < 0 else found
            if quotes[quote] < size:
                at = quotes[quote] + 1
        return lt, size, "/" * close + name[0].lower(), page[name.end() :]
    return None


#: What else an open element counts as; no tag has such a name.
_KINDS = {tag: (tag, *[" scope"] * (tag in SCOPES), *[" row scope"] * (tag in SCOPES and tag not in ("td", "th")), *[" block"] * (tag in BLOCKS)) for tag in BLOCKS | SCOPES}


class _Open:
    """Open elements; finds the innermost of a kind without walking through the others."""

    def __init__(self, known: frozenset[str] | None):
        self.known, self.tags, self.paths, self.seen = known, [], [((), frozenset())], 0
        self.places: dict[str, list[int]] = defaultdict(list)
        self.links = self.silent = 0

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        place = len(self.tags)
        for kind in self._kinds(tag):
            self.places[kind].append(place)
        self.tags.append(tag)
        path, held = self.paths[-1]
        new = tuple(x for x in dict.fromkeys(("<" + tag, *names)) if x not in held and (self.known is None or x in self.known))
        self.paths.append((path + new, held.union(new)) if new else (path, held))
        self.links += tag == "a"
        self.silent += tag in SILENT

    @staticmethod
    def _kinds(tag: str) -> tuple[str, ...]:
        return _KINDS.get(tag) or (tag,)

    def pop(self, to: int) -> None:
        while len(self.tags) > to:
            tag = self.tags.pop()
            self.paths.pop()
            for kind in self._kinds(tag):
                self.places[kind].pop()
            self.links -= tag == "a"
            self.silent -= tag in SILENT

    def first_above(self, tag: str, place: int) -> int | None:
        own = self.places.get(tag, ())
        i = bisect.bisect_right(own, place)
        return own[i] if i < len(own) else None


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Blocks with text, in page order; white space is one space; broken and missing tags are tolerated.

    Paths hold ``known`` tags and names only, if given, so that they stay short however deep the page is.  The work
    grows with the length of the page, whatever it holds.
    """
    out: list[Block] = []
    stack = _Open(known)
    run: list[str] = []
    linked, at, size = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), stack.paths[-1][0], stack.tags[-1] if stack.tags else ""))
            run.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack.silent:
            run.append(text)
            linked += len(text) * (stack.links > 0)

    quotes: dict[str, int] = {}
    ends: dict[str, int] = {}  # the next end tag of a raw element, so that none is searched twice
    while (found := next_tag(page, at, quotes)) is not None:
        lt, end, tag, attributes = found
        say(page[at:lt])
        at = end
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            place = stack.last(tag)
            if place >= 0 and (tag in BLOCKS or stack.last(" scope") <= place):
                if stack.last(" block") >= place:
                    flush()
                stack.pop(place)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img") and not stack.silent:
                run.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            scope = stack.last(" row scope" if tag in ("tr", "td", "th") else " scope")
            if tag in CLOSES:
                above = [x for t in ("p", *CLOSES[tag]) if (x := stack.first_above(t, scope)) is not None]
                if above:
                    stack.pop(min(above))
            elif stack.last("p") > scope:
                stack.pop(stack.last("p"))
        if tag in RAW:
            if ends.get(tag, 0) <= at:
                stop = _RAW_ENDS[tag].search(page, at)
                ends[tag] = stop.end() if stop else size
            at = ends[tag]
            continue
        if not attributes.endswith("/") or tag in BLOCKS:
            names = ()
            if "=" in attributes:
                names = tuple("." + w for g in _NAMES.findall(attributes) for w in _WORD.findall("".join(g).lower()))
            stack.push(tag, names)
    say(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Ancestors and their names, and what the text looks like: its length, links, words, figures and punctuation."""
    out = []
    for b in blocks:
        n = len(b.text)
        words = b.text.count(" ") + 1
        own = ["bias", f"size{min(8, n.bit_length())}", f"words{min(7, words.bit_length())}", f"link{b.linked * 4 // n}", *b.path, "leaf<" + b.leaf]
        if b.text[-1] in ".!?…":
            own.append("stop")
        own.append(f"points{min(3, 20 * len(_PUNCTUATION.findall(b.text)) // words)}")
        own.append(f"figures{min(3, 8 * len(_FIGURE.findall(b.text)) // n)}")
        own.append(f"capitals{min(3, 4 * len(_CAPITAL.findall(b.text)) // words)}")
        out.append(own)
    return out


@dataclass
class Field:
    """Weights of features for "main" against "rest", and of the steps between them."""

    weights: dict[str, float]
    steps: np.ndarray

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the likeliest labels of the whole sequence."""
        if not blocks:
            return []
        get = self.weights.get
        score = [sum(get(f, 0.0) for f in own) for own in features(blocks)]
        (a, b), (c, d) = self.steps.tolist()
        rest, main, back = 0.0, score[0], []
        for s in score[1:]:
            from_rest, from_main = (rest + a >= main + c), (rest + b > main + d)
            back.append((not from_rest, not from_main))
            rest, main = max(rest + a, main + c), max(rest + b, main + d) + s
        label = main > rest
        out = [label]
        for to_rest, to_main in reversed(back):
            label = to_main if label else to_rest
            out.append(label)
        return out[::-1]


class Sequences:
    """Labelled pages as arrays, all of one length, and the likelihood of weights given them."""

    def __init__(self, pages: list[tuple[list[Block], list[bool]]], decay: float = 2e-4):
        pages = [p for p in pages if p[0]]
        self.decay, self.names = decay, {}
        self.count, self.longest = len(pages), max(len(b) for b, _ in pages)
        self.truth, self.mask = np.zeros((self.count, self.longest)), np.zeros((self.count, self.longest), bool)
        row, col = [], []
        for i, (blocks, labels) in enumerate(pages):
            self.mask[i, : len(blocks)] = True
            self.truth[i, : len(blocks)] = labels
            for j, own in enumerate(features(blocks)):
                for f in own:
                    row.append(i * self.longest + j)
                    col.append(self.names.setdefault(f, len(self.names)))
        self.row, self.col, self.total = np.array(row), np.array(col), self.mask.sum()
        both = self.mask[:, 1:]
        self.known = np.array([[(both & (self.truth[:, :-1] == x) & (self.truth[:, 1:] == y)).sum() for y in (0, 1)] for x in (0, 1)], float)

    def loss(self, w: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log likelihood a block, with decay, and its gradient by the features' weights and the steps."""
        mask, n = self.mask, self.longest
        unit = np.zeros((self.count, n, 2))
        unit[:, :, 1] = np.bincount(self.row, weights=w[self.col], minlength=self.count * n).reshape(self.count, n)
        ahead, behind = np.zeros((self.count, n, 2)), np.zeros((self.count, n, 2))
        ahead[:, 0] = unit[:, 0]
        for j in range(1, n):
            new = np.logaddexp(ahead[:, j - 1, :1] + steps[0], ahead[:, j - 1, 1:] + steps[1]) + unit[:, j]
            ahead[:, j] = np.where(mask[:, j, None], new, ahead[:, j - 1])
        for j in range(n - 2, -1, -1):
            nxt = behind[:, j + 1] + unit[:, j + 1]
            new = np.logaddexp(nxt[:, :1] + steps[:, 0], nxt[:, 1:] + steps[:, 1])
            behind[:, j] = np.where(mask[:, j + 1, None], new, 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.where(mask, np.exp(np.minimum(ahead[:, :, 1] + behind[:, :, 1] - whole[:, None], 0)), 0)
        pair = np.zeros((2, 2))
        for j in range(1, n):
            at = mask[:, j]
            for x in (0, 1):
                for y in (0, 1):
                    pair[x, y] += np.exp(np.minimum(ahead[at, j - 1, x] + steps[x, y] + unit[at, j, y] + behind[at, j, y] - whole[at], 0)).sum()
        score = (unit[:, :, 1] * self.truth).sum() + (self.known * steps).sum()
        loss = (whole.sum() - score) / self.total + self.decay / 2 * ((w * w).sum() + (steps * steps).sum())
        g = np.bincount(self.col, weights=(p - self.truth).ravel()[self.row], minlength=len(w)) / self.total + self.decay * w
        return float(loss), g, (pair - self.known) / self.total + self.decay * steps


def fit(pages: list[tuple[list[Block], list[bool]]], decay: float = 2e-4, rounds: int = 220, rate: float = 0.15) -> Field:
    """Maximises the likelihood of labelled sequences, all pages at once, with Adam; deterministic."""
    data = Sequences(pages, decay)
    w, steps = np.zeros(len(data.names)), np.zeros((2, 2))
    moments = [np.zeros(len(w)), np.zeros(len(w)), np.zeros((2, 2)), np.zeros((2, 2))]
    for t in range(1, rounds + 1):
        _, g, gs = data.loss(w, steps)
        for k, (value, grad) in enumerate(((w, g), (steps, gs))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field({f: float(w[i]) for f, i in data.names.items()}, steps)


def labelled_pages(count: int = 600, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Invented pages of many layouts with the blocks of their articles, to train on."""
    r = random.Random(seed)
    syllables = "an be co da er fi go hu in ka lo me no or pa re sa ti un ve wo st ion ing le".split()

    def words(lo: int, hi: int, stop: str = ".") -> str:
        made = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        for i in range(3, len(made) - 1, r.randint(5, 11)):
            made[i] += r.choice([",", ".", ""])
        return " ".join(made).capitalize() + stop

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3, "")}</a></li>' for i in range(n)) + "</ul>"

    def named(tag: str, names: list[str], inner: str) -> str:
        return f'<{tag} {r.choice(["class", "id"])}="{r.choice(names)}">{inner}</{tag}>'

    def paragraph() -> str:
        lo, hi = r.choice([(1, 5), (8, 25), (20, 120), (20, 160)])
        text = words(lo, hi, r.choice([".", ".", ".", "!", "?", ""]))
        if r.random() < 0.2:  # signs and figures tell nothing about where a text belongs
            parts = text.split(" ")
            for _ in range(r.randint(1, 1 + len(parts) // 3)):
                parts.insert(r.randrange(len(parts)), r.choice(["|", "&copy;", "&middot;", "#", "*", "&amp;", "$", "%", "&lt;b&gt;", "=", "12", "2024", "3.5", "@x", "UP"]))
            text = " ".join(parts)
        return text

    def boilerplate() -> str:
        inner = lambda: r.choice([f"<p>{words(4, 30)}</p>", words(2, 25), links(r.randint(2, 6)), f"<h3>{words(1, 4, '')}</h3>{links(3)}", f"<h3>{words(1, 3, '')}</h3><p>{words(5, 40)}</p>"])
        return r.choice(
            [
                lambda: f"<nav>{links(r.randint(3, 8))}</nav>",
                lambda: named("div", ["menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "main-menu", "topnav"], links(r.randint(2, 7))),
                lambda: f"<header>{r.choice(['<h1>', '<p>', '<div>'])}{words(1, 4, '')}</header>",
                lambda: named("div", ["header", "site-header", "masthead", "banner", "topbar"], f"<p>{words(2, 8, '')}</p>"),
                lambda: f"<aside>{inner()}</aside>",
                lambda: named("div", ["sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "right-col"], inner()),
                lambda: named("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"], r.choice([words(3, 40), f"<p>{words(5, 40)}</p>"])),
                lambda: named("div", ["cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "modal"], f"<p>{words(8, 40)}</p><button>{words(1, 2, '')}</button>"),
                lambda: f"<form>{r.choice(['', f'<p>{words(4, 15)}</p>'])}<label>{words(1, 3, '')}</label><input name=q><button>{words(1, 2, '')}</button></form>",
                lambda: named("div", ["newsletter", "subscribe", "signup", "share", "social", "tags", "meta", "byline"], r.choice([words(2, 15), links(3), f"<p>{words(6, 20)}</p>"])),
                lambda: named(r.choice(["div", "section"]), ["comments", "comment-list", "disqus", "responses", "respond"], "".join(r.choice([f'<div class="comment"><p>{words(3, 60)}</p></div>', f'<article class="comment"><h4>{words(1, 2, "")}</h4><p>{words(3, 60)}</p></article>', f'<li class="comment"><p>{words(3, 60)}</p></li>']) for _ in range(r.randint(1, 5)))),
                lambda: f"<footer>{r.choice(['&copy; ' + words(1, 3, '') + ' &middot; ' + words(3, 20), links(3) + words(3, 12), f'<p>{words(3, 25)}</p>'])}</footer>",
                lambda: named("div", ["footer", "site-footer", "copyright", "legal", "bottom"], f"<p>&copy; {words(3, 25)}</p>"),
            ]
        )()

    out = []
    for _ in range(count):
        main: list[str] = []

        def say(text: str) -> str:
            main.append(" ".join(entities.unescape(re.sub(r"<[^>]*>", "", text)).split()))  # noqa: B023
            return text

        body = [f"<h1>{say(words(1, 10, r.choice(['.', ''])))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 2, 4, 8, 15, 25])):
            kind = r.random()
            if kind < 0.72:
                body.append(f"<p>{say(paragraph())}" + r.choice(["</p>", "</p>", "</p>", "<br>"]))
            elif kind < 0.78:
                body.append(f"<p><b>{say(paragraph())}<br>")
            elif kind < 0.84:
                body.append(f"<h{(k := r.randint(2, 4))}>{say(words(1, 7, ''))}</h{k}>")
            elif kind < 0.89:
                body.append("<ul>" + "".join(f"<li>{say(words(2, 14, r.choice(['.', ''])))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                body.append(f"<blockquote>{say(words(6, 40))}</blockquote>")
            elif kind < 0.95:
                body.append(f'<p>{say(words(4, 15, "") + " <a href=/x>" + words(1, 4, "") + "</a> " + words(4, 20))}</p>')
            elif kind < 0.97:
                body.append("<table><tr>" + "".join(f"<td>{say(words(1, 4, ''))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.98:
                body.append(r.choice([
                    lambda: f"<figure><img src=x><figcaption>{say(words(3, 15))}</figcaption></figure>",
                    lambda: f"<pre>{say(words(3, 30, ''))}</pre>",
                    lambda: f"<dl><dt>{say(words(1, 3, ''))}</dt><dd>{say(words(4, 20))}</dd></dl>",
                    lambda: f"<div><div>{say(paragraph())}</div></div>",
                    lambda: f"<section><h2>{say(words(1, 6, ''))}</h2><p><span>{say(paragraph())}</span></p></section>",
                ])())
            else:
                body.append(boilerplate())
        inside = "\n".join(body)
        holder = r.random()
        if holder < 0.5:
            article = f"<article>{inside}</article>"
        elif holder < 0.62:
            article = f"<main>{inside}</main>"
        elif holder < 0.72:
            article = f"<main><article>{inside}</article></main>"
        else:
            article = named("div", ["content", "post", "entry", "entry-content", "article", "article-body", "story", "main", "post-content", "text"], inside)
        before, after = [boilerplate() for _ in range(r.randint(1, 4))], [boilerplate() for _ in range(r.randint(1, 4))]
        page = "\n".join([*before, article, *after])
        for _ in range(r.choice([0, 0, 1, 2])):
            page = r.choice([f'<div class="{r.choice(["wrapper", "page", "container", "site", "row"])}">{page}</div>', f"<div><div>{page}</div></div>", f"<section>{page}</section>", f"<table><tr><td>{page}</td></tr></table>"])
        out.append((f"<!DOCTYPE html><html><head><title>{words(1, 5, '')}</title><style>p{{}}</style></head><body>{page}</body></html>", main))
    return out


def label(page: str, main: list[str]) -> tuple[list[Block], list[bool]]:
    """Blocks of a page, and which are of its article, whose blocks come in order."""
    blocks, labels, i = leaf_blocks(page), [], 0
    for b in blocks:
        hit = i < len(main) and b.text == main[i]
        labels.append(hit)
        i += hit
    return blocks, labels


@functools.lru_cache(maxsize=4)
def trained(count: int = 600, seed: int = 3) -> Field:
    return fit([label(*p) for p in labelled_pages(count, seed)])


def _extract(model, html_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        known = frozenset(field.weights)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = []
                for page in batch.column(html_at).to_pylist():
                    blocks = leaf_blocks(page or "", known)
                    texts.append("\n".join(b.text for b, main in zip(blocks, field.decode(blocks), strict=True) if main))
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != html_at), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return run


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``pages`` (page_id, url, html, others) with the html replaced by text and n_chars (its code points).

    Text holds the article's blocks in page order, joined by \\n, character references decoded and white space inside
    a block one space.  Null, empty and blank pages give an empty text.  Columns called text or n_chars are replaced.
    Without a ``field`` one is trained on invented labelled pages, the same each time.
    """
    sent = ship(pages.sparkSession).sparkContext.broadcast(field or trained())
    pages = pages.drop("text", "n_chars").withColumn("html", F.col("html").cast("string"))
    schema = pages.drop("html").schema.add("text", "string").add("n_chars", "long")
    return pages.mapInArrow(_extract(sent, pages.columns.index("html"), schema.names), schema)
