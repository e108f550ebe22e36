"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page's blocks are its runs of text between block-level tags, in order.  Features of a block are its ancestors' tags, the
words of their class, id and role, and properties of its text (length, links, punctuation).  The field has two labels, content and
rest; it is trained on labelled pages, which are generated here from many layouts, and decoded by Viterbi.

Scripts, styles, comments and the like have no text.  Character references are decoded; white space inside a block becomes
one space.  Null and empty pages, and pages without content, give an empty text; rows that repeat have one result each, and an
empty table gives no row.  Pages are whole whatever their length and depth: time grows with the length alone.  Tags left open or
closed twice are repaired as browsers do for paragraphs and list items; anything else closes with its parent.  Kept columns
named text or n_chars are replaced.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Comments, and the three elements whose content is raw text, run to the end of a page that doesn't close them.  Other elements
#: without text of the page are skipped only if they're closed before another one of their kind opens.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(noscript|template|svg|iframe|object|select|button)(?=[\s/>])(?:(?!<\2[\s/>]).)*?</\2\s*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
VOID = frozenset("br img hr input meta link area base col embed source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Tags that an opening tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SIZE = 1 << 13
MEMO = 100_000


@lru_cache(maxsize=MEMO)
def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE


class Path:
    """The open elements, and how many of them have each feature: at most SIZE features, however deep a page is."""

    def __init__(self):
        self.stack: list[tuple[str, list[int]]] = []
        self.features: dict[int, int] = {}
        self.names: dict[str, int] = {}

    def push(self, name: str, attributes: str) -> None:
        marks = [feature(f"a={name}")]
        if attributes:
            for values in ATTRIBUTE.findall(attributes):
                marks += [feature(f"c={w}") for w in WORD.findall("".join(values).lower())]
        for f in marks:
            self.features[f] = self.features.get(f, 0) + 1
        self.names[name] = self.names.get(name, 0) + 1
        self.stack.append((name, marks))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            name, marks = self.stack.pop()
            self.names[name] -= 1
            for f in marks:
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]

    def close(self, name: str) -> None:
        """Close the innermost element of a name; an inline one only inside of the innermost block."""
        if not self.names.get(name):
            return
        inline = name in INLINE
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                return self.cut(i)
            if inline and self.stack[i][0] not in INLINE:
                return None

    def close_for(self, name: str) -> None:
        """Close the paragraph or the like that the opening of a block ends."""
        closes = CLOSES.get(name, ())
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag == "p" or tag in closes:
                return self.cut(i)
            if tag not in INLINE:
                return None

    def all_features(self) -> tuple[int, ...]:
        tags = [t for t, _ in self.stack[-2:]]
        more = (f"depth={min(len(self.stack), 8)}", f"leaf={tags[-1] if tags else ''}", f"pair={'/'.join(tags)}")
        return (*self.features, *{feature(m) for m in more}.difference(self.features))


def blocks(page: str) -> list[tuple[str, tuple[int, ...], float]]:
    """(text, features of the ancestors, share of characters in links) of each block with text."""
    out: list[tuple[str, tuple[int, ...], float]] = []
    path = Path()
    parts: list[str] = []
    found: tuple[int, ...] = ()
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = SPACE.sub(" ", html.unescape(raw)).strip()
            if text:
                out.append((text, found, linked / max(1, len(raw))))
            parts.clear()
            linked = 0

    def add(text: str) -> None:
        nonlocal found, linked
        if not parts:
            if not text.strip():
                return
            found = path.all_features()
        parts.append(text)
        if path.names.get("a"):
            linked += len(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if name == "br" or name == "hr":
            parts and parts.append(" ")
            continue
        if name in VOID:
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if m[3]:
            path.close(name)
        else:
            if not inline:
                path.close_for(name)
            path.push(name, m[5])
    if at < len(page):
        add(page[at:])
    flush()
    return out


def block_features(block: tuple[str, tuple[int, ...], float]) -> list[int]:
    text, path, links = block
    n = len(text)
    names = [f"len={min(n.bit_length(), 11)}", f"links={round(links * 4)}", "stop" if text[-1] in ".!?:;\"" else "open", "bias"]
    if "©" in text or text[:9].lower() == "copyright":
        names.append("sign")
    if n < 400 and text.count("|") + text.count("·") > 1:
        names.append("bars")
    return [*path, *map(feature, names)]


class Field:
    """Emission weights [feature, label], transitions [from, to] and start weights."""

    def __init__(self):
        self.w, self.t, self.s = np.zeros((SIZE, 2)), np.zeros((2, 2)), np.zeros(2)

    def fit(self, pages: list[list[list[int]]], labels: list[list[int]], rounds: int = 120, rate: float = 0.2, decay: float = 1e-4) -> None:
        """Maximum likelihood by Adam; pages run side by side, padded to the longest."""
        n, length = len(pages), max(map(len, pages))
        page = np.repeat(np.arange(n), [sum(map(len, p)) for p in pages])
        place = np.concatenate([np.repeat(np.arange(len(p)), [len(b) for b in p]) for p in pages])
        ids = np.concatenate([np.concatenate(p) for p in pages]).astype(np.int64)
        y = np.zeros((n, length), np.int64)
        mask = np.zeros((n, length), bool)
        for i, row in enumerate(labels):
            y[i, : len(row)], mask[i, : len(row)] = row, True
        gold = np.eye(2)[y] * mask[:, :, None]
        pairs = np.einsum("nla,nlb->ab", gold[:, :-1], gold[:, 1:])
        params = [self.w, self.t, self.s]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            e = np.zeros((n, length, 2))
            for k in (0, 1):
                e[:, :, k] = np.bincount(page * length + place, weights=self.w[ids, k], minlength=n * length).reshape(n, length)
            alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
            alpha[:, 0] = self.s + e[:, 0]
            for i in range(1, length):
                a = np.logaddexp.reduce(alpha[:, i - 1, :, None] + self.t, axis=1) + e[:, i]
                alpha[:, i] = np.where(mask[:, i, None], a, alpha[:, i - 1])
            for i in range(length - 2, -1, -1):
                b = np.logaddexp.reduce(self.t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
                beta[:, i] = np.where(mask[:, i + 1, None], b, 0)
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            both = np.exp(alpha[:, :-1, :, None] + self.t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            err = (p - gold).reshape(-1, 2)
            gw = np.stack([np.bincount(ids, weights=err[page * length + place, k], minlength=SIZE) for k in (0, 1)], axis=1)
            grads = [gw / n + decay * self.w, (both.sum(axis=(0, 1)) - pairs) / n, (p[:, 0] - gold[:, 0]).mean(axis=0)]
            for i, (q, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                q -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def decode(self, page: list[list[int]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not page:
            return []
        w = self._rows()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = self.s.tolist()
        back = []
        for i, ids in enumerate(page):
            e0 = e1 = 0.0
            for k in ids:
                x = w[k]
                e0 += x[0]
                e1 += x[1]
            if i:
                p, q, r, s = a + t00, b + t10, a + t01, b + t11
                back.append((0 if p >= q else 1, 0 if r >= s else 1))
                a, b = max(p, q) + e0, max(r, s) + e1
            else:
                a, b = a + e0, b + e1
        label = 0 if a >= b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def _rows(self) -> list:
        if not hasattr(self, "_list"):
            self._list = self.w.tolist()
        return self._list

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_list"}


MARK = "\ue000"


def labelled_page(r: random.Random) -> str:
    """A generated page whose content blocks begin with MARK."""

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeiourstnlmdkbp") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def para(a: int = 1, b: int = 80) -> str:
        return words(a, b).capitalize() + r.choice([".", ".", ".", "", "?", ":"])

    def wrap(tag: str, inner: str, names: tuple[str, ...] = ()) -> str:
        if not names:
            return f"<{tag}>{inner}</{tag}>"
        return f'<{tag} {r.choice(["class", "id", "class"])}="{r.choice(names)}">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def content(tag: str) -> str:
        kind = r.random()
        text = MARK + para()
        if kind < 0.2:
            return f"<p><b>{text}<br>" if r.random() < 0.7 else f"<p>{text}"
        if kind < 0.3:
            return wrap("ul", "".join(wrap("li", MARK + para(1, 12)) for _ in range(r.randint(1, 4))))
        if kind < 0.35:
            return wrap("blockquote", text)
        if kind < 0.4:
            return wrap(r.choice(["h2", "h3"]), MARK + words(1, 8))
        if kind < 0.44:
            return wrap("pre", text)
        if kind < 0.48:
            return wrap("table", "<tr>" + "".join(wrap("td", MARK + words(1, 4)) for _ in range(3)) + "</tr>")
        if kind < 0.52:
            return f'<p>{text} <a href="/x">{words(1, 4)}</a> {words(1, 9)}.</p>'
        if kind < 0.55 and tag:
            return wrap("figure", wrap("figcaption", MARK + para(2, 12)))
        return wrap(r.choice(["p", "p", "p", "p", "div"]), text)

    ad = lambda: wrap(r.choice(["div", "aside", "section"]), r.choice([para(2, 20), wrap("p", para(2, 20))]), ("ad", "ads", "advert", "banner ad", "sponsored", "promo", "advertisement"))
    nav = lambda: wrap("nav", links(r.randint(2, 8)), r.choice([(), ("menu", "nav", "navbar")])) if r.random() < 0.7 else wrap("div", links(r.randint(2, 8)), ("menu", "nav", "navigation", "breadcrumb", "main-menu"))
    aside = lambda: wrap(r.choice(["aside", "div"]), wrap("h3", words(1, 3)) + r.choice([links(4), wrap("p", para(3, 20))]), ("sidebar", "side", "widget", "related", "sidebar-right"))
    comments = lambda: wrap(r.choice(["section", "div"]), wrap("h3", words(1, 2)) + "".join(wrap("div", wrap("p", para(3, 40)), ("comment", "reply", "comment-body")) for _ in range(r.randint(1, 4))), ("comments", "comment-list", "discussion", "responses"))
    notice = lambda: wrap("div", r.choice([para(3, 25), wrap("p", para(3, 25))]), ("cookie", "notice", "cookie-banner", "consent", "gdpr", "alert", "newsletter", "subscribe", "popup"))
    form = lambda: wrap("form", f"<label>{words(1, 3)}</label><input name=q>" + wrap("p", para(2, 10)), r.choice([(), ("search", "login", "signup")]))
    share = lambda: wrap("div", links(3), ("share", "social", "tags", "author-links"))

    tag = r.choice(["article", "article", "article", "main", "div", "section", "div"])
    names = r.choice([("content", "post", "entry", "article", "main-content", "story", "post-body", "article-body")]) if tag in ("div", "section") or r.random() < 0.3 else ()
    body = [wrap("h1", MARK + words(2, 12))] if r.random() < 0.9 else []
    for _ in range(r.randint(1, 14)):
        body.append(content(tag))
        if r.random() < 0.06:
            body.append(r.choice([ad, share, aside, form, notice])())
    if r.random() < 0.1:
        body.append(comments())
    page = [f"<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>{words(2, 10)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>"]
    if r.random() < 0.3:
        page.append(notice())
    if r.random() < 0.4:
        page.append(wrap("header", wrap(r.choice(["h1", "div", "p"]), words(1, 5)) + r.choice(["", nav()]), r.choice([(), ("header", "site-header", "masthead")])))
    for part, share_ in ((nav, 0.85), (form, 0.15), (ad, 0.6), (aside, 0.25)):
        if r.random() < share_:
            page.append(part())
    page.append(f"<!-- {words(1, 3)} -->")
    inner = wrap(tag, "".join(body), names)
    page.append(wrap("main", inner) if tag != "main" and r.random() < 0.2 else wrap("div", inner, ("wrapper", "container", "page", "row")) if r.random() < 0.2 else inner)
    for part, share_ in ((comments, 0.3), (aside, 0.25), (ad, 0.2), (form, 0.15), (share, 0.15), (notice, 0.1)):
        if r.random() < share_:
            page.append(part())
    if r.random() < 0.9:
        page.append(wrap(r.choice(["footer", "footer", "footer", "div"]), r.choice(["", "&copy; "]) + words(1, 4) + " &middot; " + para(2, 15) + r.choice(["", links(3)]), r.choice([(), ("footer", "site-footer", "copyright")])) if r.random() < 0.8 else wrap("footer", para(2, 20)))
    if r.random() < 0.9:
        page.append("</body></html>")
    return "".join(page)


@lru_cache(maxsize=1)
def trained(pages: int = 700, seed: int = 3) -> Field:
    """The field fitted to ``pages`` generated pages."""
    r = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        found = blocks(labelled_page(r))
        if found:
            labels.append([int(MARK in t) for t, _, _ in found])
            clean = [(t.replace(MARK, "") or "x", p, k) for t, p, k in found]
            rows.append([block_features(b) for b in clean])
    field = Field()
    field.fit(rows, labels)
    return field


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    labels = field.decode([block_features(b) for b in found])
    return " ".join(b[0] for b, y in zip(found, labels, strict=True) if y)


def add_main_text(df, keep: list[str], field: Field, source: str = "html"):
    """Columns ``keep`` with text and n_chars of each page."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from .bpe import slices

    keep = [c for c in keep if c not in ("text", "n_chars")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        for batch in batches:
            for lo, pages in slices(batch, "__tf_page"):
                texts = [main_text(p, field) for p in pages]
                columns = [batch.column(i).slice(lo, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.fieldNames())

    return df.select(*keep, F.col(source).cast("string").alias("__tf_page")).mapInArrow(run, schema)
