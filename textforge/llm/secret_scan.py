"""Secret scans: base patterns, and a character convolutional network over every candidate and its context.

Candidates are all runs of 12 or more characters of the alphabet of keys that hold a digit or mixed case.  The network
sees each of them whole, with BEFORE characters before it and AFTER behind it, in windows of WIDTH characters a STRIDE apart, in
which the candidate's characters are marked; a candidate's score is that of its highest window, so a key deep inside a long run
counts as one by itself does.  The network is trained on labelled findings: a generated set of secrets, alone and inside
of longer runs, and of things that look like them (mail and web addresses, numbers, paths, words, dates, version strings,
identifiers).  The threshold is the largest one that keeps the share RECALL of the calibration set's secrets; scores are calibrated
by Platt scaling on the same set.

Base findings always stay; what they leave of a run is a candidate if it's long enough.  Spans are in order of start, then kind, so
nothing ties; rows that repeat have one result each.  Null and empty texts have no findings, texts are read whole whatever their
length, an empty table gives no row, and kept columns with names of the results are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.A)
HINT = re.compile(r"(?i:passw|secret|token|api)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
BEFORE, AFTER, WIDTH, STRIDE = 16, 8, 48, 24
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-@:\"' \n"
CODE = np.full(128, len(ALPHABET) + 1, dtype=np.uint8)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
SYMBOLS = len(ALPHABET) + 2
RECALL = 0.98


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then kind."""
    found = []
    if HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs, or what base findings leave of them, that may be keys: with a digit, or capitals other than a first one next to small letters."""
    out = []
    at, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        free = []
        while at < len(base) and base[at][0] < end:  # findings are in order of start
            free.append((max(start, reach), base[at][0]))
            reach = max(reach, base[at][2])
            at += 1
        free.append((max(start, reach), end))
        for a, b in free:
            word = text[a:b].rstrip(".") if b - a >= 12 else ""
            if len(word) >= 12 and (not word.isalpha() or not (word[1:].islower() or word.isupper())):
                out.append((a, a + len(word)))
    return out


def windows(start: int, end: int) -> range:
    """Where the windows of a candidate start."""
    more = max(0, end + AFTER - (start - BEFORE) - WIDTH)
    return range(start - BEFORE, start - BEFORE - (-more // STRIDE) * STRIDE + 1, STRIDE)


def encode(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol codes of all spans' windows, and the first window of each span; symbols of the candidate count from SYMBOLS on."""
    codes = CODE[np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), 127)]
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), codes, np.zeros(2 * WIDTH, np.uint8)])
    starts = [windows(a, b) for a, b in spans]
    per = np.fromiter(map(len, starts), np.int64, len(starts))
    at = np.fromiter((w for ws in starts for w in ws), np.int64, int(per.sum()))
    places = at[:, None] + np.arange(WIDTH)
    rows = padded[places + BEFORE]
    a, b = (np.repeat(np.fromiter(x, np.int64, len(spans)), per)[:, None] for x in zip(*spans, strict=True))
    return rows + (SYMBOLS * ((places >= a) & (places < b))).astype(np.uint8), np.cumsum(per) - per


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], list[tuple[int, int] | None]]:
    """n generated findings (text, start, end), and where the secret of each about second one is."""
    r = random.Random(seed)
    hexa, upper, word62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = [a + b + c for a in ("", *"bcdfghjklmnpqrstvwxz", "ch", "sch", "th", "st", "wh") for b in ("a", "e", "i", "o", "u", "ie", "eau", "ou") for c in ("", "n", "r", "t", "s", "ng", "st", "nd", "tz", "x", "ch")]

    def of(chars: str, a: int, b: int) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(a, b)))

    common = "config settings readme index keys key token secret data lib var usr src main test docs images static file name path page list user admin before after long of the and http www html json xml".split()

    def word(a: int = 1, b: int = 4) -> str:
        if r.random() < 0.2:
            return r.choice(common)
        return "".join(r.choice(parts) for _ in range(r.randint(a, b)))

    secrets = (
        lambda: of(word62, 20, 48), lambda: of(word62 + "+/", 24, 60) + r.choice(["", "=", "=="]), lambda: of(hexa, 32, 64),
        lambda: r.choice(["sk_live_", "pk_", "ghp_", "xoxb-", "key-", "AIza", "tok_"]) + of(word62, 16, 36), lambda: "AKIA" + of(upper, 14, 18),
        lambda: "eyJ" + of(word62, 15, 30) + "." + of(word62 + "_-", 20, 40),
    )
    plain = (
        lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.{word(2, 4)}.com".split("@")[1], lambda: of("0123456789", 12, 19), lambda: f"{word(2, 5)}-{word(2, 5)}-{word(1, 3)}{r.randint(1, 99)}",
        lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", lambda: f"/{word(2, 4)}/{word(2, 4)}/{word(2, 4)}.html", lambda: f"{word(2, 4)}_{word(2, 4)}_{word(2, 4)}",
        lambda: word(3, 5).capitalize() + word(3, 5).capitalize(), lambda: f"www.{word(2, 4)}.example.{r.choice(['com', 'org', 'net'])}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + ".1",
        lambda: f"{word(3, 5)}.{word(1, 4).capitalize()}", lambda: "-" * r.randint(12, 40), lambda: f"v{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}-{word(2, 3)}", lambda: f"{word(3, 5)}...{word(1, 3)}", lambda: "=" * r.randint(12, 40),
        lambda: word(4, 7).upper() + r.choice(["", "."]), lambda: word(4, 7) + ".", lambda: word(4, 7).capitalize() + ".", lambda: word(4, 7).upper() + r.choice(["", "."]), lambda: word(2, 5) + r.choice("_-=/.+") + word(2, 5) + r.choice(["", "."]),
    )
    leads = ("key: ", "token = \"", "password=", "secret: ", "auth ", "Bearer ", "credential ", "")
    path = lambda: r.choice(["", "/"]) + "".join(word(1, 4) + r.choice("//./-_") for _ in range(r.randint(1, 12)))
    texts, places = [], []
    while len(texts) < n:
        yes = r.random() < 0.5
        value = r.choice(secrets if yes else plain)()
        inner = (0, len(value))
        if r.random() < 0.3:
            head, tail = path(), r.choice(["", "", "/" + word(1, 3), "." + word(1, 2)])
            value, inner = head + value + tail, (len(head), len(head) + len(value))
        if len(value) < 12:
            continue
        before = " ".join(word() for _ in range(r.randint(0, 5))) + " "
        lead = r.choice(leads) if r.random() < (0.5 if yes else 0.1) else r.choice(["", "@", "http:/", " "]) if not yes else ""
        text = before + lead
        places.append((len(text) + inner[0], len(text) + inner[1]) if yes else None)
        texts.append((text + value + r.choice([" ", ". ", "\"", "\n"]) + " ".join(word() for _ in range(r.randint(0, 3))), len(text), len(text) + len(value)))
    return texts, places


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of generated findings and their labels; those that show a part of a secret too short to be told are left out."""
    xs, ys = [], []
    for (text, start, end), secret in zip(*labelled_findings(n, seed), strict=True):
        x, _ = encode(text, [(start, end)])
        if secret is None:
            seen, least = np.zeros(len(x)), 1
        else:
            seen = np.array([min(w + WIDTH, secret[1]) - max(w, secret[0]) for w in windows(start, end)])
            least = min(16, seen.max())
        told = (seen >= least) | (seen <= 0)
        xs.append(x[told])
        ys.append((seen >= least)[told])
    return np.concatenate(xs), np.concatenate(ys).astype(np.float32)


class Network:
    """Embedding, one convolution of width 5, maximum over positions, a linear output; Adam on log loss."""

    def __init__(self, embed: int = 8, filters: int = 32, width: int = 5, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {"e": rng.normal(0, 0.3, (2 * SYMBOLS, embed)), "w": rng.normal(0, 0.2, (width * embed, filters)), "b": np.zeros(filters), "o": rng.normal(0, 0.2, filters), "c": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        n, length, d = e.shape
        steps = length - self.width + 1
        windows = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n, steps, self.width * d)
        z = windows @ self.p["w"] + self.p["b"]
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0]
        hidden = np.maximum(top, 0)
        return windows, at, top, hidden, hidden @ self.p["o"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step, d = 0, self.p["e"].shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                rows = order[lo : lo + batch]
                windows, at, top, hidden, out = self._forward(x[rows])
                err = (1 / (1 + np.exp(-out)) - y[rows]) / len(rows)
                g = {"o": hidden.T @ err, "c": np.array([err.sum()], np.float32)}
                gh = err[:, None] * self.p["o"] * (top > 0)
                picked = windows[np.arange(len(rows))[:, None], at]
                g["w"] = np.einsum("nf,nfk->kf", gh, picked)
                g["b"] = gh.sum(axis=0)
                ge = np.zeros_like(self.p["e"])
                back = np.einsum("nf,kf->nfk", gh, self.p["w"]).reshape(len(rows), -1, self.width, d)
                at_symbol = x[rows][np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(self.width)]
                np.add.at(ge, at_symbol.reshape(-1), back.reshape(-1, d))
                g["e"] = ge
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling, then the largest threshold that keeps the share ``recall`` of the secrets."""
        z, a, b = np.maximum.reduceat(self.logits(x), first).astype(np.float64), 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a -= 0.5 * float(((p - y) * z).mean() / max(1.0, float((z * z).mean())))
            b -= 0.5 * float((p - y).mean())
        self.scale, self.shift = a, b
        good = np.sort(self.scores(x, first)[y == 1])
        self.threshold = float(good[int((1 - recall) * len(good))])

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The score of each candidate: windows x, of which a candidate's first is one of ``first``."""
        return 1 / (1 + np.exp(-np.clip(self.scale * np.maximum.reduceat(self.logits(x), first) + self.shift, -30, 30)))


def encode_findings(found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    xs = [encode(t, [(a, b)])[0] for t, a, b in found]
    return np.concatenate(xs), np.cumsum([0, *map(len, xs[:-1])])


@lru_cache(maxsize=1)
def trained() -> Network:
    """The network fitted to 12,000 generated findings and calibrated on 4,000 others."""
    net = Network()
    net.fit(*training_windows(12000, 11))
    found, places = labelled_findings(4000, 12)
    net.calibrate(*encode_findings(found), np.array([p is not None for p in places], dtype=np.float32))
    return net


def scan(text: str, net: Network) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base findings, and the spans that the network adds."""
    base = base_findings(text)
    spans = candidates(text, base)
    if not spans:
        return base, []
    keep = net.scores(*encode(text, spans)) >= net.threshold
    return base, [s for s, k in zip(spans, keep.tolist(), strict=True) if k]


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


def add_secrets(df, keep: list[str], net: Network, text: str = "text"):
    """Columns ``keep`` with n_assign, n_access, n_hex, base_sha256, spans, n_model."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from .bpe import slices

    added = {"n_assign": T.LongType(), "n_access": T.LongType(), "n_hex": T.LongType(), "base_sha256": T.StringType(), "spans": T.StringType(), "n_model": T.LongType()}
    keep = [c for c in keep if c not in added]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, t) for c, t in added.items()])
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for batch in batches:
            for lo, texts in slices(batch, "__tf_text"):
                rows = []
                for t in texts:
                    base, more = scan(t, net)
                    kinds = [k for _, k, _ in base]
                    spans = sorted([(a, k, b) for a, k, b in base] + [(a, len(KINDS), b) for a, b in more])
                    name = lambda found: joined([(a, (*KINDS, "model")[k], b) for a, k, b in found])
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(name(base).encode()).hexdigest(), name(spans), len(more)))
                columns = [batch.column(i).slice(lo, len(texts)) for i in range(len(keep))]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=schema.fieldNames())

    return df.select(*keep, F.col(text).cast("string").alias("__tf_text")).mapInArrow(run, schema)
