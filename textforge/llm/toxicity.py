"""Toxicity by weak supervision.

1. Voters.  Some know nothing of the labels: lexicons of common insults by theme and language, and patterns (capitals, runs of
   punctuation, masked words, insults that address someone or come twice, and so on).  Others are lexicons mined from a bounded
   sample (SAMPLE) of labelled rows: words and word starts that go with the label, grouped by the rows they occur in.  The
   label that annotators gave a row of the sample is one more vote.  Each voter votes toxic or clean, or abstains; how far it's
   right, if at all, is for the label model to find out.
2. Label model: the label is hidden; each voter's vote depends on it and on the vote of at most one other voter.  Those pairs are the
   tree of greatest conditional mutual information (correlations), and all probabilities (accuracies and correlations) are estimated
   together by expectation maximisation.
3. A logistic regression on selected features is fitted to the label model's posteriors.

A score is the regression's probability; it uses the text alone.  Null and empty texts have no feature and get the
intercept's score; texts are read whole whatever their length; rows that repeat have one result each.  Without labelled rows, or with one
label only, every score is 0.  Repeated labels of one doc_id count once, as their largest; null ids are never learnt from.  An empty
table gives no row; a kept column named score is replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices

SAMPLE = 8000
LEXICONS = 12
#: Standard deviations by which a feature must go with a label: beyond what chance gives any of the features of a sample.
SURE = 8.0
WORD = re.compile(r"\w+")
#: Common insults by theme and language, each line a voter's lexicon.
LEXICA = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid dumb imbecile fool fools dimwit halfwit brainless",
    "ridicule": "clown clowns joke laughable ridiculous buffoon jerk jerks dork",
    "worth": "worthless useless pathetic loser losers failure nobody pitiful",
    "filth": "trash garbage scum filth filthy vermin sewage dirt",
    "disgust": "disgusting revolting vile repulsive nasty gross sickening",
    "malice": "hate hateful despise liar liars coward cowards traitor bastard bastards",
    "threat": "kill killed destroy burn suffer beat punish",
    "german": "idiot dummkopf trottel arschloch versager abschaum ekelhaft widerlich schwachkopf",
    "french": "idiot imb\u00e9cile cr\u00e9tin connard d\u00e9bile minable ordure d\u00e9go\u00fbtant",
    "spanish": "idiota imb\u00e9cil est\u00fapido tonto basura in\u00fatil asqueroso perdedor",
}
INSULTS = sorted({w for name in ("stupidity", "ridicule", "worth", "filth", "disgust", "malice") for w in LEXICA[name].split()})
INSULT = re.compile(rf"\b(?:{'|'.join(INSULTS)})\b", re.I)
ADDRESS = re.compile(rf"\b(?:you|your|he|she|they|this|what an?)\b(?:\W+\w+){{0,3}}?\W+(?:{'|'.join(INSULTS)})\b", re.I)
MASKED = re.compile(r"\w[*#@$]{2,}\w")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
PATTERNS = ("capitals", "exclamation", "masked", "stretched", "addressed", "insulted twice", "many different words", "figures")
#: The first patterns vote toxic, the others clean.
QUIET = 6
#: Conditional mutual information of all rows together, in nats, from which two voters count as dependent: chance gives about 4.
LINK = 40.0
#: Shares of right votes that are expected of toxic and clean votes.
PRIOR, CLEAN = 0.85, 0.97
#: Votes that the expectation counts for, as a share of a voter's own.
WEIGHT = 0.1
MEMO = 150_000


def features(word: str) -> tuple[int, ...]:
    """Feature numbers of a word: itself and its first five characters."""
    w = zlib.crc32(b"w" + word.encode())
    return (w, zlib.crc32(b"p" + word[:5].encode())) if len(word) > 5 else (w,)


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def feature_set(text: str, memo: dict[str, tuple[int, ...]]) -> np.ndarray:
    found = words(text)
    if len(memo) > MEMO:
        memo.clear()
    out: set[int] = set()
    for w in found:
        ids = memo.get(w)
        if ids is None:
            ids = memo[w] = features(w)
        out.update(ids)
    return np.fromiter(out, dtype=np.uint32, count=len(out))


def patterns(text: str, distinct: int) -> int:
    """A bit for each of PATTERNS that a text has; ``distinct`` is the number of its different words."""
    upper = sum(map(str.isupper, text))
    insults = [w.lower() for w in INSULT.findall(text)]
    found = (
        upper * 2 > len(text) > 40,
        "!!" in text or "?!" in text,
        MASKED.search(text) is not None,
        STRETCHED.search(text) is not None,
        bool(insults) and ADDRESS.search(text) is not None,
        len(insults) > len(set(insults)),
        distinct > 200,
        sum(map(str.isdigit, text)) * 50 > len(text),
    )
    return sum(1 << i for i, x in enumerate(found) if x)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    intercept: float = -30.0
    weights: dict[int, float] = field(default_factory=dict)
    voters: list[str] = field(default_factory=list)
    accuracy: np.ndarray | None = None
    parents: list[int] = field(default_factory=list)

    def scorer(self):
        memo: dict[str, float] = {}
        weights = self.weights

        def score(text: str) -> float:
            if len(memo) > MEMO:
                memo.clear()
            total = self.intercept
            for w in words(text):
                x = memo.get(w)
                if x is None:
                    x = memo[w] = sum(weights.get(i, 0.0) for i in features(w))
                total += x
            return 1 / (1 + np.exp(-min(max(total, -30.0), 30.0)))

        return score


def pair_tables(hot: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts [label, voter, voter, vote, vote]."""
    n, m, v = hot.shape
    flat = hot.reshape(n, m * v)
    return np.stack([(flat * weight[:, y : y + 1]).T @ flat for y in (0, 1)]).reshape(2, m, v, m, v).transpose(0, 1, 3, 2, 4)


def dependences(pairs: np.ndarray) -> list[int]:
    """The parent of each voter, -1 for none: the tree of greatest conditional mutual information, without its weak links."""
    joint = pairs + 1e-9
    joint = joint / joint.sum(axis=(0, 3, 4), keepdims=True)
    of_y = joint.sum(axis=(3, 4), keepdims=True)
    info = (joint * np.log(joint * of_y / (joint.sum(axis=4, keepdims=True) * joint.sum(axis=3, keepdims=True)))).sum(axis=(0, 3, 4))
    m = len(info)
    parent, best, of, left = [-1] * m, np.full(m, -1.0), np.full(m, -1), set(range(1, m))
    last = 0
    while left:
        for j in left:
            if info[last, j] > best[j]:
                best[j], of[j] = info[last, j], last
        last = max(left, key=lambda j: best[j])
        left.remove(last)
        if best[last] * pairs.sum() / m**2 > LINK:
            parent[last] = int(of[last])
    return parent


def label_model(votes: np.ndarray, rounds: int = 60, base: float = 0.1) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Posteriors of the label 1, each voter's vote probabilities [voter, label, vote], its parent, and these given the parent's vote.

    votes: [row, voter], -1 clean, 0 abstain, 1 toxic.  Whether a voter abstains says nothing about the label.  A prior, of WEIGHT
    times the votes themselves, has each voter right in the share PRIOR of its toxic votes and CLEAN of its clean ones, so that one
    which no other ever meets isn't taken for noise.  The base rate is that of the sample's labels.  The last result is [voter, label, parent's vote, vote].
    """
    n, m = votes.shape
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    total = votes.sum(axis=1)
    post = np.where(total > 0, 0.9, np.where(total < 0, 0.02, base))
    parent = [-1] * m
    code = votes + 1
    right = np.array([[CLEAN, 1 - base, 1 - PRIOR], [1 - CLEAN, base, PRIOR]])  # [label, vote]
    for step in range(rounds):
        weight = np.stack([1 - post, post], axis=1)
        pairs = pair_tables(hot, weight)
        if step in (5, 15, 30):
            parent = dependences(pairs)
        logit = np.full(n, np.log(base / (1 - base)))
        alone, given = np.zeros((m, 2, 3)), np.zeros((m, 2, 3, 3))
        for j, k in enumerate(parent):
            own = pairs[:, j, j].diagonal(axis1=1, axis2=2)
            own = own + WEIGHT * right * own.sum(axis=0) + 0.5
            alone[j] = own / own.sum(axis=1, keepdims=True)
            if k >= 0:
                counts = pairs[:, k, j] + WEIGHT * right[:, None] * pairs[:, k, j].sum(axis=0)
            else:
                counts = np.repeat(own[:, None], 3, axis=1)
            # Votes that hardly occur beside a parent's vote fall back on the voter's own share.
            counts = counts + 3 * alone[j][:, None]
            given[j] = counts / counts.sum(axis=2, keepdims=True)
            odds = np.log(given[j, 1]) - np.log(given[j, 0])
            odds[:, 1] = 0
            logit += odds[code[:, k] if k >= 0 else 0, code[:, j]]
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6 and step > 30:
            break
    return post, alone, parent, given


def grouped(sets: list[np.ndarray], found: np.ndarray, groups: int) -> list[np.ndarray]:
    """Mined features in groups that occur in the same rows: each goes with the seed it meets most often, seeds that meet least."""
    if not len(found):
        return []
    place = {int(f): i for i, f in enumerate(found)}
    met = np.zeros((len(found), len(found)))
    for ids in sets:
        here = [place[i] for i in ids.tolist() if i in place]
        met[np.ix_(here, here)] += 1
    share = met / np.sqrt(np.outer(met.diagonal(), met.diagonal()))
    seeds = [int(np.argmax(met.diagonal()))]
    while len(seeds) < min(groups, len(found)):
        seeds.append(int(np.argmax(met.diagonal() * (1 - share[seeds].max(axis=0)) * ~np.isin(np.arange(len(found)), seeds))))
    of = share[seeds].argmax(axis=0)
    of[seeds] = np.arange(len(seeds))
    return [found[of == k] for k in range(len(seeds))]


def without_copies(sets: list[np.ndarray], views: int = 8, size: int = 3) -> list[int]:
    """Rows of the sample without near copies of earlier ones, whose words would count as often as they were copied.

    Rows that share the ``size`` smallest hashes of a view are compared; over half of all features in common is a copy.
    """
    seen: dict[tuple, list[int]] = {}
    kept = []
    for i, ids in enumerate(sets):
        keys = []
        if len(ids) > size:
            for v in range(views):
                mixed = (ids.astype(np.uint64) + np.uint64(v * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                keys.append((v, *np.sort(np.partition(mixed, size)[:size]).tolist()))
        else:
            keys.append((-1, *ids.tolist()))
        near = {j for k in keys for j in seen.get(k, ())}
        if any(2 * len(np.intersect1d(ids, sets[j], assume_unique=True)) >= max(1, len(ids) + len(sets[j])) * 2 / 3 for j in near):
            continue
        kept.append(i)
        for k in keys:
            seen.setdefault(k, []).append(i)
    return kept


def fit(sets: list[np.ndarray], marks: np.ndarray, labels: np.ndarray) -> Model:
    """The model from feature sets, bits of PATTERNS and labels of the sample's rows."""
    kept = without_copies(sets)
    sets, marks, labels = [sets[i] for i in kept], marks[kept], labels[kept]
    n = len(sets)
    if not n or labels.min() == labels.max():
        return Model()
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    toxic = np.bincount(ids, weights=labels[rows], minlength=len(known))
    every = np.bincount(ids, minlength=len(known))
    rate, n1 = labels.mean(), labels.sum()
    z = (toxic - every * rate) / np.sqrt(np.maximum(every * rate * (1 - rate), 1e-9))
    sure = np.flatnonzero((every >= 8) & (toxic >= 0.7 * every) & (z > SURE))
    clean = np.flatnonzero((every >= 20) & (z < -4) & (toxic < 0.5 * rate * every))
    chosen = np.flatnonzero((every >= 8) & (np.abs(z) > SURE))

    def hits(of: np.ndarray) -> np.ndarray:
        return np.bincount(rows[np.isin(known, of)[ids]], minlength=n) > 0

    voters: dict[str, np.ndarray] = {}
    for name, lexicon in LEXICA.items():
        voters[f"lexicon {name}"] = np.where(hits(np.array([features(w)[0] for w in lexicon.split()])), 1, 0)
    for i, name in enumerate(PATTERNS):
        voters[f"pattern {name}"] = np.where(marks >> i & 1, 1 if i < QUIET else -1, 0)
    for k, lexicon in enumerate(grouped(sets, known[sure], LEXICONS)):
        voters[f"mined lexicon {k}"] = np.where(hits(lexicon), 1, 0)
    voters["no mined word"] = np.where(hits(known[sure]), 0, -1)
    voters["clean words"] = np.where(hits(known[clean]), -1, 0)
    voters["annotation"] = np.where(labels > 0, 1, -1)
    votes = np.stack(list(voters.values()), axis=1)
    post, table, parent, _ = label_model(votes, base=float(rate))
    names = list(voters)

    place = np.full(len(known), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[ids] >= 0
    r, c = rows[keep], place[ids[keep]]
    w, b = np.zeros(len(chosen)), float(np.log(rate / (1 - rate)))
    gw, gb = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(400):  # full-batch AdaGrad with an L2 penalty
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, weights=w[c], minlength=n), -30, 30)))
        err = p - post
        dw = np.bincount(c, weights=err[r], minlength=len(chosen)) / n1 + 1e-3 * w
        db = err.sum() / n1
        gw += dw**2
        gb += db**2
        w -= 0.5 * dw / np.sqrt(gw)
        b -= 0.5 * db / np.sqrt(gb)
    return Model(float(b), {int(i): float(x) for i, x in zip(known[chosen], w, strict=True)}, names, table, parent)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled rows outside the held-out fifth, chosen by a hash of doc_id."""
    known = labels.select(F.col("doc_id").alias("__tf_id"), F.col("toxic").cast("int").alias("__tf_toxic")).where(~held_out(F.col("__tf_id")) & F.col("__tf_toxic").isNotNull() & F.col("__tf_id").isNotNull())
    known = known.groupBy("__tf_id").agg(F.max("__tf_toxic").alias("__tf_toxic"))
    n = known.count()
    if not n:
        return Model()
    share = min(1.0, sample / n)
    picked = known.where(F.pmod(F.xxhash64("__tf_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The chosen ids are about ``sample`` rows whatever the input: small enough for every executor.
    rows = docs.join(F.broadcast(picked), docs["doc_id"] == picked["__tf_id"]).select(F.col("__tf_toxic"), F.col("text").cast("string").alias("__tf_text"))

    def run(batches):
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for lo, texts in slices(batch, "__tf_text"):
                sets = [feature_set(t, memo) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([patterns(t, len(x)) for t, x in zip(texts, sets, strict=True)], pa.int32())],
                    names=["label", "ids", "marks"],
                )

    found = rows.mapInArrow(run, "label int, ids binary, marks int").toArrow()
    order = np.argsort([zlib.crc32(x) for x in found["ids"].to_pylist()], kind="stable") if len(found) else []
    sets = [np.frombuffer(x, np.uint32) for x in found["ids"].to_pylist()]
    y, marks = np.array(found["label"].to_pylist(), dtype=float), np.array(found["marks"].to_pylist(), dtype=np.int64)
    return fit([sets[i] for i in order], marks[order], y[order]) if len(found) else Model()


def add_score(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and score (double)."""
    keep = [c for c in keep if c != "score"]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = shared.value.scorer()
        for batch in batches:
            for lo, texts in slices(batch, "__tf_text"):
                columns = [batch.column(i).slice(lo, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([score(t) for t in texts], pa.float64())], names=schema.fieldNames())

    return df.select(*keep, F.col("text").cast("string").alias("__tf_text")).mapInArrow(run, schema)
