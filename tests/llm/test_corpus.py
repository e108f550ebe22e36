"""De-duplication, mixing and the pipeline against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from textforge.llm import line_dedup, mixing, near_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, __c string"


def frame(spark, texts, sources=("a", "b", None)):
    return spark.createDataFrame([(i, t, "en", sources[(i or 0) % len(sources)], len(t or ""), 9, "x") for i, t in texts], SCHEMA)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def sentences(r, n):
    return " ".join(prose(r, r.randint(5, 11)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def passages():
    r = random.Random(1)
    passage = sentences(r, 10)
    texts = [(i, sentences(r, 6) + " " + prose(r, 4) + " " + passage + " " + prose(r, 3) + ". " + sentences(r, 5) if i % 2 else sentences(r, 12)) for i in range(30)]
    return passage, texts + [(30, None), (31, ""), (32, "short"), (33, "short"), (None, "no id"), (34, " \n \n"), (1, texts[1][1])]


def test_passages_are_cut(spark, passages):
    passage, texts = passages
    rows = line_dedup.dedup_lines(frame(spark, texts)).collect()
    by_id = {r.doc_id: r for r in rows if r.doc_id != 1}
    assert len(rows) == len(texts)
    first = [r for r in rows if r.doc_id == 1]
    assert all(r.text == texts[1][1] for r in first) and len(first) == 2
    words = passage.split()
    for i in range(3, 30, 2):
        left = by_id[i].text
        assert passage not in left
        stay = sum(" ".join(words[k : k + 8]) in left for k in range(len(words) - 8))
        assert stay <= 0.1 * len(words), (i, stay)
        assert by_id[i].n_chars == len(left) == len(texts[i][1]) - by_id[i].removed_chars
    for i, t in texts[:30:2] + texts[30:36]:
        assert by_id[i].text == t and by_id[i].removed_chars == 0 and by_id[i].size == 9


def test_every_cut_text_stays_somewhere(spark):
    r = random.Random(2)
    pool = [sentences(r, 3) for _ in range(12)]
    texts = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 8)))) for i in range(60)]
    rows = line_dedup.dedup_lines(frame(spark, texts)).collect()
    whole = "\n".join(x.text for x in rows)
    for text in pool:
        if any(text in t for _, t in texts):
            for part in text.split(". "):
                assert part.strip(". ") in whole
    assert sum(len(x.text) for x in rows) < 0.6 * sum(len(t) for _, t in texts)


def spans_of(text):
    runs = line_dedup.Runs([text])
    return [(int(runs.starts[i]), int(runs.ends[j])) for i, j in zip(*runs.chunks(), strict=True)]


def test_lines():
    for text in ("", "a", "One. Two! Three?\n\nFour\n", "\n\n", " \n x", "no end. ", "1.5 a.b c.\td. e\u2028f.  g"):
        runs = line_dedup.Runs([text])
        got = [text[runs.starts[i] : runs.ends[j]] for i, j in zip(*runs.lines(), strict=True)]
        assert got == [x.strip() for x in re.split(r"\n|(?<=[.!?])(?= )", text) if x.strip()]


def test_texts_in_one_slice_are_scanned_as_alone():
    r = random.Random(4)
    texts = [sentences(r, r.randint(0, 30)) + r.choice(["", " ", "\n", "\n\n x"]) for _ in range(40)] + ["", " ", "a"]
    together = line_dedup.Runs(texts).rows()
    got = sorted(zip(*(together[k].tolist() for k in ("doc", "a", "b", "c", "lo", "hi")), strict=True))
    alone = []
    for i, t in enumerate(texts):
        rows = line_dedup.Runs([t]).rows()
        alone += [(i, *x) for x in zip(*(rows[k].tolist() for k in ("a", "b", "c", "lo", "hi")), strict=True)]
    assert got == sorted(alone) and len(got) > 100


def test_boundaries_resist_shifts():
    r = random.Random(3)
    text = sentences(r, 60)
    a = {text[i:j] for i, j in spans_of(text)}
    other = sentences(r, 3) + " " + text
    b = {other[i:j] for i, j in spans_of(other)}
    assert len(a) > 5 and len(a & b) >= len(a) - 1


def repeats(texts, n):
    """Words (document, first character) in a run of n words that also stands in a lower place: by all pairs of runs."""
    seen, out = {}, set()
    for d, text in texts:
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        for i in range(len(words) - n + 1):
            run = text[words[i][0] : words[i + n - 1][1]]
            if run in seen:
                out |= {(d, a) for a, _ in words[i : i + n]}
            else:
                seen[run] = d, i
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(11)
    pool = [sentences(r, k % 9 + 1) for k in range(30)]
    texts = []
    for i in range(80):
        parts = [r.choice(pool) if r.random() < 0.4 else prose(r, r.randint(1, 40)) + r.choice([".", ""]) for _ in range(r.randint(1, 9))]
        texts.append((i, r.choice([" ", "\n"]).join(parts)))
    texts.append((80, texts[3][1]))
    docs = frame(spark, texts)
    spans = {x.doc_id: x for x in line_dedup.dedup_lines(docs).collect()}
    first: dict[str, int] = {}
    cut = repeats(texts, line_dedup.LONG)
    for d, text in texts:  # chunks that stand lower, whole
        for a, b in spans_of(text):
            if text[a:b] in first:
                cut |= {(d, a + m.start()) for m in re.finditer(r"\S+", text[a:b])}
            first.setdefault(text[a:b], d)
    # What must go is gone, and nothing that doesn't stand beside an equal word in a lower place.
    for d, text in texts:
        words = {(d, m.start()): m[0] for m in re.finditer(r"\S+", text)}
        unlike = words.keys() - repeats([(-1, t) for _, t in texts[:d]] + [(d, text)], 2)
        left = Counter(spans[d].text.split())
        assert left <= Counter(w for k, w in words.items() if k not in cut)
        assert left >= Counter(words[k] for k in unlike)
    assert len(cut) > 300


def test_line_dedup_of_nothing(spark):
    rows = spark.createDataFrame([], "doc_id long, text string, removed_chars string, n int")
    out = line_dedup.dedup_lines(rows)
    assert out.columns == ["doc_id", "text", "n", "removed_chars"] and out.count() == 0
    rows = spark.createDataFrame([(None, None, "x", 1), (None, None, "x", 1)], "doc_id long, text string, removed_chars string, n int")
    assert [tuple(x) for x in line_dedup.dedup_lines(rows).collect()] == [(None, None, 1, 0)] * 2


def jaccard(x, y):
    a, b = set(simhash.shingles(x or "", 5)), set(simhash.shingles(y or "", 5))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies(spark):
    r = random.Random(4)
    texts = []
    for _ in range(25):
        words = prose(r, r.randint(60, 300)).split()
        for edits in r.choice([(0,), (0, 0, 0), (0, 1, 2), (0, 3)]):
            copy = list(words)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two words"), (None, "a null id here and more"), (5, texts[5])]
    kept = near_dedup.keep_one(frame(spark, rows)).collect()
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, t) for i, t in rows if i is not None]
    for (i, x), (j, y) in itertools.combinations(known, 2):
        if jaccard(x, y) >= 0.8:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    assert sorted(r_.doc_id for r_ in kept if r_.doc_id is not None) == sorted({find(i) for i in parent})
    assert sum(r_.doc_id is None for r_ in kept) == 1
    assert near_dedup.keep_one(frame(spark, rows).where("false")).count() == 0


def plan(sizes):
    """Targets by repeated sharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    cap = {s: 2.0 * sizes[s] for s in order}
    target, full = {}, set()
    total = 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(cap[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: cap[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in order if s not in full and target[s] > cap[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    r = random.Random(seed)
    sources = ["a", "é", "Z", None, "b", "src10", "src9"][: 2 + 2 * seed + 1]
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 50, 300]))) for i in range(300)] + [(None, None), (7, "x y"), (7, "x y")]
    df = spark.createDataFrame([(i, t, sources[r.randrange(len(sources)) if r.random() < 0.7 else 0], 1.0) for i, t in rows], "doc_id long, text string, source string, size double")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
    goal = plan(sizes)
    for s in sizes:
        mine = [x for x in got if x.source == s]
        assert all(abs(x.target - goal[s]) < 1e-3 and x.source_size == sizes[s] and x.taken <= 2 * x.size for x in mine)
        assert abs(sum(x.taken for x in mine) - goal[s]) <= 300
    assert mixing.mix(df.where("false")).count() == 0


def test_word_counts(spark):
    texts = ["", None, " a\tb\n\x0bc\x0cd\re ", "é f g\xa0h"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {x.doc_id: x.size for x in mixing.mix(df).collect()}
    assert got == {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(texts)}


def test_stages_keep_columns(spark, passages, tmp_path):
    docs = frame(spark, passages[1])
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
