"""Cases that a cut would lose: star-shaped groups, passages off the common boundaries, keys deep inside a run."""

import random

import pytest

from textforge.llm import line_dedup, near_dedup
from textforge.llm.simhash import shingles


def test_stars_of_near_copies(spark):
    """Copies are alike to their original, not to each other."""
    r = random.Random(7)
    rows, stars = [], 12
    for star in range(stars):
        words = [f"w{star}x{i}" for i in range(300)]
        copies = [list(words) for _ in range(6)]
        for copy in copies:
            for k in range(5):
                copy[r.randrange(60 * k + 5, 60 * k + 55)] = f"e{r.random()}"
        texts = [" ".join(words), *(" ".join(c) for c in copies)]
        sets = [set(shingles(t, 5)) for t in texts]
        alike = lambda a, b: len(a & b) / len(a | b)
        assert all(alike(sets[0], s) >= 0.8 for s in sets[1:])
        assert sum(alike(a, b) < 0.8 for i, a in enumerate(sets[1:]) for b in sets[1:][:i]) >= 12
        rows += [(star * 10 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(x.doc_id for x in near_dedup.keep_one(df).collect())
    assert kept == [star * 10 for star in range(stars)]


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def sentences(r, n, least, most):
    return " ".join(prose(r, r.randint(least, most)).capitalize() + "." for _ in range(n))


@pytest.mark.parametrize(("words", "least", "most"), [(55, 12, 20), (80, 8, 15), (200, 15, 25)])
def test_whole_passages_are_cut(spark, words, least, most):
    """Every passage of over 50 words goes whole, though no chunk may end at the same places in both copies."""
    r = random.Random(words)
    rows, passages = [], []
    for i in range(60):
        passage = " ".join(sentences(r, 40, least, most).split()[3 : 3 + words])
        passages.append(passage)
        around = lambda: sentences(r, 5, least, most) + " " + prose(r, 4)
        rows += [(i, f"{around()} {passage} {around()}"), (1000 + i, f"{around()} {passage} {around()}")]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, passage in enumerate(passages):
        assert got[i].removed_chars == 0 and passage in got[i].text
        assert len(passage) <= got[1000 + i].removed_chars <= len(passage) + 2


def test_passages_whose_anchors_stand_elsewhere(spark):
    """Each run of 25 words of the passage stands in lower documents by itself."""
    r = random.Random(9)
    rows = []
    words = prose(r, 56).split()
    rows = [(k, f"{prose(r, 30)} {' '.join(words[k : k + 25])} {prose(r, 30)}") for k in range(0, 32)]
    rows += [(100 + k, f"{prose(r, 40)} {' '.join(words)} {prose(r, 40)}") for k in range(4)]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(" ".join(words))
    assert [n <= got[100 + k].removed_chars <= n + 2 for k in range(4)] == [False, True, True, True]
    assert all(got[k].removed_chars == 0 for k in range(32)) and got[100].removed_chars == 0
