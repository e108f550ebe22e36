"""Queries' results against separate computations, and the defined results of null, empty, deep, repeated and clashing input."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from textforge.llm import html_crf, line_dedup, mixing, near_dedup, order_minhash, png, secret_scan, simhash, toxicity

PAGE = "<html><body><nav><ul><li><a href=x>menu</a></ul></nav><article><h1>Head line here</h1><p>One sentence is here.</p>{}<p>Two of them are here.</p><p>Three of them are here.</p></article></body></html>"
WHOLE = "Head line here One sentence is here. Two of them are here. Three of them are here."


@pytest.mark.parametrize("tag", ["<style-guide></style-guide>", "<button-group>", "<select-box>", "<object-viewer>", "<button>", "<svg>", "<noscript>", "<iframe>", "<svg><title>x</title></svg>", "<button>x</button>", "<script>x</script >", "<style>p{}</style\n>", "<!-- x -->"])
def test_nothing_swallows_an_article(tag):
    assert html_crf.main_text(PAGE.format(tag), html_crf.trained()) == WHOLE


def test_time_of_deep_pages_grows_with_their_length():
    def steps(n):
        path, most = html_crf.Path(), 0
        for _ in range(n):
            path.push("div", 'class="a b"')
            most = max(most, len(path.all_features()))
        path.cut(0)
        assert not path.features and not any(path.names.values())
        return most

    assert steps(5000) == steps(50)
    assert len(html_crf.blocks("<div>" * 5000 + "<p>text</p>" * 5000)) == 5000


def test_main_text_of_a_table(spark):
    pages = [(1, "u", PAGE.format(""), "x"), (1, "u", PAGE.format(""), "x"), (2, None, None, "x"), (3, "u", "", None), (None, "u", "<p>", "x"), (4, "u", PAGE.format("<p>" + "very long text here. " * 20000 + "</p>"), "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    rows = html_crf.add_main_text(df, df.columns, html_crf.trained()).collect()
    assert rows[0].asDict().keys() == {"page_id", "url", "html", "text", "n_chars"}
    got = [(r.page_id, r.text) for r in rows]
    assert got[:5] == [(1, WHOLE), (1, WHOLE), (2, ""), (3, ""), (None, "")]
    assert rows[5].n_chars == len(rows[5].text) > 400_000 and "Two of them" in rows[5].text
    assert html_crf.add_main_text(df.where("false"), ["page_id"], html_crf.trained()).count() == 0


def brute_secrets(text, net):
    """Findings by scanning character by character, and the network by loops."""
    base, model = secret_scan.base_findings(text), []
    covered = {i for a, _, b in base for i in range(a, b)}
    alphabet = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in alphabet and j not in covered:
            j += 1
        run = text[i:j].rstrip(".")
        if j - i >= 12 and len(run) >= 12 and not (run.isalpha() and (run[1:].islower() or run.isupper())):
            best = -math.inf
            for w in itertools.count(i - secret_scan.BEFORE, secret_scan.STRIDE):
                x = []
                for k in range(w, w + secret_scan.WIDTH):
                    c = 0 if not 0 <= k < len(text) else secret_scan.CODE[min(ord(text[k]), 127)]
                    x.append(net.p["e"][c + (secret_scan.SYMBOLS if i <= k < i + len(run) else 0)])
                z = [np.concatenate(x[k : k + net.width]) @ net.p["w"] + net.p["b"] for k in range(len(x) - net.width + 1)]
                best = max(best, float(np.maximum(np.max(z, axis=0), 0) @ net.p["o"] + net.p["c"][0]))
                if w + secret_scan.WIDTH >= i + len(run) + secret_scan.AFTER:
                    break
            score = 1 / (1 + math.exp(-max(-30.0, min(30.0, net.scale * best + net.shift))))
            if abs(score - net.threshold) < 1e-6:
                return None
            if score > net.threshold:
                model.append((i, i + len(run)))
        i = max(j, i + 1)
    return base, model


def test_secret_scan_equals_brute_force():
    net = secret_scan.trained()
    found, _ = secret_scan.labelled_findings(240, 5)
    texts = [" ".join(t for t, _, _ in found[i : i + 3]) for i in range(0, 240, 3)] + ["", "password=abcdefghijkl0123456789abcdef/" + "ghp_A1b2C3d4E5f6G7h8I9j0K1l2 x"]
    added = 0
    for text in texts:
        expect = brute_secrets(text, net)
        if expect:
            assert secret_scan.scan(text, net) == expect
            added += len(expect[1])
    assert added > 40


def test_keys_deep_inside_a_run_are_found():
    net = secret_scan.trained()
    r = random.Random(3)
    key = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    heads = ["/srv/app/config/production/keys/sk_live_", "host.example.com/long/path/of/files/ghp_", "a-long-name-of-many-words-before-the-key-", "/var/lib/" * 30]
    hits = sum(bool(secret_scan.scan(f"see {h}{key()} there", net)[1]) for h in heads for _ in range(50))
    assert hits >= 190
    assert sum(bool(secret_scan.scan(f"see {h}settings/readme.html there", net)[1]) for h in heads[2:]) == 0


def test_secrets_of_a_table(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "password: abcdefghijklm", "x"), (2, "password: abcdefghijklm", "x"), (None, "a " * 50000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = secret_scan.add_secrets(df, df.columns, secret_scan.trained())
    got = out.collect()
    assert len(out.columns) == len(set(out.columns)) and [(r.n_assign, r.spans) for r in got] == [(0, ""), (0, ""), (1, "assign:0:23"), (1, "assign:0:23"), (0, "")]
    assert secret_scan.add_secrets(df.where("false"), ["doc_id"], secret_scan.trained()).count() == 0


def brute_media(text):
    """Payload, its figures and the cosine hash, computed with loops from an image that is read by hand."""
    raw = text.encode()
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    grey = [[(row[2 * i] + row[2 * i + 1]) / 2 for i in range(32)] for row in rows]
    if len(rows) >= 32:
        cuts = [i * len(rows) // 32 for i in range(33)]
        small = [[sum(grey[y][x] for y in range(a, b)) / (b - a) for x in range(32)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    else:
        small = [grey[i * len(rows) // 32] for i in range(32)]
    cos = lambda k, x: math.cos(math.pi / 32 * (x + 0.5) * k)
    terms = [sum(small[y][x] * cos(u, y) * cos(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    terms[0] = 0.0
    middle = sorted(terms)
    return payload, terms, (middle[31] + middle[32]) / 2


def read_by_hand(image):
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, data = 8, b""
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        assert zlib.crc32(image[at + 4 : at + 8 + n]) == struct.unpack_from(">I", image, at + 8 + n)[0]
        if kind == b"IHDR":
            width, height, *rest = struct.unpack_from(">IIBBBBB", image, at + 8)
            assert width == 64 and rest == [8, 0, 0, 0, 0]
        data += image[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    raw, out = zlib.decompress(data), []
    for y in range(height):
        kind, line = raw[65 * y], list(raw[65 * y + 1 : 65 * y + 65])
        for x in range(64):
            a, b = line[x - 1] if x else 0, out[-1][x] if out else 0
            assert kind in (0, 1, 2)
            line[x] = (line[x] + (0, a, b)[kind]) & 255
        out.append(line)
    return bytes(itertools.chain(*out))


def test_media_equals_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "line of text\n" * 300, "".join(chr(r.randrange(32, 0x3000)) for _ in range(2500))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "x")], "doc_id long, text string, media string")
    out = png.add_media(df, df.columns)
    rows = out.collect()
    assert len(out.columns) == len(set(out.columns))
    for row, text in zip(rows, [*texts, "a"], strict=True):
        payload, terms, middle = brute_media(text or "")
        assert (row.n_bytes, row.payload_bytes) == (len((text or "").encode()), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])
        assert row.media_bytes == len(row.media) and row.media_sha256 == hashlib.sha256(row.media).hexdigest()
        assert read_by_hand(bytes(row.media)) == payload
        bits = np.unpackbits(np.frombuffer(bytes(row.media_hash), np.uint8))
        assert all(bool(b) == (t > middle) for b, t in zip(bits, terms, strict=True) if abs(t - middle) > 1e-6)


def test_simhash_groups_of_odd_rows(spark):
    rows = [(3, None), (2, ""), (9, " \n"), (5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (None, "alone it stands here"), (8, "alone it stands here now")]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.fp == 0} == {(3, 2), (2, 2), (9, 2)}
    prints = {t: simhash.simhash(simhash.shingle_hashes(t or "", 3)) for _, t in rows}
    texts = [t for _, t in rows]
    linked = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
    assert not any(linked(a, b) for a in texts for b in texts if prints[a] != prints[b])
    assert {r.component_id for r in got if r.fp == prints["one two three four"]} == {5}
    assert {r.component_id for r in got if r.fp == prints["alone it stands here"]} == {None}


@pytest.mark.parametrize("ids", [[*range(700), 4 * 10**18], [7] * 300 + list(range(400)), [None] * 400 + [-(10**18), 3]])
def test_next_documents_by_any_ids(spark, ids, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET", 4)
    df = spark.createDataFrame([(d, f"text {i} of {d} has words") for i, d in enumerate(ids)], "doc_id long, text string")
    sizes = [r["count"] for r in order_minhash.with_bucket(df).groupBy("bucket").count().collect()]
    assert max(sizes) < 60 and sum(sizes) == len(ids)
    got = order_minhash.with_next(df).collect()
    after = {r.text: (r.doc_id, r.next_text) for r in got}
    text, order = min(after, key=lambda t: (after[t][0] is not None, after[t][0] or 0)), []
    start = next(t for t in after if after[t][0] == after[text][0])
    for _ in ids:
        order.append(after[start][0])
        start = after[start][1]
    # From any text, following the next ones passes through all documents, in ascending order but for one step back.
    assert len(set(after)) == len(ids) == len({n for _, n in after.values()})
    key = [(d is not None, d or 0) for d in order]
    assert sum(a > b for a, b in zip(key, key[1:] + key[:1], strict=True)) == 1


def test_mix_takes_rows_whole(spark):
    rows = [(1, "a b c d", "s"), (1, "a b c d", "s"), (1, "e f g", "s"), (None, "h i", "s"), (None, "h i", "t"), (None, None, "t"), *((i, "w " * (i % 9), "st"[i % 2]) for i in range(2, 40))]
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], "doc_id long, text string, source string, times string, size int")
    mixed = mixing.mix(df).collect()
    taken = mixing.take(df)
    assert taken.columns == df.columns
    assert taken.count() == sum(r.times for r in mixed) > 0
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    for s in "st":
        assert sum(words(r.text) for r in taken.collect() if r.source == s) == sum(r.taken for r in mixed if r.source == s)
    assert mixing.take(df.where("false")).count() == 0


def test_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "a " * 50000, "x"), (2, "bad worse", None)], "doc_id long, text string, score string")
    model = toxicity.Model(intercept=-1.0, weights={toxicity.features("bad")[0]: 3.0})
    out = toxicity.add_score(df, model, df.columns)
    got = [r.score for r in out.collect()]
    assert out.columns == ["doc_id", "text", "score"] and got == pytest.approx([1 / (1 + math.e), 1 / (1 + math.e), 1 / (1 + math.e), 1 / (1 + math.exp(-2))])
    assert toxicity.add_score(df.where("false"), model, ["doc_id"]).count() == 0


def test_stages_on_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert line_dedup.dedup_lines(docs).count() == near_dedup.keep_one(docs).count() == 0


def test_label_model_equals_brute_force():
    """Posteriors follow from the tables by the model's formula, and accuracies and a correlation come out as they were put in."""
    rng = np.random.default_rng(6)
    n, base = 4000, 0.2
    y = (rng.random(n) < base).astype(int)
    right = [0.9, 0.8, 0.95, 0.7]
    votes = np.stack([np.where(rng.random(n) < p, y, 1 - y) * 2 - 1 for p in right] + [np.zeros(n, int)], axis=1)
    votes[:, 4] = np.where(rng.random(n) < 0.95, votes[:, 1], -votes[:, 1])  # nearly a copy of the second one
    votes[rng.random((n, 5)) < 0.3] = 0
    post, table, parent, given = toxicity.label_model(votes, base=base)
    assert frozenset((1, 4)) in {frozenset((j, p)) for j, p in enumerate(parent) if p >= 0}
    for i in range(200):
        logit = math.log(base / (1 - base))
        for j, v in enumerate(votes[i].tolist()):
            if v:
                k = 0 if parent[j] < 0 else votes[i, parent[j]] + 1
                logit += math.log(given[j, 1, k, v + 1] / given[j, 0, k, v + 1])
        assert post[i] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-3)
    for j, p in enumerate(right):
        assert table[j, 1, 2] / (table[j, 1, 0] + table[j, 1, 2]) == pytest.approx(p, abs=0.12)
    alone = toxicity.label_model(votes[:, :4], base=base)[0]
    told = lambda q: ((q >= 0.5) == y).mean()
    assert told(post) >= told(alone) - 0.005 > 0.85
