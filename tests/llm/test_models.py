"""Language identification, language-model scores, media and page extraction."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxframe.llm import html_extract, langid, lm_score, media

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.report(docs).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(held) > 100 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_edges(spark):
    train = [(k, f"the {w} and of with" if k % 2 else f"der {w} und mit von", "en" if k % 2 else "de") for k, w in enumerate(["word", "text"] * 20)]
    rows = [*train, (100, None, None), (101, "", "en"), (102, "123 !?", None), (103, "the of and", None), (None, "und mit", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", langid.F.lit("x"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.report(docs).collect()}
    assert [got[k] for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    nothing = langid.report(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert (nothing["lang_pred"], nothing["score"]) == ("und", 0.0)
    assert langid.report(docs.limit(0)).collect() == []


def test_families_are_tried_first():
    model = langid.Model(["ba", "bb", "c"], [["ba", "bb"], ["c"]], np.zeros((langid.SLOTS + 1, 3)), [("ba", "bb")])
    model.weights[-1] = [-1, 2, 3]
    assert model.predict("x")[0] == "c"
    model.weights[-1] = [3, -2, -1]
    assert model.predict("x")[0] == "bb"


def reference_scores(rows):
    """The backoff model by plain recursion over dictionaries."""
    tokens = {d: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for d, t in rows}
    train = [tokens[d] for d, _ in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    c1 = Counter(w for t in train for w in t)
    n, v = sum(c1.values()), len(c1)
    head = {w for w, c in c1.items() if c >= lm_score.LEAST}
    grams = {k: Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1) if set(t[i : i + k]) <= head) for k in (2, 3)}
    grams = {k: {g: c for g, c in own.items() if c >= lm_score.LEAST} for k, own in grams.items()}
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)

    def p(history, w):
        if not history:
            return p1(w)
        own = grams[len(history) + 1]
        base = c1[history[0]] if len(history) == 1 else grams[2][history]
        if (*history, w) in own:
            return (own[*history, w] - lm_score.DISCOUNT) / base
        after = [g[-1] for g in own if g[:-1] == history]
        left = 1 - sum((own[*history, x] - lm_score.DISCOUNT) / base for x in after)
        return left / (1 - sum(p(history[1:], x) for x in after)) * p(history[1:], w)

    def context(history):
        """The longest suffix that is a state."""
        history = history[-2:]
        while history and not (history in grams[2] if len(history) == 2 else history[0] in head):
            history = history[1:]
        return history

    out = {}
    for d, t in tokens.items():
        out[d] = (len(t), sum(c1[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), sum(math.log10(p(context(tuple(t[:k])), w)) for k, w in enumerate(t)))
    masses = [sum(p(h, w) for w in c1) + p(h, "never seen") for h in [(), *[(w,) for w in head if w is not None][:5], *[g for g in grams[2] if None not in g][:10]]]
    return out, masses


def test_scores_equal_plain_recursion(spark):
    rng = random.Random(2)
    words = [f"W{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([3, 10, 30])]) for _ in range(rng.randrange(0, 60)))) for k in range(60)] + [(90, None), (91, ""), (92, "never heard w1 W1")]
    want, masses = reference_scores(rows)
    assert masses == pytest.approx([1] * len(masses))
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(got) == set(want)
    for d, (n, known, total, base, score) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, zlib.crc32(str(d).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score), d


def test_scores_of_edges(spark):
    own = next(k for k in range(1, 50) if zlib.crc32(str(k).encode()) % 7 != 2)
    docs = spark.createDataFrame([(own, "a b", 3), (own, "a b", 4), (None, None, 5)], "doc_id long, text string, words int")
    rows = lm_score.score(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["train_tokens"]) for r in rows) == [(0, 1, 7), (own, 3, 7), (own, 3, 7)]
    assert lm_score.score(docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [192, 576, 192 * 700])
def test_jpeg_round_trip(size):
    rng = np.random.default_rng(size)
    payloads = [rng.integers(0, 256, size).astype(np.uint8).tobytes(), bytes(size), b"\xff" * size, (b"plain text goes here " * size)[:size]]
    files = [media.encode(p) for p in payloads]
    for p, picture in zip(payloads, media.decode_many(files), strict=True):
        assert media.payload_of(picture) == p
        blocks = -(-picture.height // 8) * -(-picture.width // 8)
        assert picture.coefficients.shape == (blocks, 64)
        # a block's mean is its DC coefficient over 8, plus 128
        mean = np.clip(np.floor(picture.coefficients[:, 0] / 8 + 128.5), 0, 255)
        assert media.thumbnail(picture).ravel().tolist() == mean.tolist()


def test_other_files_are_refused():
    good = media.encode(bytes(192))
    for bad in (b"", b"GIF89a", good.replace(b"\xff\xc0", b"\xff\xc2"), good[:30]):
        with pytest.raises(ValueError):
            media.decode_many([bad])


def test_media_digests(spark):
    rows = [(1, None), (2, ""), (3, "abc"), (4, "é" * 2000), (4, "é" * 2000), (5, "x" * 192), (None, "y" * 193)]
    stored = media.media_table(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media"))
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.features(stored).collect())
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append((d or 0, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert got == sorted(want)


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><nav class="menu"><a href="/">Home</a></nav>
<div class="cookie-banner">We use cookies</div><article><h1>The  Title</h1><p>First &amp; <b>bold</b>\n text.</p><p>Second caf&eacute; line follows here.</p>
<script>var x = "<p>no</p>";</script></article><section class="comments"><p>Nice post!</p></section><footer>Copyright</footer></body></html>"""


def test_page(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", None), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()), key=str)
    text = "The Title First & bold text. Second café line follows here."
    assert got == [(1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (3, "v", "", 0)]
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_blocks_of_unseen_pages_are_labelled():
    rng = np.random.default_rng(99)
    data = [html_extract.labelled(*html_extract.made_up_page(rng)) for _ in range(150)]
    scores = html_extract.trained().scores([d[0] for d in data])
    right = np.concatenate([(z > 0) == (y > 0) for z, (_, y) in zip(scores, data, strict=True)])
    assert right.mean() > 0.94


def test_articles_of_raw_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html_of = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", html_of[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(b[0] for b in html_extract.blocks_of(article))


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(4)
    data = [html_extract.labelled(*html_extract.made_up_page(rng)) for _ in range(2)]
    model = html_extract.Labeller()
    _, grads = model.step([d[0] for d in data], [d[1] for d in data])
    for name in ("xf", "hb", "out", "cf"):
        w, at, eps = model.w[name], (0,) * model.w[name].ndim, 1e-5
        old = w[at]
        w[at] = old + eps
        up, _ = model.step([d[0] for d in data], [d[1] for d in data])
        w[at] = old - eps
        down, _ = model.step([d[0] for d in data], [d[1] for d in data])
        w[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-7)
