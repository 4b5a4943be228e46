import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import awkward, documents, named_like_internals
from pyspark.sql import functions as F

from secstream.llm import backoff_lm, html_blocks, knn_quality, mil_toxicity, ppm_language
from secstream.llm.common import id_remainder, table

SF = "/root/testdata/sf0.01"
LOW = {c: c + 32 for c in range(65, 91)}


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


class PlainAutomaton:
    """The model as a dictionary of states, walked token by token; ``None`` is the end of a text."""

    def __init__(self, training):
        self.tokens = [w for t in training for w in t]
        count = Counter(self.tokens)
        total, kinds = len(self.tokens), len(count)
        self.root = lambda w: (count[w] + 0.5) / (total + 0.5 * (kinds + 1))
        seen = {}
        for t in training:
            for i in range(1, len(t)):
                for size in range(1, min(i, 2) + 1):
                    seen.setdefault(tuple(t[i - size:i]), Counter())[t[i]] += 1
        self.states = {(w,) for w in count} | {h for h in seen if len(h) == 2} | {
            (a, b) for t in training for a, b in zip(t, t[1:])} | {()}
        self.arcs, self.failure = {}, {}
        for h in sorted(seen, key=len):
            mass, whole = backoff_lm.PRIOR[len(h) - 1], sum(seen[h].values())
            self.failure[h] = mass / (whole + mass)
            for w, c in seen[h].items():
                self.arcs[h, w] = c / (whole + mass) + self.failure[h] * self.weight(h[1:], w)

    def weight(self, state, w):
        if not state:
            return self.root(w)
        return self.arcs[state, w] if (state, w) in self.arcs else self.failure.get(state, 1.0) * self.weight(state[1:], w)

    def score(self, text):
        state, score = (), 0.0
        for w in text:
            score += math.log10(self.weight(state, w))
            state = (*state, w)[-2:]
            while state not in self.states:
                state = state[1:]
        return score


def test_language_model_against_a_plain_automaton(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 300)
    monkeypatch.setattr(backoff_lm, "BUCKET_BYTES", 100)
    rng = random.Random(2)
    rows = [(100 + i, " ".join(rng.choice(["a", "B", "cc", "dd.", "e", f"n{i}"]) for _ in range(rng.randrange(60))), "en", "a")
            for i in range(60)]
    docs = awkward(spark).unionByName(documents(spark, rows)).repartition(3)
    got = backoff_lm.score_texts(docs, id_remainder(F.col("doc_id"), 5) == 1).collect()
    tokens = [(r.doc_id, [w for w in re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW))] + [None]) for r in docs.collect()]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in tokens}
    model = PlainAutomaton([t for i, t in tokens if not held[i]])
    one = Counter(model.tokens)
    want = [(i, held[i], len(t), sum(one[w] > 0 for w in t), len(model.tokens),
             round(sum(math.log10(model.root(w)) for w in t), 4), round(model.score(t), 4)) for i, t in tokens]
    rounded = [(*tuple(r)[:5], round(r.base_score, 4), round(r.score, 4)) for r in got]
    assert sorted(map(repr, rounded)) == sorted(map(repr, want))


def test_language_model_awkward_tables(spark):
    held_out = id_remainder(F.col("doc_id"), 5) == 1
    assert backoff_lm.score_texts(documents(spark, []), held_out).count() == 0
    odd = named_like_internals(awkward(spark))
    scores = backoff_lm.score_texts(odd, held_out).collect()
    assert len(scores) == odd.count()
    untrained = backoff_lm.score_texts(awkward(spark), F.lit(True)).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.score == r.base_score == 0 for r in untrained)
    # one very long text beside short ones, and the order in which the rows come
    rows = [(1, "x y z " * 20_000, "en", "a"), (2, "x y", "en", "a"), (3, "x y", "en", "a")]
    one = backoff_lm.score_texts(documents(spark, rows).coalesce(1), F.lit(False))
    two = backoff_lm.score_texts(documents(spark, rows[::-1]).repartition(3), F.lit(False))
    assert [tuple(r)[:5] for r in one.orderBy("doc_id").collect()] == [tuple(r)[:5] for r in two.orderBy("doc_id").collect()]


def test_language_model_probabilities_sum_to_one():
    texts = [t.split() + [None] for t in ["a b a c", "a a b", "b c a b", "a b a b"]]
    model = PlainAutomaton(texts)
    kinds, unseen = set(model.tokens), "never seen"
    for state in model.states:
        if None not in state:
            assert abs(sum(model.weight(state, w) for w in kinds) + model.weight(state, unseen) - 1) < 1e-9


def test_language_model_packing():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 999):
        counts = rng.choice([0, 1, 14, 15, 16, 254, 255, 256, 1 << 40], n)
        assert (backoff_lm._unpack_counts(backoff_lm._pack_counts(counts), n) == counts).all()
        codes = rng.choice([0, 65534, 65535, 65536, 1 << 31], n)
        assert (backoff_lm._unpack_codes(backoff_lm._pack_codes(codes), n) == codes).all()
        hashes = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64, endpoint=True))
        assert (backoff_lm._unpack_steps(backoff_lm._pack_steps(hashes), len(hashes)) == hashes).all()
        near = np.cumsum(rng.choice([1, 255, 256, 1 << 33], n), dtype=np.uint64)
        assert (backoff_lm._unpack_steps(backoff_lm._pack_steps(near), n) == near).all()
        cuts = backoff_lm._range_cuts(hashes, 64, 70_000)  # more ranges than 16 bits tell apart
        assert len(cuts) == 70_001 and cuts[0] == 0 and cuts[-1] == len(hashes) and (np.diff(cuts) >= 0).all()


def test_quality_held_out_accuracy_and_awkward_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = (knn_quality.quality_predictions(docs, labels).join(labels, "doc_id")
            .where(id_remainder(F.col("doc_id"), 5) == 0).collect())
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    odd = named_like_internals(awkward(spark))
    model = knn_quality.fit_quality(docs, labels, sample_rows=100)
    out = knn_quality.score_quality(odd, model, out="__score")
    assert out.columns == [*odd.columns, "__score"] and all(0 <= r["__score"] <= 1 for r in out.collect())
    none = knn_quality.quality_predictions(odd.select("doc_id", "text"), no_labels(spark)).collect()
    assert len(none) == odd.count() and all(r.score == 0.5 for r in none)
    assert knn_quality.quality_predictions(documents(spark, []), labels).count() == 0


def test_quality_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.3, (60, knn_quality.TERMS)).astype(float)
    model = knn_quality.QualityModel(np.ones(knn_quality.TERMS), rng.standard_normal((knn_quality.TERMS, 8)), None, rng.integers(0, 2, 40).astype(float))
    model.vectors = model.project(counts[:40])
    got = model.scores(counts[40:], neighbours=5, block=7)
    cosine = model.project(counts[40:]) @ model.vectors.T
    for c, g in zip(cosine, got, strict=True):
        top = sorted(range(40), key=lambda i: (-c[i], i))[:5]
        weight = np.maximum(c[top].astype(float), 0)
        assert abs(g - (weight @ model.labels[top] / weight.sum())) < 1e-6


def test_toxicity_finds_words_and_sentences(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = mil_toxicity.fit_toxicity(docs, labels)
    rows = (mil_toxicity.score_toxicity(docs, model, keep=("doc_id",)).join(labels, "doc_id")
            .where(id_remainder(F.col("doc_id"), 5) == 0).collect())
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    plain = "This is a fine day. "
    tested = documents(spark, [(1, plain * 30 + "You are an idiot and a moron! " + plain * 20, "en", "a"), (2, plain * 50, "en", "a")])
    got = {r.doc_id: r for r in mil_toxicity.score_toxicity(tested, model).collect()}
    assert got[1].predicted == 1 and [s.number for s in got[1].sentences] == [30] and got[1].sentences[0].word == 150
    assert got[2].predicted == 0 and got[2].sentences == []


def test_toxicity_awkward_rows(spark):
    odd = named_like_internals(awkward(spark))
    model = mil_toxicity.fit_toxicity(odd.select("doc_id", "text"), no_labels(spark))
    rows = mil_toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert mil_toxicity.score_toxicity(documents(spark, []), model).count() == 0


def test_ppm_code_lengths_against_brute_force():
    texts = {"x": [b"abracadabra abra", b"cab"], "y": [b"banana band", b""]}
    rows = []
    for n, (_, own) in enumerate(sorted(texts.items())):
        length, gram, count = ppm_language.gram_counts(own)
        rows.append((length, gram, np.full(len(gram), n), count))
    trees = ppm_language.build(["x", "y"], *(np.concatenate(c) for c in zip(*rows, strict=True)))

    def bits(own, data):
        total = 0.0
        for i in range(len(data)):
            for k in range(min(i, ppm_language.ORDER), -2, -1):
                if k < 0:
                    total += 8
                    break
                context = data[i - k:i]
                after = Counter(t[j + k:j + k + 1] for t in own for j in range(len(t) - k) if t[j:j + k] == context)
                n, d = sum(after.values()), len(after)
                if after[data[i:i + 1]]:
                    total -= math.log2(after[data[i:i + 1]] / (n + d))
                    break
                if n:
                    total -= math.log2(d / (n + d))
        return total

    tested = [b"abra", b"banana", b"zzz q", b"cabana", b"", b"a"]
    got = trees.code_lengths(tested)
    for row, data in zip(got, tested, strict=True):
        assert np.allclose(row, [bits(texts["x"], data), bits(texts["y"], data)], atol=1e-3)


def test_language_held_out_accuracy_and_awkward_rows(spark):
    docs = table(spark, SF, "documents")
    trees = ppm_language.fit_languages(docs, id_remainder(F.col("doc_id"), 3) != 1)
    rows = ppm_language.predict_languages(docs, trees).where(id_remainder(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    odd = awkward(spark)
    got = ppm_language.predict_languages(odd, trees).collect()
    assert {r.lang_pred for r in got if not r.text or not r.text.strip()} == {"und"}
    assert all(r.lang_pred in trees.languages for r in got if r.text and r.text.strip())
    none = ppm_language.fit_languages(documents(spark, []), F.lit(True))
    assert {r.lang_pred for r in ppm_language.predict_languages(odd, none).collect()} == {"und"}


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<nav class="menu"><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
<div class="ad">Buy now!</div><article><h1>Big &amp; small</h1><p>First   paragraph &lt;here&gt;,
 with <b>bold</b> text.<p>Second one.<br>Next line. <div hidden><p>secret</p></div></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>More</a></ul></aside>
<section class="comments"><h3>Comments</h3><p>I do not agree with this at all.</p></section>
<form><label>Name</label><input name=n></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_html_main_text():
    model = html_blocks.fit_labeller()
    got, chosen = html_blocks.extract([PAGE, None, "", "<p>", PAGE], model)[0]
    assert got == "Big & small First paragraph <here>, with bold text. Second one. Next line."
    results = html_blocks.extract([PAGE, None, "", "<p>", PAGE], model)
    assert [t for t, _ in results[1:4]] == ["", "", ""] and results[0] == results[4]
    rng = random.Random(77)
    right = total = 0
    for _ in range(120):
        page, gold = html_blocks.training_page(rng)
        blocks = html_blocks.leaf_blocks(page)
        assert len(blocks) == len(gold)
        chance = model.probabilities(html_blocks.page_features([blocks]))[0]
        right += int(((chance >= 0.5) == np.array(gold)).sum())
        total += len(gold)
    assert right / total > 0.97


def test_html_gradient_is_the_slope_of_the_loss():
    rng = random.Random(5)
    pages = [html_blocks.training_page(rng) for _ in range(3)]
    features = html_blocks.page_features([html_blocks.leaf_blocks(p) for p, _ in pages])
    stacked, mask = html_blocks._pad(features)
    gold = np.zeros_like(mask)
    for k, (_, g) in enumerate(pages):
        gold[:len(g), k] = g
    model = html_blocks.Labeller(seed=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        out = model.probabilities(features)
        return -sum(np.log(p if g else 1 - p) for ps, (_, gs) in zip(out, pages, strict=True) for p, g in zip(ps, gs, strict=True)) / mask.sum()

    grad = model.gradient(stacked, gold, mask)
    for name in ("out", "xf", "hf", "hb", "cb", "path", "word"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        model.p[name][at] += 1e-3
        high = loss()
        model.p[name][at] -= 2e-3
        slope = (high - loss()) / 2e-3
        model.p[name][at] += 1e-3
        assert abs(slope - grad[name][at]) < 2e-2 * abs(slope) + 1e-4


def test_html_query_over_pages(spark):
    pages = table(spark, SF, "pages")
    model = html_blocks.fit_labeller(pages, sample_pages=60)
    rows = html_blocks.extract_pages(pages, model).collect()
    import html as h
    wrong = 0
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        wrong += r.text != " ".join(" ".join(h.unescape(x).split()) for x in parts if x.strip())
        assert r.n_chars == len(r.text)
    assert wrong <= 2
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "plain words only, no tags here at all."), (2, "<<<>>")], "page_id bigint, html string")
    assert html_blocks.extract_pages(odd, model).count() == 4
