"""Noisy-or scores and their gradient against plain Python; recall and AUC on held-out rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from secstream.llm import mil_toxicity as M
from secstream.llm.common import hash_words, id_remainder, table

WORDS = ["Idiot!", "idiots", "moron", "fine.", "day", "you", "are", "--", "aa", "stupidity", "stupid?", "ok"]


def texts_of(seed, n):
    rng = random.Random(seed)
    out = [None, "", " \t\n ", "idiot", "\n\nidiot\n\n"]
    while len(out) < n:
        out.append("".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randrange(1, 14))))
    return out


def sentences_of(text):
    """Lists of words: a sentence ends after a word that ends in a mark, and at a line end."""
    out, own = [], []
    for line_number, line in enumerate((text or "").split("\n")):
        if line_number:
            own.append(".")  # the line end is a word that ends the sentence
            out.append(own)
            own = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", line):
            own.append(w)
            if w[-1] in ".!?":
                out.append(own)
                own = []
    return [*out, own] if own else out


def features_of(word):
    bare = word.lower().strip(M.MARKS)
    return ([("word", bare)] if bare else []) + [(n, bare[:n]) for n in M.PREFIXES if len(bare) > n]


def hashed(feature):
    kind, text = feature
    return int(hash_words(pa.array([text]), 0 if kind == "word" else kind)[0])


def score_of(text, weights, bias):
    clean = 1.0
    sentences = sentences_of(text) or [[]]
    for words in sentences:
        kept = [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
        z = bias + sum(weights.get(hashed(f), 0.0) for w in kept for f in features_of(w))
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def as_dict(model):
    return dict(zip(model.features.tolist(), model.weights.tolist()))


def test_scores_are_the_noisy_or_of_sentences():
    texts = texts_of(1, 200)
    known = sorted({hashed(f) for w in WORDS[::2] for f in features_of(w)})
    model = M.ToxicityModel(np.array(known, np.uint64), np.random.default_rng(0).normal(0, 2, len(known)), -1.5)
    bags = M.read_bags(pa.array(texts, pa.string()))
    got = model.scores(bags, model.sentence_scores(bags))
    assert np.allclose(got, [score_of(t, as_dict(model), -1.5) for t in texts], atol=1e-9)


def test_the_training_step_is_the_gradient_of_the_likelihood(monkeypatch):
    monkeypatch.setattr(M, "SHRINK", 0.0)
    monkeypatch.setattr(M, "START_BIAS", -1.0)
    texts = texts_of(2, 60)
    labels = np.array([float("idiot" in (t or "").lower()) for t in texts])
    bags = M.read_bags(pa.array(texts, pa.string()))
    start, moved = M.train(bags, labels, 0), M.train(bags, labels, 1)

    def likelihood(weights, bias):
        p = np.clip([score_of(t, weights, bias) for t in texts], 1e-12, 1 - 1e-12)
        return float(np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    def applied(step):  # Adagrad's first step is RATE * g / sqrt(1e-8 + g * g)
        s = step / M.RATE
        return s * math.sqrt(1e-8 / max(1 - s * s, 1e-300))

    base, eps = as_dict(start), 1e-5
    assert len(base) >= 5
    slope = (likelihood(base, -1.0 + eps) - likelihood(base, -1.0 - eps)) / (2 * eps)
    # texts without a sentence are scored by the bias alone and teach nothing
    empty = [i for i, t in enumerate(texts) if not sentences_of(t)]
    p0 = 1 / (1 + math.exp(1.0))
    slope -= sum(-p0 if labels[i] == 0 else 1 - p0 for i in empty) / len(texts)
    assert math.isclose(applied(moved.bias + 1.0), slope, rel_tol=1e-3, abs_tol=1e-6)
    for feature, was, now in zip(start.features.tolist(), start.weights, moved.weights):
        up, down = {**base, feature: base[feature] + eps}, {**base, feature: base[feature] - eps}
        want = (likelihood(up, -1.0) - likelihood(down, -1.0)) / (2 * eps)
        assert math.isclose(applied(now - was), want, rel_tol=1e-2, abs_tol=1e-5)


def test_held_out_recall_and_area(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    model = M.fit_toxicity(docs, labels)
    rows = (M.score_toxicity(docs, model, keep=("doc_id",)).join(labels, "doc_id")
            .where(id_remainder(F.col("doc_id"), 5) == 0).collect())
    toxic, clean = ([r.score for r in rows if r.toxic == v] for v in (1, 0))
    assert len(toxic) > 50 and np.mean(np.array(toxic) >= 0.5) > 0.7 and np.mean(np.array(clean) >= 0.5) < 0.01
    ranks = np.searchsorted(np.sort(clean), toxic, "left") + np.searchsorted(np.sort(clean), toxic, "right")
    assert ranks.mean() / 2 / len(clean) > 0.95


def test_text_counts_do_not_depend_on_the_texts_at_once():
    import numpy as np
    import pyarrow as pa

    from secstream.llm import mil_toxicity as M
    bags = M.read_bags(pa.array(["bad words here. bad again", "", None, "good words\nbad", "here here"]))
    labels = np.array([1.0, 0.0, 1.0, 0.0, 1.0])
    features, number = np.unique(bags.features, return_inverse=True)
    number = number.reshape(bags.features.shape)
    texts = np.repeat(np.arange(5), np.diff(bags.sentence_bounds))
    seen, toxic = M.text_counts(bags, labels, texts, number, len(features), 100)
    for n in (1, 2, 3):
        np.testing.assert_array_equal(M.text_counts(bags, labels, texts, number, len(features), n), (seen, toxic))
    at = np.searchsorted(features, M.word_features(pa.array(["bad", "here"]))[:, 0])
    assert seen[at].tolist() == [2, 2] and toxic[at].tolist() == [1.0, 2.0]
