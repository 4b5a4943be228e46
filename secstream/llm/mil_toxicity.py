"""Toxicity by multiple-instance learning.

A text is a bag of sentences (cut after words that end in ``.``, ``!`` or
``?`` and at line ends). A word's weight is the sum of the weights of its
features: the word itself and its first 4 to 7 letters, lower-cased, without
marks at either end. A sentence's score is the logistic function of the summed
weights of its words (a word that repeats the one before counts once), and the
text's score is the noisy-or of its sentences, ``1 - prod(1 - p)``. Only text
labels are known: weights start from smoothed log-odds and are trained by the
gradient of the noisy-or likelihood (Adagrad, with weights shrunk towards 0),
so blame moves to the sentences that explain a label. Sentences that reach the
threshold are located by their place in the text.

The model is fitted on at most ``SAMPLE_ROWS`` labelled texts; features of
fewer than ``LEAST_TEXTS`` of them are unknown. Features are compared by 64-bit
hashes.

Defined cases: a null or empty text has no sentence; its score is that of one
sentence without known words. Without any labelled sample every score is that
of the starting bias. Repeated rows get equal scores; very long texts are read
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, labelled_sample, segment_sums, split_words, text_slices

SAMPLE_ROWS = 6_000
LEAST_TEXTS = 3
TEXTS_AT_ONCE = 250
START_BIAS = -6.0
START = 0.3
EPOCHS = 60
RATE = 0.2
SHRINK = 0.3
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.5
MARKS = ".,;:!?\"'()[]{}<>#$%&*+-/=@\\^_`|~"


@dataclass
class Bags:
    """Words of sentences of texts, as numbers into ``features``.

    Sentence ``s`` holds ``codes[word_bounds[s]:word_bounds[s + 1]]``, text ``t``
    the sentences ``sentence_bounds[t]`` to ``sentence_bounds[t + 1]``; ``places``
    is the number of a sentence's first word in its text.
    """

    features: np.ndarray
    codes: np.ndarray
    word_bounds: np.ndarray
    sentence_bounds: np.ndarray
    places: np.ndarray


def word_features(words: pa.Array) -> np.ndarray:
    """Hashes of every word's features (words x kinds); 0 where there is none."""
    bare = pc.utf8_trim(pc.utf8_lower(words), MARKS)
    length = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = np.where(length > 0, hash_words(bare), 0)
    for i, n in enumerate(PREFIXES, 1):
        long = length > n
        if long.any():
            prefix = pc.utf8_slice_codeunits(bare.filter(pa.array(long)), 0, n).dictionary_encode()
            out[long, i] = hash_words(prefix.dictionary, n)[prefix.indices.to_numpy(zero_copy_only=False)]
    return out


def read_bags(texts: pa.Array) -> Bags:
    """Sentences of every text."""
    words, codes, bounds = split_words(pc.replace_substring(pc.fill_null(texts, ""), "\n", " .\n"))
    if not len(codes):
        return Bags(np.zeros((0, 1 + len(PREFIXES)), np.uint64), codes, np.zeros(1, np.int64),
                    np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64))
    ends = np.zeros(len(words), bool)
    for mark in ".!?":
        ends |= pc.ends_with(words, mark).to_numpy(zero_copy_only=False)
    starts = np.append(True, ends[codes[:-1]])
    starts[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.flatnonzero(starts)
    kept = starts | np.append(True, codes[1:] != codes[:-1])
    before = np.concatenate(([0], np.cumsum(kept)))
    return Bags(word_features(words), codes[kept], before[np.append(first, len(codes))], np.searchsorted(first, bounds),
                first - bounds[np.searchsorted(bounds, first, side="right") - 1])


@dataclass
class ToxicityModel:
    """Sorted feature hashes with their weights, and the bias of a sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of every known feature; the last number, with weight 0, for the others."""
        if not len(self.features):
            return np.zeros(hashes.shape, np.int64)
        at = np.searchsorted(self.features, hashes)
        at[at == len(self.features)] = 0
        return np.where(self.features[at] == hashes, at, len(self.features))

    def sentence_scores(self, bags: Bags, numbers: np.ndarray | None = None) -> np.ndarray:
        numbers = self.numbers(bags.features) if numbers is None else numbers
        weights = np.append(self.weights, 0.0)[numbers].sum(axis=1)
        logits = self.bias + segment_sums(weights[bags.codes], bags.word_bounds)
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))

    def scores(self, bags: Bags, sentences: np.ndarray) -> np.ndarray:
        clean = segment_sums(np.log1p(-np.minimum(sentences, 1 - 1e-12)), bags.sentence_bounds)
        none = np.diff(bags.sentence_bounds) == 0
        clean[none] = np.log1p(-1 / (1 + np.exp(-self.bias)))
        return np.clip(-np.expm1(clean), 0.0, 1.0)


def text_counts(bags: Bags, labels: np.ndarray, texts: np.ndarray, number: np.ndarray, features: int,
                at_once: int = TEXTS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Texts and labelled texts that hold each feature. The pairs of text and feature are laid out for ``at_once``
    texts at a time, so they take no more memory for a larger sample."""
    seen, toxic = np.zeros(features, np.int64), np.zeros(features)
    for start in range(0, len(labels), at_once):
        lo, hi = np.searchsorted(texts, (start, start + at_once))
        codes = bags.codes[bags.word_bounds[lo]:bags.word_bounds[hi]]
        text_of = np.repeat(texts[lo:hi], np.diff(bags.word_bounds[lo:hi + 1]))
        text_of, word_of = np.divmod(np.unique(text_of * max(len(number), 1) + codes), max(len(number), 1))
        pairs = np.unique((text_of[:, None] * max(features, 1) + number[word_of]).ravel())
        text_of, feature_of = np.divmod(pairs, max(features, 1))
        seen += np.bincount(feature_of, minlength=features)
        toxic += np.bincount(feature_of, weights=labels[text_of], minlength=features)
    return seen, toxic


def train(bags: Bags, labels: np.ndarray, epochs: int = EPOCHS) -> ToxicityModel:
    """Fit feature weights to text labels by the noisy-or likelihood."""
    n_words, kinds = bags.features.shape
    texts = np.repeat(np.arange(len(labels)), np.diff(bags.sentence_bounds))
    sentence = np.repeat(np.arange(len(texts)), np.diff(bags.word_bounds))
    features, number = np.unique(bags.features, return_inverse=True)
    number = number.reshape(bags.features.shape)
    seen, toxic = text_counts(bags, labels, texts, number, len(features))
    known = (seen >= LEAST_TEXTS) & (features != 0)
    positives, negatives = max(labels.sum(), 1.0), max(len(labels) - labels.sum(), 1.0)
    odds = np.log((toxic + 0.5) / (positives + 1)) - np.log((seen - toxic + 0.5) / (negatives + 1))
    model = ToxicityModel(features[known], START * np.maximum(odds[known] - 2.0, 0.0), START_BIAS)
    if not known.any():
        return model
    numbers = model.numbers(bags.features)
    squares, bias_square = np.full(len(model.features) + 1, 1e-8), 1e-8
    for _ in range(epochs):
        p = model.sentence_scores(bags, numbers)
        score = np.clip(model.scores(bags, p), 1e-9, 1 - 1e-9)
        # d log-likelihood / d logit of a sentence: p * (1 - score) / score for label 1, -p for label 0
        slope = np.where(labels[texts] == 1, p * ((1 - score) / score)[texts], -p) / len(labels)
        by_word = np.bincount(bags.codes, weights=slope[sentence], minlength=n_words)
        gradient = np.bincount(numbers.ravel(), weights=np.repeat(by_word, kinds), minlength=len(squares))
        squares += gradient ** 2
        step = RATE / np.sqrt(squares)
        weights = model.weights + (step * gradient)[:-1]
        model.weights = np.sign(weights) * np.maximum(np.abs(weights) - step[:-1] * SHRINK / len(labels), 0)
        bias_square += slope.sum() ** 2
        model.bias += RATE * slope.sum() / np.sqrt(bias_square)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled texts outside the held-out remainder."""
    sample = labelled_sample(docs, labels, label, sample_rows).toArrow().sort_by("doc_id")
    texts = sample.column("text").combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    return train(read_bags(texts.cast(pa.string())), sample.column("label").to_numpy().astype(np.float64))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] | None = None,
                   threshold: float = THRESHOLD) -> DataFrame:
    """Append ``score``, ``predicted`` and ``sentences``, the offending ones.

    ``sentences`` is an array of structs (number, word, score): a sentence's
    number in the text, the number of its first word (a line end counts as a
    word of its own), and its score, for those at or above the threshold. A
    text may be toxic by many weak sentences; then its strongest one is listed.
    """
    keep = tuple(df.columns) if keep is None else keep
    if clash := {"score", "predicted", "sentences"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are taken; choose others with keep")
    sent = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]),
                        "score double, predicted int, sentences array<struct<number:int,word:int,score:double>>"])
    found_type = pa.list_(pa.struct([("number", pa.int32()), ("word", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            bags = read_bags(part.column("__text"))
            sentences = sent.value.sentence_scores(bags)
            scores = sent.value.scores(bags, sentences)
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for t in np.flatnonzero(scores >= threshold):
                lo, hi = bags.sentence_bounds[t], bags.sentence_bounds[t + 1]
                own = sentences[lo:hi]
                chosen = np.flatnonzero(own >= threshold)
                if not len(chosen) and len(own):
                    chosen = np.array([int(own.argmax())])
                found[t] = [{"number": int(i), "word": int(bags.places[lo + i]), "score": float(own[i])} for i in chosen]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                 pa.array(found, found_type)], names=[*part.schema.names[:-1], "score", "predicted", "sentences"])

    return source.mapInArrow(run, schema)
