"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed terms: its words, the shapes of its words
(letter case, digits and marks collapsed to runs), and words that repeat the
one before. A bounded, documented sample of labelled texts gives the inverse
document frequencies and, by the eigenvectors of its term covariance, the
latent space. The sample's unit vectors and labels are broadcast (their size is
``sample_rows * dims`` floats). Every text is projected, its cosines with all
sample vectors are computed block by block, and the ``neighbours`` largest
vote with weight ``max(cosine, 0)``; the score is the weighted share of label 1.
Ties in the cosine go to the smaller sample number.

Defined cases: an empty or null text has no neighbour and gets the sample's
share of label 1, as does a text whose cosines are all zero or below. With no
labelled sample the score is 0.5. Repeated rows get equal scores; other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, labelled_sample, split_words, text_slices

SAMPLE_ROWS = 4_000
SHAPE_TERMS = 384
WORD_TERMS = 512
TERMS = SHAPE_TERMS + WORD_TERMS + 1
SHAPE_WEIGHT = 3.0
DIMS = 48
NEIGHBOURS = 25
THRESHOLD = 0.3


def word_shapes(words: pa.Array) -> pa.Array:
    """``Word12!!`` becomes ``Aa0!!``: runs of letters and digits collapse, marks stay (two at most)."""
    shape = pc.replace_substring_regex(words, r"\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, r"[\p{Ll}\p{Lo}\p{M}]+", "a")
    shape = pc.replace_substring_regex(shape, r"\p{Nd}+", "0")
    return pc.utf8_slice_codeunits(shape, 0, 12)


def term_counts(texts: pa.Array) -> np.ndarray:
    """Dense counts (texts x TERMS) of shape terms, word terms and repeats."""
    n = len(texts)
    words, codes, bounds = split_words(texts)
    row = np.repeat(np.arange(n), np.diff(bounds))
    if not len(codes):
        return np.zeros((n, TERMS))
    shape = (hash_words(word_shapes(words)) % np.uint64(SHAPE_TERMS)).astype(np.int64)
    word = (hash_words(pc.ascii_lower(words), 1) % np.uint64(WORD_TERMS)).astype(np.int64) + SHAPE_TERMS
    counts = np.bincount(row * TERMS + shape[codes], minlength=n * TERMS)
    counts += np.bincount(row * TERMS + word[codes], minlength=n * TERMS)
    same = np.flatnonzero((codes[1:] == codes[:-1]) & (row[1:] == row[:-1]))
    counts += np.bincount(row[same] * TERMS + TERMS - 1, minlength=n * TERMS)
    return counts.reshape(n, TERMS).astype(np.float64)


@dataclass
class QualityModel:
    """Inverse document frequencies, projection, and the sample's vectors and labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        length = np.maximum(counts[:, :-1].sum(axis=1, keepdims=True) / 2, 1)
        return np.sqrt(counts / length) * self.idf

    def project(self, counts: np.ndarray) -> np.ndarray:
        vectors = self.weigh(counts) @ self.axes
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0).astype(np.float32)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        prior = float(self.labels.mean())
        out = np.full(len(counts), prior)
        k = min(neighbours, len(self.labels))
        for start in range(0, len(counts), block):
            cosine = self.project(counts[start:start + block]) @ self.vectors.T
            # all cosines at or above the k-th largest, then the first k by (cosine, sample number)
            floor = np.partition(cosine, -k, axis=1)[:, -k, None]
            above, level = cosine > floor, cosine == floor
            room = k - above.sum(axis=1, keepdims=True)
            chosen = above | (level & (np.cumsum(level, axis=1) <= room))
            weight = np.where(chosen, np.maximum(cosine, 0), 0).astype(np.float64)
            total = weight.sum(axis=1)
            np.divide(weight @ self.labels, total, out=out[start:start + block], where=total > 0)
        return np.clip(out, 0.0, 1.0)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
                dims: int = DIMS) -> QualityModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out remainder."""
    sample = labelled_sample(docs, labels, label, sample_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            counts = term_counts(part.column("text"))
            rows = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("label"),
                 pa.array([r.tolist() for r in rows], pa.list_(pa.int32())),
                 pa.array([counts[i, r].tolist() for i, r in enumerate(rows)], pa.list_(pa.float64()))],
                names=["doc_id", "label", "terms", "counts"])

    rows = sample.mapInArrow(features, "doc_id bigint, label int, terms array<int>, counts array<double>").collect()
    rows.sort(key=lambda r: r.doc_id)
    counts = np.zeros((len(rows), TERMS))
    for i, r in enumerate(rows):
        counts[i, r.terms] = r.counts
    found = (counts > 0).sum(axis=0)
    idf = np.log((1 + len(rows)) / (1 + found)) + 0.1
    idf[:SHAPE_TERMS] *= SHAPE_WEIGHT
    idf[-1] *= SHAPE_WEIGHT
    model = QualityModel(idf, np.zeros((TERMS, 0)), np.zeros((0, 0), np.float32),
                         np.array([r.label for r in rows], np.float64))
    weighed = model.weigh(counts)
    _, axes = np.linalg.eigh(weighed.T @ weighed)
    model.axes = axes[:, ::-1][:, :dims]
    model.vectors = model.project(counts)
    return model


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", out: str = "score",
                  neighbours: int = NEIGHBOURS) -> DataFrame:
    """Append the score column ``out`` to every row; all other columns stay as they are."""
    if out in df.columns:
        raise ValueError(f"column {out} is taken")
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            scores = sent.value.scores(term_counts(part.column(text)), neighbours)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())],
                                             names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def quality_predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``."""
    model = fit_quality(docs, labels)
    return (score_quality(docs.select("doc_id", "text"), model)
            .select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
