"""Language identification by prediction by partial matching (PPM).

For every language a tree of byte contexts up to ``ORDER`` bytes counts which
byte follows. A byte is coded in its longest known context; if it was never
seen there, an escape of probability ``d / (n + d)`` is paid (method C: ``n``
bytes and ``d`` distinct bytes were seen) and the next shorter context is tried,
down to a uniform choice of 256. With the counts frozen, the code length of a
whole text is a sum of table entries, computed exactly for every language in
one walk over its bytes. The shortest code wins; equal codes go to the smaller
name. The score is the winner's posterior for equal priors.

The trees are fitted on at most ``ROWS_PER_LANGUAGE`` training texts of each
language (``MOST_LANGUAGES`` of them at most, the most frequent), chosen by the
order of a hash of their ids; whole texts are used.

Defined cases: a null text and a text without a letter get ``und`` with score 0,
as does every text if no language was learned; a null language is never learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices

ORDER = 3
ROWS_PER_LANGUAGE = 300
#: Languages learned at most: the model that is broadcast grows with them.
MOST_LANGUAGES = 256
RANK_BUCKETS = 16
CHUNK_BYTES = 1 << 20
DENSE_ENTRIES = 1 << 25
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ContextTrees:
    """Grams of 1 to ORDER + 1 bytes seen in any language: a tree node each, 0 for none.

    ``steps[k]`` maps ``node * 256 + byte`` of a k-byte gram to the node of the
    gram one byte longer, as sorted keys and nodes. ``cost`` and ``escape`` hold the
    code length in bits of a node's last byte in the context of the others, and of
    an escape from the node as a context, for each language.
    """

    languages: list[str]
    steps: list[tuple[np.ndarray, np.ndarray]]
    cost: np.ndarray
    escape: np.ndarray
    tables: list = field(default_factory=list, repr=False)

    def step(self, k: int, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        if not self.tables:
            for keys, found in self.steps:
                size = (int(keys[-1]) // 256 + 2) * 256 if len(keys) else 256
                if size <= DENSE_ENTRIES:
                    dense = np.zeros(size, np.int32)
                    dense[keys] = found
                    self.tables.append(dense)
                else:
                    self.tables.append(None)
        wanted = nodes * 256 + data
        if self.tables[k] is not None:
            dense = self.tables[k]
            return np.where(wanted < len(dense), dense[np.minimum(wanted, len(dense) - 1)], 0)
        keys, found = self.steps[k]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, found[at], 0)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language (texts x languages)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        starts = bounds[:-1][sizes > 0]
        bits = np.zeros((len(data), len(self.languages)), np.float32)
        before = np.zeros(len(data), np.int64)  # the context of each length, as a node
        nodes, contexts = [], []
        fresh = np.zeros(len(data), bool)
        fresh[starts] = True
        for k in range(ORDER + 1):
            if k:
                before = np.append(0, nodes[-1][:-1])
                before[fresh] = 0
            here = self.step(k, before, data)
            if k:
                here = np.where(before > 0, here, 0)
            nodes.append(here)
            contexts.append(before)
        rest = np.arange(len(data))
        for k in range(ORDER, -1, -1):
            node = nodes[k][rest]
            hit = node > 0
            bits[rest[hit]] += self.cost[node[hit]]
            rest = rest[~hit]
            known = rest if k == 0 else rest[contexts[k][rest] > 0]
            bits[known] += self.escape[contexts[k][known]] if k else self.escape[0]
        bits[rest] += np.float32(8)
        totals = np.concatenate((np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)))
        return totals[bounds[1:]] - totals[bounds[:-1]]


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, gram as a big-endian number, count) of all grams of 1 to ORDER + 1 bytes."""
    lengths, grams, counts = [], [], []
    for k in range(1, ORDER + 2):
        found = []
        for text in texts:
            data = np.frombuffer(text, np.uint8).astype(np.int64)
            if len(data) >= k:
                value = np.zeros(len(data) - k + 1, np.int64)
                for i in range(k):
                    value = value << 8 | data[i:len(data) - k + 1 + i]
                found.append(value)
        if found:
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            lengths.append(np.full(len(gram), k))
            grams.append(gram)
            counts.append(n)
    if not grams:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(lengths), np.concatenate(grams), np.concatenate(counts)


def build(languages: list[str], length: np.ndarray, gram: np.ndarray, language: np.ndarray, count: np.ndarray) -> ContextTrees:
    """Frozen tables from (length, gram, language number, count) rows."""
    names, at = np.unique(length.astype(np.int64) << 40 | gram, return_inverse=True)
    n_nodes, n_lang = len(names) + 1, len(languages)
    counts = np.zeros((n_nodes, n_lang))
    np.add.at(counts, (at + 1, language), count)
    size, value = names >> 40, names & (1 << 40) - 1
    of = {int(k): i + 1 for i, k in enumerate(names)}
    parent = np.array([0, *(of[(s - 1) << 40 | v >> 8] if s > 1 else 0 for s, v in zip(size.tolist(), value.tolist(), strict=True))])
    suffix = np.array([0, *(of[(s - 1) << 40 | v & (1 << 8 * (s - 1)) - 1] if s > 1 else 0
                            for s, v in zip(size.tolist(), value.tolist(), strict=True))])
    followers, kinds = np.zeros_like(counts), np.zeros_like(counts)
    np.add.at(followers, parent[1:], counts[1:])
    np.add.at(kinds, parent[1:], counts[1:] > 0)
    seen = followers > 0
    total = np.where(seen, followers + kinds, 1)
    escape = np.where(seen, -np.log2(np.where(seen, kinds / total, 1)), 0)
    cost = np.zeros_like(counts)
    for s in range(1, ORDER + 2):
        rows = np.flatnonzero(size == s) + 1
        direct = -np.log2(np.where(counts[rows] > 0, counts[rows] / total[parent[rows]], 1))
        lower = cost[suffix[rows]] if s > 1 else np.full((len(rows), n_lang), 8.0)
        cost[rows] = np.where(counts[rows] > 0, direct, escape[parent[rows]] + lower)
    steps = []
    for s in range(1, ORDER + 2):
        rows = np.flatnonzero(size == s) + 1
        keys = parent[rows] * 256 + (value[rows - 1] & 255)
        order = np.argsort(keys)
        steps.append((keys[order].astype(np.int64), rows[order].astype(np.int64)))
    return ContextTrees(languages, steps, cost.astype(np.float32), escape.astype(np.float32))


def sampled_texts(docs: DataFrame, training: Column, rows_per_language: int, most_languages: int) -> DataFrame:
    """(lang, text) of the sample: the first ``rows_per_language`` ids of each language by the order of a hash.

    Ids are ranked in two levels, buckets of a language before the language, so no task ranks a whole language.
    """
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    languages = (rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "lang")
                 .limit(most_languages).select("lang"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = rows.select("doc_id", "lang").withColumn("__bucket", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_BUCKETS)))
    for keys in (("lang", "__bucket"), ("lang",)):
        rank = Window.partitionBy(*keys).orderBy(*order)
        ids = ids.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= rows_per_language)
    ids = ids.select("doc_id", "lang").distinct().join(F.broadcast(languages), "lang")
    return (docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
            .groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text"))


def fit_languages(docs: DataFrame, training: Column, rows_per_language: int = ROWS_PER_LANGUAGE,
                  most_languages: int = MOST_LANGUAGES) -> ContextTrees:
    """Fit on at most ``rows_per_language`` texts of each language among the rows where ``training`` holds; of
    more than ``most_languages`` languages the most frequent are learned. A language's grams are counted once."""

    def count(own: pd.DataFrame) -> pd.DataFrame:
        length, gram, n = gram_counts([t.encode() for t in own["text"]])
        return pd.DataFrame({"lang": own["lang"].iloc[0], "length": length, "gram": gram, "n": n})

    counts = (sampled_texts(docs, training, rows_per_language, most_languages)
              .groupBy("lang").applyInPandas(count, "lang string, length int, gram bigint, n bigint").toArrow())
    languages = sorted(set(counts.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    return build(languages, counts.column("length").to_numpy(), counts.column("gram").to_numpy(),
                 np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64), counts.column("n").to_numpy())


def predict_languages(df: DataFrame, trees: ContextTrees, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Append ``lang_pred``, ``score`` and ``bits_per_byte`` (of the shortest code; null for ``und``)."""
    keep = tuple(df.columns) if keep is None else keep
    if clash := {"lang_pred", "score", "bits_per_byte"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are taken; choose others with keep")
    sent = df.sparkSession.sparkContext.broadcast(trees)
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]),
                        "lang_pred string, score double, bits_per_byte double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for part in text_slices(batches, "__text", CHUNK_BYTES):
            texts = part.column("__text").to_pylist()
            data = [t.encode() if t and trees.languages and _LETTER.search(t) else b"" for t in texts]
            names, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if any(data):
                bits = trees.code_lengths(data)
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(best)), best]
                posterior = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                for i, d in enumerate(data):
                    if d:
                        names[i], scores[i], rates[i] = trees.languages[best[i]], float(posterior[i]), float(low[i] / len(d))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                names=[*part.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])

    return source.mapInArrow(run, schema)
