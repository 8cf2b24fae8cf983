"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

The n-grams of a text are its words, pairs of neighbouring words (a word after itself is the pair "again", whatever the
word) and word shapes (letters, digits and marks, runs collapsed), hashed to 2 ** BITS weights. A text's vector is the
n-gram counts over their number, times SCALE; its score is the sigmoid of one sparse dot product.

Training reads a bounded sample of the labelled rows (SAMPLE rows, those of the least hash; a parameter), as sparse
vectors, in one task. Scoring covers every whole text, where it lies, with the weights sent to the tasks: their size is
fixed by BITS, whatever the data.

Edge cases: an empty table gives no scores; a text of any length is one sparse vector, in pieces of whole texts; further
columns, whatever their names, are never read; null and empty texts have no n-grams and score the bias; without training rows every score is 0.5; rows
with null labels or ids are not learnt from; a document with several label rows counts once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .runs import parts
from .textnum import U, mix, word_hashes, word_spans

BITS, SCALE, SAMPLE, EPOCHS = 18, 20.0, 12_000, 4
#: Of follow-the-regularised-leader: learning rate, smoothing, L1 and L2 weights.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.7

_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")
_KIND[128:] = ord("a")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hashed slot of each n-gram."""
    starts, ends, words = word_spans(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    word = word_hashes(data, starts, ends)
    kind = _KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[starts] = True
    place = np.concatenate(([0], np.cumsum(first)))
    shape = word_hashes(kind[first], place[starts], place[ends], 3)
    pair = mix(word[:-1] * U(3) + word[1:] * U(7))
    pair[word[:-1] == word[1:]] = U(1)
    same = text[:-1] == text[1:]
    slots = np.concatenate((word, mix(shape + U(11)), pair[same]))
    return np.concatenate((text, text, text[1:][same])), (slots >> U(64 - BITS)).astype(np.int64)


def vectors(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, and the slots and values of each text's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [], []
            for lo, hi, data, offsets in parts(batch.column(batch.num_columns - 1)):
                text, slot = ngrams(data, offsets)
                total = np.bincount(text, minlength=hi - lo)
                key, count = np.unique(text << BITS | slot, return_counts=True)
                at = np.searchsorted(key >> BITS, np.arange(hi - lo + 1))
                for j in range(hi - lo):
                    k = slice(at[j], at[j + 1])
                    slots.append(key[k] & ((1 << BITS) - 1))
                    values.append(count[k] * (SCALE / max(1, total[j])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(slots, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], [*keep, "slots", "values"])

    rows = docs.select(*keep, text_or_empty().alias("text"))
    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.drop("text").dtypes) + ", slots array<long>, values array<double>")


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def leader(rows: pd.DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias behind them, by follow-the-regularised-leader over the rows in order."""
    n_slots = 1 << BITS
    z, n = np.zeros(n_slots + 1), np.zeros(n_slots + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    bias = np.array([n_slots])
    for _ in range(epochs):
        for slots, values, label in rows[["slots", "values", "label"]].itertuples(index=False):
            i, x = np.concatenate((np.asarray(slots, np.int64), bias)), np.append(values, 1.0)
            w = weights(i)
            g = (_sigmoid(w @ x) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(n_slots + 1))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from at most `sample` labelled rows that are not held out, however many documents have one id."""
    known = labels.select(F.col("doc_id").alias("_doc"), F.col(label).cast("double").alias("label")).filter(F.col("_doc").isNotNull() & F.col("label").isNotNull() & ~held_out("_doc"))
    order = F.xxhash64(F.col("_doc"), F.lit(7))
    chosen = known.withColumn("_order", order).orderBy("_order", "_doc", "label").limit(sample)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"))  # at most `sample` rows of three numbers
    order = ["_order", "_doc", "label", "_text"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w = leader(pdf.sort_values(order))
        slot = np.flatnonzero(w)
        return pd.DataFrame({"slot": slot, "weight": w[slot]})

    found = vectors(rows, order).orderBy(*order).limit(sample).groupBy().applyInPandas(fit, "slot long, weight double").toPandas()
    out = np.zeros((1 << BITS) + 1)
    out[found["slot"].to_numpy(np.int64)] = found["weight"]
    return out


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            out = []
            for lo, hi, data, offsets in parts(batch.column(2)):
                text, slot = ngrams(data, offsets)
                total = np.maximum(1, np.bincount(text, minlength=hi - lo))
                out.append(_sigmoid(np.bincount(text, w[slot], hi - lo) * (SCALE / total) + w[-1]))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
