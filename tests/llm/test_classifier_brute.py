"""The classifier's training and scores against follow-the-regularised-leader over dicts, in plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import classifier as C
from tracemill.llm.textnum import buffer_of

SF = "/root/testdata/sf0.001"


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def vector(text):
    """Slots and values; the slots of single n-grams come from the operator, one text at a time."""
    data, offsets = buffer_of(pa.array([text or ""]))
    _, slots = C.ngrams(data, offsets)
    n = len(slots)
    return {int(s): k * C.SCALE / max(1, n) for s, k in Counter(slots.tolist()).items()}


def learn(rows):
    z, n = Counter(), Counter()
    bias = 1 << C.BITS

    def weight(i):
        if abs(z[i]) <= C.L1:
            return 0.0
        return -(z[i] - math.copysign(C.L1, z[i])) / ((C.BETA + math.sqrt(n[i])) / C.ALPHA + C.L2)

    for _ in range(C.EPOCHS):
        for x, label in rows:
            x = {**x, bias: 1.0}
            w = {i: weight(i) for i in x}
            error = sigmoid(sum(w[i] * v for i, v in x.items())) - label
            for i, v in x.items():
                g = error * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / C.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_training_and_scores(spark, tables):
    docs, labels = tables
    order = {r.doc_id: r.h for r in labels.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h")).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    known = sorted((order[r.doc_id], r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    weights = learn([(vector(text[i]), y) for _, i, y in known])
    ours = C.train(docs, labels)
    theirs = np.zeros((1 << C.BITS) + 1)
    for i, w in weights.items():
        theirs[i] = w
    assert np.allclose(ours, theirs, rtol=1e-9, atol=1e-12) and np.count_nonzero(theirs) > 100
    found = {r.doc_id: r for r in C.score(docs, ours).collect()}
    assert sorted(found) == sorted(text)
    for i, t in text.items():
        p = sigmoid(sum(theirs[k] * v for k, v in vector(t).items()) + theirs[-1])
        assert found[i].score == pytest.approx(p, abs=1e-9)
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if abs(p - 0.7) > 1e-9:
            assert found[i].predicted == (p >= 0.7)


def test_scores_at_the_threshold(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    bias = np.zeros((1 << C.BITS) + 1)
    for p, want in ((0.7, 1), (0.7 - 1e-12, 0), (0.7 + 1e-12, 1)):
        bias[-1] = math.log(p / (1 - p))
        got = C.score(d, bias).collect()
        assert {r.predicted for r in got if r.score >= 0.7} <= {1} and {r.predicted for r in got if r.score < 0.7} <= {0}
        assert len(got) == 3 and all(abs(r.score - p) < 1e-11 for r in got) and want in (0, 1)


def test_held_out_rows_and_other_columns_teach_nothing(spark, tables):
    docs, labels = tables
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("one"), "_doc": F.lit(1), "label": F.lit(0), "score": F.lit(2.0)})
    assert (C.train(docs, labels) == C.train(renamed, other)).all()
