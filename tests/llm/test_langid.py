from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from orderdesk.llm import gru, langid
from orderdesk.llm.common import read_table

DATA = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    p = {k: v.astype(np.float64) for k, v in gru.init_params(3, hidden=4, stride=2, seed=1).items()}
    p["byte"] = np.random.default_rng(0).normal(size=(256, 3)) * 0.1
    data = np.random.default_rng(1).integers(97, 105, (5, 8)).astype(np.uint8)
    lengths, target = np.array([8, 8, 5, 8, 3]), np.array([0, 1, 2, 1, 0])
    _, grads = gru.gradients(p, data, lengths, target)
    for k in p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        slope = (gru.gradients(up, data, lengths, target)[0] - gru.gradients(down, data, lengths, target)[0]) / 2e-3
        assert abs(slope - grads[k][at]) < 1e-4


def test_pooling_covers_every_byte_of_long_and_short_texts():
    p = gru.init_params(3, seed=5)
    texts = [b"", b"a", b"abc" * 1000, bytes(range(256)) * 40, b"x" * 256]
    got = gru.pooled(p, texts, lanes=8)
    for text, row in zip(texts, got, strict=True):
        data, lengths, _ = gru.windows_of([text])
        want = gru.position_sums(p, data, lengths).sum(axis=0) / max(1, len(text)) if text else np.zeros(3)
        assert np.allclose(row, want, atol=1e-5) and abs(row.sum() - bool(text)) < 1e-4
        assert lengths.sum() == len(text)


def scalar(p, text, window):
    """The mean class probabilities of a text, unit by unit and byte by byte, in Python floats."""
    stride, hidden, classes = p["embed_f"].shape[0], p["state_f"].shape[0], len(p["bias"])
    sums = [0.0] * classes
    for at in range(0, len(text), window):
        part = text[at:at + window]
        steps = [list((part + bytes(window))[k:k + stride]) for k in range(0, window, stride)]
        logits = [[float(x) for x in p["bias"]] for _ in steps]
        for d, order in (("f", range(len(steps))), ("b", range(len(steps) - 1, -1, -1))):
            h = [0.0] * hidden
            for t in order:
                x = [float(p[f"gate_{d}"][i]) + sum(float(p[f"embed_{d}"][k, b, i]) for k, b in enumerate(steps[t])) for i in range(3 * hidden)]
                u = [sum(h[j] * float(p[f"state_{d}"][j, i]) for j in range(hidden)) for i in range(3 * hidden)]
                new = []
                for i in range(hidden):
                    z = 1 / (1 + math.exp(-(x[i] + u[i])))
                    r = 1 / (1 + math.exp(-(x[hidden + i] + u[hidden + i])))
                    n = math.tanh(x[2 * hidden + i] + r * u[2 * hidden + i])
                    new.append((1 - z) * n + z * h[i])
                h = new
                for c in range(classes):
                    logits[t][c] += sum(h[j] * float(p[f"out_{d}"][j, c]) for j in range(hidden))
        for place, byte in enumerate(part):
            each = [math.exp(logits[place // stride][c] + float(p["byte"][byte, c])) for c in range(classes)]
            for c in range(classes):
                sums[c] += each[c] / sum(each)
    return [x / max(1, len(text)) for x in sums]


def test_network_matches_a_scalar_one():
    p = gru.init_params(3, hidden=5, seed=11)
    rng = np.random.default_rng(4)
    p["byte"] = rng.normal(size=(256, 3)).astype(np.float32)
    p["bias"] = rng.normal(size=3).astype(np.float32)
    for d in "fb":
        p[f"gate_{d}"] = rng.normal(size=15).astype(np.float32)
    texts = [b"a", b"abc", "héllo wörld, schön".encode(), bytes(range(256)), b"xyz " * 41, rng.integers(0, 256, 333).astype(np.uint8).tobytes()]
    for text, row in zip(texts, gru.pooled(p, texts, window=64), strict=True):
        assert np.allclose(row, scalar(p, text, 64), atol=1e-4)


def test_held_out_accuracy_and_clean_sample(spark):
    docs = read_table(spark, DATA, "documents")
    pairs = langid.sample(docs)
    texts = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert pairs == langid.sample(docs.repartition(7)) and len(pairs) <= 4 * langid.SAMPLE_DOCS
    assert all(any(part in t for t in texts) for _, part in pairs[::40])
    held = langid.identified(docs).filter((langid.fold(F.col("doc_id")) == 2) & F.col("lang").isNotNull()).collect()
    assert len(held) > 200 and np.mean([r["__lang"] == r["lang"] for r in held]) > 0.96
    assert all(0 <= r["__score"] <= 1 for r in held)


def test_prediction_ignores_label_source_and_id(spark):
    docs = read_table(spark, DATA, "documents").limit(60)
    train = read_table(spark, DATA, "documents")
    other = docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"))
    a = {r.doc_id: (r["__lang"], r["__score"]) for r in langid.identified(docs, train_on=train).collect()}
    b = {r.doc_id - 5000: (r["__lang"], r["__score"]) for r in langid.identified(other, train_on=train).collect()}
    assert a == b


def test_odd_rows(spark, odd, none):
    rows = langid.identified(odd).collect()
    assert len(rows) == odd.count()
    und = {r.doc_id for r in rows if r["__lang"] == "und"}
    assert {3, 4, 5, 7} <= und and all(r["__score"] == 0 for r in rows if r["__lang"] == "und")
    assert all(r["__lang"] in ("en", "fr", "de") for r in rows if r.doc_id in (1, 2, 6, 8, 9, 10))
    assert langid.accepted(odd).columns == odd.columns
    assert langid.identified(none).count() == 0 and langid.accepted(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["__lang"] for r in langid.identified(unlabelled).collect()} == {"und"}
