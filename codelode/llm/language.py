"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams,
trained with follow-the-regularised-leader and elastic-net penalties, then calibrated by one
temperature.

N-grams are hashed. Document frequencies count all documents that may be learned from; the model
itself is fitted on about ``SAMPLE_ROWS`` of them per language, chosen by a hash of the id. What goes
through the driver is the table of frequencies and the model, both bounded by ``FEATURES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm.common import bounded, with_text_columns
from codelode.sources.scratch import saved

FEATURES = 1 << 17
#: Documents of a language that the model is fitted on, about; one in ``CALIBRATE`` sets the temperature.
SAMPLE_ROWS, CALIBRATE = 1_500, 5
#: Learning rate and penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-3
EPOCHS = 2
SCALE = 40.0
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def ngrams(text: str) -> np.ndarray:
    """Hashed 1- to 3-grams of the lower-cased characters, in no order, each occurrence once."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    one = chars * np.uint32(2654435761)
    two = (one[:-1] ^ (chars[1:] + np.uint32(0x9E37))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (chars[2:] + np.uint32(0x79B9))) * np.uint32(0xC2B2AE35)
    grams = np.concatenate([one, two, three])
    return (grams ^ (grams >> np.uint32(15))) & np.uint32(FEATURES - 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # FEATURES
    weights: np.ndarray  # FEATURES x languages
    bias: np.ndarray  # languages
    temperature: float = 1.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their TF-IDF (share of the n-grams, times IDF)."""
    at, count = np.unique(ngrams(text), return_counts=True)
    return at, SCALE * count / max(1, count.sum()) * idf[at]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int,
         epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal, one document after the other."""
    z, n = np.zeros((FEATURES + 1, n_labels)), np.zeros((FEATURES + 1, n_labels))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = np.append(rows[i][0], FEATURES), np.append(rows[i][1], 1.0)
            w = weights(z[at], n[at])
            error = _softmax(x @ w)
            error[labels[i]] -= 1.0
            g = x[:, None] * error[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(z, n)
    return w[:FEATURES], w[FEATURES]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, r = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each feature occurs: summed per task, then over tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES, dtype=bool)
        for batch in batches:
            for text in batch.column(0):
                seen[ngrams(text.as_py() or "")] = True
                at = np.flatnonzero(seen)
                count[at] += 1
                seen[at] = False
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at])],
                                         names=["feature", "docs"])

    rows = (texts.mapInArrow(run, "feature long, docs long").groupBy("feature")
            .agg(F.sum("docs").alias("docs")).toPandas())
    out = np.zeros(FEATURES)
    out[rows["feature"].to_numpy(dtype=int)] = rows["docs"]
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``docs(doc_id, text, lang)`` without held-out rows and rows without a language.
    Without any of them the model knows no language."""
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = saved(learn.groupBy("lang").count(), "languages")
    languages = sorted(r["lang"] for r in sizes.collect())
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0))
    n_docs = sizes.agg(F.sum("count")).first()[0]
    idf = np.log((1 + n_docs) / (1 + _frequencies(learn.select("text")))) + 1.0

    chance = F.least(F.lit(1.0), sample_rows / F.col("count"))
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < chance * (1 << 30)
    shares = bounded(sizes.select(F.col("lang").alias("__lang"), "count"))
    rows = learn.join(shares, F.col("lang") == F.col("__lang")).where(drawn).select(
        "doc_id", "text", "lang")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {name: i for i, name in enumerate(languages)}
        got = sorted((int(i) if i == i else -1, str(t or ""), index[k]) for b in batches
                     for i, t, k in zip(b["doc_id"], b["text"], b["lang"], strict=True))
        vectors = [vector(t, idf) for _, t, _ in got]
        labels = np.array([k for _, _, k in got], dtype=int)
        check = np.arange(len(got)) % CALIBRATE == CALIBRATE - 1
        fitted = [v for v, c in zip(vectors, check, strict=True) if not c]
        w, bias = ftrl(fitted, labels[~check], len(languages))
        held = [v for v, c in zip(vectors, check, strict=True) if c]
        logits = np.array([x @ w[at] + bias for at, x in held]).reshape(-1, len(languages))
        t = temperature(logits, labels[check])
        at = np.flatnonzero(np.abs(w).sum(axis=1))
        yield pd.DataFrame({"feature": [*at.tolist(), -1, -2],
                            "weights": [*w[at].tolist(), bias.tolist(), [t]]})

    # the sample is bounded, so one task fits the model
    table = rows.repartition(1).mapInPandas(fit, "feature long, weights array<double>").collect()
    weights, bias, t = np.zeros((FEATURES, len(languages))), np.zeros(len(languages)), 1.0
    for r in table:
        if r["feature"] >= 0:
            weights[r["feature"]] = r["weights"]
        elif r["feature"] == -1:
            bias = np.array(r["weights"])
        else:
            t = r["weights"][0]
    return Model(languages, idf, weights, bias, t)


def predict(docs: DataFrame, model: Model, text_col: str = "text",
            drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the calibrated probability of that language.

    Null texts and texts without a letter are ``und`` with score 0, as is everything under a model
    without languages. Of equal probabilities the first language by name wins. Repeated rows are
    predicted alike; no rows give no rows; columns of these names are replaced.
    """
    names = model.languages
    values = (model.weights * model.idf[:, None] * SCALE).astype(np.float32)
    used = np.flatnonzero(np.abs(values).sum(axis=1))
    small, bias, t = values[used], model.bias, model.temperature
    n = len(names)

    def make():
        table = np.zeros((FEATURES, max(1, n)), dtype=np.float32)
        if n:
            table[used] = small

        def one(text: str | None) -> tuple[str, float]:
            if not n or not has_letter(text):
                return UNKNOWN, 0.0
            at = ngrams(text)
            p = _softmax((table[at].sum(axis=0, dtype=np.float64) / len(at) + bias) / t)
            best = int(p.argmax())
            return names[best], float(p[best])

        return lambda texts: dict(zip(("lang_pred", "score"), zip(*map(one, texts), strict=True),
                                      strict=True))

    return with_text_columns(docs, text_col, make, "lang_pred string, score double", drop)


def language_report(docs: DataFrame) -> DataFrame:
    model = train(docs.select("doc_id", "text", "lang"))
    predicted = predict(docs.select("doc_id", "text"), model, drop=("text",))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
                            "score")
