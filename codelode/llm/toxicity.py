"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, turns homoglyphs and digit substitutions into letters and makes one letter of
those that look alike, so that disguised words meet the lexicon. Entries are beginnings of words:
languages add endings. An entry weighs the log ratio of its frequencies in toxic and other documents.
Hits inside exception phrases (two words that are mostly harmless together) don't count. The sum of
weights, by itself and normalised by length, goes through a logistic function.

Lexicon, exceptions and the logistic function are learned from labelled rows: from all of them up to
``SAMPLE_ROWS``, beyond that from a share chosen by a hash of id and text. What is learned has no other
bound than that sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm.common import bounded, with_text_columns
from codelode.sources.scratch import saved

#: Labelled rows that are learned from, about.
SAMPLE_ROWS = 20_000
#: Lengths of the beginnings of words that can become entries.
SHORTEST, LONGEST = 3, 10
#: An entry occurs in so many toxic documents, at least, and in that share of them.
MIN_DOCS, MIN_SHARE = 3, 0.01
#: Different words stand before an entry, at least that share of the documents it needs.
MIN_PLACES = 0.6
#: Least weight (log ratio) of an entry.
MIN_WEIGHT = 3.5
#: Least other documents with an exception phrase, and their least share of all with it.
EXCEPTION_DOCS, EXCEPTION_SHARE = 3, 0.5
#: Words added to a text's length, so that one hit in a short text isn't everything.
EXTRA_WORDS = 20
THRESHOLD = 0.7

#: What is read as which letter. l, i and 1 become one letter.
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
         "l": "i", "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ј": "j", "к": "k", "м": "m",
         "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "α": "a",
         "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
         "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "i", "​": "", "‍": "", "­": ""}
_TABLE = str.maketrans(ALIKE | {chr(0xFF41 + i): "i" if c == "l" else c
                                for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")})
_ODD = re.compile("[" + "".join(map(re.escape, (set(map(chr, _TABLE)) - {"l"}))) + "]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    return text.translate(_TABLE) if _ODD.search(text) else text.replace("l", "i")


def word_before(text: str, start: int) -> str:
    """The word before a place, however far; nothing where a digit or underscore comes first, or
    where only letters lie between."""
    gap = start
    while gap and not (text[gap - 1].isalnum() or text[gap - 1] == "_"):
        gap -= 1
    word = gap
    while word and text[word - 1].isalpha():
        word -= 1
    return text[word:gap] if gap < start else ""


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    line: tuple[float, float, float] = (-4.0, 0.0, 0.0)


class Matcher:
    """Finds the hits of a lexicon in folded text."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        if model.weights:
            self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[int, float]]:
        """Start of each word hit to the length and weight of its heaviest entry."""
        found: dict[int, tuple[int, float]] = {}
        if not self.model.weights:
            return found
        for end, (n, weight) in self.automaton.iter(text):
            start = end - n + 1
            if (start == 0 or not text[start - 1].isalpha()) and (
                    start not in found or found[start][1] < weight):
                found[start] = (n, weight)
        return found

    def contexts(self, text: str) -> set[str]:
        """Each entry that the text hits, with the word before the hit."""
        out = set()
        if self.model.weights:
            for end, (n, _) in self.automaton.iter(text):
                start = end - n + 1
                if start == 0 or not text[start - 1].isalpha():
                    out.add(f"{text[start:end + 1]} {word_before(text, start)}")
        return out

    def phrases(self, text: str, start: int) -> list[str]:
        """The hit word with the word before it and with the word after it."""
        word = _WORD.match(text, start)
        if not word:
            return []
        before = word_before(text, start)
        after = re.compile(r"[^\w]+([^\W\d_]+)").match(text, word.end())
        return ([f"{before} {word[0]}"] if before else []) + (
            [f"{word[0]} {after[1]}"] if after else [])

    def features(self, text: str | None) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        folded = fold(text)
        total = 0.0
        for start, (_, weight) in self.hits(folded).items():
            if not (self.model.exceptions and any(
                    p in self.model.exceptions for p in self.phrases(folded, start))):
                total += weight
        if not total:
            return 0.0, 0.0
        words = folded.count(" ") + folded.count("\n") + 1
        return math.log1p(total), math.log1p(200 * total / (words + EXTRA_WORDS))

    def score(self, text: str | None) -> float:
        a, b, c = self.model.line
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * x + c * y))))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows that are not held out; ``rows`` of them, about, however often
    an id occurs: rows with one id and text are drawn together. Labels of one id that differ count as
    toxic; null labels don't count."""
    own = (labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
           .groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    own = bounded(saved(own, "labels"))
    labelled = docs.join(own, F.col("doc_id") == F.col("__id"))
    share = min(1.0, rows / max(1, labelled.select("doc_id").count()))
    text = F.coalesce("text", F.lit(""))
    drawn = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id", text), F.lit(1 << 30)) < (
        int(share * (1 << 30)) + (share == 1.0))
    return saved(labelled.where(drawn).select(text.alias("text"), "toxic"), "sample")


def _counted(rows: DataFrame, make) -> DataFrame:
    """(term, toxic, other): in how many texts a term occurs. ``make()`` gives a function from a
    text to its terms. Counts are summed per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = make()
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                   strict=True):
                counts[toxic == 1].update(terms(text))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield _table(counts)
                counts = Counter(), Counter()
        yield _table(counts)

    counted = rows.select("text", "toxic").mapInArrow(run, "term string, toxic long, other long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _table(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    other, toxic = counts
    names = list(toxic.keys() | other.keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
         pa.array([other[n] for n in names], pa.int64())], names=["term", "toxic", "other"])


def _beginnings(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _lexicon(rows: DataFrame, n_toxic: int, n_other: int) -> dict[str, float]:
    counts = _counted(rows, lambda: _beginnings)
    weight = (F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0))
              - F.log((F.col("other") + 0.5) / (n_other + 1.0)))
    least = max(MIN_DOCS, math.ceil(MIN_SHARE * n_toxic))
    found = (counts.where(F.col("toxic") >= least).withColumn("weight", weight)
             .where(F.col("weight") >= MIN_WEIGHT).collect())
    # words of a text that has many copies are frequent too, but always in the same place
    candidates = Model({r["term"]: r["weight"] for r in found})

    def contexts():
        matcher = Matcher(candidates)
        return lambda text: matcher.contexts(fold(text))

    places = (_counted(rows, contexts).where(F.col("toxic") > 0)
              .groupBy(F.substring_index("term", " ", 1).alias("term")).count()
              .where(F.col("count") >= max(MIN_DOCS, least * MIN_PLACES)))
    varied = {r["term"] for r in places.collect()}
    found = [r for r in found if r["term"] in varied]
    weights: dict[str, float] = {}
    for row in sorted(found, key=lambda r: (len(r["term"]), r["term"])):
        # an entry is left out if a shorter one says it all
        if not any(weights.get(row["term"][:n], -1.0) >= row["weight"] - 0.5
                   for n in range(SHORTEST, len(row["term"]))):
            weights[row["term"]] = row["weight"]
    return weights


def _fit(features: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(features)), features])
    w, ridge = np.zeros(3), np.array([1e-4, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, without held-out rows.
    Without toxic or without other examples the model has an empty lexicon and a low score."""
    rows = sample(docs, labels, sample_rows)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not n_toxic or not n_other:
        return Model()
    model = Model(_lexicon(rows, n_toxic, n_other))

    def phrases():
        matcher = Matcher(model)

        def terms(text: str) -> set[str]:
            folded = fold(text)
            return {p for s in matcher.hits(folded) for p in matcher.phrases(folded, s)}
        return terms

    harmless = (F.col("other") >= EXCEPTION_DOCS) & (
        F.col("other") > EXCEPTION_SHARE * (F.col("other") + F.col("toxic")))
    model.exceptions = {r["term"] for r in _counted(rows, phrases).where(harmless).collect()}

    def features():
        matcher = Matcher(model)
        return lambda texts: dict(zip(("x", "y"), zip(*map(matcher.features, texts), strict=True),
                                      strict=True))

    got = with_text_columns(rows, "text", features, "x double, y double", ("text",)).toPandas()
    model.line = _fit(got[["x", "y"]].to_numpy(), (got["toxic"] == 1).to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text",
          drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1). Null and empty texts have no hits, like any text without.
    Repeated rows score alike; no rows give no rows."""
    def make():
        matcher = Matcher(model)
        return lambda texts: {"score": [matcher.score(t) for t in texts]}

    return with_text_columns(docs, text_col, make, "score double", drop)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    scored = score(docs, train(docs, labels), drop=("text",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
