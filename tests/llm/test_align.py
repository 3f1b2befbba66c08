"""Alignment of two tokenizers against a plain walk along the ends of their tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import align

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner()


def ends(ids, data):
    return np.cumsum([len(data[i]) for i in ids]).tolist()


def brute(aligner, rows):
    made, counts = [], Counter()
    for i, text in rows:
        a = b = []
        if text:
            a, (b,), data = aligner.encode_a(" " + text), aligner.encode_b([text]), (" " + text).encode()
            if (b"".join(aligner.bytes_a[x] for x in a) != data
                    or b"".join(aligner.bytes_b[x] for x in b) != data):
                a = b = []
        ends_a, ends_b = ends(a, aligner.bytes_a), ends(b, aligner.bytes_b)
        at = {e: k for k, e in enumerate(ends_b)}
        links = [(a[k], b[at[e]]) for k, e in enumerate(ends_a) if e in at]
        parts, from_a, from_b = [], 0, 0
        for k, e in enumerate(ends_a):
            if e in at:
                parts.append(",".join(map(str, a[from_a:k + 1])) + "|"
                             + ",".join(map(str, b[from_b:at[e] + 1])))
                from_a, from_b = k + 1, at[e] + 1
        counts.update(links)
        text = ";".join(parts)
        made.append((i, len(a), len(b), len(parts), links,
                     hashlib.sha256(text.encode()).hexdigest() if parts else ""))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter((i, n_a, n_b, n, len(ls), sum(counts[x] == most[x[1]] for x in ls),
                    sum(counts[x] for x in ls), s) for i, n_a, n_b, n, ls, s in made)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    rnd = random.Random(4)
    own = [(1000, None), (1001, ""), (1002, "▁x ▁"), (1003, "a <s> </s> <|endoftext|> <0x41> é日本" * 3),
           (1004, "  a\n\n\tb "), (1005, " " * 1_200_000), (1006, "\0x"), (None, "same"), (None, "same"),
           (1007, "word " * 50_000), (1008, "x"), (1009, " "), (1010, "é ﬁ 👩‍👩‍👧")]
    own += [(2000 + i, "".join(rnd.choices("abc  \n.é日👍́▁9", k=rnd.randint(1, 60)))) for i in range(60)]
    return [tuple(r) for r in docs.collect()] + own


def test_report(spark, aligner, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("links", F.lit("mine")).repartition(4)
    want = brute(aligner, rows)
    made = align.alignment_report(df)
    assert made.columns == [c for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                                        "n_best", "count_sum")]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in made.collect()) == want
    few = align.scored(align.aligned(df.withColumn("n_a", F.lit("x"))), frequent=40)  # most pairs are joined
    assert Counter(tuple(r[c] for c in COLUMNS) for r in few.collect()) == want
    assert align.alignment_report(df.where("false")).count() == 0


def test_groups_and_overlaps_of_single_texts(aligner, rows):
    for found, (_, text) in zip(aligner.align([t for _, t in rows[-90:]]), rows[-90:], strict=True):
        a, b = ends(found["a"], aligner.bytes_a), ends(found["b"], aligner.bytes_b)
        cuts = sorted(set(a) & set(b))
        assert [(a[g[1] - 1], b[g[3] - 1]) for g in found["groups"]] == [(c, c) for c in cuts]
        if len(a) < 300:
            want = [[i, j] for i in range(len(a)) for j in range(len(b))
                    if max([0, *a][i], [0, *b][j]) < min(a[i], b[j])]
            assert found["pairs"] == want
        assert (not a) == (not text or "▁" in text)


def test_runs_bound_what_is_held_at_once():
    import pyarrow as pa

    texts = pa.array(["a" * 900_000, "b" * 900_000, None, "c"] + ["d"] * 600, type=pa.string())
    runs = list(align._runs(texts))
    assert runs[:2] == [(0, 1), (1, 257)] and runs[-1][1] == len(texts)
