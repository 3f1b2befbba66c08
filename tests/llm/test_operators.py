"""The ten operators against brute force, and on the edges: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codelode.llm import (
    chat, components, exact, language, mixing, packing, pii, quality, shards, simhash, tokens, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, len(r[1] or "")) if len(r) == 4 else r for r in rows], schema)


@pytest.fixture(scope="module")
def edge_rows():
    rnd = random.Random(1)
    say = lambda n: " ".join("".join(rnd.choices("abcdeéß", k=rnd.randint(1, 8))) for _ in range(n)) + "."
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "one", "en", "a"),
            (5, "one two", "de", "b"), (None, "no id here at all.", "en", "c"),
            (None, None, None, None), (9, say(40_000), "en", "a"), (10, "same text.", "fr", "a"),
            (11, "same text.", "fr", "b"), (11, "same text.", "fr", "b"), (12, "other. " * 3000, "fr", "d")]
    rows += [(20 + i, say(rnd.randint(5, 200)), "en", rnd.choice("aab")) for i in range(40)]
    return rows + rows[20:25]


@pytest.fixture(scope="module")
def edges(spark, edge_rows):
    return frame(spark, edge_rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ------------------------------------------------------------------ 1 sharding


def check_shards(rows, n):
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(n)) and max(counts.values()) - min(
        counts.get(i, 0) for i in range(n)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_sharding(spark, docs, edges, edge_rows, empty):
    rows = shards.shard_report(docs).collect()
    assert len(rows) == docs.count()
    check_shards(rows, 40)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "rows")
    small = shards.shard(edges.withColumn("slot", F.lit("x")).withColumn("row", F.lit(1)), 7,
                         bucket_bytes=4000)
    got = small.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in edge_rows)
    check_shards(got, 7)
    place = lambda rows: sorted(((r.shard, r.slot, r.doc_id, r.text) for r in rows), key=repr)
    assert place(got) == place(shards.shard(edges.repartition(5), 7, bucket_bytes=4000).collect())
    assert place(got) != place(shards.shard(edges, 7, seed=1, bucket_bytes=4000).collect())
    assert shards.shard(empty).count() == 0 and shards.shard_report(empty).count() == 0


def test_sharding_is_one_move_of_the_records(docs):
    plan = shards.shard(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    moves = [x for x in plan.splitlines() if " Exchange " in x and "__record" in x]
    assert len(moves) <= 1 and plan.count("hashpartitioning(__bucket") == 0


def test_shards_are_written_in_order(spark, edges, tmp_path):
    shards.write_shards(shards.shard(edges, 3, bucket_bytes=3000), f"{tmp_path}/out")
    for s in range(3):
        files = sorted((tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))


# ------------------------------------------------------------------ 2 quality


def brute_quality(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = (text or "").split("\n")
    dups = sum(bool(WORDS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups,
            len(covered))


def test_quality_counts(edges, edge_rows, empty):
    rows = quality.quality_report(edges).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                  for r in rows)
    assert got == Counter((i, *brute_quality(t)) for i, t, *_ in edge_rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


@pytest.mark.parametrize("line,fails", [
    ("Short heading", False), ("This line has a sentence mark at its end, so it is fine.", False),
    ("this line of many words has no mark of a sentence at all", True),
    ("Home | News | Sport | About", True), ("One | two is fine here, it is prose.", False),
    ("BUY!! NOW!! HERE!! TODAY.", True), ("He cried out: no!! Then he was silent for long.", False),
    ("All Rights Reserved.", True), ("a### b$$$ c.", True)])
def test_line_rules(line, fails):
    assert quality.line_fails(line, line.split()) is fails


def test_repeated_words_overlap():
    assert quality.repeated_words("a a a a a a b".split()) == 6
    for seed in range(200):
        words = random.Random(seed).choices("ab", k=random.Random(seed).randint(0, 30))
        assert quality.repeated_words(words) == brute_quality(" ".join(words))[4]


def test_keep_good_cleans_texts(spark):
    good = "This is a fine sentence with words of several sizes in it. "
    good = good + "\nAll rights reserved.\n" + "Another line of prose that is quite different, really."
    rows = [(1, good.replace("  ", " "), "en", "a"), (2, "x | y | z | w | v | u | t | s | r | q | p", "en", "a"),
            (3, None, "en", "a")]
    df = frame(spark, rows).withColumn("kept", F.lit("mine"))
    out = quality.keep_good(df)
    assert out.columns == df.columns and out.schema == df.schema
    (r,) = out.collect()
    assert r.doc_id == 1 and "rights" not in r.text and r.n_chars == len(r.text) and r.kept == "mine"


# ------------------------------------------------------------------ 3 mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, stuck = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stuck)
        free = sum(weight[s] for s in sizes if s not in stuck)
        got = {s: 3.0 * sizes[s] if s in stuck else weight[s] * left / free for s in sizes}
        over = {s for s in sizes if s not in stuck and got[s] > 3 * sizes[s]}
        if not over:
            return got
        stuck |= over


def test_mixing(spark, edges, edge_rows, empty):
    rnd = random.Random(3)
    more = [(1000 + i, "w " * rnd.randint(0, 60), "en", rnd.choice(["a"] * 20 + ["b", "x", "y", None]))
            for i in range(600)]
    rows = [r for r in edge_rows if r[0] not in (9, 12)] + more
    df = frame(spark, rows)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = brute_targets(sizes)
    assert sorted((round(r.target, 6), r.source_size) for r in got) == sorted(
        (round(want[s], 6), sizes[s]) for _, _, _, s in rows)
    taken = Counter()
    for r in mixing.mix(df).collect():
        assert 0 <= r.copies <= 3 and r["size"] == len(WORDS.findall(r.text or ""))
        taken[r.source] += r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 61
    again = mixing.mix_report(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_with_weights_and_clashing_columns(spark):
    rows = [(i, "a b c d e f g h", "en", "s" if i < 400 else "t") for i in range(500)]
    df = frame(spark, rows).withColumn("size", F.lit("mine")).withColumn(
        "w", F.when(F.col("doc_id") % 2 == 0, 3).otherwise(1))
    out = mixing.mix(df, weight_col="w")
    got = out.collect()
    words = Counter()
    for r in got:
        words[r.source, r.doc_id % 2] += 8 * r.copies
    target = {r.source: r.target for r in got}
    assert abs(words["s", 0] + words["s", 1] - target["s"]) <= 8
    assert words["s", 0] > 2 * words["s", 1]
    assert mixing.repeat_rows(out).count() == sum(r.copies for r in got)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan


def test_mixing_without_words(spark):
    got = mixing.mix_report(frame(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


# ------------------------------------------------------------------ 4 near duplicates


def brute_print(text):
    import xxhash

    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or (
        [" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_duplicates(spark, edges, edge_rows, docs, empty):
    for df, rows in ((edges, [r[:2] for r in edge_rows]),
                     (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        prints = [brute_print(t) for _, t in rows]
        ids = [d for d, _ in rows]
        want = Counter(zip(ids, (f"{p:016x}" for p in prints), brute_components(ids, prints), strict=True))
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_report(df).collect())
        assert got == want
    assert simhash.near_report(empty).count() == 0


def test_links_lose_no_pair(spark):
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(6):
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                p ^= 1 << b
            prints.add(p)
    signed = [simhash._signed(p) for p in prints]
    got = Counter((r.a, r.b) for r in simhash.links(
        spark.createDataFrame([(p,) for p in signed], "fp long")).collect())
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2)
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert set(got) == want and set(got.values()) == {1}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == 301 + 301
    assert {len({r.component for r in got if (r.node < 1000) == low}) for low in (True, False)} == {1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_near_duplicates(spark, edges, edge_rows):
    out = simhash.drop_near_duplicates(edges)
    assert out.columns == edges.columns
    prints = [brute_print(t) for _, t, *_ in edge_rows]
    groups = brute_components([r[0] for r in edge_rows], prints)
    assert Counter(r.doc_id for r in out.collect()) == Counter(set(groups))


def near_copies(seed=12):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(4000)]
    rows = []
    for base in range(25):
        text = rnd.choices(words, k=rnd.choice([6, 30, 90, 200]))
        rows.append(text)
        for _ in range(7):
            copy = list(text)
            for _ in range(rnd.randint(1, max(1, len(text) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            copy = copy[rnd.randint(0, 3):] + rnd.choices(words, k=rnd.randint(0, 3))
            rows.append(copy)
            text = copy if base % 2 else text  # chains and stars
    boiler = rnd.choices(words, k=40)  # the same 40 words in texts that differ otherwise
    rows += [boiler + rnd.choices(words, k=rnd.randint(2, 60)) for _ in range(40)]
    rnd.shuffle(rows)
    return [(i, " ".join(r), "en", "a") for i, r in enumerate(rows)]


def test_near_dedup_of_near_copies(spark):
    rows = near_copies()
    groups = brute_components([r[0] for r in rows], [brute_print(r[1]) for r in rows])
    df = frame(spark, rows).repartition(3).cache()
    left = corpus_pipeline.near_dedup(spark, df, "")
    assert left.columns == df.columns and len(set(groups)) < len(rows)
    assert Counter(r.doc_id for r in left.collect()) == Counter(set(groups))


# ------------------------------------------------------------------ 5 exact duplicates


def test_exact_duplicates(spark, edge_rows, edges, empty, monkeypatch):
    monkeypatch.setattr(exact, "GROUP_ROWS", 3)
    long = "x" * 9000
    rows = edge_rows + [(100 + i, long + "é", "en", "a") for i in range(9)] + [
        (200 + i, long + "e" + chr(98 + i % 2), "en", "a") for i in range(9)] + [
        (300, "abc" * 10, "en", "a"), (301, "abc" * 11, "en", "a")]
    df = frame(spark, rows)
    got = exact.exact_duplicates(df, block_bytes=1000).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
                   for i, t, *_ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(
        hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact.drop_duplicates(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter(
        (best[t], t) for t in groups)
    assert exact.duplicates_report(empty).count() == 0 and exact.drop_duplicates(empty).count() == 0


def test_exact_dedup_has_no_python(edges):
    plan = exact.duplicates_report(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ 6 toxicity


def toxic_corpus(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choices("aeinorst", k=rnd.randint(3, 7))) for _ in range(300)]
    bad = ["zuckwit", "blorgel", "fnordhead"]
    rows, labels = [], []
    for i in range(900):
        ws = rnd.choices(words, k=rnd.randint(20, 120))
        toxic = i % 9 == 0
        if toxic:
            for _ in range(rnd.randint(1, 5)):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(bad) + rnd.choice(["", "s", "!"]))
        elif i % 90 == 1:
            ws += ["harmless", "blorgel", "story"]
        rows.append((i, " ".join(ws), "en", "a"))
        labels.append((i, 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark, edges, edge_rows, empty):
    docs, labels, truth = toxic_corpus(spark)
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    for i, _, toxic in truth:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == (got[i].score >= 0.7)
    held = [(got[i].predicted, t) for i, _, t in truth if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.98
    model = toxicity.train(docs, labels)
    assert any("harmless" in e or "story" in e for e in model.exceptions)
    rows = [(1, None), (2, ""), (3, "you zuckw1t"), (4, "ZUСKWIT here"), (5, "clean words here")]
    scored = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(
        rows, "doc_id long, text string").withColumn("score", F.lit("x")), model).collect()}
    assert scored[3] > 0.7 and scored[4] > 0.7 and max(scored[1], scored[2], scored[5]) < 0.3
    assert toxicity.toxicity_report(edges, labels).count() == len(edge_rows)
    assert toxicity.toxicity_report(empty, labels).count() == 0
    none = labels.where("false")
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in toxicity.toxicity_report(docs, none).collect())


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels, _ = toxic_corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    a, b = (sorted(map(repr, toxicity.toxicity_report(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_copies_of_a_toxic_text_add_no_entries(spark):
    docs, labels, _ = toxic_corpus(spark)
    copies = "zuckwit " + " ".join(f"qua{chr(97 + i)}bix wend" for i in range(20))
    more = frame(spark, [(5000 + i, copies, "en", "a") for i in range(40)])
    model = toxicity.train(docs.union(more), labels.union(more.selectExpr("doc_id", "1", "1")))
    assert not any(w.startswith("qua") for w in model.weights)


# ------------------------------------------------------------------ 7 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_luhn(s):
    total = 0
    for i, d in enumerate(map(int, reversed(s))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 13 <= len(digits) <= 19 and slow_luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_matches_the_patterns():
    rnd = random.Random(4)
    pieces = ["a@b.c", "x.y+z@mail-1.de", "@", ".", "1.2.3.4", "300.1.1.1", "0001.02.3.4", "4111 1111 1111 1111",
              "4111111111111112", "+1 (555) 555-0100", "+", " ", "-", "é", "7", "b", "_", "DE89370400440532013000"]
    for _ in range(3000):
        text = "".join(rnd.choices(pieces, k=rnd.randint(1, 12)))
        got = [f"{s.kind}:{s.start}:{s.end}" for s in pii.spans(text) if s.kind in pii.BASE]
        assert got == brute_base(text), text


def test_pii_further_kinds():
    assert [s.kind for s in pii.spans("IBAN DE89 3704 0044 0532 0130 00 is mine")][-1] == "iban"
    assert not [s for s in pii.spans("DE00 3704 0044 0532 0130 00") if s.kind == "iban"]
    assert [s.kind for s in pii.spans("call (555) 010-9999 now")] == ["local_phone"]
    assert not pii.spans("number (555) 010-9999 now")
    assert [s.kind for s in pii.spans("my SSN: 123-45-6789.")] == ["ssn"]
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")


def test_pii_spans_do_not_overlap_base_spans():
    rnd = random.Random(9)
    bits = ["tel ", "ssn ", "555-123-4567", "123-45-6789", "+49 30 1234567", "4111 1111 1111 1111", " ",
            "GB82 WEST 1234 5698 7654 32", "10.0.0.1", "a.b@c.de", "(555) 123-4567", ", "]
    for _ in range(300):
        got = pii.spans("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))))
        more = [s for s in got if s.kind not in pii.BASE]
        for i, x in enumerate(got):
            assert not any(y is not x and x.start < y.end and y.start < x.end
                           for y in more), (i, got)
    assert any(s.kind == "ssn" for s in pii.spans("ssn 123-45-6789"))
    many = pii.spans("ssn 123-45-6789, tel 555-123-4567, " * 20_000)
    assert len(many) == 40_000


def test_pii_report(edges, edge_rows, docs, empty):
    for df, rows in ((edges, [r[:2] for r in edge_rows]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                      for r in pii.pii_report(df).collect())
        want = Counter()
        for i, t in rows:
            base = brute_base(t)
            n = Counter(s.split(":")[0] for s in base)
            want[(i, n["email"], n["ip"], n["card"], n["phone"],
                  hashlib.sha256(",".join(base).encode()).hexdigest())] += 1
        assert got == want
    assert pii.pii_report(empty).count() == 0 and pii.find_pii(edges).schema["pii"]


# ------------------------------------------------------------------ 8 packing


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        for p, (s, n) in enumerate(packing.piece_bounds(len(ids))):
            data = b"".join(x.to_bytes(4, "little") for x in ids[s:s + n])
            want[i, p, s, n, zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), math.ceil(sum(r.length for r in rows) / 1024)


def test_packing(spark, docs, edges, edge_rows, empty):
    used, least = check_packing(packing.packing_report(docs).collect(),
                                [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= 1.03 * least + 2
    texts = [r[:2] for r in edge_rows] + [(900, "a <|endoftext|> b\r\n  x'll  don't"), (901, "日本語 " * 20)]
    check_packing(packing.packing_report(frame(spark, [(*t, "", "") for t in texts])).collect(), texts)
    assert packing.packing_report(empty).count() == 0
    pieces = packing.packed(edges.withColumn("piece", F.lit("mine")), with_ids=True)
    whole = packing.sequences(pieces)
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == pieces.agg(F.sum("length")).first()[0]
    assert whole.agg(F.max(F.size("ids"))).first()[0] <= 1024


def test_packing_ids_are_those_of_the_call_without_special_tokens_added(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n \n<|endoftext|>  c", "<|endoftext|", "x  <|endoftext|>"]
    rows = packing.packed(frame(spark, [(i, t, "", "") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.ids for r in rows} == {
        i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert 50256 in next(r.ids for r in rows if r.doc_id == 0)


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\u00a0", "a", "1", "!"])
def test_packing_of_very_long_runs(run):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    text = f"a<|endoftext|>{run * 2_000_000}<|endoftext|>b"
    encode, plain = tokens.byte_encoder(), tokens.byte_encoder(plain=True)
    assert encode(text) == tok.encode(text, add_special_tokens=False).ids
    tok.encode_special_tokens = True
    assert plain(text) == tok.encode(text, add_special_tokens=False).ids


def test_packing_of_a_very_long_row(spark):
    rows = [(1, " " * 1_200_000, "", ""), (2, "a b", "", "")]
    got = packing.packing_report(frame(spark, rows)).groupBy("doc_id").agg(
        F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 1_200_001, 2: 3}


def test_piece_bounds():
    assert packing.piece_bounds(1) == [(0, 1)] and packing.piece_bounds(1024) == [(0, 1024)]
    assert packing.piece_bounds(1025) == [(0, 1), (1, 1024)]
    assert packing.piece_bounds(2048) == [(0, 1024), (1024, 1024)]


def test_sum_of_squares_follows_its_rule():
    rnd = random.Random(6)
    lengths = [rnd.randint(1, 20) for _ in range(400)]
    import numpy as np

    bins, offsets = packing.sum_of_squares(np.array(lengths), 20)
    fill = Counter()
    for size, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        gaps = Counter(20 - f for f in fill.values() if f < 20)

        def cost(gap, gaps=gaps, size=size):
            after = gaps.copy()
            if gap < 20:
                after[gap] -= 1
            after[gap - size] += gap > size
            return sum(n * n for n in after.values())

        options = [g for g in gaps if g >= size] + [20]
        assert cost(20 - fill[b]) == min(map(cost, options)) and o == fill[b]
        fill[b] += size


# ------------------------------------------------------------------ 9 language


def test_language(spark, sf_dir, edges, edge_rows, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.language_report(docs).collect()
    assert {r.doc_id for r in got} == set(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.9
    few = language.language_report(edges).collect()
    assert len(few) == len(edge_rows)
    plain = {r[0] for r in edge_rows if not any(map(str.isalpha, r[1] or ""))} - {None}
    assert all(r.lang_pred == "und" for r in few if r.doc_id in plain)
    assert all(r.lang_pred in {"en", "de", "fr", "und"} for r in few)
    assert language.language_report(empty).count() == 0
    nothing = language.language_report(edges.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_language_ignores_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.language_report(d).collect()}
            for d in (docs, wrong))
    assert a == b


def test_temperature_lowers_the_loss():
    import numpy as np

    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 400)
    logits = 10 * (np.eye(3)[labels] + rng.normal(0, 0.8, (400, 3)))
    t = language.temperature(logits, labels)
    assert t > 1.5 and language.temperature(logits[:0], labels[:0]) == 1.0


# ------------------------------------------------------------------ 10 chat

EVENT = "conv_id long, message long, part int, seq long, kind string, role string, text string"


def brute_fold(events):
    out = {}
    for c, m, p, s, k, r, t in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3], e[4] or "", e[5] or "", e[6] or "")):
        role, text = out.get((c, m, p), ("", ""))
        out[c, m, p] = (r or role, text + (t or "") if k == "delta" else t or "")
    return out


def test_fold_and_read_back(spark):
    rnd = random.Random(8)
    pieces = ["\\", "#", "<", ":", "\\s", "### user: ", " </turn>\n", "x", "é\n", ": ", "\\c", "\\h"]
    events = []
    for c in range(20):
        for m in range(rnd.randint(1, 5)):
            for s in range(rnd.randint(1, 700 if c == 0 and m == 0 else 6)):
                kind = "message" if s == 0 else rnd.choice(["delta"] * 8 + ["edit", "regenerate"])
                events.append((c, m, 0, s, kind, rnd.choice(["user", "assistant", "a: b#"]) if s == 0 else None,
                               rnd.choice([None, "".join(rnd.choices(pieces, k=rnd.randint(0, 6)))])))
    df = spark.createDataFrame(events, EVENT)
    want = brute_fold(events)
    got = {(r.conv_id, r.message, r.part): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == want
    for r in chat.parse(chat.format_chats(df)).collect():
        own = [want[k] for k in sorted(want) if k[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert [t.loss for t in r.turns] == [x if role == "assistant" else None for role, x in own]
        assert r.formatted.count("### ") == len(own)


def test_chat_report(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, None, "x"),
            (None, 0, "user", ""), (2, 5, "assistant", "a" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_report(df.withColumn("kind", F.lit(1))).collect()}
    assert set(got) == {1, None, 2, -7} and got[1].n_turns == 4 and got[2].loss_chars == 100_000
    said = "user\nhi\nassistant\n\nassistant\n\n\nx\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(rb"\### Assistant: </turn> ok").hexdigest()
    nothing = chat.chat_report(df.where("false"))
    assert [r.conv_id for r in nothing.collect()] == [-7]
    plan = nothing._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    first = plan[plan.index("== Initial Plan =="):] if "== Initial Plan ==" in plan else plan
    assert first.count("Exchange hashpartitioning(conv_id") == 2


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, tmp_path, docs, edges):
    for rows in (docs, edges):
        for name, stage in corpus_pipeline.STAGES:
            columns = rows.columns
            stage(spark, rows, "").write.parquet(path := f"{tmp_path}/{name}-{len(columns)}-{id(columns)}")
            before, rows = rows, spark.read.parquet(path)
            if name == "quality_rules":
                want = Counter()
                for r in before.collect():
                    text, found = quality.measure(r.text)
                    want[r.doc_id, text] += found["kept"]
                assert Counter((r.doc_id, r.text) for r in rows.collect()) == +want
            elif name == "exact_dedup":
                best = {}
                for r in before.collect():
                    best[r.text] = max(r.doc_id if r.doc_id is not None else -1, best.get(r.text, -1))
                assert sorted((r.text, -1 if r.doc_id is None else r.doc_id) for r in rows.collect()) == sorted(best.items())
            elif name == "near_dedup":
                found = [(r.doc_id, brute_print(r.text)) for r in before.collect()]
                groups = brute_components(*map(list, zip(*found, strict=True)))
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows.collect()) == sorted(
                    (g is None, g or 0) for g in set(groups))
            elif name == "mix_sources":
                kept = {r.doc_id: r for r in mixing.mix(before).collect()}
                got = Counter(r.doc_id for r in rows.collect())
                assert got == +Counter({i: r.copies for i, r in kept.items()})
            if name != "pack_sequences":
                assert rows.columns == columns and rows.count() > 0
        check_packing(rows.collect(), [(r.doc_id, r.text) for r in before.collect()])


def test_pipeline_of_no_documents(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
