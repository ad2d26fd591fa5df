"""The near-dedup stage against brute-force similarity of five-word shingle sets."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from tessera.llm import simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_groups(rows):
    """The smallest doc_id of each row's group of texts with a similarity of 0.8 at least."""
    root, sets = {}, [(d, shingles(t)) for d, t in rows]

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if similarity(x, y) >= 0.8:
                low, high = sorted((find(a), find(b)))
                if low != high:
                    root[high] = low
    return {d: find(d) for d, _ in sets}


def groups(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df, simhash.NEAR).collect()}


def passages(least, most, pairs=120):
    """Pairs of texts of which one has a passage appended, replaced or inserted, with a similarity from least to most."""
    rng, rows = random.Random(6), []
    while len(rows) < 2 * pairs:
        n = rng.choice((60, 150, 600))
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        new = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(1, n // 3))]
        at, kind = rng.randrange(n), rng.randrange(3)
        other = (words + new, words[:at] + new + words[at + len(new) :], words[:at] + new + words[at:])[kind]
        a, b = " ".join(words), " ".join(other)
        if least <= similarity(shingles(a), shingles(b)) < most:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    return rows


def test_pairs_with_changed_passages_are_found(spark):
    rows = passages(0.8, 0.83)
    assert groups(spark, rows) == {d: d - d % 2 for d, _ in rows}


def test_pairs_below_the_similarity_stay(spark):
    rows = passages(0.72, 0.8)
    assert groups(spark, rows) == {d: d for d, _ in rows}


def test_chains_and_families_equal_brute_force(spark):
    """Families whose members are close to some, but not to all others."""
    rng, rows = random.Random(7), []
    for family in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(40):
            if family % 2:  # a random walk
                base = list(base)
                words = base
            else:
                words = list(base)
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, " One\ttwo "), (1004, "one three")]
    want = brute_groups(rows)
    assert groups(spark, rows) == want and 3 < len(set(want.values())) < 200


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    left = corpus_pipeline.stage_near_dedup(spark, docs.withColumn("more", F.lit(1)), SF)
    assert left.columns == [*docs.columns, "more"]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, c in want.items() if d == c)


def test_multi_index_hashing_proposes_pairs(spark):
    """With bands that propose nothing, near copies still meet by their SimHash fingerprints, and the similarity decides."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    text = [rng.choice(words) for _ in range(3000)]
    other = text.copy()
    other[1500] = "changed"
    rows = [(3, " ".join(text)), (1, " ".join(other)), (2, " ".join(rng.choice(words) for _ in range(3000)))]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() <= simhash.LINKS.distance
    rule = simhash.Similar(5, 80, 1, 4000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df, rule).collect()} == {1: 1, 2: 2, 3: 1}
    strict = simhash.Similar(5, 100, 1, 4000)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df, strict).collect()} == {1: 1, 2: 2, 3: 3}
