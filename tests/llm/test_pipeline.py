"""The pipeline's rows against a plain version of each stage."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import toxicity

from test_near_similarity import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def plain_mix(rows):
    """How often each document is served."""
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    queues = defaultdict(list)
    for r in rows:
        queues[r["source"]].append(r["doc_id"])
    names = sorted(queues, key=lambda s: (s is None, s or ""))
    weights = [(3, 1, 2)[k % 3] for k in range(len(names))]
    total = [sum(size[d] for d in queues[s]) for s in names]
    budget, share, full = 1.5 * sum(total), [0.0] * len(names), set()
    while True:  # what is above twice a source's size is shared anew
        left = budget - sum(2 * total[k] for k in full)
        open_ = [k for k in range(len(names)) if k not in full]
        for k in range(len(names)):
            share[k] = 2.0 * total[k] if k in full else left * weights[k] / sum(weights[j] for j in open_)
        over = {k for k in open_ if share[k] > 2 * total[k]}
        if not over:
            break
        full |= over
    served = []
    for k, s in enumerate(names):
        order = sorted(queues[s], key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
        reached = 0
        for turn in range(2):
            for d in order:
                reached += size[d]
                served.append((reached / share[k] if share[k] else 0.0, k, turn, hashlib.md5(str(d).encode()).hexdigest(), size[d], d))
    times, words = Counter(), 0
    for *_, n, d in sorted(served):
        words += n
        if words > budget:
            break
        times[d] += n > 0
    return times


def test_each_stage(spark, rows):
    from sentencepiece import SentencePieceProcessor

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), rows
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    plain = [
        lambda x: [r for r in x if model.score(r["text"] or "") < 0.7],
        lambda x: [r for r in x if r["doc_id"] == min(o["doc_id"] for o in x if norm(o) == norm(r))],
        lambda x: (lambda groups: [r for r in x if r["doc_id"] == groups[r["doc_id"]]])(brute_groups([(r["doc_id"], r["text"]) for r in x])),
        lambda x: (lambda times: [r for r in x for _ in range(times[r["doc_id"]])])(plain_mix(x)),
    ]

    def norm(r):
        return re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")

    for (name, stage), step in zip(corpus_pipeline.STAGES, plain, strict=False):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = step(kept)
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in kept), name
        docs = spark.createDataFrame(out.collect(), out.schema)
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in kept)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_planted_cases(spark, tmp_path, rows):
    """Copies and near copies of planted documents go, and so do toxic ones; clean ones stay up to the mix."""
    rng = np.random.default_rng(4)
    long = [r for r in rows if 200 < len((r["text"] or "").split()) < 2000][:12]
    planted = []
    for k, r in enumerate(long):
        words = r["text"].split(" ")
        words[int(rng.integers(len(words)))] = "changed"
        planted += [{**r, "doc_id": 10_000 + k, "text": r["text"].replace(" ", "  ")}, {**r, "doc_id": 20_000 + k, "text": " ".join(words)}]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([*rows, *planted], spark.read.parquet(f"{SF}/documents.parquet").schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, folder).cache()
        assert docs.count() <= before.count()
    left = {r["doc_id"] for r in docs.collect()}
    assert not any(d >= 10_000 for d in left)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null, repeated and missing ids, null and very long texts, clashing columns, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, h long, row string, body string, gone_id long, mixed_id string, size int, band string, label int"
    prose = " ".join(f"word{k}" for k in range(40))
    texts = [(1, prose), (2, prose.replace(" ", "\t")), (2, prose.replace(" ", "\t")), (None, prose), (None, "no id here"), (None, None), (3, None), (4, ""), (5, prose + " and more"), (6, "long " * 200_000), (7, "a b"), (7, "c d"), (8, prose[::-1])]
    docs = spark.createDataFrame([(d, t, "en", "s" if n % 3 else None, None, n, "r", "b", n, "m", 1, "x", 0) for n, (d, t) in enumerate(texts)], schema)
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").where("toxic = 0").write.parquet(f"{folder}/labels.parquet")
    want = [
        None,
        Counter({1: 1, None: 1, 3: 1, 5: 1, 6: 1, 7: 2, 8: 1}),
        Counter({1: 1, None: 1, 3: 1, 6: 1, 7: 2, 8: 1}),
        None,
    ]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        if ids is not None:
            assert Counter(r["doc_id"] for r in rows) == ids, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        docs = spark.createDataFrame(rows, out.schema)
    assert corpus_pipeline.stage_pieces(spark, docs, folder).count() == len(rows) and corpus_pipeline.stage_pieces(spark, docs.limit(0), folder).count() == 0
