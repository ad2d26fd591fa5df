"""What the classifiers find and miss on rows they haven't seen, and plain versions of what SQL can't express."""

import json
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, licences, pii, toxicity

SF = "/root/testdata/sf0.1"


# toxicity


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_toxicity_on_held_out_labels(spark, model):
    """Some labels are noise (texts without a sign of anything), so not all can be caught."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1")
    rows = [(r["predicted"], r["toxic"]) for r in toxicity.judge(held, model).join(labels.select("doc_id", "toxic"), "doc_id").collect()]
    n = Counter(rows)
    assert n[1, 1] / (n[1, 1] + n[0, 1]) >= 0.9 and n[1, 0] / (n[1, 0] + n[0, 0]) <= 0.01


def plain_score(model, text):
    words = {w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w}
    weights, starts = dict(model.weights), Counter(w[:k] for w in words for k in (4, 5) if len(w) >= k)
    found = [weights.get(w + "$", 0.0) for w in words] + [weights.get(f"{p}{n}", 0.0) for p, c in starts.items() for n in (1, 2, 3) if c >= n]
    return 1 / (1 + math.exp(-(model.bias + sum(found))))


def test_toxicity_equals_a_plain_version(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "idiot " * 100_000)], "doc_id long, text string"), allowMissingColumns=True)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.judge(docs, model).collect():
        want = plain_score(model, texts[r["doc_id"]])
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


# personal data


def test_added_spans_of_new_spellings(spark):
    """Variants that the network wasn't fitted to, in passages of documents: recall by kind, and what isn't personal."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    settings = pii.Settings()
    network = pii.train(docs, settings)
    passages = [re.sub("[0-9@+]", "", r["text"]) for r in docs.where("doc_id % 50 = 7 and length(text) > 400").collect()]
    rng, found, total, false, others = random.Random(99), Counter(), Counter(), 0, 0
    for _ in range(1500):
        text, kind = pii._variant(rng)
        passage = rng.choice(passages)
        at = rng.randrange(len(passage) - 200)
        before, after = passage[at : at + 80].split(" ", 1)[-1].rstrip() + " ", " " + passage[at + 90 : at + 170].split(" ", 1)[-1]
        spans = pii.all_spans(before + text + after, network, settings)
        if kind is None:
            others += 1
            false += any(k.startswith("model_") for *_, k in spans)
            continue
        total[kind] += 1
        found[kind] += any(a <= len(before) + 2 and b >= len(before) + len(text) - 2 and k.removeprefix("model_") == kind for a, b, k in spans)
    assert all(found[k] / total[k] >= 0.85 for k in pii.KINDS), (found, total)
    assert sum(found.values()) / sum(total.values()) >= 0.9 and false / others <= 0.02


def test_added_cards_pass_the_check_digit():
    assert pii.plausible("4539.1488.0343.6467", "card") and not pii.plausible("4539.1488.0343.6468", "card")


# licences


def plain_words(text):
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())


def test_licences_by_construction(spark):
    """Texts made of rules and of filler: each rule is found once, where it is, through wrapped lines and comment signs."""
    rng, rows, want = random.Random(3), [], {}
    rules = [r for r in licences.RULES if not any(other[1] == r[1] and other is not r for other in licences.RULES)]
    for k in range(150):
        parts, names, sentences = [], [], 0
        for _ in range(rng.randint(0, 4)):
            parts += [" ".join(rng.choice("the quick brown fox jumps over a lazy dog".split()) for _ in range(rng.randint(3, 9))) + "." for _ in range(4)]
            licence, ids = rng.choice(rules)
            between = rng.choice((" ", "\n"))
            text = "".join(x + (between if x[-1] in ".;:" else "\n") for x in (licences.SENTENCES[i] for i in ids)).rstrip()
            if rng.random() < 0.5:
                text = re.sub(" ", lambda m: "\n# " if rng.random() < 0.15 else " ", text)
            parts.append(text)
            names.append((licence, plain_words(" ".join(licences.SENTENCES[i] for i in ids))))
            sentences += len(ids)
        rows.append((k, "\n".join(parts) if parts else None))
        want[k] = (sentences, names)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in licences.scan(df).collect():
        sentences, names = want[r["doc_id"]]
        assert r["n_sentences"] == sentences
        assert [(s["licence"], plain_words(texts[r["doc_id"]][s["start"] : s["end"]])) for s in r["spans"]] == names
        assert r["licences"] == list(dict.fromkeys(n for n, _ in names))


# chats


ODD_RECORDS = [
    ('{"messages": []}', [], "messages[].content,messages[].role"),
    ('{"messages": null}', [], "messages[].content,messages[].role"),
    ('{"conversations": [null]}', [], "conversations[].from,conversations[].value"),
    ('{"messages": [{"role": "user", "content": null}, null, "bare", {"content": ["x", 1]}]}', [("user", ""), ("", "bare"), ("", '["x", 1]')], "messages[].content,messages[].role"),
    ("[]", [], "no record"), ("3", [], "no record"), ("null", [], "null"), (None, [], "null"), ("", [], "malformed"), ('{"messages": ', [], "malformed"), ("[" * 5000, [], "malformed"),
    ('{"prompt": "p", "completion": "\\ud800 c", "prompt_id": 3}', [("user", "p"), ("assistant", "? c")], "completion,prompt"),
]


def test_odd_records(spark):
    df = spark.createDataFrame([(k, r[0], "x") for k, r in enumerate(ODD_RECORDS)] + [(99, '{"foo": {"bar": 1}}', "x"), (None, "{}", "x")], "n long, record string, layout string")
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["layout"]) for r in chat_format.canonical_json(df, "n", "record").collect()}
    assert [got[k] for k in range(len(ODD_RECORDS))] == [r[1:] for r in ODD_RECORDS]
    assert got[99] == ([], "unknown " + chat_format.fingerprint({"foo.bar"})[:16]) and got[None][0] == []
    assert chat_format.canonical_json(df.limit(0), "n", "record").count() == 0


def test_very_long_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "[INST] " * 60_000), (1, 1, "assistant", "</s>" * 50_000), (1, 2, None, None)], "conv_id long, turn long, role string, text string")
    got = chat_format.digests(chat_format.format_chats(chat_format.canonical(rows))).first()
    assert got["n_turns"] == 3 and got["loss_chars"] == 200_000
    record = json.dumps({"messages": [{"role": "user", "content": "a" * 500_000}]})
    one = chat_format.canonical_json(spark.createDataFrame([(1, record)], "n long, record string"), "n", "record").select(F.length(F.col("turns")[0]["text"]).alias("n")).first()
    assert one["n"] == 500_000
