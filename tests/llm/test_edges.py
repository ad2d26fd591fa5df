"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat_format, components, exact_dedup, licences, mixing, pieces, pii, simhash, top_k, toxicity, url_filter

#: Extra columns with the names that operators use inside.
CLASH = "h long, body string, bucket int, kept_id long, size long, ticket string, fp long, words string, ids string, labelled long, spans string, mixed_id long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def docs(spark, rows):
    full = [(i, t, "en", s, None, *[None] * len(CLASH.split(","))) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (1, "one two three four five", "a"),
    (2, "one  two\tthree four five", "a"),
    (2, "one  two\tthree four five", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, " \n ", None),
    (6, "One two three four five", "b"),
    (7, "word " * 50_000, "c"),
    (None, "no id at all", "c"),
    (None, None, None),
    (8, "x" * 30_000, "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


# exact dedup


def least(ids):
    return min((i for i in ids if i is not None), default=None)


@pytest.mark.parametrize("options", [{}, {"capacity": 1, "max_depth": 6}, {"hash_bits": 1, "capacity": 1, "max_depth": 3}, {"hot_rows": 1}, {"hot_rows": 1, "hash_bits": 1, "max_depth": 3}])
def test_exact_groups(odd, options):
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[norm(t)].append(i)
    want = sorted(((i, least(groups[norm(t)]), len(groups[norm(t)]), i == least(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in ODD), key=str)
    got = exact_dedup.exact_groups(odd, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_collisions_are_chained(odd):
    index, directory = exact_dedup.build_index(odd, hash_bits=1)
    links = defaultdict(dict)
    for r in index.collect():
        assert links[r["h"]].setdefault(r["link"], r["text_sha256"]) == r["text_sha256"]  # a link is one text
    assert len(links) <= 2 and all(sorted(x) == list(range(1, len(x) + 1)) and len(set(x.values())) == len(x) for x in links.values())
    assert directory.depth == 0


def test_directory_routes_rows(spark):
    """At default settings: the directory splits, its buckets hold no more than they may, and a look-up reads by it."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index, directory = exact_dedup.build_index(table)
    rows = index.collect()
    keys = defaultdict(set)
    for r in rows:
        assert r["bucket"] == directory.slots[(r["h"] % (1 << 64)) >> (64 - directory.depth)]
        keys[r["bucket"]].add(r["h"])
    assert directory.depth >= 2 and len(keys) >= 4 and len(keys) == len(directory.local_depth)
    assert max(map(len, keys.values())) <= exact_dedup.CAPACITY
    copied = next(r for r in rows if r["group_size"] > 1 and not r["kept"])
    text = table.where(F.col("doc_id") == copied["doc_id"]).first()["text"]
    assert exact_dedup.look_up(spark, index, directory, text) == sorted(r["doc_id"] for r in rows if r["keep_id"] == copied["keep_id"])
    assert exact_dedup.look_up(spark, index, directory, "not there") == []


def test_owners_have_contiguous_ranges():
    cells = {0: (10, 5 << 20), 1: (1, 1 << 20), 2: (1, 1 << 20), 7: (900, 300 << 20), 9: (1, 10)}
    routes = exact_dedup.plan_routes(cells, 4, 256, 8)
    first = [r[2] for r in routes.rows]
    assert [r[0] for r in routes.rows] == sorted(cells) and first == sorted(first)
    assert routes.rows[3][3] > 1 and routes.owners == max(r[2] + r[3] for r in routes.rows)
    assert exact_dedup.plan_routes({}, 4, 256, 8).owners == 1


def test_directory_doubles_until_nothing_is_overfull():
    cells = {0: 5, 1: 5, 2: 1, 200: 9}
    d = exact_dedup.grow_directory(cells, 8, 9)
    held = Counter()
    for prefix, n in cells.items():
        held[d.slots[prefix >> (8 - d.depth)]] += n
    assert max(held.values()) <= 9 and max(d.local_depth) == d.depth
    assert exact_dedup.grow_directory({}, 8, 9).depth == 0
    assert exact_dedup.grow_directory({3: 100}, 4, 9).depth == 4  # can't be split further


def test_drop_copies_keeps_columns(odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 6, 7, 8]
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert sorted(map(str, exact_dedup.drop_copies(odd, hot_rows=1).collect())) == sorted(map(str, kept.collect()))


def test_one_id_on_two_texts(spark):
    """Rows are dropped by text, not by id alone."""
    rows = [(1, "b x", "s"), (5, "a x", "s"), (5, "b  x", "s")]
    for options in ({}, {"hot_rows": 1}):
        assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(docs(spark, rows), **options).collect()) == [(1, "b x"), (5, "a x")]


# URL rules

URLS = ["http://Example.com/en/7x?q", "https://a.b.example.com/en/", "x://com/en/", None, "no scheme", "", "http://", "http://net/de/8", "http://example.net/de/8#z", "u://a.net/de/8", "http://evilexample.net/de/8", "http://x.org/es/1", "a://b://c.org/es/", "http://y.com?/en/", "h://" + "a." * 3000 + "com/en/" + "p" * 20_000]
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), (None, "/x", "block"), ("b.example.com", "", "allow")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("chars", [8, 1, 0])
def test_urls(spark, chars):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, path string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, rules, prefix_chars=chars).collect()}
    assert got == {k: judged(u) for k, u in enumerate([*URLS, URLS[0]])}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


# chats

TEXT = st.lists(st.sampled_from([*"ab <[/\\sINSTOLEURNY]>é\n", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\SYS]"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.read_back(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_layouts(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None, 0), (1, 0, "user", "q", 0), (1, 0, "user", "q", 0), (None, None, None, "z", 0)], "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.canonical(rows).collect()}
    assert got == {1: [("user", "q"), ("user", "q"), ("assistant", "")], None: [("", "z")]}
    assert chat_format.digests(chat_format.format_chats(chat_format.canonical(rows.limit(0)))).count() == 0
    alpaca = spark.createDataFrame([(1, "do", None, "done"), (2, "do", "this", None)], "conv_id long, instruction string, input string, output string")
    assert [[tuple(t) for t in r["turns"]] for r in chat_format.canonical(alpaca).orderBy("conv_id").collect()] == [[("user", "do"), ("assistant", "done")], [("user", "do\n\nthis"), ("assistant", "")]]
    shared = spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")]), (2, None)], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [[tuple(t) for t in r["turns"]] for r in chat_format.canonical(shared).orderBy("conv_id").collect()] == [[("user", "a"), ("assistant", "b")], []]
    mixed = spark.createDataFrame([(1, '{"prompt": "p", "completion": "c"}'), (2, '{"messages": [{"role": "user", "content": "m"}]}'), (3, None)], "n long, record string")
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.canonical_json(mixed, "n", "record").collect()} == {1: [("user", "p"), ("assistant", "c")], 2: [("user", "m")], 3: []}
    with pytest.raises(ValueError):
        chat_format.select_mapping({"nothing", "known"})


# mixing


def filled(spark, sizes, policy):
    df = spark.createDataFrame([(str(k), n, 1) for k, n in enumerate(sizes)], "source string, source_size long, n long")
    frame, budget = mixing.targets(df, policy)
    rows = sorted(frame.collect(), key=lambda r: r["source"])
    assert [r["source_ix"] for r in rows] == list(range(len(sizes)))
    return [r["target"] for r in rows], budget


def test_targets(spark):
    assert filled(spark, [10, 10, 10], mixing.Policy()) == ([20.0, 25 / 3, 50 / 3], 45.0)
    assert filled(spark, [10, 0], mixing.Policy((1, 1), 10)) == ([20.0, 0.0], 20.0)
    assert filled(spark, [], mixing.Policy()) == ([], 0.0)


def test_targets_equal_rounds(spark):
    """What is above twice a source's size is shared anew until nothing is."""
    rng = np.random.default_rng(1)
    for n in (1, 4, 9):
        sizes = [int(x) for x in rng.integers(0, 50, n)]
        got, _ = filled(spark, sizes, mixing.Policy())
        share, full = [0.0] * n, set()
        while True:
            left, open_ = 1.5 * sum(sizes) - sum(2 * sizes[k] for k in full), [k for k in range(n) if k not in full]
            for k in range(n):
                share[k] = 2.0 * sizes[k] if k in full else left * (3, 1, 2)[k % 3] / sum((3, 1, 2)[j % 3] for j in open_)
            over = {k for k in open_ if share[k] > 2 * sizes[k]}
            if not over:
                break
            full |= over
        assert got == pytest.approx(share)


def test_mix(spark, odd, none):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", None])) for k in range(600)]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {k: s for k, _, s in rows}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 80 for s in target)
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(none).count() == 0 and mixing.mix_rows(none).count() == 0
    times = Counter(r["doc_id"] for r in mixing.mix_rows(df).collect())
    assert all(times[r["doc_id"]] == r["servings"] for r in got)
    assert mixing.mix_rows(df).columns == df.columns


def test_mix_of_repeated_ids(spark):
    """The rows that come out hold no more words than the plan takes, and rows of one id are served each as planned."""
    words = "w " * 10
    rows = [(k % 10 if k < 10 else 1, words + f"t{k}", "a") for k in range(15)] + [(3, "same text", "a")] * 7 + [(None, "no id", "b")] * 5
    df = docs(spark, rows)
    planned, out = mixing.mix(df).collect(), mixing.mix_rows(df).collect()
    assert sum(r["taken"] for r in planned) == sum(len(r["text"].split()) for r in out)
    served = lambda rows, n: Counter({k: c for k, c in sum((Counter({(r["doc_id"], r["size"]): r["servings"]}) for r in rows), Counter()).items() if c}) if n else None
    assert served(planned, 1) == Counter((r["doc_id"], len(r["text"].split())) for r in out)


# licences


def test_licences(odd, none):
    s = licences.SENTENCES
    wrapped = "# " + s["mit-grant"].replace(", to", ",\n# to") + "\n\n" + s["mit-notice"] + "\n" + s["as-is"] + " " + s["no-liability"]
    assert licences.licences(wrapped) == (4, [("MIT", 0, len(wrapped))])
    text = "Some words.\nLicensed under CC BY-NC 4.0.\nmore words. Released under the MIT License."
    assert [x[0] for x in licences.licences(text)[1]] == ["CC-BY-NC-4.0", "MIT"]
    assert text[slice(*licences.licences(text)[1][0][1:])] == "Licensed under CC BY-NC 4.0."
    apart = s["bsd-grant"] + "\n" + "Word word.\n" * 5 + s["bsd-source"]
    assert licences.licences(apart) == (2, [])
    bsd = [s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]
    assert [x[0] for x in licences.licences("\n".join(bsd))[1]] == ["BSD-3-Clause"]
    assert [x[0] for x in licences.licences("\n".join(bsd[:3]))[1]] == ["BSD-2-Clause"]
    assert licences.licences("") == (0, []) and licences.licences("the licence of a " * 5000) == (0, [])
    assert licences.scan(odd).count() == len(ODD) and licences.scan(none).count() == 0


# pieces


@pytest.fixture(scope="module")
def model():
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    return SentencePieceProcessor(model_file=path), pieces.Vocabulary.load(path)


def test_pieces_equal_the_library(model):
    library, vocabulary = model
    encoder, decoder, rng = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary), random.Random(1)
    parts = [" ", "  ", "a", "the", "in", "ing", "\n", "\t", "é", "你", "▁", "_", "0", "9", "  \n", "s", "t", "er", "https://", "::", "😀", "\x00", "A", "//", "    ", "=", "<s>", "<0x41>", "Ver", "ung"]
    texts = ["", " ", "▁", "a" * 5000, " " * 3000, "ab" * 4000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        ids = library.encode(text)
        assert encoder.encode(text) == ids and decoder.decode(ids) == library.decode(ids)
    for _ in range(2000):
        ids = [rng.randrange(32_000) for _ in range(rng.randint(0, 12))]
        assert decoder.decode(ids) == library.decode(ids)


def test_pieces_frames(odd, none, model):
    library, vocabulary = model
    both = pieces.encode(odd, vocabulary, and_decode=True).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in both) == Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t, _ in ODD)
    again = pieces.decode(pieces.encode(odd, vocabulary), vocabulary).collect()
    assert Counter(map(str, again)) == Counter(map(str, both))
    assert pieces.encode(none, vocabulary).count() == 0


# top-k


def best(rows, k):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in ok)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = []
    for q, v in ok:
        if q % 20 == 0:
            ranked = sorted(((int(v @ w), i) for i, w in ok if i != q), key=lambda x: (-x[0], x[1]))[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 15, 3])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "QUERY_BLOCK", block)
    monkeypatch.setattr(top_k, "SHARD_ROWS", 70)
    monkeypatch.setattr(top_k, "BATCH_ROWS", 16)
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 24)]) for k in range(150)]
    rows += [(k, [0.25] * 24) for k in range(150, 190)]  # ties
    rows += [(191, None), (192, [float("nan")] * 24), (193, [None] * 24), (194, [float("inf")] * 24), (195, [0.5] * 3), (None, [0.5] * 24)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, rank int, terms string").repartition(3)
    want = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in top_k.search(df).collect()) == best(want, 20)
    assert top_k.search(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Scores are exact where sums of floating-point numbers, or 64-bit sums of bounds, wouldn't be."""
    rows = [(0, [2.0**25, 1.0]), (1, [2.0**25, 0.0]), (2, [2.0**23, 5.0]), (3, [-(2.0**25), 3.0]), (20, [1.5, 2.0**60]), (21, [2.0**51 + 0.5, -0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    floors = {i: [int(np.floor(64 * x)) if abs(x) < 2**52 else 64 * int(x) for x in v] for i, v in rows}
    exact = lambda q, i: sum(a * b for a, b in zip(floors[q], floors[i], strict=True))
    some = df.where("vec_id <> 20")
    got = [(r["vec_id"], r["score"]) for r in top_k.search(some.where("vec_id < 20")).orderBy("rank").collect()]
    assert got == sorted(((i, exact(0, i)) for i in (1, 2, 3)), key=lambda x: -x[1]) and got[0][1] == 4611686018427387904
    with pytest.raises(Exception, match="64 bits"):
        top_k.search(df).collect()


# personal data


def plain(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(d[-1::-2] + [sum(divmod(2 * v, 10)) for v in d[-2::-2]]) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda p: (p[0], pii.KINDS.index(p[2])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789 .-+@()aB%_\n٣é", max_size=80))
def test_base_spans(text):
    assert pii.base_matches(text)[0] == plain(text)


def test_base_spans_of_long_texts():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" * 50_000, "1." * 100_000, "@" * 100_000, "a.b@" * 50_000):
        pii.base_matches(text)


def test_cover():
    rng = random.Random(9)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 5)) for a in (rng.randrange(40) for _ in range(rng.randint(0, 6)))]
        cover = pii.Cover(spans)
        for a in range(40):
            b = a + rng.randint(1, 4)
            assert cover.meets(a, b) == any(x < b and a < y for x, y in spans)


def test_reconcile():
    whole, cut = (5, 15, "phone", 2.0, False, False), (8, 15, "phone", 3.0, True, False)
    assert pii.reconcile([whole, cut]) == [(5, 15, "phone")]
    assert pii.reconcile([(5, 20, "card", 1.0, False, True), (18, 30, "card", 1.5, True, False)]) == [(5, 30, "card")]
    assert pii.reconcile([(0, 4, "ip", 1.0, False, False), (2, 6, "phone", 5.0, False, False), (6, 9, "ip", 1.0, False, False)]) == [(2, 6, "phone"), (6, 9, "ip")]
    many = [(20 * k, 20 * k + 12, "phone", 1.0, False, False) for k in range(20_000)]
    assert len(pii.reconcile(many)) == 20_000


def test_network_gradients():
    s = pii.Settings(hidden=3, window=6)
    net = pii.Network.new(s)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, (4, 6)), rng.integers(0, len(pii.TAGS), (4, 6))
    _, grads = net.loss(x, y)
    for name in ("step", "first", "out", "ahead_own", "back_in"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-3
        up = net.loss(x, y)[0]
        net.p[name][at] = kept - 1e-3
        down = net.loss(x, y)[0]
        net.p[name][at] = kept
        assert (up - down) / 2e-3 == pytest.approx(float(grads[name][at]), rel=0.05, abs=1e-4)


def test_pii_end_to_end(spark, odd, none):
    filler = "and the words of a plain text that says nothing of anyone at all, as such texts do, for a while, "
    rows = [(1, filler * 3 + "call (559) 555-3817 now " + filler, "a"), (2, filler + "mail ana.lee@mail.example.com or +1 (559) 555-3817", "a"), (3, filler * 4, "a"), (4, None, "a"), (5, filler + "192.168.0.1 and 999.1.1.1", "a")]
    df = docs(spark, rows)
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(df, pii.train(df)).collect()}
    for i, t, _ in rows:
        assert [s for s in found[i] if not s[0].startswith("model_")] == [(k, a, b) for a, b, k in plain(t or "")]
    assert found[3] == [] and found[4] == []
    assert any(k == "model_phone" and rows[0][1][a:b].endswith("555-3817") for k, a, b in found[1])
    net = pii.train(none)
    assert pii.find(none, net).count() == 0 and pii.find(odd, net).count() == len(ODD)


# SimHash and components


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 400)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in components.label(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got.keys() == nodes
    classes, mine = defaultdict(set), defaultdict(set)
    for x in nodes:
        classes[find(x)].add(x)
        mine[got[x]].add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))
    assert components.label(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), seed=42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_groups(prints):
    n, root = len(prints), {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k in range(n):
        ids[find(k)].append(prints[k][0])
    return sorted(((prints[k][0], prints[k][1], least(ids[find(k)])) for k in range(n)), key=str)


def test_near_groups(spark, odd, none):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(300)) for _ in range(12)]
    rows = [(k, t, "a") for k, t in enumerate(base)]
    for k in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new"
        rows.append((100 + k, " ".join(words), "b"))
    rows += ODD
    got = simhash.near_groups(docs(spark, rows)).collect()
    want = brute_groups([(i, brute_fingerprint(t)) for i, t, _ in rows])
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=str) == want
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    assert simhash.drop_near_copies(odd).columns == odd.columns


def test_cells_of_many_fingerprints(spark):
    """One dense cell over many batches, and links at each distance."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(700)} | {rng.getrandbits(64) for _ in range(300)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").withColumn("node", F.col("fp"))
    roots = {r["node"]: r["root"] for r in components.label(simhash.links(df)).collect()}
    mine = defaultdict(set)
    for p in prints:
        s = p - (1 << 64) if p >> 63 else p
        mine[roots.get(s, s)].add(p)
    want = defaultdict(set)
    for i, p, c in brute_groups(list(enumerate(prints))):
        want[c].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_near_rule(spark):
    """Copies with a similarity of 0.9 or so of five-word shingles are found; unrelated texts of the same words aren't."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(250)] for _ in range(40)]
    rows = [(k, " ".join(t), "a") for k, t in enumerate(base)]
    for k in range(40):
        copy = list(base[k % 10])
        copy[rng.randrange(250)] = "changed"
        copy[rng.randrange(250)] = "anew"
        rows.append((100 + k, " ".join(copy), "a"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, rows), simhash.NEAR).collect()}
    assert got == {k: k if k < 100 else (k - 100) % 10 for k in got}
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows)).collect()) == list(range(40))
    with pytest.raises(ValueError):
        simhash.Rule(4, 6, 2)


def test_near_copies_of_one_id(spark):
    """Two unrelated texts share an id: what one's copy does leaves the other alone."""
    w, u = " ".join(f"w{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))
    rows = [(3, w + " more", "a"), (7, w, "a"), (7, u, "a"), (8, u + " more", "a"), (7, u, "a"), (None, w + " end", "a")]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs(spark, rows)).collect()) == [(3, w + " more"), (7, u), (7, u)]


@pytest.mark.parametrize("few", [0, 3, 100])
def test_near_squares(spark, monkeypatch, few):
    """Families that are dealt into many cells link as in one."""
    from test_near_similarity import brute_groups as brute

    monkeypatch.setattr(simhash, "_SIDE", 7)
    monkeypatch.setattr(simhash, "_SHINGLES", 2000)
    monkeypatch.setattr(simhash, "_FEW", few)
    rng, rows = random.Random(12), []
    for family in range(3):
        base = [f"w{family}x{k}" for k in range(100)]
        for k in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(100)] = f"v{rng.randrange(30)}"
            rows.append((100 * family + k, " ".join(words), "a"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, rows), simhash.NEAR).collect()}
    assert got == brute([(i, t) for i, t, _ in rows])


# toxicity


def test_toxicity(spark, odd, none):
    rng = random.Random(6)
    plain_words, bad = ["house", "river", "stone", "green", "walks", "bread", "women", "muslim"], ["idiot", "scum"]
    rows, marks = [], []
    for k in range(900):
        toxic = rng.random() < 0.25
        words = [rng.choice(plain_words) for _ in range(40)]
        if toxic:
            words[5:5] = [rng.choice(bad), "muslim"]
        rows.append((k, " ".join(words), "a"))
        marks.append((k, 1, int(toxic), "x"))
    df, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(df, labels)
    got = toxicity.judge(df, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [(r["predicted"], marks[r["doc_id"]][2]) for r in got if r["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    # neutral mentions score like each other
    scores = [model.score(f"the {who} of the river walks") for who in ("women", "men", "muslim", "christian", "house")]
    assert max(scores) < 0.5 and abs(scores[2] - scores[3]) < 0.05
    assert toxicity.drop_toxic(df, model).columns == df.columns
    assert toxicity.judge(odd, model).count() == len(ODD) and toxicity.judge(none, model).count() == 0
    assert toxicity.train(df, labels.limit(0)).score("idiot") < 0.01
    assert toxicity.train(df, labels.where("toxic = 1")).score("house") > 0.99
    repeated = labels.unionAll(spark.createDataFrame([(None, 1, 1, "x"), (3, 1, None, "x")], labels.schema)).unionAll(labels)
    assert toxicity.train(df, repeated) == model


def test_held_out_of_null(spark):
    assert spark.range(1).select(toxicity.held_out(F.lit(None).cast("long")).alias("x")).first()["x"] is False
