"""Personal data: exact base patterns, and a character-level BiLSTM-CRF that adds what they miss.

The base kinds (email, ip, card, phone) are found by patterns and checks over the whole text, in linear time. A
bidirectional LSTM over characters with CRF transitions, trained in numpy, tags the same kinds in looser spellings. Its
labelled spans are the base spans in a bounded sample of documents (``Settings.sample_rows``) and spelling variants
written into passages of that sample by a seeded generator, beside numbers that are nothing personal. Texts are cut
into overlapping windows; every window with a digit or an ``@``, without which no labelled span exists, is decoded.
Spans of all windows of a document are reconciled together: fragments of a kind that meet are joined, pieces cut by a
window's edge give way to whole ones, and where spans overlap the surest stays. Base spans stay as they are. An added span never
overlaps one, nor what has its own kind's base form but failed the kind's check, nor cuts a word; as a card, its digits
must pass the check digit. Its kind is ``model_`` and the base kind.

Bounds of the fit, all in ``Settings``: documents (``sample_rows``), passages of a document (``snippets``, drawn by a
digest from all that hold a digit or an ``@``), base spans of a document that are shown as they stand (``shown``, drawn by
the seed), and generated windows (``generated``). Decoding has no bounds: it covers whole texts.

Defined results: a null or empty text has no spans; without a digit or ``@`` anywhere in the sample the model is trained
on the generator's spans alone; repeated rows get equal spans; an empty table gives an empty result; positions are code
points, ends exclusive; further columns are neither read nor touched.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import tidy

KINDS = ("email", "ip", "card", "phone")
TRIGGER = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def _emails(text: str) -> list[tuple[int, int]]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return found


def _luhn(digits: list[int]) -> bool:
    return not (sum(digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])) % 10


def base_matches(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans by (start, kind as listed), and what has a kind's form but the wrong numbers (parts of an ip, check digit of a card)."""
    if not TRIGGER.search(text):
        return [], []
    found: tuple[list[Span], list[Span]] = ([], [])
    for start, end in _emails(text):
        found[0].append((start, end, "email"))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            if kind == "ip":
                good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
            else:
                digits = [int(c) for c in m[0] if "0" <= c <= "9"]
                good = 14 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 10 <= len(digits) <= 15
            if good or kind == "ip" or kind == "card" and 14 <= len(digits) <= 19:
                found[not good].append((m.start(), m.end(), kind))
    for spans in found:
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


# the network

_SIGNS = "\n\t @._%+-()/:,;#*&$\"'=<>[]{}|\\!?~^`"
_CODES = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz" + "0123456789" + _SIGNS, 3)}
SYMBOLS = 3 + len(_CODES)
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def codes(text: str) -> list[int]:
    """0 beyond the text, 1 other letters, 2 other characters."""
    get = _CODES.get
    return [get(c) or (1 if c.isalpha() else 2) for c in text.lower()] if len(text.lower()) == len(text) else [get(c.lower()) or (1 if c.isalpha() else 2) for c in text]


@dataclass(frozen=True)
class Settings:
    """Size of the network, its windows, how it is fitted, and to how much at most (see the module)."""

    hidden: int = 14
    window: int = 96
    overlap: int = 48
    epochs: int = 7
    batch: int = 48
    rate: float = 0.02
    sample_rows: int = 300
    snippets: int = 8
    shown: int = 4
    generated: int = 1800
    seed: int = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Network:
    """Parameters by name; windows are rows of ``window`` codes."""

    def __init__(self, parameters: dict[str, np.ndarray], window: int):
        self.p, self.window = parameters, window

    @classmethod
    def new(cls, s: Settings) -> Network:
        rng, h, k = np.random.default_rng(s.seed), s.hidden, len(TAGS)
        p = {"out": rng.normal(0, 0.2, (2 * h, k)), "out_bias": np.zeros(k), "step": np.zeros((k, k)), "first": np.zeros(k)}
        for way in ("ahead", "back"):
            p[f"{way}_in"] = rng.normal(0, 0.2, (SYMBOLS, 4 * h))
            p[f"{way}_own"] = rng.normal(0, 0.2, (h, 4 * h))
            p[f"{way}_bias"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        return cls({n: v.astype(np.float32) for n, v in p.items()}, s.window)

    def _pass(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        own, given = self.p[f"{way}_own"], (self.p[f"{way}_in"] + self.p[f"{way}_bias"])[x]
        size = own.shape[0]
        h = c = np.zeros((x.shape[0], size), np.float32)
        out, saved = np.empty((x.shape[1], x.shape[0], size), np.float32), []
        for t in range(x.shape[1]) if way == "ahead" else range(x.shape[1] - 1, -1, -1):
            z = given[:, t] + h @ own
            gates, new = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            before_h, before_c = h, c
            c = f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep:
                saved.append((t, i, f, o, new, squashed, before_h, before_c))
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        ahead, a = self._pass(x, "ahead", keep)
        back, b = self._pass(x, "back", keep)
        both = np.concatenate([ahead, back], axis=2)
        return both @ self.p["out"] + self.p["out_bias"], both, a, b

    def _unroll(self, x: np.ndarray, way: str, saved: list, d_out: np.ndarray, grads: dict) -> None:
        own = self.p[f"{way}_own"]
        size = own.shape[0]
        d_in, d_own = np.zeros_like(self.p[f"{way}_in"]), np.zeros_like(own)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t, i, f, o, new, squashed, before_h, before_c in reversed(saved):
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before_c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
            np.add.at(d_in, x[:, t], dz)
            d_own += before_h.T @ dz
            dh, dc = dz @ own.T, dc * f
        grads[f"{way}_in"], grads[f"{way}_own"], grads[f"{way}_bias"] = d_in, d_own, d_in.sum(0)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the tags ``y``, and its gradients."""
        e, both, a, b = self.emissions(x, keep=True)
        step, first = self.p["step"], self.p["first"]
        n, length, k = len(x), x.shape[1], len(TAGS)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + first
        for t in range(1, length):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + step, 1) + e[t]
        for t in range(length - 2, -1, -1):
            beta[t] = _log_sum(step + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _log_sum(alpha[-1], 1)
        d_e = np.exp(alpha + beta - total[None, :, None])
        pairs = np.exp(alpha[:-1][:, :, :, None] + step + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]).sum((0, 1))
        rows = np.arange(n)
        gold = first[y[:, 0]] + sum(e[t, rows, y[:, t]] for t in range(length)) + step[y[:, :-1], y[:, 1:]].sum(1)
        for t in range(length):
            d_e[t, rows, y[:, t]] -= 1
        np.subtract.at(pairs, (y[:, :-1], y[:, 1:]), 1)
        grads = {"first": d_e[0].sum(0) / n, "step": pairs / n}
        d_e /= n
        grads["out"] = both.reshape(-1, both.shape[2]).T @ d_e.reshape(-1, k)
        grads["out_bias"] = d_e.sum((0, 1))
        d_both = d_e @ self.p["out"].T
        half = d_both.shape[2] // 2
        self._unroll(x, "ahead", a, d_both[:, :, :half], grads)
        self._unroll(x, "back", b, d_both[:, :, half:], grads)
        return float((total - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        mean = {n: np.zeros_like(v) for n, v in self.p.items()}
        square = {n: np.zeros_like(v) for n, v in self.p.items()}
        turn = 0
        for epoch in range(s.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), s.batch):
                chosen = order[at : at + s.batch]
                _, grads = self.loss(x[chosen], y[chosen])
                norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
                turn += 1
                for n, g in grads.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    mean[n] = 0.9 * mean[n] + 0.1 * g
                    square[n] = 0.99 * square[n] + 0.01 * g**2
                    rate = s.rate * (1 - epoch / s.epochs)
                    self.p[n] = (self.p[n] - rate * mean[n] / (1 - 0.9**turn) / (np.sqrt(square[n] / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window, and by how much each beats having no span there."""
        e = self.emissions(x)[0]
        best, came = e[0] + self.p["first"], np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            ways = best[:, :, None] + self.p["step"]
            came[t] = ways.argmax(1)
            best = ways.max(1) + e[t]
        tags = np.empty((len(x), len(e)), np.int8)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(len(x))
        for t in range(len(e) - 1, 0, -1):
            tags[:, t - 1] = came[t, rows, tags[:, t]]
        margin = np.take_along_axis(e.transpose(1, 0, 2), tags[:, :, None].astype(int), 2)[:, :, 0] - e[:, :, 0].T
        return tags, margin


# windows


def windows(text: str, s: Settings) -> list[int]:
    """Where windows with a trigger start; together with those without one they cover the text."""
    stride = s.window - s.overlap
    last = max(0, -(-(len(text) - s.window) // stride)) * stride
    starts: set[int] = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // stride * stride
        starts.update(a for a in range(k, k - s.window, -stride) if 0 <= a <= last and a <= m.start() < a + s.window)
    return sorted(starts)


def _tagged(tags: np.ndarray, margin: np.ndarray, start: int, size: int) -> list[tuple[int, int, str, float, bool, bool]]:
    """Spans of a window: start, end, kind, surety, whether each side is cut by the window's edge."""
    found, t = [], 0
    size = min(size, len(tags))
    while t < size:
        tag = int(tags[t])
        if not tag:
            t += 1
            continue
        kind, end = (tag - 1) // 2, t + 1
        while end < size and int(tags[end]) == 2 * kind + 2:
            end += 1
        found.append((start + t, start + end, KINDS[kind], float(margin[t:end].mean()), t == 0 and start > 0, end == len(tags)))
        t = end
    return found


class Cover:
    """Spans without overlaps, in order; each question takes a binary search."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.starts and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.ends, a + 1)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        """A span that meets none."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def reconcile(pieces: list[tuple[int, int, str, float, bool, bool]]) -> list[Span]:
    """One set of spans without overlaps from the spans of all windows."""
    pieces = sorted(set(pieces))
    whole = [p for p in pieces if not (p[4] or p[5])]
    reach: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}  # starts, and how far any span up to there goes
    for a, b, kind, *_ in whole:
        starts, ends = reach[kind]
        starts.append(a)
        ends.append(max(b, ends[-1]) if ends else b)

    def held(a: int, b: int, kind: str) -> bool:
        k = bisect_right(reach[kind][0], a)
        return k > 0 and reach[kind][1][k - 1] >= b

    joined: list[tuple[int, int, str, float]] = []
    for a, b, kind, sure, *_ in (p for p in pieces if (p[4] or p[5]) and not held(*p[:3])):
        if joined and joined[-1][2] == kind and a <= joined[-1][1]:
            x = joined[-1]
            joined[-1] = (x[0], max(b, x[1]), kind, max(sure, x[3]))
        else:
            joined.append((a, b, kind, sure))
    cover, taken = Cover(), []
    for a, b, kind, _ in sorted([*((*p[:4],) for p in whole), *joined], key=lambda p: (-p[3], p)):
        if not cover.meets(a, b):
            cover.add(a, b)
            taken.append((a, b, kind))
    return sorted(taken)


def plausible(text: str, kind: str) -> bool:
    """An added span must hold what its kind can't be without."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return "@" in text and "." in text and text[-1].isalnum()
    if kind == "card" and not _luhn([int(c) for c in text if "0" <= c <= "9"]):
        return False
    return {"ip": 4, "card": 13, "phone": 9}[kind] <= digits <= {"ip": 12, "card": 19, "phone": 15}[kind] and not any(c.isalpha() for c in text)


def all_spans(text: str, network: Network, s: Settings) -> list[Span]:
    """Base spans and added ones, by start, then kind."""
    good, failed = base_matches(text)
    starts = windows(text, s)
    pieces = []
    for at in range(0, len(starts), 256):
        some = starts[at : at + 256]
        x = np.zeros((len(some), s.window), np.int64)
        for row, a in zip(x, some, strict=True):
            part = codes(text[a : a + s.window])
            row[: len(part)] = part
        for a, tags, margin in zip(some, *network.decode(x), strict=True):
            pieces += _tagged(tags, margin, a, len(text) - a)
    taken = {kind: Cover([(a, b) for a, b, _ in good] + [(a, b) for a, b, k in failed if k == kind]) for kind in KINDS} if pieces else {}
    apart = lambda a, b: not (a and text[a - 1].isalnum()) and not text[b : b + 1].isalnum()  # noqa: E731  not a part of a longer word
    added = [(a, b, f"model_{k}") for a, b, k in reconcile(pieces) if apart(a, b) and not taken[k].meets(a, b) and plausible(text[a:b], k)]
    order = (*KINDS, *(f"model_{k}" for k in KINDS))
    return sorted([*good, *added], key=lambda p: (p[0], order.index(p[2])))


# labelled spans


def _variant(rng: random.Random) -> tuple[str, str | None]:
    """A number or address in one of many spellings, and its kind; None: nothing personal."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    host = "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8))) + rng.choice([".com", ".org", ".example.com", ".net"])
    sep = rng.choice(["-", " ", "."])
    match rng.randrange(14):
        case 0:
            return f"{name} @ {host}", "email"
        case 1:
            return f"{name}.{d(2)}@{host}", "email"
        case 2:
            return f"{name}(@){host}", "email"
        case 3:
            return f"({d(3)}) {d(3)}-{d(4)}", "phone"
        case 4:
            return sep.join([d(3), d(3), d(4)]), "phone"
        case 5:
            return f"00{d(2)} {d(3)} {d(3)} {d(3)}", "phone"
        case 6:
            return f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", "phone"
        case 7:
            return " . ".join(str(rng.randint(1, 255)) for _ in range(4)), "ip"
        case 8:
            return ".".join(str(rng.randint(1, 255)) for _ in range(4)), "ip"
        case 9:
            digits = [int(c) for c in d(15)]
            odd, even = sum(digits[-2::-2]), sum(2 * c - 9 * (c > 4) for c in digits[::-2])
            number = "".join(map(str, digits)) + str(-(odd + even) % 10)
            return rng.choice([".", "/", "_", " / "]).join(number[k : k + 4] for k in range(0, 16, 4)), "card"
        case 10:
            return rng.choice([f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"1{d(1)}.0{rng.randint(1, 9)}.19{d(2)}", f"{d(2)}:{d(2)}:{d(2)}"]), None
        case 11:
            return rng.choice([f"{d(1)},{d(3)}.{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}", d(rng.randint(1, 8)), f"{d(2)}%", f"${d(3)}"]), None
        case 12:
            return "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40))), None
        case _:
            return rng.choice([f"@{name}", f"page {d(2)}", f"{name}{d(2)}", f"#{d(4)}", f"{d(2)} {name} {d(3)}"]), None


def labelled(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags: around the base spans of the texts, and with variants written into passages of them."""
    rng = random.Random(s.seed)
    made: list[tuple[str, list[Span]]] = []
    for text in texts:
        good, failed = base_matches(text)
        for a, b, _ in rng.sample(good, min(len(good), s.shown)):
            at = max(0, a - rng.randint(5, 40))
            if b - at <= s.window and not any(x < at + s.window and y > at for x, y, _ in failed):
                made.append((text[at : at + s.window], [(x - at, y - at, k) for x, y, k in good if x >= at and y <= at + s.window]))
    passages = [t for t in texts if len(t) > 2 * s.window] or ["the and of to in is it on as by " * 8]
    for _ in range(s.generated):
        parts, spans = [], []
        room = s.window
        while room > 25:
            t = rng.choice(passages)
            at = rng.randrange(len(t) - s.window)
            filler = re.sub("[0-9@+]", "", t[at : at + rng.randint(4, 40)]).split(" ", 1)[-1].strip() + rng.choice([" ", " ", "\n", ": "])
            text, kind = _variant(rng)
            start = s.window - room + len(filler)
            parts.append(filler + text + rng.choice([" ", " ", ". ", ", ", "\n"]))
            if kind:
                spans.append((start, start + len(text), kind))
            room -= len(parts[-1])
        made.append(("".join(parts)[: s.window], [p for p in spans if p[1] <= s.window]))
        for a, b, k in spans:
            if a < s.window < b:
                made[-1][1].append((a, s.window, k))
    x, y = np.zeros((len(made), s.window), np.int64), np.zeros((len(made), s.window), np.int64)
    for row, tags, (text, spans) in zip(x, y, made, strict=True):
        row[: len(text)] = codes(text)
        for a, b, kind in spans:
            tags[a:b] = 2 * KINDS.index(kind) + 2
            tags[a] -= 1
    return x, y


def train(docs: DataFrame, s: Settings = Settings()) -> Network:  # noqa: B008
    """A network fitted on the driver to spans labelled in at most ``s.sample_rows`` documents with a digit or ``@``."""
    able = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    chosen = able.select(F.col("doc_id").alias("chosen")).distinct().orderBy(F.md5(F.col("chosen").cast("string"))).limit(s.sample_rows)
    near = F.regexp_extract_all("text", F.lit(r"[^0-9@]{0,100}[0-9@][\s\S]{0,200}"), F.lit(0))
    drawn = F.slice(F.array_sort(F.transform(near, lambda x: F.struct(F.xxhash64(x, F.lit(s.seed)).alias("at"), x.alias("x")))), 1, s.snippets)
    found = able.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("doc_id", F.array_join(F.transform(drawn, lambda d: d["x"]), "\n").alias("text")).toArrow()  # sample_rows rows of snippets
    texts = sorted(set(found.column("text").to_pylist()))
    network = Network.new(s)
    network.fit(*labelled(texts, s), s)
    return network


def find(docs: DataFrame, network: Network, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, spans (kind, start, end) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((network.p, network.window))  # some thousand numbers

    @tidy
    def convert(batches):
        own = Network(*shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in all_spans(t or "", own, s)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(convert, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")
