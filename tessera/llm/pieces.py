"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback, exactly as the library's.

Encoding doesn't merge: it searches for the one sequence of pieces in which every two neighbours stay apart when they
are merged again. An Aho-Corasick automaton finds the longest piece at a position, tried first; then come the pieces
that it starts with. A piece is taken if it is compatible with the one before it (the two, merged again, come out as
they are) and its end isn't marked as failed in the bitfield; where none fits, the position is marked and the
search steps back. No position is tried twice, so the work is linear.

No piece of the vocabulary holds a character other than the word mark before a word mark (checked on loading; else the
whole text is one unit), so no merge crosses the start of a word: each word is encoded by itself and kept in a bounded
cache. Characters without a piece become their UTF-8 bytes' pieces and can't be merged with anything.

Models that normalise text, drop white space, mark words elsewhere or hold user-defined pieces are refused on loading.

Defined results: a null or empty text has no ids, and no ids decode to an empty text; other cases have no exceptions;
repeated rows are encoded each; an empty table gives an empty result; further columns are neither read nor touched.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import tidy

MARK = "▁"
#: Words, and pairs of pieces, that a worker process remembers at most in each of two generations; the longest such word.
CACHED_WORDS, CACHED_PAIRS, CACHED_CHARS = 1 << 18, 1 << 17, 64
#: Bytes of text, or ids, that go into one output batch.
BATCH_SIZE = 4 << 20


@dataclass(frozen=True)
class Vocabulary:
    """What a model file holds: pieces and scores by id, the ids of the byte pieces, and the kinds that aren't text."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    control: frozenset[int]
    unknown: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        _refuse_unsupported(path)
        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        byte_ids = [k for k in ids if model.is_byte(k)]
        if len(byte_ids) != 256:
            raise ValueError("only models with byte fallback are supported")
        control = frozenset(k for k in ids if model.is_control(k) or model.is_unused(k))
        return cls(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), tuple(sorted(byte_ids, key=lambda k: int(model.id_to_piece(k)[3:-1], 16))), control, model.unk_id())


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def _refuse_unsupported(path: str) -> None:
    """Raise unless the model merges by score, takes text as it is but for one leading mark, and has plain pieces alone."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    # fixed values: field numbers of the public model format, and their defaults
    trainer, normaliser = (dict(_fields(next((v for k, v in parts if k == n), b""))) for n in (2, 3))
    wrong = {
        "not of merge type": trainer.get(3, 1) != 2, "marks after words": bool(trainer.get(24, 0)), "normalises": bool(normaliser.get(2, b"")), "no leading mark": not normaliser.get(3, 1),
        "removes white space": bool(normaliser.get(4, 1)), "keeps spaces": not normaliser.get(5, 1), "has user-defined pieces": any(dict(_fields(v)).get(3, 1) == 4 for k, v in parts if k == 1),
        "another sign for the unknown": trainer.get(44, " ⁇ ".encode()) != " ⁇ ".encode(),
    }
    if found := [what for what, so in wrong.items() if so]:
        raise ValueError(f"unsupported model: {', '.join(found)}")


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        v = self.vocabulary = vocabulary
        apart = {*v.byte_ids, *v.control, v.unknown}
        self.ids = {p: k for k, p in enumerate(v.pieces) if k not in apart}
        self.scores = {p: v.scores[k] for p, k in self.ids.items()}
        self.characters = {c for p in self.ids for c in p}
        if missing := self.characters - self.ids.keys():
            raise ValueError(f"characters without a piece of their own: {sorted(missing)[:5]}")
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: The longest piece that a piece starts with, other than itself.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) for p in self.ids}
        #: When a piece is made, by score; characters are there before. And the two pieces that make it; none for a
        #: character, and False for a piece that merging doesn't arrive at.
        self.turn = {p: -1.0 if len(p) == 1 else -score for p, score in self.scores.items()}
        self.halves = {p: None if len(p) == 1 else self._last_merge(p) for p in self.ids}
        self.apart = _Recent(lambda pair: self._stay_apart(*pair), CACHED_PAIRS)
        self.words = _Recent(lambda word: self.unit(MARK + word), CACHED_WORDS)

    def _best_merge(self, parts: list[str]) -> int | None:
        """Where the pair of neighbours with the highest score is, of those the leftmost."""
        best, at = None, None
        for k, pair in enumerate(pairwise(parts)):
            score = self.scores.get(pair[0] + pair[1])
            if score is not None and (best is None or score > best):
                best, at = score, k
        return at

    def _last_merge(self, piece: str) -> tuple[str, str] | bool:
        parts, last = list(piece), None
        while (at := self._best_merge(parts)) is not None:
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = ["".join(last)]
        return last if len(parts) == 1 else False

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether two neighbours, merged again from their characters, come out as they are; left may be empty.

        The merges on both sides are undone from the last one back. As long as the pieces that face each other at the
        border can't merge before what stands there was used up, no merge crosses the border.
        """
        if self.halves[right] is False or not left:
            return self.halves[right] is not False
        before = float("inf")
        while True:
            made = self.turn.get(left + right)
            if made is not None and made < before:
                return False
            if self.turn[left] > self.turn[right]:
                before, left = self.turn[left], self.halves[left][1]
            elif self.halves[right] is None:
                return True
            else:  # of equal merges the left one comes first
                before, right = self.turn[right] + 0.5, self.halves[right][0]

    def _longest(self, text: str, at: int) -> str:
        return next(self.automaton.iter_long(text, at))[1]

    def _search(self, text: str) -> list[str]:
        """The pieces of a text of which each character has a piece."""
        greedy = [piece for _, piece in self.automaton.iter_long(text)]
        apart, last, right = self.apart, "", 0
        for piece in greedy:
            if not apart[last, piece]:
                break
            last, right = piece, right + 1
        else:
            return greedy
        # up to here the search would have taken the longest pieces, too
        n, taken = len(text), greedy[:right]
        longest = dict(zip(accumulate(map(len, greedy), initial=0), greedy, strict=False))
        alive = bytearray(b"\x01") * (n + 1)
        at, piece = sum(map(len, taken)), self.shorter[piece]
        while True:
            while piece is not None:
                end = at + len(piece)
                if alive[end] and apart[last, piece]:
                    break
                piece = self.shorter[piece]
            if piece is not None:
                taken.append(piece)
                if end == n:
                    return taken
                last, at = piece, end
                piece = longest.get(at) or self._longest(text, at)
            else:
                alive[at] = 0
                taken.pop()
                at -= len(last)
                piece, last = self.shorter[last], taken[-1] if taken else ""

    def unit(self, text: str) -> bytes:
        """The ids of a unit, as the bytes of 32-bit integers."""
        if self.characters.issuperset(text):
            return array("i", map(self.ids.__getitem__, self._search(text))).tobytes()
        # a character without a piece merges with nothing: what stands between such characters is encoded by itself
        out = []
        for part in re.split(f"([{re.escape(''.join(sorted(set(text) - self.characters)))}])", text):
            if part[:1] == MARK and len(part) > 1:
                out.append(self.words[part[1:]])
            elif part and part[0] not in self.characters:
                out.append(array("i", map(self.vocabulary.byte_ids.__getitem__, part.encode())).tobytes())
            elif part:
                out.append(array("i", map(self.ids.__getitem__, self._search(part))).tobytes())
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.unit(MARK + text.replace(" ", MARK))
        words = text.split(" ")
        if MARK in text or "" in words:
            marked = MARK + text.replace(" ", MARK)
            words = [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", marked)]
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.bytes = [p.replace(MARK, " ").encode() for p in v.pieces]
        for k in v.control:
            self.bytes[k] = b""
        for byte, k in enumerate(v.byte_ids):
            self.bytes[k] = bytes([byte])
        self.bytes[v.unknown] = " ⁇ ".encode()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "one-mark-a-byte")
        first = next((k for k in ids if k not in self.vocabulary.control), None)
        return text[1:] if first is not None and self.vocabulary.pieces[first].startswith(MARK) else text


class _Recent(dict):
    """Results by key, of at least the last ``most`` keys and at most twice as many."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
            if len(key) > CACHED_CHARS:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


codecs.register_error("one-mark-a-byte", lambda e: ("\ufffd", e.start + 1))


@lru_cache(maxsize=1)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    """Kept in a worker process from task to task."""
    return Encoder(vocabulary)


@lru_cache(maxsize=1)
def _decoder(vocabulary: Vocabulary) -> Decoder:
    return Decoder(vocabulary)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text", and_decode: bool = False) -> DataFrame:
    """The id column and ``ids``, without begin or end ids; with ``and_decode`` also what the ids decode to, ``decoded``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary

    @tidy
    def convert(batches):
        encoder, decoder = _encoder(shared.value), _decoder(shared.value)
        for batch in batches:
            for a, b in _slices(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), BATCH_SIZE):
                coded = [encoder.encode_bytes(t or "") for t in batch.column(1).slice(a, b - a).to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in coded], dtype=np.int32)
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))]
                if and_decode:
                    columns.append(pa.array([decoder.decode(np.frombuffer(x, np.int32).tolist()) for x in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)
        encoder.words.older, encoder.apart.older = {}, {}  # an idle worker process keeps its memory

    names = [id_column, "ids", "decoded"][: 2 + and_decode]
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column], docs[text_column]).mapInArrow(convert, f"`{id_column}` {kind}, ids array<int>" + ", decoded string" * and_decode)


def decode(coded: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id") -> DataFrame:
    """The id column, ``ids`` and the text that they decode to, ``decoded``."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    @tidy
    def convert(batches):
        decoder = _decoder(shared.value)
        for batch in batches:
            for a, b in _slices(batch.column(1).value_lengths().fill_null(0).to_pylist(), BATCH_SIZE):
                part = batch.column(1).slice(a, b - a)
                texts = [decoder.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part, pa.array(texts, pa.string())], [id_column, "ids", "decoded"])

    kind = coded.schema[id_column].dataType.simpleString()
    return coded.select(id_column, "ids").mapInArrow(convert, f"`{id_column}` {kind}, ids array<int>, decoded string")
