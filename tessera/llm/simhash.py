"""Near-duplicate detection by SimHash and multi-index hashing, and by verified similarity of shingle sets.

``LINKS`` is the plain rule: shingles of 4 words, 4 bits. A document's fingerprint has a bit set where more than half of
its shingles' hashes have it. Two fingerprints link at ``distance`` or fewer differing bits. The fingerprint is cut into
segments; of a pair that links, one segment differs in 2 bits at most (5 bits over 2 segments, 11 over 4), so it is
enough to look up each segment's Hamming ball: the ball of radius 2 is met from both sides, each fingerprint being filed
in, and looked up in, the ball of radius 1 around its segment. All that a table cell holds is verified on the complete
distance.

``NEAR`` is the rule for a Jaccard similarity of 0.8 of the sets of five-word shingles. The fingerprints of ``LINKS`` and
their multi-index propose what is near in them. Other such pairs lie too far apart in a fingerprint of 64 bits for any
index of it, so bands of minima of the hashed shingles propose them too: a pair at
similarity s shares one of 30 bands of 5 with probability 1 - (1 - s^5)^30, wherever its differences stand; at 0.8 that
misses 7 in a million. Nothing links but on the similarity of its real sets. What bands connect, through however many
steps, is a family. In a family each is compared with each, in cells of bounded size: a cell counts shared shingles by
postings, and hands on only links that connect what wasn't connected, so no pair of sets leaves it; a family of up to
eight times a cell's side is dealt into squares. Larger families, which grow where passages are common, are compared by
band: the first of each band with all others, then, in bands that this hasn't connected, each with each, in squares. No
comparison that could connect anything is left out. Sets are made again from the texts of candidates, never written.

Only distinct fingerprints go into the tables, so copies cost one row. A cell is worked off as a stream, by one task and
without emitting pairs: a search takes one fingerprint after another, finds all that it links to among those not yet
reached, and emits for each group one link to its smallest member. A dense group of any size is reached in few steps.
What the cells emit goes through distributed connected components; no link is lost, and nothing is capped.

Defined results: a null text counts as empty; documents without words have fingerprint 0 and link like any other (under
a similarity: with each other alone); fewer words than a shingle has are one shingle; a null doc_id is larger than every
other; of a group, the documents that stay have the smallest doc_id and, of several texts with it, the smallest
fingerprint, so rows that repeat an id and a text stay or go together; repeated rows are copies of each other; an empty
table gives an empty result; further columns are neither read nor touched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, shared
from .shared import tidy

SEED = 42
_CAPITALS = bytes(range(65, 91))
_TO_SMALL = bytes.maketrans(_CAPITALS, _CAPITALS.lower())
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Shingles whose bits are counted at a time, documents of an output batch, and members of a cell that are compared at once.
_BLOCK, _ROWS, _AT_ONCE = 255 * 64, 2000, 512
#: Members on one side of a cell of sets; sides of a family that is compared as a whole.
_SIDE, _FEW = 2048, 8
#: Shingles of an output batch of sets.
_SHINGLES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Shingle length, differing bits and segments."""

    words: int
    distance: int
    segments: int

    def __post_init__(self):
        if self.segments not in (1, 2, 4) or not 0 <= self.distance < 3 * self.segments:
            raise ValueError("a segment may differ in 2 bits at most: 5 bits for 2 segments, 11 for 4")


@dataclass(frozen=True)
class Similar:
    """Shingle length and least Jaccard similarity in hundredths; bands, each of so many minima, that propose pairs."""

    words: int
    percent: int
    bands: int
    minima: int


LINKS = Rule(4, 4, 2)
NEAR = Similar(5, 80, 30, 5)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the highest on."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(len(hashes), 8), axis=1)
    even = len(bits) // 255 * 255  # sums of 255 bits fit a byte
    return bits[:even].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[even:].sum(0, dtype=np.uint8)


def _stirred(h: np.ndarray) -> np.ndarray:
    """Further 64 bits from each hash: fixed shifts and odd multipliers of a public finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a text, joined by single spaces, and where each starts and ends."""

    def __init__(self, text: str):
        found = _WORD.findall(text.encode().translate(_TO_SMALL))
        self.n, self.joined = len(found), b" ".join(found)
        self.ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1] + 1])

    def shingles(self, words: int) -> np.ndarray:
        """The set of the shingles' hashes, sorted; empty for a text without words."""
        from xxhash import xxh64_intdigest

        n, joined = max(1, self.n - words + 1) if self.n else 0, self.joined
        spans = zip(self.starts[:n].tolist(), self.ends[self.n - n :].tolist(), strict=True)
        return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n))

    def fingerprint(self, words: int) -> int:
        from xxhash import xxh64_intdigest

        if not self.n:
            return 0
        n, joined = max(1, self.n - words + 1), self.joined
        last = self.ends[self.n - n :]
        counts = np.zeros(64, np.int64)
        for at in range(0, n, _BLOCK):
            spans = zip(self.starts[at : min(n, at + _BLOCK)].tolist(), last[at : at + _BLOCK].tolist(), strict=True)
            counts += _set_bits(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))
        return int.from_bytes(np.packbits(2 * counts > n).tobytes())


def fingerprint(text: str, words: int = LINKS.words) -> int:
    return Words(text).fingerprint(words)


def _read(docs: DataFrame) -> DataFrame:
    """The id, the text, and a hash of the text that tells rows with one id apart."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), text_key(docs["text"]).alias("text_key"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, rule: Rule = LINKS) -> DataFrame:
    """doc_id, text_key, fp (as a signed long)."""

    @tidy
    def convert(batches):
        for batch in batches:
            prints = [Words(text.as_py() or "").fingerprint(rule.words) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "text_key", "fp"])

    return _read(docs).mapInArrow(convert, "doc_id long, text_key long, fp long")


def _roots(prints: np.ndarray, rule: Rule) -> np.ndarray:
    """For each of the fingerprints, the place of the first one that it is connected with."""
    n = len(prints)
    if n <= _AT_ONCE:
        near = np.bitwise_count(prints[:, None] ^ prints) <= rule.distance
        if np.count_nonzero(near) == n:
            return np.arange(n)
    root, waiting = np.empty(n, np.int64), np.arange(n)
    while len(waiting):
        first, waiting = waiting[0], waiting[1:]
        root[first], frontier = first, [first]
        while frontier and len(waiting):
            near = np.bitwise_count(prints[frontier.pop()] ^ prints[waiting]) <= rule.distance
            if near.any():
                root[waiting[near]] = first
                frontier += waiting[near].tolist()
                waiting = waiting[~near]
    return root


def _cell_links(cells: np.ndarray, prints: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal cells."""
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(starts, len(cells)))
    two = starts[sizes == 2]
    two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= rule.distance]
    left, right = [prints[two]], [prints[two + 1]]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        run = prints[start : start + size]
        root = _roots(run, rule)
        other = np.flatnonzero(root != np.arange(size))
        if len(other):
            left.append(run[root[other]])
            right.append(run[other])
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, rule: Rule = LINKS) -> DataFrame:
    """a, b: links by fingerprint that connect exactly what the rule's links among the distinct fingerprints (fp) connect."""
    width = 64 // rule.segments
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(width)))
    tables = []
    for s in range(rule.segments):
        part = F.shiftrightunsigned("fp", s * width) if s else F.col("fp")
        if width < 64:
            part = part.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        number = F.lit(s << width if width < 64 else 0).cast("long")
        tables.append(_filed(flips, part, number))
    filed = distinct.select(F.explode(F.concat(*tables)).alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")

    def emit(cells: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = _cell_links(cells, prints.view(np.uint64), rule)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    @tidy
    def search(batches):
        waiting: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if waiting[-1][0][0] == waiting[-1][0][-1]:
                continue  # one cell may fill many batches
            rest = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            cut = int(np.searchsorted(rest[0], rest[0][-1]))
            if cut:
                yield emit(*(x[:cut] for x in rest))
            waiting = [tuple(x[cut:] for x in rest)]
        if waiting:
            yield emit(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    return filed.mapInArrow(search, "a long, b long")


def _filed(flips, part, number):
    """The cells of a segment's table: its value, and its value with each bit flipped."""
    return F.transform(flips, lambda flip: part.bitwiseXOR(flip).bitwiseOR(number))


def _minima(shingles: np.ndarray, rule: Similar) -> np.ndarray:
    """The least of the hashed shingles under each of the rule's functions."""
    n = rule.bands * rule.minima
    masks, factors = _stirred(np.arange(1, 2 * n + 1, dtype=np.uint64)).reshape(2, n)
    least = np.full(n, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), _AT_ONCE):
        np.minimum(least, ((shingles[at : at + _AT_ONCE, None] ^ masks) * (factors | np.uint64(1))).min(0), out=least)
    return least


def _bands(least: np.ndarray, rule: Similar) -> list[int]:
    """A hash of each band's minima, as signed longs."""
    from xxhash import xxh64_intdigest

    bands = [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(rule.bands, -1))]
    return np.array(bands, np.uint64).view(np.int64).tolist()


def band_rows(docs: DataFrame, rule: Similar = NEAR) -> DataFrame:
    """doc_id, text_key, fp (a hash of the set of shingles, as a signed long), n (shingles), bands, and mark (the SimHash
    fingerprint of ``LINKS``)."""

    @tidy
    def convert(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            prints, sizes, bands, marks = [], [], [], []
            for text in batch.column(1):
                words = Words(text.as_py() or "")
                x = words.shingles(rule.words)
                marks.append(words.fingerprint(LINKS.words))
                prints.append(xxh64_intdigest(x.tobytes(), SEED))
                sizes.append(len(x))
                bands.append(_bands(_minima(x, rule), rule) if len(x) else [])
            columns = [batch.column(0), batch.column(2), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(marks, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fp", "n", "bands", "mark"])

    return _read(docs).mapInArrow(convert, "doc_id long, text_key long, fp long, n long, bands array<long>, mark long")


_PLACES = "array<struct<c:long,d:int,root:long,left:boolean,right:boolean>>"


def _with_sets(rows: DataFrame, rule: Similar) -> DataFrame:
    """fp, places and shingles (the set itself, as signed longs) of fp, text and places."""
    kind = pa.list_(pa.struct([("c", pa.int64()), ("d", pa.int32()), ("root", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_())]))

    def batch_of(prints, places, sets):
        offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        values = pa.array(np.concatenate(sets).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(places, kind), pa.ListArray.from_arrays(pa.array(offsets), values)], ["fp", "places", "shingles"])

    @tidy
    def convert(batches):
        for batch in batches:
            prints, places, sets, held = [], [], [], 0
            for fp, text, own in zip(*(batch.column(k) for k in range(3)), strict=True):
                prints.append(fp.as_py())
                places.append(own.as_py())
                sets.append(Words(text.as_py() or "").shingles(rule.words))
                held += len(sets[-1])
                if held >= _SHINGLES or len(sets) >= _ROWS:
                    yield batch_of(prints, places, sets)
                    prints, places, sets, held = [], [], [], 0
            if sets:
                yield batch_of(prints, places, sets)

    return rows.select("fp", "text", "places").mapInArrow(convert, f"fp long, places {_PLACES}, shingles array<long>")


class _Cell:
    """Sets of shingles, of which those on the left are to be compared with those on the right; ``roots``: what is known
    to be connected. A link is handed on only where it connects what wasn't."""

    def __init__(self, prints: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray]):
        self.prints, self.left, self.right, self.sets = prints, np.flatnonzero(left), np.flatnonzero(right), sets
        _, self.group = np.unique(roots, return_inverse=True)
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))

    def links(self, percent: int) -> tuple[list[int], list[int]]:
        """Pairs of places."""
        if not len(self.left) or not len(self.right):
            return [], []
        owner = np.repeat(self.right, self.sizes[self.right])
        shingles = np.concatenate([self.sets[k] for k in self.right])
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], owner[order]
        a, b = [], []
        for k in self.left.tolist():
            starts = np.searchsorted(shingles, self.sets[k], "left")
            counts = np.searchsorted(shingles, self.sets[k], "right") - starts
            at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            both = np.bincount(owner[at], minlength=len(self.sets))
            alike = (100 + percent) * both >= percent * (self.sizes[k] + self.sizes)
            for other in np.flatnonzero(alike & (both > 0) & (self.group != self.group[k])).tolist():
                if self.group[other] != self.group[k]:
                    self.group[self.group == self.group[other]] = self.group[k]
                    a.append(k)
                    b.append(other)
        return a, b


def _compared(cells: DataFrame, rule: Similar) -> DataFrame:
    """a, b: links by fp between the left and the right rows of each cell (c, d; of bounded size), of different roots."""

    def emit(cell: list[tuple]) -> pa.RecordBatch:
        prints, roots, left, right = (np.concatenate([part[k] for part in cell]) for k in range(4))
        a, b = _Cell(prints, roots, left, right, [x for part in cell for x in part[4]]).links(rule.percent)
        return pa.RecordBatch.from_arrays([pa.array(prints[a], pa.int64()), pa.array(prints[b], pa.int64())], ["a", "b"])

    @tidy
    def search(batches):
        now, cell = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            c, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            plain = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            ends, values = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy()
            borders = [0, *(np.flatnonzero((c[1:] != c[:-1]) | (d[1:] != d[:-1])) + 1).tolist(), len(c)]
            for start, end in zip(borders[:-1], borders[1:], strict=True):
                if (c[start], d[start]) != now:
                    if cell:
                        yield emit(cell)
                    now, cell = (c[start], d[start]), []
                cell.append((*(x[start:end] for x in plain), [values[ends[k] : ends[k + 1]].copy() for k in range(start, end)]))
        if cell:
            yield emit(cell)

    dealt = cells.select("c", "d", "fp", "root", "left", "right", "shingles").repartition("c", "d").sortWithinPartitions("c", "d")
    return shared.table(dealt.mapInArrow(search, "a long, b long").distinct(), "similar")


def _sides(df: DataFrame, key: str) -> DataFrame:
    """For each key, into how many parts its rows are dealt, so that a part has a bounded number of rows and shingles."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(_SIDE)), F.ceil(F.sum("n") / F.lit(_SHINGLES)))
    return df.groupBy(key).agg(parts.cast("int").alias("sides"))


def similar_links(distinct: DataFrame, docs: DataFrame, rule: Similar = NEAR) -> DataFrame:
    """a, b: links by fp that connect exactly what is similar enough among the sets that share a band, or
    whose fingerprints multi-index hashing connects.

    ``distinct``: fp, n (shingles), bands, mark, and rep, the (doc_id, text_key) of a row of ``docs`` that has the set.
    """

    def side() -> Column:
        return F.pmod(F.xxhash64("fp"), F.col("sides")).cast("int")

    def every() -> Column:
        return F.explode(F.sequence(F.lit(0), F.col("sides") - 1))

    def squares(df: DataFrame, key: str) -> DataFrame:
        """Of rows with a key, the number of its sides, fp and root: the cells in which each with each of a key meets once."""
        own = df.withColumn("side", side()).withColumn("other", every())
        square = F.least("side", "other") * F.col("sides") + F.greatest("side", "other")
        return own.select(F.col(key).alias("c"), square.alias("d"), "fp", "root", (F.col("side") <= F.col("other")).alias("left"), (F.col("side") >= F.col("other")).alias("right"))

    def compared(rows: DataFrame) -> DataFrame:
        """The links inside cells of rows c, d, fp, root, left, right. Each text meets its cells once, by id and text; its
        set is made there and then dealt to the cells, so sets are never written, and only those of candidates move."""
        places = rows.groupBy("fp").agg(F.collect_list(F.struct(*(F.col(k) for k in ("c", "d", "root", "left", "right")))).cast(_PLACES).alias("places"))
        asked = places.join(reps, "fp").select("fp", "id", "key", "places")
        met = texts.join(asked, texts["doc_id"].eqNullSafe(asked["id"]) & (texts["text_key"] == asked["key"]))
        # rows that repeat an id and a text come once; they are in one task already
        once = met.groupBy("doc_id", "text_key", "fp").agg(F.any_value("text").alias("text"), F.any_value("places").alias("places"))
        cells = _with_sets(once, rule).select("fp", F.explode("places").alias("at"), "shingles")
        return _compared(cells.select("at.*", "fp", "shingles"), rule)

    texts = _read(docs)
    # what multi-index hashing of the fingerprints connects is a band more; a fingerprint without neighbours is its own
    marks = components.label(links(distinct.where("n > 0").select(F.col("mark").alias("fp")).distinct()))
    near = distinct.where("n > 0").join(marks.withColumnRenamed("node", "mark"), "mark", "left")
    proposed = near.select(F.xxhash64(F.lit("mark"), F.coalesce("root", "mark")).alias("band"), "fp", "n")
    filed = distinct.select(F.explode("bands").alias("band"), "fp", "n").unionByName(proposed)
    # the first of a band is that with the least fp, which is a hash
    bands = filed.groupBy("band").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("members"))
    met = shared.table(bands.where("members > 1").select("band", "hub"), "bands")
    members = shared.table(filed.join(met, "band"), "members")
    star = shared.table(members.where("fp <> hub").select("hub", "fp", "n").distinct(), "star")
    shared.forget(met, marks)
    # families: what bands connect, through however many steps
    family = components.label(star.select(F.col("hub").alias("a"), F.col("fp").alias("b")))
    sized = shared.table(family.select(F.col("node").alias("fp"), F.col("root").alias("family")).join(distinct.select("fp", "n", "rep"), "fp"), "families")
    reps = sized.select("fp", F.col("rep.doc_id").alias("id"), F.col("rep.text_key").alias("key"))
    shared.forget(family)
    dealt = shared.table(_sides(sized, "family"), "sides")
    own = sized.join(dealt, "family").withColumn("root", F.col("fp"))
    found = compared(squares(own.where(F.col("sides") <= _FEW), "family"))
    large = shared.table(dealt.where(F.col("sides") > _FEW).select("family"), "large")
    if large.isEmpty():
        shared.forget(members, star, sized, dealt)
        return found

    # in families too large for that: the first of each band against all others
    within = sized.join(large, "family", "left_semi").select("fp")
    star = star.join(within, "fp", "left_semi")
    hubs = _sides(star, "hub")
    others = star.join(hubs, "hub").select(F.col("hub").alias("c"), side().alias("d"), "fp", F.lit(False).alias("left"))
    firsts = hubs.select(F.col("hub").alias("c"), every().alias("d"), F.col("hub").alias("fp"), F.lit(True).alias("left"))
    again = compared(others.unionByName(firsts).select("c", "d", "fp", F.col("fp").alias("root"), "left", (~F.col("left")).alias("right")))
    roots = components.label(again)
    # and of bands that this hasn't connected, all members of different components
    rest = members.join(within, "fp", "left_semi").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rest = shared.table(rest.select("band", "fp", "n", F.coalesce("root", "fp").alias("root")), "rest")
    apart = rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high and members > 2").select("band")
    open_ = shared.table(rest.join(apart, "band", "left_semi"), "open")
    more = compared(squares(open_.join(_sides(open_, "band"), "band"), "band"))
    shared.forget(members, sized, dealt, roots, rest, open_)
    return found.unionByName(again).unionByName(more)


def _groups(docs: DataFrame, rule: Rule | Similar) -> tuple[DataFrame, list[DataFrame]]:
    """As ``near_groups``, and the tables that it reads."""
    alike = isinstance(rule, Similar)
    prints = shared.table(band_rows(docs, rule) if alike else signatures(docs, rule), "fingerprints")
    once = [F.max("bands").alias("bands"), F.max("n").alias("n"), F.min("mark").alias("mark"), F.min(F.struct("doc_id", "text_key")).alias("rep")] if alike else []
    distinct = shared.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), *once), "distinct-fingerprints")
    roots = components.label(similar_links(distinct, docs, rule) if alike else links(distinct.select("fp"), rule))
    rooted = shared.table(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    # as a table of its own, so that both sides of the next join are dealt anew and a large group can be split
    first = F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "fp")).alias("first")
    named = shared.table(rooted.groupBy("root").agg(first).select("root", F.col("first.least").alias("component_id"), F.col("first.fp").alias("first_fp")), "named")
    grouped = shared.table(rooted.join(named, "root", "left").select("fp", "component_id", "first_fp"), "grouped")
    shared.forget(distinct, roots, rooted, named)
    stays = (F.col("fp") == F.col("first_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return prints.select("doc_id", "text_key", "fp").join(grouped, "fp").select("doc_id", "text_key", "fp", "component_id", stays.alias("stays")), [prints, grouped]


def near_groups(docs: DataFrame, rule: Rule | Similar = LINKS) -> DataFrame:
    """doc_id, text_key, fp, component_id (the smallest doc_id that can be reached) and stays for each row.

    One document of each group stays: of those with the smallest doc_id, the one with the smallest fp, and its repeats.
    """
    return _groups(docs, rule)[0]


def drop_near_copies(docs: DataFrame, rule: Rule | Similar = NEAR) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay of their groups."""
    groups, tables = _groups(docs, rule)
    # written down, so that its size is known: texts are shuffled only where it is too large to go to all of them
    gone = shared.table(groups.where(~F.col("stays")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "near-copies")
    shared.forget(*tables)
    met = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (text_key(docs["text"]) == gone["gone_key"])
    return docs.join(shared.small(gone), met, "left_anti")
