"""Exact deduplication by an extendible-hash index kept in shared files. DataFrame functions only.

A text's key is the 64-bit hash of its normalised form; equal texts are those whose bytes are equal, never those whose
hashes are. Two passes over the texts:

1. Hashes alone are counted. Counts by the first ``MAX_DEPTH`` bits drive the directory: it starts as one bucket, and
   doubles whenever a bucket of more than ``CAPACITY`` keys is as deep as the directory; only overfull buckets split.
   A bucket's keys are a contiguous range, and so are those of an owner, a task that takes the buckets, or parts of a
   bucket that can't be split further, of about ``OWNER_BYTES`` of text.
2. The directory routes each row by its slot to its owner, in one shuffle. The owner sorts its range by hash and bytes.
   Rows whose bytes are equal are a group; different texts with one hash are chained (``link`` 1, 2, ...) in the order
   of their bytes. The owners write the index: files of contiguous key ranges, in order of bucket and hash.

A hash that more than ``HOT_ROWS`` rows share doesn't go through the shuffle row by row: its texts are grouped by (hash,
bytes) with partial aggregation, one row a text and task, and only the narrow rows (id, hash, digest) meet these entries.
So a text that a third of the corpus repeats is nobody's single task.

Defined results: a null text counts as empty; empty texts form a group of their own; a null doc_id never wins against
another id; of rows with equal texts and the smallest id all stay, so rows that repeat a doc_id and a text stay or go
together, and so do rows without an id if their text has none with one; an empty table gives an empty result; further
columns are neither read nor touched, whatever their names.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

#: Keys of a bucket; bits of a hash that the directory can use at most (so many counts at most reach the driver).
CAPACITY, MAX_DEPTH = 256, 16
#: Rows of one hash beyond which they are aggregated before the shuffle.
HOT_ROWS = 4096
#: Text of an owner task: at most, and where there is little text, at least (as long as there are tasks enough).
OWNER_BYTES, LEAST_BYTES = 128 << 20, 4 << 20


@dataclass(frozen=True)
class Directory:
    """``slots[prefix]`` names the bucket of all hashes whose first ``depth`` bits are ``prefix``."""

    depth: int
    slots: tuple[int, ...]
    local_depth: tuple[int, ...]


def grow_directory(cells: dict[int, int], max_depth: int, capacity: int) -> Directory:
    """Double the directory until no bucket holds more than ``capacity`` keys; ``cells``: keys by their first ``max_depth`` bits."""
    filled = sorted(cells)
    before = [0, *accumulate(cells[p] for p in filled)]

    def keys(prefix: int, local: int) -> int:
        width = max_depth - local
        return before[bisect_left(filled, (prefix + 1) << width)] - before[bisect_left(filled, prefix << width)]

    depth, buckets = 0, [(0, 0)]  # a bucket is (its prefix, its local depth)
    while overfull := [b for b in buckets if b[1] < max_depth and keys(*b) > capacity]:
        depth = max(depth, 1 + max(local for _, local in overfull))
        split = set(overfull)
        buckets = [half for b in buckets for half in ([(2 * b[0], b[1] + 1), (2 * b[0] + 1, b[1] + 1)] if b in split else [b])]
    slots = tuple(k for k, (_, local) in enumerate(buckets) for _ in range(1 << (depth - local)))
    return Directory(depth, slots, tuple(local for _, local in buckets))


@dataclass(frozen=True)
class Routes:
    """The directory, and a row (prefix, bucket, first owner, owners) for each prefix of ``max_depth`` bits that is in use."""

    directory: Directory
    rows: list[tuple[int, int, int, int]]
    owners: int


def plan_routes(cells: dict[int, tuple[int, int]], max_depth: int, capacity: int, tasks: int) -> Routes:
    """``cells``: keys and bytes by prefix; ``tasks``: as many owners at least, if each has enough to do."""
    directory = grow_directory({p: n for p, (n, _) in cells.items()}, max_depth, capacity)
    total = sum(size for _, size in cells.values())
    room = min(OWNER_BYTES, max(LEAST_BYTES, total // max(1, tasks)))
    rows, owner, used = [], 0, 0
    for prefix in sorted(cells):
        size = cells[prefix][1]
        if used and used + size > room:
            owner, used = owner + 1, 0
        parts = max(1, -(-size // room))
        rows.append((prefix, directory.slots[prefix >> (max_depth - directory.depth)], owner, parts))
        owner, used = owner + parts - 1, used + size if parts == 1 else room
    return Routes(directory, rows, owner + 1)


def _key(text: Column, hash_bits: int) -> Column:
    h = F.xxhash64(text)
    return h if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def _digest(body: Column) -> Column:
    return F.sha2(body, 256)


@dataclass(frozen=True)
class _Pass:
    """What the first pass finds: the routes, the hot hashes (None: there are none), and the options."""

    routes: Routes
    hot: DataFrame | None
    hash_bits: int
    max_depth: int


def _count(keyed: DataFrame, capacity: int, max_depth: int, hash_bits: int, hot_rows: int) -> _Pass:
    spark = keyed.sparkSession
    hashes = shared.table(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body").cast("long")).alias("size")), "dedup-hashes")
    hot = shared.table(hashes.where(F.col("n") > hot_rows).select(F.col("h").alias("hot_h")), "dedup-hot")
    by_prefix = hashes.groupBy(_prefix(F.col("h"), max_depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n") <= hot_rows, F.col("size")).otherwise(0)).alias("size"))
    cells = {r["prefix"]: (r["n"], r["size"]) for r in by_prefix.collect()}  # 2**max_depth rows at most
    shared.forget(hashes)
    routes = plan_routes(cells, max_depth, capacity, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _Pass(routes, None if hot.isEmpty() else hot, hash_bits, max_depth)


def _owned(keyed: DataFrame, p: _Pass, unpacked: Column | None = None) -> DataFrame:
    """Rows that aren't hot, at their owners, with what the owners find: bucket, link, keep_id, group_size.

    ``unpacked``: the normalised text, once the row is there, where it has travelled in another form."""
    spark = keyed.sparkSession
    routes = spark.createDataFrame(p.routes.rows or [(0, 0, 0, 1)], "prefix int, bucket int, first int, parts int")
    cold = keyed if p.hot is None else keyed.join(p.hot, keyed["h"] == p.hot["hot_h"], "left_anti")
    routed = cold.withColumn("prefix", _prefix(F.col("h"), p.max_depth)).join(F.broadcast(routes), "prefix")  # 2**max_depth rows at most
    # of a bucket that has several owners, each has an equal part of the range of the next 16 bits
    part = F.floor(F.shiftrightunsigned(F.shiftleft("h", p.max_depth), 48) * F.col("parts") / F.lit(1 << 16)).cast("int")
    dealt = routed.withColumn("owner", F.col("first") + part).drop("prefix", "first", "parts").repartitionById(p.routes.owners, F.col("owner"))
    if unpacked is not None:
        dealt = dealt.withColumn("body", unpacked)
    equal = Window.partitionBy("owner", "h", "body")
    chain = Window.partitionBy("owner", "h").orderBy("body")
    found = dealt.withColumn("link", F.dense_rank().over(chain)).withColumn("keep_id", F.min("id").over(equal)).withColumn("group_size", F.count(F.lit(1)).over(equal))
    return found.drop("owner")


def _hot_entries(keyed: DataFrame, p: _Pass) -> DataFrame:
    """A row for each text of a hot hash: h, text_sha256, keep_id, group_size, bucket, link."""
    spark = keyed.sparkSession
    some = keyed.join(p.hot, keyed["h"] == p.hot["hot_h"], "left_semi")
    groups = some.groupBy("h", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    linked = groups.withColumn("link", F.dense_rank().over(Window.partitionBy("h").orderBy("body")))
    routes = spark.createDataFrame([r[:2] for r in p.routes.rows] or [(0, 0)], "prefix int, bucket int")
    placed = linked.withColumn("prefix", _prefix(F.col("h"), p.max_depth)).join(F.broadcast(routes), "prefix")
    return shared.table(placed.select("h", _digest(F.col("body")).alias("text_sha256"), "keep_id", "group_size", "bucket", "link"), "dedup-hot-entries")


_INDEX = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket", "link", "h")


def _index_rows(keyed: DataFrame, p: _Pass) -> DataFrame:
    def rows(df: DataFrame, digest: Column) -> DataFrame:
        return df.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), digest.alias("text_sha256"), "bucket", "link", "h")

    owned = rows(_owned(keyed, p), _digest(F.col("body"))).sortWithinPartitions("bucket", "h")
    if p.hot is None:
        return owned
    some = keyed.join(p.hot, keyed["h"] == p.hot["hot_h"], "left_semi").select("id", "h", _digest(F.col("body")).alias("digest"))
    entries = _hot_entries(keyed, p)
    met = some.join(entries.withColumnRenamed("h", "at"), (F.col("h") == F.col("at")) & (F.col("digest") == F.col("text_sha256")))
    return owned.unionByName(rows(met, F.col("digest")))


def build_index(docs: DataFrame, *, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, Directory]:
    """The index over ``docs`` as it is in the shared folder, and its directory, which lies beside it as JSON.

    A row for each document, in files of key ranges: doc_id, keep_id, group_size, kept, text_sha256, bucket, link, h.
    ``hash_bits`` under 64 makes collisions likely; the groups don't depend on it.
    """
    keyed = docs.select(docs["doc_id"].alias("id"), shared.single_spaced(docs["text"]).alias("body")).withColumn("h", _key(F.col("body"), hash_bits))
    found = _count(keyed, capacity, max_depth, hash_bits, hot_rows)
    rows = _index_rows(keyed, found)
    path = shared.scratch(docs.sparkSession, "dedup-index")
    rows.write.parquet(f"{path}/entries")
    directory = found.routes.directory
    told = json.dumps({"depth": directory.depth, "slots": directory.slots, "local_depth": directory.local_depth})
    docs.sparkSession.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{path}/directory")
    return docs.sparkSession.read.schema(rows.schema).parquet(f"{path}/entries"), directory


def look_up(spark: SparkSession, index: DataFrame, directory: Directory, text: str, hash_bits: int = 64) -> list[int]:
    """The ids of the documents in the index with this text: the directory names the bucket, and Parquet's minima and
    maxima skip the files and row groups that don't hold it."""
    body = shared.single_spaced(F.lit(text))
    asked = spark.range(1).select(_key(body, hash_bits).alias("h"), _digest(body).alias("digest")).first()
    bucket = directory.slots[(asked["h"] % (1 << 64)) >> (64 - directory.depth)]
    found = index.where((F.col("bucket") == bucket) & (F.col("h") == asked["h"]) & (F.col("text_sha256") == asked["digest"]))
    return sorted(r["doc_id"] for r in found.where("doc_id is not null").select("doc_id").collect())


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """Build the index of ``docs``: the group of each row, its bucket and its link."""
    return build_index(docs, **options)[0].drop("h")


def drop_copies(docs: DataFrame, *, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest among equal texts. Rows go to the
    owners whole, so nothing is joined back."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    wide = docs.select(row, docs["doc_id"].alias("id"), shared.single_spaced(docs["text"]).alias("body")).withColumn("h", _key(F.col("body"), hash_bits))
    found = _count(wide.select("h", "body"), capacity, max_depth, hash_bits, hot_rows)
    text = F.col("row.text")
    packed = wide.withColumn("body", F.when(F.col("body") == text, F.lit(None)).otherwise(F.col("body")))  # most texts are as they are when normalised
    kept = _owned(packed, found, F.coalesce("body", text)).where(F.col("id").eqNullSafe(F.col("keep_id"))).select("row")
    if found.hot is not None:
        some = wide.join(found.hot, wide["h"] == found.hot["hot_h"], "left_semi").withColumn("digest", _digest(F.col("body")))
        entries = _hot_entries(wide.select("id", "body", "h"), found).select(F.col("h").alias("at"), "text_sha256", "keep_id")
        hit = (F.col("h") == F.col("at")) & (F.col("digest") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("keep_id"))
        kept = kept.unionByName(some.join(entries, hit, "left_semi").select("row"))
    return kept.select("row.*")
