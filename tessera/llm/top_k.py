"""Exact top-k search by inner product, with MaxScore pruning over sharded postings.

A term is a component, its posting list the component's values over a shard. For a query, a term adds at least ``low``
and at most ``high`` to any score of the shard. Terms whose ranges together can't lift the shard's floor to the query's
k-th best score so far are non-essential: only the others are traversed for all rows; what stays competitive is probed
in the rest, the widest ranges first, and dropped as soon as its bound is too low. A batch whose bound is too low as a
whole is skipped.

Rows are dealt to shards and queries to blocks, both by a hash of the id. Each pair of a block and a shard is a cell of a
grid: a task reads the cell's queries, of which it holds one block, then goes through the cell's rows as a stream, and
hands on the k best for each query. The cells' lists are merged by rank. Nothing goes through the driver but two counts.

Scores are exact whatever the size of the components: in 32-bit or 64-bit floating point where every partial sum is a
whole number that it holds, else in 64-bit integers, else in integers without a bound. A score among the k best that
doesn't fit 64 bits is an error.

Defined results: rows whose vector is null, or holds a null or non-finite component, take no part; shorter vectors count
as ending in zeros; a row with a null id can't be found and asks nothing; rows that repeat an id are candidates each, are
never found for their own id, and ask once, with the largest of their vectors; ties go to the smaller id; an empty table
gives an empty result; further columns are neither read nor touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared
from .shared import tidy

#: Queries of a block, and rows of a shard, some more or less; rows that are compared at once; terms of a probe.
QUERY_BLOCK, SHARD_ROWS, BATCH_ROWS, PROBE_TERMS = 1 << 14, 1 << 22, 8192, 8
#: Where there are fewer rows, shards of at least so many, as long as there are tasks for them.
LEAST_ROWS = 8192


def terms(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the components, as doubles, of each row that takes part."""
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    doubles = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    return doubles.where(F.col("vec_id").isNotNull() & usable)


def floors(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """Rows of the floors of the scaled components, filled with zeros to ``width``, as 64-bit or unbounded integers."""
    sizes = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        rows = values.reshape(-1, width)
    else:
        rows, ends = np.zeros((len(sizes), width)), np.cumsum(sizes)
        for k, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            rows[k, :n] = values[end - n : end]
    if not rows.size or np.abs(rows).max() < 2.0**62 / scale:
        return np.floor(scale * rows).astype(np.int64)
    # from 2**52 on a double is a whole number
    whole = [int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(scale * x)) for x in rows.ravel().tolist()]
    return np.array(whole, object).reshape(rows.shape)


def wider(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.hstack([rows, np.zeros((len(rows), width - rows.shape[1]), rows.dtype)])


class Shards:
    """The k best rows for each query, over the batches of rows seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(ids):
            return
        width = max(rows.shape[1], self.queries.shape[1])
        rows, given = wider(rows, width), wider(self.queries, width)
        reach = sum(int(a) * int(b) for a, b in zip(abs(rows).max(0).tolist(), abs(given).max(0).tolist(), strict=True)) if len(given) else 0
        # sums are exact in it
        kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64 if reach < 2**61 else object
        whole = object if kind is object else np.int64
        rows, given = rows.astype(whole), given.astype(whole)
        top, bottom = rows.max(0), rows.min(0)
        postings = np.ascontiguousarray(rows.T).astype(kind)
        high = np.maximum(given * top, given * bottom)
        low = np.minimum(given * top, given * bottom)
        order = np.argsort(high - low, axis=1, kind="stable")
        gain = np.cumsum(np.take_along_axis(high - low, order, 1), axis=1)
        floor, queries = low.sum(1), given.astype(kind)
        for q in range(len(self.ids)):
            scores = self.best[q][1]
            full = len(scores) == self.k
            if full and floor[q] + (gain[q, -1] if gain.shape[1] else 0) < scores[-1]:
                continue
            spare = int(np.searchsorted(gain[q], scores[-1] - floor[q], "left")) if full else 0  # non-essential terms
            essential, rest = order[q, spare:], order[q, :spare]
            found = (queries[q, essential] @ postings[essential]).astype(whole) if len(essential) else np.zeros(len(ids), whole)
            chosen = np.flatnonzero(ids != self.ids[q])
            for end in range(spare, -1, -PROBE_TERMS):
                if full:
                    open_terms = rest[:end]
                    chosen = chosen[found[chosen] + high[q, open_terms].sum() >= scores[-1]]
                if not len(chosen) or not end:
                    break
                probe = rest[max(0, end - PROBE_TERMS) : end]
                found[chosen] += (queries[q, probe] @ postings[np.ix_(probe, chosen)]).astype(whole)
                if end <= PROBE_TERMS and full:
                    chosen = chosen[found[chosen] >= scores[-1]]
            if len(chosen):
                self._merge(q, ids[chosen], found[chosen])

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.best[q][0], ids]), np.concatenate([self.best[q][1], scores])
        if len(ids) > self.k and scores.dtype != object:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda n: (-scores[n], ids[n]))[: self.k])
        self.best[q] = ids[order], scores[order]

    def batches(self):
        """query_id, vec_id, score of all that was found; scores as decimals where they might not fit 64 bits."""
        for at in range(0, len(self.ids), 1024):
            best = self.best[at : at + 1024]
            counts = [len(x[0]) for x in best]
            scores = [int(s) for x in best for s in x[1].tolist()]
            columns = [pa.array(np.repeat(self.ids[at : at + 1024], counts), pa.int64()), pa.array(np.concatenate([x[0] for x in best]), pa.int64())]
            short = [s if -(1 << 63) <= s < 1 << 63 else None for s in scores]
            over = [None if s is not None else 1 if full > 0 else -1 for s, full in zip(short, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(short, pa.int64()), pa.array(over, pa.int32())], ["query_id", "vec_id", "score", "over"])


def _deal(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """cell, asks, vec_id, v: the queries and the rows of each cell of the grid, queries first."""
    n, asked = rows.count(), queries.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-asked // QUERY_BLOCK))
    shards = max(1, -(-n // SHARD_ROWS), min(tasks // blocks, -(-n // LEAST_ROWS)))

    def number(of: int, seed: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of))

    def all_of(of: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))

    asking = queries.withColumn("block", number(blocks, 1)).withColumn("shard", all_of(shards)).withColumn("asks", F.lit(True))
    found = rows.withColumn("shard", number(shards, 2)).withColumn("block", all_of(blocks)).withColumn("asks", F.lit(False))
    both = asking.unionByName(found).select((F.col("block") * shards + F.col("shard")).cast("int").alias("cell"), "asks", "vec_id", "v")
    cells = blocks * shards
    return both.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", F.desc("asks"))


def search(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    rows = terms(vectors)
    queries = shared.table(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v")), "top-k-queries")

    @tidy
    def search(batches):
        cell, asked, shards = None, [], None

        def ready() -> Shards:
            width = max((x.shape[1] for _, x in asked), default=1)
            return Shards(np.concatenate([x for x, _ in asked]), np.concatenate([wider(x, width) for _, x in asked]), k)

        for batch in batches:
            cells = batch.column(0).to_numpy()
            for at in np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])).tolist() if len(cells) else ():
                run = batch.slice(at, int(np.searchsorted(cells, cells[at], "right")) - at)
                if cells[at] != cell:
                    if shards:
                        yield from shards.batches()
                    cell, asked, shards = cells[at], [], None
                asks = int(np.count_nonzero(run.column(1).to_numpy(zero_copy_only=False)))
                for start, size in ((0, asks), *((s, min(BATCH_ROWS, run.num_rows - s)) for s in range(asks, run.num_rows, BATCH_ROWS))):
                    part = run.slice(start, size)
                    if not size:
                        continue
                    ids, column = part.column(2).to_numpy(), part.column(3)
                    values = floors(column, max(1, int(column.value_lengths().to_numpy().max())), scale)
                    if start < asks:
                        asked.append((ids, values))
                    elif asked:
                        shards = shards or ready()
                        shards.add(ids, values)
        if shards:
            yield from shards.batches()

    found = _deal(rows, queries).mapInArrow(search, "query_id long, vec_id long, score long, over int")
    # over: beyond 64 bits, upwards or downwards; such scores come first or last, and are an error among the k best
    order = [F.coalesce("over", F.lit(0)).desc(), F.desc("score"), F.col("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    score = F.when(F.col("over").isNull(), F.col("score")).otherwise(F.raise_error(F.lit("a score doesn't fit 64 bits")).cast("long"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
