"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Each source is a queue of its documents in a shuffled order (by a digest of the id), offered again up to ``max_repeats``
times. A document's virtual finish time is the cumulative size in its queue divided by the source's target. All queues
are merged by a global range sort on finish time and truncated at the total budget; since every queue reaches time 1
when it has given its target, each source ends within a document or so of its target.

No source is ever one task's work: cumulative sizes are two-level sums. A source of n rows is cut into about sqrt(n)
buckets of its shuffled order; bucket sums are added up over the few buckets, and rows inside each bucket. Sources are a
table like any other, so they may be as many as web domains: their places, and the sums by which targets are shared, are
running sums over ranges of them. The driver sees a row for each partition of the schedule, the level to which sources
are filled, and the one row at which the budget runs out.

Targets: of the total, each source gets a share by weight, none above ``max_repeats`` times its size; what is cut off is
shared among the others. Filled in order of (top / weight, place), the first source whose top isn't reached gives the
level; a source gets the lesser of its top and weight times level.

Defined results: a null text has size 0; a null source is a source, the last in order; rows without words get nothing
(``taken`` and ``servings`` 0) and aren't queued; a source without words has target 0; of equal finish times the order
is by place of the source, repeat, digest of the id, size; an empty table gives an empty result; rows that repeat a
doc_id are queued each for itself, and where rows comes out (``mix_rows``) each as often as the plan says, so no more
words than the plan takes; which of several rows with one id, text and source that is, is left open; further columns
are neither read nor touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ordering import numbered, running

from . import shared


@dataclass(frozen=True)
class Policy:
    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    max_repeats: int = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(shared.text_or_empty(text), F.lit(f"[^{shared.SPACE}]+")).cast("long")


def targets(sizes: DataFrame, policy: Policy) -> tuple[DataFrame, float]:
    """``sizes`` (source, source_size, n) with source_ix, target and buckets, written down; the words that the mix takes."""
    weights = F.array(*(F.lit(w).cast("long") for w in policy.weights))
    placed = numbered(sizes.withColumn("last", F.col("source").isNull()), [F.col("last"), F.col("source")], "source_ix").drop("last")
    weight = F.element_at(weights, (F.col("source_ix") % len(policy.weights) + 1).cast("int"))
    weighed = shared.table(placed.withColumn("weight", weight).withColumn("top", policy.max_repeats * F.col("source_size")), "mix-sources")
    all_ = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"), F.sum("top").alias("top")).first()
    total = policy.budget * (all_["size"] or 0)
    by_fill = F.col("top").cast("double") / F.col("weight")
    level = None
    if total < (all_["top"] or 0):
        filled = running(weighed.select("source_ix", "top", "weight"), [by_fill, F.col("source_ix")], {"full": F.col("top"), "used": F.col("weight")})
        before, left = F.col("full") - F.col("top"), F.lit(all_["weight"]) - F.col("used") + F.col("weight")
        levels = filled.select(by_fill.alias("fill"), before.alias("before"), ((F.lit(total) - before) / left).alias("level"))
        level = levels.where("level <= fill").agg(F.min(F.struct("before", "level")).alias("first")).first()["first"]["level"]
    target = F.col("top").cast("double") if level is None else F.least(F.col("top").cast("double"), F.col("weight") * F.lit(level))
    buckets = F.greatest(F.ceil(F.sqrt("n")), F.lit(1)).cast("int")
    frame = shared.table(weighed.select("source", "source_ix", "source_size", target.alias("target"), buckets.alias("buckets")), "mix-targets")
    return frame, total if level is not None else float(min(total, all_["top"] or 0))


def _queues(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with ``reached``: the words its source's queue has given once this row is served for the first time."""
    place = F.conv(F.substring("ticket", 1, 13), 16, 10).cast("double") / float(16**13)
    rows = sized.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "text_key", "size", "ticket", "source_ix", "source_size", "target", F.floor(place * F.col("buckets")).cast("int").alias("bucket")
    )
    earlier = Window.partitionBy("source_ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source_ix", "bucket").agg(F.sum("size").alias("words")).select("source_ix", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_ix", "bucket").orderBy("ticket", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, ["source_ix", "bucket"]).withColumn("reached", F.col("before") + F.sum("size").over(inside)).drop("before", "bucket")


def _finish(epoch: Column) -> Column:
    return F.try_divide((F.col("reached") + epoch * F.col("source_size")).cast("double"), F.col("target"))  # null for rows without words alone


def _cut(queues: DataFrame, budget: float, policy: Policy) -> tuple | None:
    """The place in the merged schedule of the first serving that the budget doesn't cover; None if it covers all."""
    order = ["finish", "source_ix", "epoch", "ticket", "size"]
    served = queues.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(policy.max_repeats - 1)))).withColumn("finish", _finish(F.col("epoch"))).select(*order)
    schedule = shared.table(served.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-schedule")
    before, cut = 0, None
    for row in schedule.groupBy("part").agg(F.sum("size").alias("words")).orderBy("part").collect():  # a row for each shuffle partition
        if before + row["words"] > budget:
            so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            over = schedule.where(F.col("part") == row["part"]).withColumn("so_far", F.sum("size").over(so_far)).where(F.col("so_far") + before > budget)
            cut = tuple(over.orderBy(*order).select(*order).first())
            break
        before += row["words"]
    shared.forget(schedule)
    return cut


def _plan(docs: DataFrame, policy: Policy) -> DataFrame:
    """As ``mix``, with text_key, a hash of text and source."""
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")), F.coalesce(docs["source"], F.lit("")))
    sized = shared.table(
        docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"), key.alias("text_key"))
        .withColumn("ticket", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        "mix-sizes",
    )
    sources, budget = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), policy)
    queues = shared.table(_queues(sized, sources), "mix-queues")
    shared.forget(sized)
    cut = _cut(queues, budget, policy)

    def in_mix(epoch: int) -> Column:
        if cut is None:
            return F.lit(1)
        here = F.struct(_finish(F.lit(epoch)).alias("a"), F.col("source_ix").alias("b"), F.lit(epoch).alias("c"), F.col("ticket").alias("d"), F.col("size").alias("e"))
        there = F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(cut, ("double", "long", "int", "string", "long"), "abcde", strict=True)))
        return (here < there).cast("int")

    servings = F.when(F.col("size") > 0, sum((in_mix(e) for e in range(1, policy.max_repeats)), in_mix(0))).otherwise(F.lit(0))
    return queues.select("doc_id", "text_key", "size", "source_size", "target", (F.col("size") * servings).alias("taken"), servings.alias("servings"))


def mix(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """doc_id, size, source_size, target, taken (words), servings (how often the row is in the mix) for each row."""
    return _plan(docs, policy).drop("text_key")


def mix_rows(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` with all their columns, each as often as the mix serves it.

    Rows meet the plan by id, text and source. Of rows that repeat all three, those that the plan serves equally often
    need no telling apart; only where it doesn't are they numbered, in any order, and the first ones served more often.
    """
    most = policy.max_repeats
    counts = [F.count_if(F.col("servings") >= r).alias(f"at_least_{r}") for r in range(1, most + 1)]
    grouped = _plan(docs, policy).groupBy(F.col("doc_id").alias("mixed_id"), F.col("text_key").alias("mixed_key")).agg(F.count(F.lit(1)).alias("mixed_rows"), *counts)
    # written down, so that its size is known where the join with the texts is chosen
    plan = shared.table(grouped.where("at_least_1 > 0"), "mix-plan")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")), F.coalesce(docs["source"], F.lit("")))
    met = docs["doc_id"].eqNullSafe(plan["mixed_id"]) & (key == plan["mixed_key"])
    alike = F.forall(F.array(*(F.col(f"at_least_{r}") for r in range(1, most + 1))), lambda n: n.isin(0) | (n == F.col("mixed_rows")))
    columns = [docs[f"`{c}`"] for c in docs.columns]

    def repeated(df: DataFrame, n: Column) -> DataFrame:
        served = sum((F.col(f"at_least_{r}") >= n).cast("int") for r in range(1, most + 1))
        return df.withColumn("mixed_times", served).where("mixed_times > 0").withColumn("mixed_time", F.explode(F.sequence(F.lit(1), F.col("mixed_times"))))

    def own(df: DataFrame) -> DataFrame:
        return df.select("mixed_row.*")

    row = F.struct(*(c.alias(n) for c, n in zip(columns, docs.columns, strict=True))).alias("mixed_row")
    joined = docs.join(plan, met).select(row, *(plan[c] for c in plan.columns))
    same = own(repeated(joined.where(alike), F.lit(1)))
    different = plan.where(~alike)
    if different.isEmpty():
        return same
    number = F.row_number().over(Window.partitionBy("mixed_id", "mixed_key").orderBy("mixed_rows"))
    return same.unionByName(own(repeated(joined.where(~alike).withColumn("mixed_number", number), F.col("mixed_number"))))
