"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, as often as it may be repeated. A document's
virtual finish time is the tokens its source has sent up to its end, divided by the source's target.
All copies are sorted by finish time and the queue is cut where the budget is spent, so at every
point of the queue each source has sent nearly the same part of its target.

The order is global: a range exchange and sums of its parts take the place of one task's window, so
a source with most of the rows is spread like any other. Equal rows may be told apart only by where
they were read; their results are interchangeable.

Null texts have size 0, null sources are one source that sorts last, null doc_ids are ordinary ids,
an empty table gives an empty result, and extra columns are carried along into the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, aside, before_each_part, beside, content_key, globally_ordered, numbered, stored

#: How often a document may be taken at most.
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating by the rank of the source, from 0."""
    return (rank % 3 + 1).cast("double")


def targets(sized: DataFrame, source: str = "source", size: str = "size", weight=cyclic_weights, repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: source_size and target. Targets share the sum of all sizes by weight; none is above
    `repeats` times its source's size, and what that cuts off is shared again among the others.

    In order of the level at which a source is full, the sources before the first that isn't filled
    by an equal share of what is left are full, all others get that share. Ranks and sums come from
    global orders, so no task sees all sources. One row per source.
    """
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    ranked = numbered(per, F.col("source").asc_nulls_last(), name="rank")
    ranked = ranked.withColumn("weight", weight(F.col("rank"))).withColumn("cap", F.col("source_size") * repeats)
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    line = globally_ordered(ranked, "full_at", "rank")
    starts = before_each_part(line, ("caps", F.col("cap")), ("weights", F.col("weight")))
    so_far = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the exchange: the bound of this broadcast
    line = line.join(F.broadcast(starts), "_part")
    before = {c: F.col(c + "s") + F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in ("cap", "weight")}
    level = (F.lit(total[0]) - before["cap"]) / (F.lit(total[1]) - before["weight"])
    share = line.withColumn("level", level).where("level <= full_at").agg(F.min(F.struct("full_at", "rank", "level"))["level"]).first()[0]
    return ranked.select(F.col("source").alias(source), "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.lit(share).cast("double"), F.col("full_at")) * F.col("weight")).alias("target"))


def queue_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """Per row doc_id, source, size, key and order, which shuffles a source's rows; texts aren't needed after this.

    key is the same for rows that are equal in all columns (but maps, which can't be hashed).
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order.alias("order"), content_key(docs).alias("key"))


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weight=cyclic_weights, repeats: int = MAX_REPEATS) -> DataFrame:
    """Per row of `docs` doc_id, source, size, key, source_size, target, copies and taken (words that the mix takes of this row)."""
    scratch = Scratch(docs.sparkSession)
    # texts are read once: the range exchange looks at its input twice
    rows = scratch.table("sizes", queue_of(docs, text_col, id_col, source_col))
    queue = globally_ordered(rows, F.col("source").asc_nulls_last(), "order", "doc_id", keep=lambda df: scratch.table("queue", df.drop("order"))).withColumnsRenamed({"_part": "p", "_at": "a"})
    scratch.drop("sizes")
    # cumulative tokens of the source: its earlier parts, then its rows in this part
    parts = queue.groupBy("p", "source").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_source = targets(queue, "source", "size", weight, repeats)
    plan = parts.alias("a").join(per_source.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("p", F.col("a.source").alias("s"), "start", "source_size", "target")
    timed = queue.alias("q").join(plan.alias("t"), (F.col("q.p") == F.col("t.p")) & F.col("q.source").eqNullSafe(F.col("s"))).select("q.*", "start", "source_size", "target")
    timed = timed.withColumn("sent", F.col("start") + F.sum("size").over(Window.partitionBy("p", "source").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)))
    timed = scratch.table("timed", timed.drop("start"))
    finish = lambda e: (F.col("sent") + F.col("source_size") * e) / F.col("target")
    copies = timed.where("target > 0").select("p", "a", "size", F.explode(F.array(*[finish(e) for e in range(repeats)])).alias("finish"))
    line = globally_ordered(copies, "finish", "p", "a")
    starts = before_each_part(line, ("start", F.col("size")))
    # one row per partition of the exchange: the bound of this broadcast
    running = line.join(F.broadcast(starts), "_part").withColumn("sum", F.col("start") + F.sum("size").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    budget = timed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    last = running.where(F.col("sum") <= budget).agg(F.max(F.struct("finish", "p", "a"))).first()[0]
    if last is None:
        taken = F.lit(0)
    else:
        bound = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["p"]).cast("long").alias("p"), F.lit(last["a"]).cast("long").alias("a"))
        taken = sum(F.when((F.col("target") > 0) & (F.struct(finish(e).alias("finish"), F.col("p").cast("long").alias("p"), F.col("a").cast("long").alias("a")) <= bound), 1).otherwise(0) for e in range(repeats))
    out = timed.withColumn("copies", taken.cast("int"))
    return out.select("doc_id", "source", "size", "key", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def expanded(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken. Texts meet the decisions once, by key."""
    taken = mixed(docs, text_col, id_col, source_col, **how).groupBy("doc_id", "key").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
    taken = stored(taken.where("copies > 0"))
    rows = aside(docs, id=F.col(id_col), key=content_key(docs))

    def met(some: DataFrame, left: DataFrame) -> DataFrame:
        asked = some.select(F.col("doc_id").alias("asked_id"), F.col("key").alias("asked_key"), "copies")
        found = left.join(asked, (F.col("key") == F.col("asked_key")) & F.col("id").eqNullSafe(F.col("asked_id")))
        return beside(found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))))

    out = met(taken.where("rows = 1"), rows)
    again = taken.where("rows > 1")
    if not again.isEmpty():
        # of wholly equal rows one stands for all, as often as they are taken together
        some = rows.join(again.select(F.col("key").alias("asked_key")).distinct(), F.col("key") == F.col("asked_key"), "left_semi").dropDuplicates(["id", "key"])
        out = out.unionByName(met(again, some))
    return out
