"""Mixing sources to target weights by weighted fair queueing.

Every document of a source queues in a shuffled order, twice over (a source may be
repeated once). An entry's virtual finish time is the source's words up to and with
it, divided by the source's target. Entries are served in the order of finish times
until the total budget is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: The mix's size in percent of all words, the repeats a source allows, and the time steps of the range sort.
SHARE, REPEATS, STEPS, LAST = 150, 2, 4096, 16384


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def targets(sources: DataFrame) -> DataFrame:
    """Targets by source from (source, source_size): weights 3, 1, 2, repeating by code
    point, null last; a target stops at twice its source, the excess goes to the others
    by weight. Sorted by cap / weight, the capped sources are a prefix, so one pass over
    the sources (never over documents) finds the level without iterating.
    """
    everything = Window.partitionBy(F.lit(1))
    ranked = sources.select("source", "source_size", (F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source"))) - 1).alias("rank"))
    ranked = ranked.select("*", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).alias("w"), (F.col("source_size") * REPEATS).alias("cap"))
    by_level = everything.orderBy(F.col("cap") / F.col("w"), "rank")
    upto = by_level.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("source_size").over(everything) * F.lit(SHARE / 100)
    left = F.sum("w").over(everything) - F.sum("w").over(upto)
    level = (total - F.sum("cap").over(upto)) / F.nullif(left, F.lit(0))
    # The level if none, or the sources up to this one, are capped; the right one is the first that its next source's cap admits.
    leveled = ranked.select("*", F.row_number().over(by_level).alias("place"), level.alias("after"), (F.lead(F.col("cap") / F.col("w")).over(by_level)).alias("next"), (total / F.sum("w").over(everything)).alias("even"), F.min(F.col("cap") / F.col("w")).over(everything).alias("lowest"))
    found = F.when(F.first("even").over(everything) <= F.first("lowest").over(everything), F.first("even").over(everything)).otherwise(
        F.min(F.when(F.col("after") <= F.col("next"), F.struct("place", "after"))).over(everything)["after"]
    )
    target = F.coalesce(F.least(F.col("cap").cast("double"), found * F.col("w")), F.col("cap").cast("double"))
    return leveled.select("source", "rank", "source_size", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """Every row of docs(doc_id, source, text): doc_id, size, source_size, target, taken,
    times (how often the mix takes it), text_hash, source.

    Null texts and texts without words have size 0 and are never taken; a null source is
    a source of its own; equal rows are served one by one; an empty table gives no rows.
    Only counts and keys are sorted: prefix sums
    run per (source, digest bucket) with bucket offsets, so a hot source is spread over
    4096 buckets, and only the time step where the budget ends is sorted row by row.
    """
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("u"), F.substring(digest, 1, 3).alias("bucket"), text_hash(F.col("text")).alias("text_hash")), "mix-rows")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    goals = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")))
    offsets = buckets.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before")).alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "bucket", "before", "rank", "source_size", "target")
    own = Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.select("*", F.sum("size").over(own).alias("run")).alias("r").join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.bucket") == F.col("o.bucket")))
    queued = stage(queued.select("r.doc_id", "r.source", "size", "u", "text_hash", "rank", "source_size", "target", (F.col("before") + F.col("run")).alias("done")), "mix-queue")

    def finish(done):
        return done.cast("double") / F.col("target")

    def step(done):
        return F.least(F.floor(finish(done) * STEPS), F.lit(LAST)).cast("int")

    epochs = [F.col("done") + F.col("source_size") * e for e in range(REPEATS)]
    served = queued.where("size > 0")
    entries = served.select("size", F.explode(F.array(*[step(e) for e in epochs])).alias("step"))
    steps = entries.groupBy("step").agg(F.sum("size").alias("words"))  # LAST + 1 rows at most
    running = steps.select("step", "words", F.sum("words").over(Window.partitionBy(F.lit(1)).orderBy("step")).alias("upto"))
    total = served.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all")).select((F.col("all") * F.lit(SHARE / 100)).alias("budget"))
    edge = running.join(F.broadcast(total)).where("upto > budget").agg(F.min(F.struct("step", (F.col("budget") - F.col("upto") + F.col("words")).alias("room"))).alias("e")).select(F.coalesce("e.step", F.lit(LAST + 1)).alias("edge"), F.coalesce("e.room", F.lit(0)).alias("room"))
    edge = edge.first()  # two numbers
    at, room = F.lit(edge["edge"]), F.lit(edge["room"])
    close = served.select("doc_id", "u", "size", "rank", F.explode(F.array(*[F.struct(step(e).alias("step"), finish(e).alias("f"), F.lit(i).alias("e")) for i, e in enumerate(epochs)])).alias("x"), "done").where(F.col("x.step") == at)
    order = Window.partitionBy(F.lit(1)).orderBy("x.f", "rank", "x.e", "done").rowsBetween(Window.unboundedPreceding, 0)
    inside = close.select("*", F.sum("size").over(order).alias("upto")).where(F.col("upto") <= room)
    # In one step a source's entries are served in the order of done, so the last one served tells the rest.
    last = inside.groupBy("rank").agg(*[F.max(F.when(F.col("x.e") == i, F.col("done"))).alias(f"last{i}") for i in range(REPEATS)])
    out = queued.join(last, "rank", "left")
    times = sum((F.when((step(e) < at) | ((step(e) == at) & (F.col("done") <= F.col(f"last{i}"))), 1).otherwise(0) for i, e in enumerate(epochs)), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * times).otherwise(F.lit(0)).cast("long").alias("taken"), F.when(F.col("size") > 0, times).otherwise(0).cast("int").alias("times"), "text_hash", "source")


def mixed(docs: DataFrame) -> DataFrame:
    """docs, with its own columns whatever their names, each row as often as the mix takes
    it. Only the narrow decisions and docs itself, once by doc_id and text, are shuffled.
    Rows with one doc_id, source and text share what the mix takes of them; only where that
    doesn't divide are they numbered."""
    h, times, copies, n = (free_name(docs, c) for c in ("h", "times", "copies", "n"))
    chosen = mix(docs).groupBy("doc_id", "source", "text_hash").agg(F.sum("times").alias("all"), F.count("*").alias("rows"))
    chosen = chosen.where("all > 0").select(F.struct("doc_id", "source", "text_hash").alias(h), F.col("all").alias(times), F.col("rows").alias(copies))
    key = F.struct("doc_id", "source", text_hash(F.col("text")).alias("text_hash"))
    same = F.col(f"{h}.doc_id").eqNullSafe(docs["doc_id"]) & F.col(f"{h}.source").eqNullSafe(docs["source"]) & (F.col(f"{h}.text_hash") == text_hash(docs["text"]))
    placed = docs.join(chosen, same)
    even = placed.where(F.col(times) % F.col(copies) == 0).withColumn(n, (F.col(times) / F.col(copies)).cast("int"))
    odd = placed.where(F.col(times) % F.col(copies) != 0).withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0))))
    odd = odd.withColumn(n, (F.floor(F.col(times) / F.col(copies)) + F.when(F.col(n) <= F.col(times) % F.col(copies), 1).otherwise(0)).cast("int"))
    both = even.unionByName(odd).where(F.col(n) > 0)
    return both.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
