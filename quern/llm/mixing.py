"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets, in a shuffled order that depends on its id and text alone, a virtual finish time: the
source's words up to and with it, divided by the source's target. A source whose target is above its size is queued for
a second round. All documents are then sorted by finish time over the whole cluster, summed up, and cut at the budget.
Finish times rise within a source, so the cut is one last (round, key, row) per source: that small table is the decision,
and applying it to documents needs no shuffle of texts. Rows of one id and text share a key; their row numbers, behind the
key in the order, spread them over tasks and let the cut fall between them.

Defined results: a null text counts 0 words and takes 0; a null source is a source, ordered last; sources without words
get target 0; of repeated rows of one id and text some can be taken once more than others, which ones is open, as they are
equal. An empty table gives an empty result. No document is taken more than twice, and one without words never.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD_JVM, running, small, written

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MOST_PERCENT = 150, 200


def key_of():
    """The place in its source's shuffled order."""
    return F.xxhash64(F.lit(0x51D5), F.col("doc_id"), F.col("text"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> also weight and target. `sources` must be materialised: one row per source, so that its
    one ordered window is as small as the number of sources. The excess over a source's cap is shared again among the
    others until none is above its cap; each round is one aggregate over the sources."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(x)) for x in weights))
    t = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * (MOST_PERCENT / 100.0))
    t = written(t, "op9-weights")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    budget, level = min(total * SHARE_PERCENT / 100.0, total * MOST_PERCENT / 100.0), 0.0
    above = F.lit(False)
    while True:
        x = t.agg(F.sum(F.when(above, F.col("cap"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")).first()
        if not x["open"]:
            break
        level = (budget - (x["full"] or 0.0)) / x["open"]
        now = above | (F.col("cap") < level * F.col("weight"))
        if t.where(now).count() == x["n"]:
            break
        above = now
    return t.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).select("source", "source_size", "target")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_JVM)), F.lit(0)).cast("long").alias("size"), key_of().alias("key"))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows' sizes as a table, each with a number of its own."""
    return written(sized(docs).withColumn("row", F.monotonically_increasing_id()), "op9-sizes")


def decisions(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, lap, last_key, last_row, last_rows, tied): documents up to (last_key, last_row) are taken
    lap + 1 times, others lap times. Of the `tied` rows with the last key, last_rows are up to it."""
    sources = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "op9-sources")
    goal = written(targets(sources, weights), "op9-targets")
    budget = int(round(goal.agg(F.sum("target")).first()[0] or 0.0))
    g = small(goal.withColumnRenamed("source", "s"))
    queue = running(sizes.select("source", "key", "row", "size"), ["source", "key", "row"], "size", "op9-queue", by="source")
    queue = queue.join(g, queue["source"].eqNullSafe(g["s"])).where("target > 0 and size > 0")
    lap = F.explode(F.array(F.lit(0), F.lit(1))).alias("lap")
    finish = ((F.col("before") + F.col("size") + F.col("lap") * F.col("source_size")) / F.col("target")).alias("finish")
    queue = queue.select("source", "key", "row", "size", "before", "source_size", "target", lap).select("source", "key", "row", "size", "lap", finish)
    # Nothing that ends after virtual time 1 by more than a whole source can be within the budget; the cut itself is below.
    cut = running(written(queue, "op9-finish"), ["finish", "source", "key", "row", "lap"], "size", "op9-cut").where(F.col("before") + F.col("size") <= F.lit(budget))
    last = cut.groupBy("source").agg(F.max(F.struct("lap", "key", "row")).alias("last")).withColumnRenamed("source", "s")
    out = goal.join(last, goal["source"].eqNullSafe(last["s"]), "left").select("source", "source_size", "target", F.coalesce("last.lap", F.lit(-1)).alias("lap"), F.col("last.key").alias("last_key"), F.col("last.row").alias("last_row"))
    out = written(out, "op9-cuts")
    at = small(out.select(F.col("source").alias("s"), "last_key", "last_row"))
    ties = sizes.join(at, sizes["source"].eqNullSafe(at["s"]) & (sizes["key"] == at["last_key"]) & (sizes["size"] > 0)).groupBy("s").agg(F.sum((F.col("row") <= F.col("last_row")).cast("long")).alias("last_rows"), F.count("*").alias("tied"))
    return written(out.join(ties, out["source"].eqNullSafe(ties["s"]), "left").drop("s"), "op9-decisions")


def copies(lap, up_to):
    """How often a document is taken: once more than the whole rounds before the last, if it is not after the last row."""
    return F.when(lap < 0, F.lit(0)).otherwise(lap + F.when(up_to, F.lit(1)).otherwise(F.lit(0))).cast("int")


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sizes = numbered(docs)
    d = small(decisions(sizes, weights).withColumnRenamed("source", "s"))
    up_to = (F.col("key") < F.col("last_key")) | ((F.col("key") == F.col("last_key")) & (F.col("row") <= F.col("last_row")))
    return sizes.join(d, sizes["source"].eqNullSafe(d["s"])).select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("lap"), up_to)).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns that came in. Where the cut falls between rows
    of one id and text, these rows (of one key a source) are written and numbered."""
    cuts = decisions(numbered(docs), weights).select(F.col("source").alias("__s"), F.col("lap").alias("__lap"), F.col("last_key").alias("__last"), F.col("last_rows").alias("__rows"), (F.col("tied") > F.col("last_rows")).alias("__split"))
    d, names = small(cuts), docs.columns
    key = F.xxhash64(F.lit(0x51D5), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.join(d, docs["source"].eqNullSafe(d["__s"])).where(F.col("text").cast("string").rlike(WORD_JVM))
    at_cut = F.coalesce(F.col("__split") & (key == F.col("__last")), F.lit(False))
    repeat = lambda rows, up_to: rows.withColumn("__i", F.explode(F.array_repeat(F.lit(1), copies(F.col("__lap"), up_to)))).select(*names)
    if not cuts.where("__split").limit(1).count():
        return repeat(out, key <= F.col("__last"))
    tied = written(out.where(at_cut).withColumn("__row", F.monotonically_increasing_id()), "op9-tied")
    place = running(tied.select(F.col("__s").alias("source"), F.col("__row").alias("row"), F.lit(1).cast("long").alias("one"), "__rows"), ["source", "row"], "one", "op9-places", by="source")
    ends = written(place.where(F.col("before") < F.col("__rows")).groupBy("source").agg(F.max("row").alias("__end")), "op9-ends")
    e = small(ends.withColumnRenamed("source", "__e"))
    tied = tied.join(e, tied["__s"].eqNullSafe(e["__e"]), "left")
    return repeat(out.where(~at_cut), key <= F.col("__last")).unionByName(repeat(tied, F.col("__row") <= F.col("__end")))
