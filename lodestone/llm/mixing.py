"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every document gets a virtual finish time: the tokens of its source up to and with it, in a shuffled order, divided by
the source's target. The mix is what finishes first, up to a total budget of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import stash, whole_row

#: A source is read at most so many times.
MOST_PASSES = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows that one running sum is made over, on average.
RUN_ROWS = 10_000
#: Ranges that the queue is cut into at once, at most.
MOST_PARTS = 4096

WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sources: DataFrame, passes: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, weight) -> with `target`.

    Targets are in proportion to weight and sum to the total of all sizes; none is above `passes` times its source's size.
    What that takes away goes to the others by weight. In order of size over weight, the full sources come first:
    with `full` of them, a unit of weight is worth `level`, and the first `level` that doesn't fill the next source holds.
    """
    order = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = (
        sources.withColumn("_most", passes * F.col("source_size"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_most").over(before), F.lit(0))) / (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("_holds", F.when(F.col("_level") * F.col("weight") <= F.col("_most"), F.struct(F.row_number().over(order).alias("n"), F.col("_level").alias("level"))))
    )
    level = F.min("_holds").over(everything)["level"]
    return levels.withColumn("_at", level).select("source", "source_size", "weight", F.least(F.col("_at") * F.col("weight"), F.col("_most").cast("double")).alias("target"))


def weights_by_name(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources in code-point order, null last, get the weights in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))


def _running(df: DataFrame, groups: list[str], run: Column, order: list[Column], size: str) -> DataFrame:
    """Adds `_before`, the sum of `size` of all rows of the group that come before in (run, order).

    `run` cuts the order into runs, so no task sorts a whole group: totals of runs are summed first, then rows within a run.
    """
    df = df.withColumn("_run", run)
    totals = df.groupBy(*groups, "_run").agg(F.sum(size).alias("_of_run"))
    over_runs = Window.partitionBy(*groups).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(g).alias(f"_b_{g}") for g in groups], F.col("_run").alias("_b_run"), F.coalesce(F.sum("_of_run").over(over_runs), F.lit(0)).alias("_base"))
    same = [F.col(g).eqNullSafe(F.col(f"_b_{g}")) for g in groups] + [F.col("_run") == F.col("_b_run")]
    in_run = Window.partitionBy(*groups, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in_run", F.coalesce(F.sum(size).over(in_run), F.lit(0)))
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(bases, on).withColumn("_before", F.col("_base") + F.col("_in_run")).drop("_base", "_in_run", "_b_run", "_run", *[f"_b_{g}" for g in groups])


def _cut(queue: DataFrame, order: list[str], n: int, budget: int) -> Row | None:
    """The first row in global order at which the running sum of sizes is above the budget; null if there is none.

    The queue is put in global order in ranges, a bounded number of them; the budget ends within one range, which is cut
    into ranges again until it is as short as a run, and only that one is summed row by row.
    """
    while True:
        parts = min(MOST_PARTS, 1 + n // RUN_ROWS)
        queue = stash(queue.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "mix-queue")
        # a row a range
        reached = F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        totals = queue.groupBy("part").agg(F.sum("size").alias("of_part"), F.count("*").alias("rows")).withColumn("reached", reached)
        over = totals.filter(F.col("reached") > budget).orderBy("part").first()
        if over is None:
            return None
        queue = queue.filter(F.col("part") == over["part"]).drop("part")
        budget -= over["reached"] - over["of_part"]
        # rows of one finish time and shuffle are not parted by ranges
        if over["rows"] <= 4 * RUN_ROWS or over["rows"] == n:
            break
        n = over["rows"]
    total = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return queue.select(*order, total.alias("total")).filter(F.col("total") > budget).orderBy(*order).first()


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, passes_taken, text_key and its_source of every document.

    Documents of a source are shuffled by md5 of seed, doc_id and the text's md5; pass n of a document finishes n
    source sizes later. All passes are put in order of finish time and cut where the total of all sizes is reached.
    Documents without words take nothing and are never in the mix; a null source is a source of its own; equal rows
    are documents of their own, and the shuffle breaks ties. Only doc_id, text and source are read.
    """
    key = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("\x00")), "UTF-8"))
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"), key.alias("text_key"),
        F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key), "UTF-8")).alias("shuffle"),
    )
    sized = stash(sized, "mix-sized")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # one row a source, and one action: how many rows there are decides how many runs the sums are cut into
    most, n = by_source.agg(F.max("n"), F.sum("n")).first()
    runs = 1 + (most or 0) // RUN_ROWS
    targets = stash(source_targets(weights_by_name(by_source.drop("n"), weights), passes), "mix-targets")

    spot = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    placed = _running(sized.filter("size > 0"), ["source"], F.floor(spot * runs / F.lit(1 << 32)), [F.col("shuffle"), F.col("doc_id")], "size")
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    placed = stash(placed.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-placed")

    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    finish = (F.col("nth") * F.col("source_size") + F.col("_before") + F.col("size")) / F.col("target")
    queue = placed.filter("target > 0").withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select("doc_id", "shuffle", "size", "nth", finish.alias("finish"))
    cut = _cut(queue, ["finish", "shuffle", "doc_id", "nth"], passes * (n or 0), budget)
    if cut is None:
        taken = F.when(F.col("target") > 0, F.lit(passes)).otherwise(0)
    else:
        taken = F.lit(0)
        for nth in range(passes):
            f = (nth * F.col("source_size") + F.col("_before") + F.col("size")) / F.col("target")
            taken = taken + F.when((F.col("target") > 0) & ((f < cut["finish"]) | ((f == cut["finish"]) & (F.col("shuffle") < cut["shuffle"]))), 1).otherwise(0)
    with_words = placed.select("doc_id", "text_key", F.col("source").alias("its_source"), "size", "source_size", "target", (taken * F.col("size")).cast("long").alias("taken"), taken.cast("int").alias("passes_taken"))
    without = (
        sized.filter("size = 0").join(t, F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "text_key", F.col("source").alias("its_source"), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("passes_taken"))
    )
    return with_words.unionByName(without)


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it was taken.

    Rows that agree in doc_id, text and source are told apart by nothing that the mix reads; they share out what was taken
    of them, so that the mix holds no more than the plan. Null texts and texts without words are never taken, an empty
    table gives an empty mix, texts of any length are taken whole, and other columns stay whatever their names.
    """
    plan = mix(docs, **options).select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), F.col("its_source").alias("of_source"), F.col("passes_taken").alias("times"))
    plan = stash(plan, "mix-plan")
    same = ["of_doc", "of_text", "of_source"]
    repeats = bool(plan.groupBy(*same).count().filter("count > 1").take(1))
    key = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("\x00")), "UTF-8"))
    rows = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").alias("its_doc"), key.alias("its_text"), F.col("source").cast("string").alias("its_source"))
    on = F.col("its_doc").eqNullSafe(F.col("of_doc")) & (F.col("its_text") == F.col("of_text")) & F.col("its_source").eqNullSafe(F.col("of_source"))
    if repeats:
        rows = rows.withColumn("nth_row", F.row_number().over(Window.partitionBy("its_doc", "its_text", "its_source").orderBy(F.lit(0))))
        plan = plan.withColumn("nth_plan", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("times"))))
        on = on & (F.col("nth_row") == F.col("nth_plan"))
    taken = rows.join(plan.filter("times > 0"), on)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
