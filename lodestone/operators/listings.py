"""Derived listings as rows (path, place, line): whole, however many notes there are, and joined into files by a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import inline_text
from lodestone.operators.search import is_superseded
from lodestone.session import stash

#: Headings of the router's two lists, and what stands in an empty one.
SECTIONS, NOTHING = ("**Active work-state**", "**Recent decisions**"), "- _None._"
UNATTRIBUTED = "(unattributed)"


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str = "place", first: int = 1) -> DataFrame:
    """`rows` with their place in order within their group.

    All rows are put in ranges of (group, order), counted in each, and numbered from where the ranges before have come to: no
    task holds a whole group.
    """
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    runs = stash(ranged.select("*", F.spark_partition_id().alias("_run"), F.monotonically_increasing_id().alias("_at")), "listing-runs")
    counts = runs.groupBy(*group, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_run").alias("_r"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    on = F.col("_run") == F.col("_r")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return runs.join(bases, on).withColumn(name, F.col("_base") + F.col("_at") - F.col("_first") + first).select(*rows.columns, name)


def _headed(lines: DataFrame, heads: DataFrame) -> DataFrame:
    return heads.select("path", "place", "line").unionByName(lines.select("path", "place", "line"))


def folder_listing(notes: DataFrame) -> DataFrame:
    """(path, place, line): the index of each folder of notes: its name at place 0, then a link to every note's file, in order of ids, superseded ones too."""
    folder, file = F.regexp_replace("path", "/[^/]*$", ""), F.regexp_extract("path", "[^/]*$", 0)
    rows = notes.select(folder.alias("path"), "id", F.concat(F.lit("- ["), inline_text(F.coalesce("title", F.lit(""))), F.lit("]("), file, F.lit(")")).alias("line"))
    heads = rows.select("path").distinct().withColumn("place", F.lit(0).cast("long")).withColumn("line", F.concat(F.lit("# "), "path"))
    return _headed(numbered(rows, ["path"], [F.col("id"), F.col("line")]), heads)


def kind_listing(notes: DataFrame) -> DataFrame:
    """(path, place, line): every note of each kind, from the newest; superseded ones are marked. Place 0 has the kind and their number."""
    mark = F.when(is_superseded(), " _(superseded)_").otherwise("")
    line = F.concat(F.lit("- **"), F.coalesce("title", F.lit("")), F.lit("**"), mark, F.lit(" — `"), "id", F.lit("` ("), "path", F.lit(")"))
    rows = notes.select(F.col("kind").alias("path"), "created", "id", line.alias("line"))
    heads = rows.groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit(0).cast("long").alias("place"), F.concat(F.lit("# "), "path", F.lit(" — "), F.col("n").cast("string"), F.lit(" note(s)")).alias("line"))
    return _headed(numbered(rows, ["path"], [F.desc_nulls_last("created"), F.desc("id"), F.col("line")]), heads)


def router(notes: DataFrame, project: Column, sources: Column | None = None) -> DataFrame:
    """(project, source, section, place, line): by project, and by source where a project has several, active work by id and then live decisions from the newest.

    `project` is a note's resolved project; notes without one, or without a source, come under one label, which is the last.
    Section 0 is the project's heading, 1 a source's, 2 work and 3 decisions, each with its own heading at place 0; an empty
    list says so.
    """
    label = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(UNATTRIBUTED))
    of = notes.withColumn("_project", label(project)).withColumn("_source", label(F.col("source") if sources is None else sources))
    groups = of.select(F.col("_project").alias("project"), F.col("_source").alias("source")).distinct()
    several = groups.groupBy("project").agg((F.count("*") > 1).alias("several"))
    groups = groups.join(several, "project")
    # a project of one source is flat
    flat = F.when(F.col("several"), F.col("source")).otherwise("")
    work = (F.col("kind") == "work-state") & (F.col("status") != "done")
    said = F.when(F.col("kind") == "decision", F.col("created")).otherwise(F.col("status"))
    line = F.concat(F.lit("- ["), inline_text(F.coalesce("title", F.lit(""))), F.lit("]("), "path", F.lit(") — "), F.coalesce(said, F.lit("")))
    live = of.filter(work | ((F.col("kind") == "decision") & ~is_superseded()))
    rows = live.select(F.col("_project").alias("project"), F.col("_source").alias("source"), F.when(work, 2).otherwise(3).alias("section"), F.when(~work, F.col("created")).alias("newest"), "id", line.alias("line"))
    rows = numbered(rows.join(several, "project").withColumn("source", flat).drop("several"), ["project", "source", "section"], [F.desc_nulls_last("newest"), F.col("id"), F.col("line")])
    spots = groups.select("project", flat.alias("source")).distinct().select("project", "source", F.explode(F.array(F.lit(2), F.lit(3))).alias("section"))
    titles = spots.select("project", "source", "section", F.lit(0).cast("long").alias("place"), F.when(F.col("section") == 2, SECTIONS[0]).otherwise(SECTIONS[1]).alias("line"))
    empty = spots.join(rows.select("project", "source", "section").distinct(), ["project", "source", "section"], "left_anti").select("*", F.lit(1).cast("long").alias("place"), F.lit(NOTHING).alias("line"))
    heads = several.select("project", F.lit("").alias("source"), F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("## "), inline_text(F.col("project"))).alias("line"))
    subheads = groups.filter("several").select("project", "source", F.lit(1).alias("section"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("### "), inline_text(F.col("source"))).alias("line"))
    out = rows.select("project", "source", "section", "place", "line")
    for more in (titles, empty, heads, subheads):
        out = out.unionByName(more)
    return out


def router_order() -> list[Column]:
    """The order of the router's lines: labels in order, the label for none last."""
    last = lambda c: [(F.col(c) == UNATTRIBUTED).cast("int"), F.col(c)]
    return [*last("project"), *last("source"), F.col("section"), F.col("place")]


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, first_place, lines): derived listings that differ from what the notes give now, and the first line that does; lines are compared one by one."""
    a = before.select("path", "place", F.col("line").alias("old"))
    b = after.select("path", "place", F.col("line").alias("new"))
    both = a.join(b, ["path", "place"], "full")
    odd = ~F.col("old").eqNullSafe(F.col("new"))
    told = both.groupBy("path").agg(F.count("old").alias("n_old"), F.count("new").alias("n_new"), F.min(F.when(odd, F.col("place"))).alias("first_place"), F.count(F.when(odd, 1)).alias("lines")).filter("lines > 0")
    return told.select("path", F.when(F.col("n_old") == 0, "missing").when(F.col("n_new") == 0, "left over").otherwise("changed").alias("change"), "first_place", "lines")


def write_listings(lines: DataFrame, folder: str) -> None:
    """The sink: a folder of text files a path, whose lines, file after file by name, are the listing."""
    lines.repartitionByRange("path", "place").sortWithinPartitions("path", "place").select("path", F.col("line").alias("value")).write.mode("overwrite").partitionBy("path").text(folder)
