"""Transcripts, mined commits, staging moves and rendered listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import BLANK, collapse, gist
from lodestone.operators.search import is_superseded

TRANSCRIPT_BYTES, COMMIT_BODY = 2_000_000, 4000


def first_seen(lines: DataFrame) -> DataFrame:
    """Of equal texts in a conversation the first stays."""
    place = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("line_no"))
    return lines.withColumn("place", place).filter("place = 1").drop("place")


def compact(lines: DataFrame) -> DataFrame:
    """One text a conversation: its turns in order, each with its role."""
    row = F.struct("line_no", F.concat("role", F.lit(": "), "text").alias("line"))
    return lines.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n").alias("transcript"))


def tail_cap(lines: DataFrame, most: int = TRANSCRIPT_BYTES) -> DataFrame:
    """The last lines of each conversation that fit into so many bytes, newlines counted."""
    after = Window.partitionBy("conv_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length(F.concat("role", F.lit(": "), "text")) + 1
    return lines.withColumn("used", F.sum(size).over(after)).filter(F.col("used") <= most)


def mine_commits(commits: DataFrame) -> DataFrame:
    """Commits worth a note: with a pull-request number or a body, not trivial, the first of each title."""
    s = F.col("subject")
    squash = F.nullif(F.regexp_extract(s, "\\(#([0-9]+)\\)[ \\t]*$", 1), F.lit(""))
    merge = F.nullif(F.regexp_extract(s, "^Merge pull request #([0-9]+) from ", 1), F.lit(""))
    number = F.coalesce(squash, merge)
    title = F.when(squash.isNotNull(), F.trim(F.regexp_replace(s, "\\(#[0-9]+\\)[ \\t]*$", ""))).otherwise(s)
    trivial = s.rlike("(?i)^(?:(?:wip|fixup|bump)(?:$|[\\s:!])|merge branch\\b|chore\\(deps\\))")
    has_body = F.length("body") > 0
    keep = (F.length(title) > 0) & ~(number.isNull() & trivial) & ~(number.isNull() & ~has_body) & ~(merge.isNotNull() & ~has_body)
    trimmed = lambda c: F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")
    rows = commits.filter(keep).select("ord", title.alias("title"), F.lower(collapse(title)).alias("title_key"), F.substring(trimmed(F.when(has_body, F.col("body")).otherwise(title)), 1, COMMIT_BODY).alias("body"), number.alias("number"))
    first = F.row_number().over(Window.partitionBy("title_key").orderBy("ord"))
    rows = rows.withColumn("place", first).filter("place = 1")
    tags = F.when(F.col("number").isNotNull(), F.array(F.lit("git"), F.lit("seed"), F.lit("pr"))).otherwise(F.array(F.lit("git"), F.lit("seed")))
    return rows.select("ord", F.lit("memory").alias("kind"), "title", "body", F.array_join(tags, ",").alias("tags"))


def reconcile(staged: DataFrame, canon: DataFrame) -> DataFrame:
    """Staged rows: cleared where canon has their id by now, else kept."""
    there = canon.select("id", F.lit(True).alias("_there")).distinct()
    return staged.join(there, "id", "left").withColumn("state", F.when(F.col("_there"), "cleared").otherwise("kept")).drop("_there")


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Overwrite in place: rows of known keys take the place of what was there, others join."""
    return target.join(rows.select(key), key, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def supersede(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """Mark duplicates as superseded by their survivors; memory and decision notes only."""
    p = plan.select(F.col("duplicate").alias("_d"), F.col("survivor").alias("_s"))
    rows = notes.join(p, F.col("id") == F.col("_d"), "left")
    hit = F.col("_s").isNotNull() & F.col("kind").isin("memory", "decision")
    return rows.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.when(hit, F.col("_s")).otherwise(F.col("superseded_by"))).drop("_d", "_s")


#: Sections of an emitted context; a title costs its length and four characters of line ends and marks.
SECTIONS = ("Decisions", "Active work", "Key facts")
#: What an entry costs at least: its marks and the end of its line.
LEAST_ENTRY = 7


def emit_header(source: Column) -> Column:
    return F.concat(F.lit("# Team brain\n\nShared knowledge for **"), source, F.lit("**, generated from the team's notes.\nRead this before acting. Do not edit: it is made anew from the notes.\n"))


def emit_context(notes: DataFrame, budget: int = 8000) -> DataFrame:
    """Per source: decisions, active work and memories as one markdown text within a budget of characters, of which the header and titles are a part.

    A section stops at its first entry that doesn't fit, but has one entry at least. An entry has a least length, so a
    section holds a bounded number of rows: those are taken by rank, which Spark limits before it shuffles; a fold over
    them then spends the budget.
    """
    g = gist(F.col("body"))
    tail = F.when(g != "", F.concat(F.lit(" — "), g)).otherwise("")
    head = F.concat(F.lit("- **"), "title", F.lit("**"))
    entry = F.when(F.col("kind") == "decision", F.concat(head, F.lit(" ("), "created", F.lit(")"), tail)).when(F.col("kind") == "work-state", F.concat(head, F.lit(" ["), "status", F.lit("]"), tail)).otherwise(F.concat(head, tail))
    section = F.when(F.col("kind") == "decision", 0).when(F.col("kind") == "work-state", 1).otherwise(2)
    live = notes.filter(~is_superseded() & F.col("kind").isin("decision", "work-state", "memory") & ~((F.col("kind") == "work-state") & (F.col("status") == "done")))
    w = Window.partitionBy("source", "section").orderBy(F.when(F.col("section") == 0, F.col("created")).desc_nulls_last(), "id")
    rows = live.select("source", "id", "created", section.alias("section"), entry.alias("entry")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= budget // LEAST_ENTRY + 1)
    rows = rows.withColumn("so_far", F.sum(F.length("entry") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("place") == 1) | (F.col("so_far") <= budget))
    listed = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("section", "place", F.length("entry").alias("n"), "entry"))).alias("entries"))
    header = emit_header(F.coalesce("source", F.lit("")))
    start = F.struct(F.length(header).alias("used"), F.lit(-1).alias("section"), F.lit(False).alias("stopped"), F.lit(0).alias("kept"), F.array().cast("array<string>").alias("out"))
    titles = F.array(*[F.lit(t) for t in SECTIONS])

    def step(s, x):
        fresh = s["section"] != x["section"]
        # what a section's title costs is spent when the next one begins
        used = s["used"] + F.when(fresh & (s["section"] >= 0), F.length(F.element_at(titles, F.greatest(s["section"], F.lit(0)) + 1)) + 4).otherwise(0)
        stop = ~fresh & (s["stopped"] | (used + x["n"] + 1 > budget))
        title = F.when(fresh, F.array(F.concat(F.lit("\n## "), F.element_at(titles, x["section"] + 1), F.lit("\n")))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.when(stop, used).otherwise(used + x["n"] + 1).cast("int").alias("used"), x["section"].alias("section"), stop.alias("stopped"), (s["kept"] + F.when(stop, 0).otherwise(1)).alias("kept"),
            F.when(stop, s["out"]).otherwise(F.concat(s["out"], title, F.array(x["entry"]))).alias("out"),
        )

    folded = listed.select("source", header.alias("header"), F.aggregate("entries", start, step).alias("f"))
    return folded.select("source", F.col("f.kept").alias("entries"), F.concat("header", F.array_join("f.out", "\n"), F.lit("\n")).alias("context"))
