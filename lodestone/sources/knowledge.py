"""The knowledge-base tables as projections of the given Parquet tables (see FIXTURES.md, part 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Note kinds in canonical order and their folders.
KINDS = ("memory", "decision", "work-state", "person")
KIND_FOLDERS = {"memory": "memory", "decision": "decisions", "work-state": "work-state", "person": "people"}

TODAY = "2024-07-15"
LOG_NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_id(doc_id: Column) -> Column:
    return F.concat(F.lit("n"), F.lpad(doc_id.cast("string"), 8, "0"))


def day(offset: Column) -> Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int")), "yyyy-MM-dd")


def clean_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def kind_folder(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in KIND_FOLDERS.items() for x in kv]), kind)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as notes: one wide row a note, `kind` telling which columns count."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.when(d % 10 <= 5, "memory").when(d % 10 <= 7, "decision").when(d % 10 == 8, "work-state").otherwise("person")
    memory = F.when(F.col("toxic") == 1, "stale").when(d % 17 == 0, "superseded").otherwise("active")
    decision = F.when(d % 3 == 0, "proposed").when(d % 3 == 1, "accepted").otherwise("superseded")
    status = F.when(F.col("kind") == "memory", memory).when(F.col("kind") == "decision", decision).when(F.col("kind") == "work-state", F.when(d % 4 == 0, "planned").otherwise("done"))
    replaced = F.when(F.col("status") == "superseded", F.when(d % 29 == 0, "n99999999").otherwise(note_id(d + 10)))
    return (
        docs.withColumn("kind", kind)
        .withColumn("status", status)
        .select(
            "doc_id", note_id(d).alias("id"), "kind", F.substring(clean_line(F.col("text")), 1, 60).alias("title"), F.col("text").alias("body"), "source", "lang",
            F.concat(F.lit("brain"), (d % 3).cast("string")).alias("brain"), day(d % 180).alias("created"), F.when(d % 5 == 0, day(d % 180 + 30)).alias("updated"),
            F.when((F.col("quality") == 1) & (d % 2 == 0), day(d % 180 + 45)).alias("verified"), "status", replaced.alias("superseded_by"),
            F.when(F.col("quality") == 0, F.array("lang", F.lit("Contradicted"))).otherwise(F.array("lang")).alias("tags"),
            F.when(d % 4 == 0, F.array(F.concat(F.lit("[["), note_id(d + 1), F.lit("]]")))).otherwise(F.array().cast("array<string>")).alias("relates"),
            F.when(d % 7 == 0, "").otherwise(F.concat(F.lit("user"), (d % 7).cast("string"))).alias("author"), F.when(d % 13 == 0, "acme").alias("project"), (d % 2 == 0).alias("graduate"),
            F.concat(kind_folder(F.col("kind")), F.lit("/"), note_id(d), F.lit(".md")).alias("path"), "quality",
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(note_id(F.col("vec_id")).alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as capture-log entries; `log_ord` is the log's order, which differs from time for brain2."""
    k = F.get_json_object("props", "$.k").cast("int")
    now = F.lit(LOG_NOW).cast("timestamp")
    week = F.col("ts") >= now - F.expr("INTERVAL 7 DAYS")
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "ts", F.concat(F.lit("brain"), (F.col("user_id") % 5).cast("string")).alias("brain"),
        F.when(F.col("user_id") % 5 == 2, -F.col("event_id")).otherwise(F.col("event_id")).alias("log_ord"),
        F.when(e.isin("purchase", "signup", "click"), "ok").when(e == "view", "skipped").when(k % 4 == 3, "curate-failed").otherwise("extraction-failed").alias("outcome"),
        F.when(e == "error", F.when(k % 4 == 0, "extractor-timeout").when(k % 4 == 1, "extractor-unavailable").when(k % 4 == 2, "").otherwise("curate-runtime")).alias("reason"),
        F.when(e == "purchase", 1).when((e == "click") & week & (F.col("user_id") % 5 == 0), 1).otherwise(0).alias("staged"),
        F.when((e == "signup") & ~(week & (F.col("user_id") % 5 == 1)), 1).otherwise(0).alias("promoted"),
    )


def brains(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(F.concat(F.lit("brain"), F.col("id").cast("string")).alias("brain"))


def candidates(all_notes: DataFrame) -> DataFrame:
    return all_notes.filter("doc_id % 4 = 3").withColumn("ord", F.col("doc_id"))


def canon(all_notes: DataFrame) -> DataFrame:
    return all_notes.filter("doc_id % 4 <> 3")


def verdicts(all_notes: DataFrame) -> DataFrame:
    """Candidates with a classifier's verdict, malformed in places on purpose."""
    d = F.col("doc_id")
    relation = F.element_at(F.array(*[F.lit(x) for x in ("distinct", "duplicate", "supersedes", "contradicts", "bogus")]), (d % 5 + 1).cast("int"))
    return candidates(all_notes).select(
        "ord", "id", "kind", "title", "tags",
        F.when(d % 11 == 0, "??").when(F.col("quality") == 0, "trivia").otherwise("durable").alias("judge"), relation.alias("consolidation"),
        F.when(d % 9 == 0, "  ").when(d % 14 == 0, "nope").otherwise(note_id(d - 4)).alias("target_id"),
        F.when(d % 8 == 7, F.lit(None)).when(d % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(note_id(d - 4))).alias("neighbor_ids"),
    )


def alias_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("eng-a", ["src0", "src1"]), ("eng-b", ["src2", "src3"]), ("eng-c", ["src1", "src4"])], "project string, sources array<string>")


#: Routing rules in authored order.
RULES = (
    (0, "org1/repo1", None, None, "brain-repo", False, "local"), (1, "org2/repo2", None, None, None, True, "local"), (2, None, "org0/*", None, None, False, "local"), (3, None, "org3", None, None, True, "local"),
    (4, None, None, "/work/t0", "brain-t0", False, "local"), (5, None, None, "/work/t0/p3", "brain-t0-p3", False, "local"), (6, None, None, "/work/t1", "brain-t1", False, "local"), (7, None, None, "/work/t1", None, True, "local"),
    (8, None, None, "/work/t0", "brain-shared", False, "shared"), (9, None, None, "/work/t2/p5", "brain-shared-p5", False, "shared"), (10, None, None, "*", "brain-any", False, "local"),
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "ord int, repo string, org string, prefix string, brain string, deny boolean, origin string")


def route_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 8 != 0, F.concat(F.lit("org"), (d % 4).cast("string"), F.lit("/repo"), (d % 15).cast("string"))).alias("slug"),
        F.when(d % 10 == 9, F.concat(F.lit("/workshop/p"), (d % 9).cast("string"))).otherwise(F.concat(F.lit("/work/t"), (d % 3).cast("string"), F.lit("/p"), (d % 9).cast("string"))).alias("path"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, and every third again after the last turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"), "role", "text")
    last = turns.groupBy("conv_id").agg(F.max("line_no").alias("last"))
    replay = turns.filter("line_no % 3 = 0").join(last, "conv_id").select("conv_id", (F.col("line_no") + F.col("last") + 1).alias("line_no"), "role", "text")
    return turns.unionByName(replay)


def commits(all_notes: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    n = d.cast("string")
    t = F.col("title")
    subject = F.when(d % 6 == 0, t).when(d % 6 == 1, F.concat(t, F.lit(" (#"), n, F.lit(")"))).when(d % 6 == 2, F.concat(F.lit("wip: "), t)).when(d % 6 == 3, F.concat(F.lit("bump "), t)).when(d % 6 == 4, F.concat(F.lit("Merge pull request #"), n, F.lit(" from x/y"))).otherwise(F.concat(F.lit("wipe out "), t))
    return all_notes.select(d.alias("ord"), subject.alias("subject"), F.when(d % 4 == 0, "").otherwise(F.col("body")).alias("body"))
