"""Health buckets and scores, contributor and kind counts, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import days_between, round_half_up, unlink
from lodestone.operators import listings
from lodestone.sources.knowledge import KINDS

STALE_DAYS = 90


def _kind_table(notes: DataFrame) -> DataFrame:
    return notes.sparkSession.createDataFrame(list(enumerate(KINDS)), "kind_ord int, kind string")


def kind_counts(notes: DataFrame) -> DataFrame:
    counts = notes.groupBy("kind").agg(F.count("*").alias("n"))
    return _kind_table(notes).join(counts, "kind", "left").select("kind_ord", "kind", F.coalesce("n", F.lit(0)).alias("n")).orderBy("kind_ord")


def contributor_counts(notes: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.lit("(unattributed)"))
    return notes.groupBy(name.alias("contributor")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "contributor")


def links(notes: DataFrame, *carry: str) -> DataFrame:
    """(id, ref): what each note points to; a link may be written [[id]] or bare."""
    by = F.when(F.col("kind").isin("memory", "decision"), F.array("superseded_by")).otherwise(F.array())
    refs = F.array_compact(F.concat("relates", by.cast("array<string>")))
    return notes.select("id", *carry, F.explode(refs).alias("ref")).withColumn("ref", unlink(F.col("ref")))


def flags(notes: DataFrame, now: str, stale_days: int = STALE_DAYS, group: str | None = None) -> DataFrame:
    """id and four flags; with `group`, only links within a group count."""
    carry = [group] if group else []
    referenced = links(notes, *carry).select(F.col("ref").alias("id"), *carry).distinct().withColumn("linked", F.lit(True))
    memory = F.col("kind") == "memory"
    touched = F.coalesce("verified", "updated", "created")
    old = (F.col("status") == "active") & (days_between(F.lit(now), touched) > stale_days)
    rows = notes.join(referenced, ["id", *carry], "left") if not group else notes.join(referenced.withColumnRenamed(group, "_g"), (notes["id"] == referenced["id"]) & notes[group].eqNullSafe(F.col("_g")), "left").drop(referenced["id"])
    true = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "id", "kind", *carry, true(memory & ((F.col("status") == "stale") | old)).alias("stale"), true(memory & (F.col("status") == "active") & F.col("verified").isNull()).alias("unverified"),
        F.exists("tags", lambda t: F.lower(t) == "contradicted").alias("contradicted"), F.col("linked").isNull().alias("orphaned"),
    )


def buckets(flagged: DataFrame) -> DataFrame:
    """(bucket, n, id): a row for each note in a bucket, with the bucket's size; a list of a bucket's ids would grow with the notes."""
    names = ["stale", "unverified", "contradicted", "orphaned"]
    which = F.explode(F.array_compact(F.array(*[F.when(F.col(b), F.lit(b)) for b in names])))
    rows = flagged.select("id", which.alias("bucket"))
    sizes = flagged.agg(*[F.count(F.when(F.col(b), 1)).alias(b) for b in names])
    # one row of four sizes
    size = F.coalesce(*[F.when(F.col("bucket") == b, F.col(b)) for b in names])
    return rows.join(F.broadcast(sizes)).select("bucket", size.alias("n"), "id")


def score(flagged: DataFrame, *by: str) -> DataFrame:
    serious = F.col("stale") | F.col("contradicted")
    soft = (F.col("unverified") | F.col("orphaned")) & ~serious
    n = lambda c: F.count(F.when(c, 1))
    raw = round_half_up(100 * (1 - (n(serious) + 0.5 * n(soft)) / F.count("*")))
    return flagged.groupBy(*by).agg(
        F.count("*").alias("total"), n(F.col("stale")).alias("stale"), n(F.col("unverified")).alias("unverified"), n(F.col("contradicted")).alias("contradicted"), n(F.col("orphaned")).alias("orphaned"),
        F.when(F.count("*") == 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), raw))).cast("int").alias("score"),
    )


def duplicate_ids(notes: DataFrame) -> DataFrame:
    return notes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def supersede_refs(notes: DataFrame) -> DataFrame:
    return notes.filter(F.col("kind").isin("memory", "decision") & (F.length("superseded_by") > 0)).select("id", unlink(F.col("superseded_by")).alias("ref"))


def dangling(notes: DataFrame) -> DataFrame:
    return supersede_refs(notes).join(notes.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", "ref")


def verify(notes: DataFrame, has_secret: Column) -> DataFrame:
    """One row a check with the number of findings; ok if there is none."""
    one = lambda name, df: df.agg(F.count("*").alias("findings")).select(F.lit(name).alias("check_name"), "findings")
    bad = notes.filter("title = '' OR id IS NULL OR kind IS NULL")
    out = one("schema", bad).unionByName(one("duplicate-ids", duplicate_ids(notes))).unionByName(one("dangling-supersede", dangling(notes))).unionByName(one("secrets", notes.filter(has_secret)))
    return out.withColumn("ok", F.col("findings") == 0)


def resource_listing(notes: DataFrame, cap: int = 200) -> DataFrame:
    """The newest notes, `cap` at most, and a row that says how many more there are."""
    newest = notes.select("id", "kind", "title", "created").orderBy(F.desc("created"), F.desc("id")).limit(cap)
    listed = newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created"), F.desc("id"))))
    more = notes.agg((F.count("*") - cap).alias("more")).filter("more > 0").select(F.lit("…").alias("id"), F.lit("").alias("kind"), F.concat(F.col("more").cast("string"), F.lit(" more")).alias("title"), F.lit("").alias("created"), F.lit(cap + 1).alias("place"))
    return listed.unionByName(more)


def brain_status(flagged: DataFrame, staged: DataFrame) -> DataFrame:
    """(brain, score, total, pending) of every brain with notes; flagged rows have their brain."""
    pending = staged.groupBy("brain").agg(F.count("*").alias("pending"))
    return score(flagged, "brain").join(pending, "brain", "left").select("brain", "score", "total", F.coalesce("pending", F.lit(0)).alias("pending"))


def signature(files: DataFrame, changed: Column) -> DataFrame:
    """(n, newest): what tells whether an index is of these files."""
    return files.agg(F.count("*").alias("n"), F.max(changed).alias("newest"))


def index_freshness(files: DataFrame, changed: Column, built: DataFrame) -> DataFrame:
    """(n, newest, fresh): an index is fresh if it was built over as many files and no file is newer; `built` is its stored signature, one row or none."""
    now = signature(files, changed)
    stored = built.agg(F.max("n").alias("stored_n"), F.max("newest").alias("stored_newest"))
    # one row each
    return now.join(F.broadcast(stored)).select("n", "newest", F.coalesce((F.col("n") == F.col("stored_n")) & F.col("newest").eqNullSafe(F.col("stored_newest")), F.lit(False)).alias("fresh"))


def recovery_point(commits: DataFrame, now: Column, checks: DataFrame) -> DataFrame:
    """(last, seconds, ok): the newest commit, how long ago it was, and whether all checks of the restored notes passed."""
    last = commits.agg(F.max("ts").alias("last"))
    return last.join(F.broadcast(overall(checks))).select("last", (F.unix_timestamp(now) - F.unix_timestamp("last")).alias("seconds"), (F.col("last").isNotNull() & F.col("ok")).alias("ok"))


def overall(checks: DataFrame) -> DataFrame:
    """One row: how many checks there are and whether none failed."""
    return checks.agg(F.count("*").alias("checks"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))


def parse_failures(parsed: DataFrame) -> DataFrame:
    """(path, error) of files that look like notes and are none: a verification names them instead of passing them over."""
    return parsed.filter("error IS NOT NULL").select("path", "error")


def report(notes: DataFrame, has_secret: Column, parsed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """`verify` with the files that don't parse and the derived files that drifted."""
    one = lambda name, df: df.agg(F.count("*").alias("findings")).select(F.lit(name).alias("check_name"), "findings").withColumn("ok", F.col("findings") == 0)
    return verify(notes, has_secret).unionByName(one("parse", parse_failures(parsed))).unionByName(one("derived", listings.drift(before, after)))


def map_listing(notes: DataFrame, cap: int = 200) -> DataFrame:
    """(place, id, kind, title): the map, a row a kind with its count, the newest notes, and how many more there are."""
    top = notes.sparkSession.createDataFrame([(-5, "map", "", "map of the brain")], "place int, id string, kind string, title string")
    kinds = kind_counts(notes).select((F.col("kind_ord") - 4).alias("place"), F.concat(F.lit("kind:"), "kind").alias("id"), "kind", F.concat(F.col("n").cast("string"), F.lit(" note(s)")).alias("title"))
    return top.unionByName(kinds).unionByName(resource_listing(notes, cap).select("place", "id", "kind", "title"))
