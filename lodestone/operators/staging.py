"""The layers of a knowledge base and how rows move between them: staged, canon, tombstones; and edits of rules and alias maps.

Every function returns new DataFrames; the caller writes them. Spark's committer makes a written table whole or absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import note_key, note_path
from lodestone.operators.clusters import cluster_key
from lodestone.operators.routing import drop_shadowed, rule_key
from lodestone.sources.knowledge import kind_folder


def create(notes: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(created, refused): rows of new ids, and those whose id is taken or comes twice. Nothing is overwritten."""
    twice = notes.groupBy("id").agg(F.count("*").alias("_n"))
    there = canon.select("id").distinct().withColumn("_there", F.lit(True))
    seen = notes.join(twice, "id").join(there, "id", "left")
    bad = F.col("_there").isNotNull() | (F.col("_n") > 1)
    return seen.filter(~bad).select(*notes.columns), seen.filter(bad).select(*notes.columns)


def canon_path() -> object:
    return note_path(kind_folder(F.col("kind")), F.col("id"), F.coalesce("source", F.lit("")))


def approve(staged: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(promoted with their canon path, left, unknown): of the ids given, those that aren't pending are `unknown`."""
    promoted = staged.join(ids.select("id").distinct(), "id", "left_semi").withColumn("path", canon_path())
    return promoted.select(*staged.columns), staged.join(ids, "id", "left_anti").select(*staged.columns), ids.select("id").distinct().join(staged, "id", "left_anti")


def tombstones_of(rejected: DataFrame) -> DataFrame:
    """(cluster_key, refs, title, kind) of rejected rows that came from a cluster across brains (`graduated_from` isn't empty)."""
    from_cluster = rejected.filter(F.size("graduated_from") > 0)
    return from_cluster.select(cluster_key(F.col("graduated_from")).alias("cluster_key"), F.array_sort(F.array_distinct("graduated_from")).alias("refs"), "title", "kind")


def add_tombstones(stones: DataFrame, new: DataFrame) -> DataFrame:
    """Insert where the key is absent; of new ones with equal keys the first title stays."""
    columns = ["refs", "title", "kind"]
    fresh = new.join(stones.select("cluster_key"), "cluster_key", "left_anti").groupBy("cluster_key").agg(F.min(F.struct("title", "kind", "refs")).alias("s"))
    return stones.select("cluster_key", *columns).unionByName(fresh.select("cluster_key", *[F.col(f"s.{c}").alias(c) for c in columns]))


def reject(staged: DataFrame, ids: DataFrame, stones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, tombstones): rejected rows go; a rejected cluster isn't proposed again."""
    gone = staged.join(ids, "id", "left_semi")
    return staged.join(ids, "id", "left_anti").select(*staged.columns), add_tombstones(stones, tombstones_of(gone))


def reassign(staged: DataFrame, moved: DataFrame) -> DataFrame:
    """(predicted, actual) persons, one row a `predicted`: rows of a predicted author_ref get the actual one, there and among `relates`."""
    rows = staged.join(moved.select(F.col("predicted").alias("author_ref"), F.col("actual").alias("_actual")), "author_ref", "left")
    kept = F.filter("relates", lambda r: r != F.col("author_ref"))
    hit = F.col("_actual").isNotNull()
    return (
        rows.withColumn("relates", F.when(hit, F.array_union(kept, F.array("_actual"))).otherwise(F.col("relates")))
        .withColumn("author_ref", F.coalesce("_actual", "author_ref")).select(*staged.columns)
    )


def conflict_siblings(versions: DataFrame) -> DataFrame:
    """(path, ours, theirs: structs of id, title, created, kind or null) -> a row a version that stays, and where.

    Where both sides have content, both stay, under new ids that their sides and paths decide; else the one there is stays in place.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("note")) for s in ("ours", "theirs")])
    rows = versions.select("path", (F.col("ours").isNotNull() & F.col("theirs").isNotNull()).alias("both"), F.explode(F.filter(sides, lambda x: x["note"].isNotNull())).alias("v")).select("path", "both", "v.side", "v.note")
    title = F.concat("note.title", F.lit(" ("), "side", F.lit(")"))
    new_id = note_key(F.col("note.created"), title, F.concat("path", F.lit(":"), "side"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    return rows.select("path", "side", F.when(F.col("both"), new_id).otherwise(F.col("note.id")).alias("id"), F.when(F.col("both"), F.concat(folder, new_id, F.lit(".md"))).otherwise(F.col("path")).alias("new_path"))


def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by matcher: a rule of a known matcher takes its place in the order, others follow. Of new rules with one matcher the last counts."""
    columns = rules.columns
    fresh = new.withColumn("_key", rule_key()).filter("_key IS NOT NULL")
    fresh = fresh.groupBy("_key").agg(F.max(F.struct("ord", *[c for c in columns if c != "ord"])).alias("_r"))
    old = rules.withColumn("_key", rule_key())
    place = old.groupBy("_key").agg(F.min("ord").alias("_place"))
    last = rules.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last"))
    placed = fresh.join(place, "_key", "left").join(F.broadcast(last))
    ordinal = F.coalesce("_place", F.col("_last") + 1 + F.col("_r.ord")).cast(rules.schema["ord"].dataType)
    put = placed.select(*[ordinal.alias(c) if c == "ord" else F.col(f"_r.{c}").alias(c) for c in columns])
    return old.join(fresh.select("_key"), "_key", "left_anti").select(*columns).unionByName(put)


def remove_rules(rules: DataFrame, matchers: DataFrame) -> DataFrame:
    return rules.withColumn("_key", rule_key()).join(matchers.select(rule_key().alias("_key")), "_key", "left_anti").select(*rules.columns)


def import_shared_rules(rules: DataFrame, shared: DataFrame, brain: str) -> tuple[DataFrame, DataFrame]:
    """(rules, counts): what was imported from `brain` before is replaced by what it shares now; a local rule of the same matcher wins.

    `counts` is a row (imported, pruned): matchers that are new from this brain, and those that are gone.
    """
    from_here = F.coalesce((F.col("origin") == "shared") & (F.col("shared_from") == brain), F.lit(False))
    prior, kept = rules.filter(from_here), rules.filter(~from_here)
    local = rules.filter("coalesce(origin, 'local') <> 'shared'").select(rule_key().alias("_key"))
    wanted = shared.withColumn("_key", rule_key()).filter("_key IS NOT NULL").join(local, "_key", "left_anti")
    last = rules.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last"))
    values = {"brain": F.when(~F.coalesce("deny", F.lit(False)), F.lit(brain)), "origin": F.lit("shared"), "shared_from": F.lit(brain), "ord": (F.col("_last") + 1 + F.col("ord")).cast(rules.schema["ord"].dataType)}
    put = wanted.join(F.broadcast(last)).select(*[values.get(c, F.col(c) if c in shared.columns else F.lit(None)).alias(c) for c in rules.columns])
    old_keys, new_keys = prior.select(rule_key().alias("_key")).distinct(), wanted.select("_key").distinct()
    imported = new_keys.join(old_keys, "_key", "left_anti").agg(F.count("*").alias("imported"))
    pruned = old_keys.join(new_keys, "_key", "left_anti").agg(F.count("*").alias("pruned"))
    return kept.unionByName(put), imported.join(F.broadcast(pruned))


def effective_rules(rules: DataFrame) -> DataFrame:
    return drop_shadowed(rules)


def link_sources(aliases: DataFrame, project: str, sources: list[str]) -> DataFrame:
    """(project, sources) with more sources; a project that isn't there is made. Sources are sorted."""
    new = aliases.sparkSession.createDataFrame([(project, sources)], "project string, sources array<string>")
    both = aliases.select("project", F.explode("sources").alias("s")).unionByName(new.select("project", F.explode("sources").alias("s")))
    return both.groupBy("project").agg(F.array_sort(F.collect_set("s")).alias("sources"))


def unlink_sources(aliases: DataFrame, project: str, sources: list[str]) -> DataFrame:
    """A project whose last source goes, goes as well; other projects stay as they are."""
    mine = F.col("project") == project
    left = F.array_sort(F.array_except("sources", F.array(*[F.lit(s) for s in sources]).cast("array<string>")))
    return aliases.withColumn("sources", F.when(mine, left).otherwise(F.array_sort(F.array_distinct("sources")))).filter(~mine | (F.size("sources") > 0))
