"""Rules that route a path or repository to a brain, and projects that sources belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import stash


def rule_key() -> object:
    return F.coalesce(F.concat(F.lit("repo:"), F.lower("repo")), F.concat(F.lit("org:"), F.lower("org")), F.concat(F.lit("prefix:"), F.col("prefix")))


def drop_shadowed(rules: DataFrame) -> DataFrame:
    """Local rules win over shared ones with the same matcher."""
    keyed = rules.withColumn("key", rule_key())
    local = keyed.filter("origin <> 'shared'").select("key").distinct()
    return keyed.filter("origin <> 'shared'").unionByName(keyed.filter("origin = 'shared'").join(local, "key", "left_anti").select(*keyed.columns)).drop("key")


#: Older lists are numbered from here on, past any list that is authored rule by rule.
AFTER_AUTHORED = 1 << 40


def with_scope_lists(rules: DataFrame, allow: list[str], deny: list[str]) -> DataFrame:
    """Older allow and deny lists follow the authored rules, deny first."""
    if not allow and not deny:
        return rules
    spark = rules.sparkSession
    extra = [(AFTER_AUTHORED + i, None, None, p, None, i < len(deny), "local") for i, p in enumerate([*deny, *allow])]
    return rules.withColumn("ord", F.col("ord").cast("long")).unionByName(spark.createDataFrame(extra, "ord long, repo string, org string, prefix string, brain string, deny boolean, origin string"))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """(key, best): of all rules that match by one key the one that wins; a rule has a key for each of its matchers, a catch-all the key `*`."""
    any_ = F.greatest(*[F.coalesce((F.col(c) == "*").cast("int"), F.lit(0)) for c in ("repo", "org", "prefix")]) == 1
    owner = F.lower(F.regexp_replace("org", "/\\*$", ""))
    key = lambda kind, value, tier: F.struct(F.concat(F.lit(kind), value).alias("key"), F.lit(tier).alias("tier"), F.length(value).alias("len"))
    own = F.array(key("repo:", F.lower("repo"), 4), key("org:", F.when(owner != "", owner), 3), key("prefix:", F.col("prefix"), 2))
    catch_all = F.array(F.struct(F.lit("*").alias("key"), F.lit(1).alias("tier"), F.lit(0).alias("len")))
    keyed = rules.select(F.explode(F.when(any_, catch_all).otherwise(F.filter(own, lambda k: k["key"].isNotNull()))).alias("k"), "ord", "deny", "brain")
    best = F.struct(F.col("k.tier").alias("tier"), F.col("k.len").alias("len"), F.col("deny").cast("int").alias("deny"), (-F.col("ord").cast("long")).alias("first"), F.col("brain").alias("brain"))
    return keyed.groupBy(F.col("k.key").alias("key")).agg(F.max(best).alias("best"))


def _subject_keys() -> Column:
    """The keys by which a rule can match a subject: its repository, the repository's owner, its path and every folder above it."""
    slug_owner = F.when(F.contains("slug", F.lit("/")), F.lower(F.substring_index("slug", "/", 1)))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("prefix:"), F.array_join(F.slice(parts, 1, i), "/")))
    given = F.array(F.concat(F.lit("repo:"), F.lower("slug")), F.concat(F.lit("org:"), F.when(slug_owner != "", slug_owner)))
    return F.filter(F.concat(given, F.coalesce(above, F.array().cast("array<string>"))), lambda k: k.isNotNull())


def resolve(subjects: DataFrame, rules: DataFrame, default_brain: str | None = None) -> DataFrame:
    """(doc_id, slug, path) -> with kind (brain, denied, none, unmatched) and brain.

    The most specific rule wins: repository, organisation, longest path prefix, catch-all; a denial wins an exact tie, else
    the first authored. Subjects and rules meet by keys, of which a rule has the winner alone, so a subject meets no more rules
    than its path has folders, however many rules there are. The winning catch-all is one row.
    """
    keys = stash(_rule_keys(drop_shadowed(rules)), "routing-keys")
    asked = subjects.select("doc_id", F.explode(_subject_keys()).alias("key"))
    won = asked.join(keys.filter("key <> '*'"), "key").groupBy("doc_id").agg(F.max("best").alias("own"))
    any_ = keys.filter("key = '*'").agg(F.max("best").alias("any"))
    found = subjects.join(won, "doc_id", "left").join(F.broadcast(any_)).withColumn("best", F.coalesce("own", "any"))
    brain = F.coalesce("best.brain", F.lit(default_brain))
    kind = F.when(F.col("best").isNull(), "unmatched").when(F.col("best.deny") == 1, "denied").when(brain.isNotNull(), "brain").otherwise("none")
    return found.select("doc_id", "slug", "path", kind.alias("kind"), F.when(kind == "brain", brain).alias("brain"))


def scope_decision(resolved: DataFrame) -> DataFrame:
    write = F.col("kind") == "brain"
    why = F.when(F.col("kind") == "denied", "denied by rule").when(F.col("kind") == "none", "allowed, no destination").when(F.col("kind") == "unmatched", "no rule").otherwise("routed")
    return resolved.select("doc_id", "brain", write.alias("may_write"), why.alias("why"))


def fallback(candidates: DataFrame) -> DataFrame:
    """Of several resolutions of a subject the best kind: brain, corrupt, denied, none; the first given among equals."""
    order = F.when(F.col("kind") == "brain", 0).when(F.col("kind") == "corrupt-config", 1).when(F.col("kind") == "denied", 2).otherwise(3)
    return candidates.groupBy("doc_id").agg(F.min_by(F.struct("kind", "brain"), F.struct(order, "place")).alias("x")).select("doc_id", "x.*")


def project_of_source(alias_map: DataFrame) -> DataFrame:
    """(source, project): the first project in order that lists a source."""
    return alias_map.select("project", F.explode("sources").alias("source")).groupBy("source").agg(F.min("project").alias("project"))


def resolve_project(notes: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Declared project, else the alias map's, else the source, else null."""
    aliased = project_of_source(alias_map).select(F.col("source").alias("_s"), F.col("project").alias("_p"))
    return notes.join(aliased, F.col("source") == F.col("_s"), "left").withColumn("resolved", F.coalesce(F.nullif(F.trim("project"), F.lit("")), "_p", F.nullif("source", F.lit("")))).drop("_s", "_p")


def adopt(notes: DataFrame, alias_map: DataFrame, project: str) -> DataFrame:
    """Notes of the project's sources: adopted where no other project is declared, else in conflict."""
    own = alias_map.filter(F.col("project") == project).select(F.explode("sources").alias("source"))
    mine = notes.join(own, "source", "left_semi")
    declared = F.nullif(F.trim("project"), F.lit(""))
    state = F.when(declared.isNull(), "adopted").when(declared == project, "already").otherwise("conflict")
    return mine.withColumn("state", state).withColumn("new_project", F.when(state == "conflict", F.col("project")).otherwise(F.lit(project))).withColumn("new_tags", F.when(state == "adopted", F.array_union("tags", F.array(F.lit(f"project:{project}")))).otherwise(F.col("tags")))


def retire(adopted: DataFrame, alias_map: DataFrame, project: str) -> DataFrame:
    """The alias map after an adoption: sources of the project without a conflict need no entry any more, and a project without sources goes."""
    stuck = adopted.filter("state = 'conflict'").select("source").distinct()
    rows = alias_map.select("project", F.explode("sources").alias("source"))
    kept = rows.filter(F.col("project") != project).unionByName(rows.filter(F.col("project") == project).join(stuck, "source", "left_semi").select("project", "source"))
    return kept.groupBy("project").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def adopt_counts(notes: DataFrame, staged: DataFrame, alias_map: DataFrame, project: str) -> DataFrame:
    """`adopt_report` with what waits of each source."""
    waiting = staged.groupBy("source").agg(F.count("*").alias("staged"))
    return adopt_report(adopt(notes, alias_map, project), alias_map, project).join(waiting, "source", "left").withColumn("staged", F.coalesce("staged", F.lit(0)))


def adopt_report(adopted: DataFrame, alias_map: DataFrame, project: str) -> DataFrame:
    sources = alias_map.filter(F.col("project") == project).select(F.explode("sources").alias("source"))
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    counts = adopted.groupBy("source").agg(n("adopted").alias("adopted"), n("conflict").alias("conflict"))
    return sources.join(counts, "source", "left").select("source", F.coalesce("adopted", F.lit(0)).alias("adopted"), F.coalesce("conflict", F.lit(0)).alias("conflict"))
