"""Settings of a knowledge base, projects that folders belong to, and the order in which they decide where a note goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import repo_slug

#: Feature flags and their defaults.
FEATURES = {"autoAdr": True, "autoPromote": True, "semanticDedup": False, "semanticSearch": True, "llmCurator": True, "contradictionGuard": False}
PROVIDERS, MODES = ("none", "local", "hosted"), ("warn", "ask")
DEDUP_LEAST, GUARD_LEAST = 0.85, 0.82


def read_config(texts: DataFrame) -> DataFrame:
    """(brain, text: a JSON object) -> (brain, name, provider, dedup_threshold, guard_mode, guard_threshold, features).

    What the file doesn't say, or says in the wrong type, has its default; a text that is no object is all defaults.
    Flags that aren't known stay as the file has them.
    """
    v = F.try_parse_json("text")
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    share = lambda path, default: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)") & F.try_variant_get(v, path, "double").between(0, 1), F.try_variant_get(v, path, "double")), F.lit(default))
    one_of = lambda path, known, default: F.coalesce(F.when(text(path).isin(*known), text(path)), F.lit(default))
    given = F.try_variant_get(v, "$.features", "map<string, variant>")
    flags = F.map_filter(given, lambda k, x: F.schema_of_variant(x) == "BOOLEAN")
    flags = F.transform_values(flags, lambda k, x: x.cast("boolean"))
    default = F.create_map(*[F.lit(x) for kv in FEATURES.items() for x in kv])
    left = F.map_filter(default, lambda k, x: ~F.coalesce(F.map_contains_key(flags, k), F.lit(False)))
    features = F.when(flags.isNull(), default).otherwise(F.map_concat(left, flags))
    return texts.select(
        "brain", F.coalesce(F.nullif(text("$.name"), F.lit("")), F.col("brain")).alias("name"), one_of("$.embeddings.provider", PROVIDERS, "local").alias("provider"), share("$.embeddings.threshold", DEDUP_LEAST).alias("dedup_threshold"),
        one_of("$.contradictionGuard.mode", MODES, "warn").alias("guard_mode"), share("$.contradictionGuard.threshold", GUARD_LEAST).alias("guard_threshold"), features.alias("features"),
    )


def feature(config: Column, name: str) -> Column:
    """False for a flag that isn't there."""
    return F.coalesce(F.element_at(config, F.lit(name)), F.lit(False))


def set_feature(config: DataFrame, name: str, value: bool) -> DataFrame:
    rest = F.map_filter("features", lambda k, x: k != name)
    return config.withColumn("features", F.map_concat(rest, F.create_map(F.lit(name), F.lit(value))))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def normal_path(path: Column) -> Column:
    """Without empty and `.` segments; `..` takes the one before away."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def same_brain(entry: Column, brain: Column) -> Column:
    """A log entry's folder is that of a brain; an empty one is of none."""
    return F.coalesce((entry != "") & (normal_path(entry) == normal_path(brain)), F.lit(False))


def synthetic_cwd(path: Column) -> Column:
    """Folders that a terminal makes up for a session."""
    return F.endswith(basename(path), F.lit("-pty-cwd"))


def project_source(path: Column, root: Column, remote: Column) -> Column:
    """owner/repo of the repository's remote, else the name of its root, else that of the folder; null for an empty path."""
    return F.when(path != "", F.coalesce(repo_slug(remote), F.when(root.isNotNull(), basename(root)), basename(path)))


def valid_project(project: Column) -> Column:
    return (project != "") & (F.length(project) <= 200) & ~project.rlike("[/\\\\\\x00-\\x1F\\x7F]")


def nearest_manifest(subjects: DataFrame, manifests: DataFrame) -> DataFrame:
    """(doc_id, path, root) and (dir, project, customer) -> subjects with the project and customer of the nearest folder above that has a valid manifest, not beyond the repository's root."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    above = subjects.select("doc_id", F.coalesce(F.length("root"), F.lit(0)).alias("least"), F.explode(dirs).alias("dir")).filter("length(dir) >= least")
    fine = manifests.filter(valid_project(F.col("project"))).select("dir", "project", F.nullif("customer", F.lit("")).alias("customer"))
    best = above.join(fine, "dir").groupBy("doc_id").agg(F.max_by(F.struct("project", "customer"), F.length("dir")).alias("m"))
    return subjects.join(best, "doc_id", "left").select(*subjects.columns, "m.project", "m.customer")


def wired_brains(rules: DataFrame, default_brain: str | None, org_brain: str | None) -> DataFrame:
    """(place, brain): every brain that a rule or the default leads to, once, in authored order; the organisation's own is left out."""
    rows = rules.filter("brain IS NOT NULL").select("ord", normal_path(F.col("brain")).alias("brain"))
    if default_brain is not None:
        rows = rows.unionByName(rules.sparkSession.range(1).select(F.lit(2_000_000_000).alias("ord"), normal_path(F.lit(default_brain)).alias("brain")))
    out = rows.groupBy("brain").agg(F.min("ord").alias("place"))
    return out.filter(F.col("brain") != normal_path(F.lit(org_brain))) if org_brain else out


def resolve_in_order(subjects: DataFrame) -> DataFrame:
    """(doc_id, marker, self_brain, rule_kind, rule_brain, env, config_state) -> (doc_id, kind, brain, stage): the first that decides.

    A marker that leads to a brain, a folder that is a brain, the rules (of which a denial and a bare allowance decide too),
    the environment, and a config that is there but doesn't parse.
    """
    by_rule = F.coalesce(F.col("rule_kind") != "unmatched", F.lit(False)) & (F.col("config_state") == "ok")
    set_ = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    stage = F.when(set_("marker"), "marker").when(set_("self_brain"), "self").when(by_rule, "rules").when(set_("env"), "env").when(F.col("config_state") == "corrupt", "corrupt").otherwise("none")
    kind = F.when(stage.isin("marker", "self", "env"), "brain").when(stage == "rules", F.col("rule_kind")).when(stage == "corrupt", "corrupt-config").otherwise("none")
    brain = F.when(stage == "marker", F.col("marker")).when(stage == "self", F.col("self_brain")).when(stage == "rules", F.col("rule_brain")).when(stage == "env", F.col("env"))
    return subjects.select("doc_id", kind.alias("kind"), brain.alias("brain"), stage.alias("stage"))


def scoped_destination(resolved: DataFrame, explicit: Column, force: bool = False) -> DataFrame:
    """(doc_id, kind, brain) -> (doc_id, destination, skip): where a capture may go, or why it doesn't.

    The resolution is the gate and an explicit brain only redirects what passes; `force` passes the gate but needs a brain.
    """
    wanted = F.nullif(explicit, F.lit(""))
    own = F.when(F.col("kind") == "brain", F.col("brain"))
    if force:
        to, skip = F.coalesce(wanted, own), F.lit("no-brain")
    else:
        to = F.when(F.col("kind") == "brain", F.coalesce(wanted, F.col("brain"))).when(F.col("kind") == "corrupt-config", wanted)
        skip = F.when(F.col("kind") == "denied", "out-of-scope").otherwise("no-brain")
    return resolved.select("doc_id", to.alias("destination"), F.when(to.isNull(), skip).alias("skip"))


def wire_folder(folders: DataFrame) -> DataFrame:
    """(doc_id, path, remote, brain) -> (doc_id, repo, prefix, brain): the rule that leads a folder to a brain, by its repository if it has one."""
    slug = repo_slug(F.col("remote"))
    return folders.select("doc_id", slug.alias("repo"), F.when(slug.isNull(), F.col("path")).alias("prefix"), "brain")


def normal_rule(rules: DataFrame) -> DataFrame:
    """(ord, matcher, brain, deny): what a rule matches, as one text; a denial has no brain."""
    matcher = F.coalesce(F.concat(F.lit("repo:"), F.lower("repo")), F.concat(F.lit("org:"), F.lower("org")), F.concat(F.lit("prefix:"), F.col("prefix")))
    return rules.filter(matcher.isNotNull()).select("ord", matcher.alias("matcher"), F.when(~F.col("deny"), F.col("brain")).alias("brain"), "deny")


def parse_matcher(token: Column) -> Column:
    """`repo:x`, `org:x`, `prefix:x` or a bare path -> a struct (kind, value)."""
    kind = F.regexp_extract(token, "^(repo|org|prefix):", 1)
    return F.struct(F.when(kind != "", kind).otherwise("prefix").alias("kind"), F.when(kind != "", F.regexp_replace(token, "^(repo|org|prefix):", "")).otherwise(token).alias("value"))
