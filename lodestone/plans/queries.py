"""The knowledge-base queries over the given tables: each one an operator at work."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import scalars
from lodestone.operators import capture, clusters, coverage, curation, health, index, listings, routing, search, secrets, similarity, staging
from lodestone.plans import settings as S
from lodestone.plans.oracles import ORACLES
from lodestone.session import shared_folder, stash
from lodestone.sources import files
from lodestone.sources import knowledge as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    found = K.vectors(spark, d).filter(F.col("id") == S.SEMANTIC_ID).select("vec").first()
    return list(found["vec"]) if found else []


@query
def lexical_search(spark, d):
    return search.search_lexical(K.notes(spark, d), S.QUERY).select("id", "kind", "title", "path", "n_match", F.round("score", 6).alias("score"))


_built: dict[tuple[str, str, str], str] = {}


def kept_index(spark, d, name: str, build: Callable[[str], object]) -> str:
    """The folder of an index over the given tables: built once an application, as such an index is kept, then looked up."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _built:
        folder = f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
        build(folder)
        _built[at] = folder
    return _built[at]


@query
def lexical_search_indexed(spark, d):
    return index.search(spark, kept_index(spark, d, "index", lambda folder: index.build(K.notes(spark, d), folder)), S.QUERY).select("id", "kind", "title", "path", "n_match", F.round("score", 6).alias("score"))


@query
def index_after_changes(spark, d):
    """A third of the notes come later, a tenth are edited, a seventh go, and the segments are merged."""
    notes, folder = K.notes(spark, d), f"{shared_folder(spark)}/lodestone/index-{uuid.uuid4().hex}"
    index.build(notes.filter("doc_id % 3 <> 0"), folder)
    index.update(spark, folder, notes.filter("doc_id % 3 = 0"))
    index.update(spark, folder, notes.filter("doc_id % 10 = 1").withColumn("title", F.concat(F.lit("thor "), "title")), notes.filter("doc_id % 7 = 2 AND doc_id % 10 <> 1").select("id"))
    index.merge(spark, folder, 3)
    return index.search(spark, folder, S.QUERY).select("id", "title", "n_match", F.round("score", 6).alias("score"))


@query
def lexical_or_fallback(spark, d):
    # a term that no note holds makes the match fall back to any term
    found = search.lexical(K.notes(spark, d), S.QUERY + " zzqqxxunseen")
    return found.select("id", "n_match", F.round("score", 6).alias("score"))


@query
def semantic_topk(spark, d):
    return search.semantic(K.notes(spark, d), K.vectors(spark, d), _query_vector(spark, d)).select("id", "title", F.round("similarity", 6).alias("similarity"))


def _hybrid(spark, d, limit, **options):
    return search.hybrid(K.notes(spark, d), K.vectors(spark, d), S.QUERY, _query_vector(spark, d), limit, **options)


@query
def hybrid_rrf(spark, d):
    return _hybrid(spark, d, 20).select("id", "kind", "title", "path", F.round("score", 9).alias("score"))


@query
def hybrid_diagnostics(spark, d):
    return search.hybrid(K.notes(spark, d), K.vectors(spark, d), S.QUERY, _query_vector(spark, d), 60).select("id", "lexical_rank", "semantic_rank", F.round("score", 9).alias("rrf_score"), "tier")


@query
def hybrid_strict(spark, d):
    return _hybrid(spark, d, 60, min_support=1).select("id", F.round("score", 9).alias("score"))


def _ranked(spark, d, limit):
    hits = search.search_lexical(K.notes(spark, d), S.QUERY, limit)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*search.fresh_first())))


@query
def ask_budget(spark, d):
    return search.ask(_ranked(spark, d, 20), K.notes(spark, d), S.ASK_CHARS, S.QUERY).select("rank", "id", "title", "excerpt", "used")


@query
def ask_coverage(spark, d):
    return search.coverage_signal(_ranked(spark, d, 8)).withColumn("top_score", F.round("top_score", 6))


@query
def context_default(spark, d):
    return search.default_context(K.notes(spark, d), 60)


@query
def who_is(spark, d):
    return search.who_is(K.notes(spark, d), S.WHO).select("id", "title")


@query
def work_state_active(spark, d):
    return K.notes(spark, d).filter("kind = 'work-state' AND status <> 'done'").select("id", "status", "title")


@query
def jaccard_pairs(spark, d):
    sets = K.table(spark, d, "documents").select(F.col("doc_id").alias("id"), similarity.token_set(F.col("text")).alias("tokens"))
    return similarity.similar_classes(sets).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query
def neighbors_lexical(spark, d):
    c = similarity.token_sets(K.table(spark, d, "benchmark"), "item_id", "text")
    docs = similarity.token_sets(K.table(spark, d, "documents"), "doc_id", "text")
    return similarity.neighbours_lexical(c, docs).withColumn("score", F.round("score", 9))


def _asked():
    return F.substring("id", 2, 18).cast("long") % S.ASK_EVERY == 0


@query
def neighbors_vector(spark, d):
    v = K.vectors(spark, d)
    return similarity.neighbours_by_vector(v.filter(_asked()), v).withColumn("score", F.round("score", 6))


@query
def semantic_duplicates(spark, d):
    v = K.vectors(spark, d)
    in_canon = v.join(K.canon(K.notes(spark, d)).select("id"), "id", "left_semi")
    return similarity.neighbours_by_vector(v.filter(_asked()), in_canon, 1, S.COSINE_LEAST).select("candidate", "neighbour", F.round("score", 6).alias("score"))


@query
def curate_gate(spark, d):
    return curation.gate(K.candidates(K.notes(spark, d))).select("id", "reason")


@query
def curate_greedy_batch(spark, d):
    docs = K.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), "text")
    return curation.greedy_dedup(docs)


@query
def contradiction_check(spark, d):
    return curation.contradiction_check(K.notes(spark, d), K.vectors(spark, d), _query_vector(spark, d), S.COSINE_LEAST).withColumn("score", F.round("score", 6))


@query
def consolidate_clusters(spark, d):
    return clusters.consolidation_clusters(K.notes(spark, d))


@query
def consolidate_plan(spark, d):
    return clusters.consolidation_plan(K.notes(spark, d))


@query
def supersede_apply(spark, d):
    notes = K.notes(spark, d)
    return capture.supersede(notes, clusters.consolidation_plan(notes)).select("id", "status", "superseded_by")


def _graduated(spark, d):
    notes = K.notes(spark, d)
    found = clusters.recurrence_clusters(notes, K.vectors(spark, d), S.RECUR_COSINE)
    return clusters.graduation_candidates(notes, found)


@query
def graduate_candidates(spark, d):
    return _graduated(spark, d)


@query
def graduate_suppressed(spark, d):
    # read twice
    found = stash(_graduated(spark, d), "graduated")
    tombstones = found.select("cluster_key").filter(F.substring("cluster_key", 1, 1).isin(*"0369cf"))
    return clusters.suppress(found, tombstones)[0].select("cluster_key")


def _plan(spark, d):
    notes = K.notes(spark, d)
    return curation.verdict_plan(K.verdicts(notes), K.canon(notes))


@query
def verdict_plan(spark, d):
    return _plan(spark, d).withColumn("tags", F.array_join("tags", ","))


@query
def capture_outcomes(spark, d):
    return curation.capture_outcomes(_plan(spark, d))


@query
def brain_map_kinds(spark, d):
    return health.kind_counts(K.notes(spark, d))


@query
def brain_map_contributors(spark, d):
    return health.contributor_counts(K.notes(spark, d))


@query
def health_buckets(spark, d):
    return health.buckets(health.flags(K.notes(spark, d), K.TODAY))


@query
def health_score(spark, d):
    return health.score(health.flags(K.notes(spark, d), K.TODAY))


@query
def health_by_project(spark, d):
    return health.score(health.flags(K.notes(spark, d), K.TODAY, group="source"), "source")


def _windows(spark, d):
    return coverage.windows(K.capture_log(spark, d), K.brains(spark), K.LOG_NOW)


@query
def coverage_windows(spark, d):
    return _windows(spark, d).select("brain", "short_seen", "short_productive", "long_seen", "long_productive", F.round("short_ratio", 9).alias("short_ratio"), F.round("long_ratio", 9).alias("long_ratio"))


@query
def coverage_trend(spark, d):
    return _windows(spark, d).select("brain", "trend", "has_data", F.round("prior_ratio", 9).alias("prior_ratio"))


@query
def coverage_gate(spark, d):
    return coverage.gate_failed(_windows(spark, d), 0.5).select("brain", "failed")


@query
def failure_breakdown(spark, d):
    return coverage.failure_breakdown(K.capture_log(spark, d), K.LOG_NOW)


@query
def last_failure(spark, d):
    return coverage.last_failure(K.capture_log(spark, d), K.LOG_NOW)


@query
def failure_streak(spark, d):
    return coverage.severity(coverage.failure_streak(K.capture_log(spark, d)))


@query
def caplog_rolling_cap(spark, d):
    size = F.length("outcome") + F.length(F.coalesce("reason", F.lit(""))) + 40
    return coverage.rolling_cap(K.capture_log(spark, d), size, most_bytes=20_000).select("brain", "log_ord", "outcome", "used")


def _routed(spark, d):
    rules = routing.with_scope_lists(K.rules(spark), S.ALLOW, S.DENY)
    return routing.resolve(K.route_subjects(spark, d), rules, "brain-default")


@query
def route_resolution(spark, d):
    return _routed(spark, d)


@query
def scope_decision(spark, d):
    return routing.scope_decision(_routed(spark, d))


@query
def project_identity(spark, d):
    return routing.resolve_project(K.notes(spark, d), K.alias_map(spark)).select("id", "resolved")


@query
def adopt_report(spark, d):
    aliases = K.alias_map(spark)
    return routing.adopt_report(routing.adopt(K.notes(spark, d), aliases, "eng-a"), aliases, "eng-a")


@query
def adopt_notes(spark, d):
    return routing.adopt(K.notes(spark, d), K.alias_map(spark), "eng-a").select("id", "state", F.array_join("new_tags", ",").alias("tags"))


@query
def verify_checks(spark, d):
    return health.verify(K.notes(spark, d), secrets.has_secret(F.col("body")))


@query
def dangling_refs(spark, d):
    return health.dangling(K.notes(spark, d))


@query
def duplicate_ids(spark, d):
    notes = K.notes(spark, d)
    return health.duplicate_ids(notes.unionByName(notes.filter("doc_id % 50 = 0")))


@query
def reconcile_promoted(spark, d):
    notes = K.notes(spark, d)
    return capture.reconcile(notes.filter("doc_id % 5 = 0"), notes.filter("doc_id % 5 <> 0 OR doc_id % 10 = 0")).select("id", "state")


@query
def staged_pending(spark, d):
    return K.notes(spark, d).filter("doc_id % 5 = 0").groupBy("brain").agg(F.count("*").alias("pending"))


@query
def resource_listing(spark, d):
    return health.resource_listing(K.notes(spark, d))


@query
def secret_scan(spark, d):
    return secrets.scan(K.table(spark, d, "documents"), "text", generic=True).select("doc_id", F.array_join("kinds", ",").alias("kinds"))


@query
def secret_withheld(spark, d):
    staged = K.notes(spark, d).filter("doc_id % 5 = 0")
    return secrets.withhold(staged, "body", generic=True).groupBy("brain", "withheld").agg(F.count("*").alias("n"))


@query
def transcript_compact(spark, d):
    return capture.compact(K.transcripts(spark, d))


@query
def transcript_dedup(spark, d):
    return capture.first_seen(K.transcripts(spark, d))


@query
def transcript_tail_cap(spark, d):
    return capture.tail_cap(K.transcripts(spark, d), S.TAIL_BYTES).select("conv_id", "line_no", "used")


@query
def commit_mining(spark, d):
    return capture.mine_commits(K.commits(K.notes(spark, d)))


@query
def scalars_text(spark, d):
    return K.notes(spark, d).select(
        "id", scalars.slugify(F.col("title")).alias("slug"), scalars.gist(F.col("body")).alias("gist"), scalars.inline_text(F.col("title")).alias("inline_title"),
        scalars.excerpt(F.col("body")).alias("excerpt"), scalars.days_between(F.lit(K.TODAY), F.coalesce("verified", "updated", "created")).alias("age"),
    )


@query
def scalars_path(spark, d):
    return K.table(spark, d, "pages").select("page_id", F.coalesce(scalars.repo_slug(F.col("url")), F.lit("")).alias("slug"))


@query
def scalars_identity(spark, d):
    key = scalars.identity_key(F.lit(None).cast("string"), F.col("c_name"))
    return K.table(spark, d, "customer").select("c_custkey", key.alias("identity"), scalars.contributor_id(F.col("c_name"), key).alias("contributor"))


@query
def router_render(spark, d):
    notes = routing.resolve_project(K.notes(spark, d), K.alias_map(spark))
    return listings.router(notes, F.col("resolved"))


@query
def emit_context(spark, d):
    return capture.emit_context(K.notes(spark, d))


@query
def notes_parsed(spark, d):
    parsed = files.parse_notes(files.render_notes(K.notes(spark, d)))
    return parsed.select("path", "id", "kind", "title", "status", "superseded_by", F.array_join("tags", ",").alias("tags"), F.array_join("relates", ",").alias("relates"), F.length("body").alias("chars"), "error")


@query
def transcript_parse(spark, d):
    turns = K.table(spark, d, "conversations")
    lines = turns.select("conv_id", F.col("turn").alias("line_no"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("json"))
    return files.transcript_lines(lines).select("conv_id", "line_no", "line")


@query
def staging_approve(spark, d):
    notes = K.notes(spark, d)
    promoted, left, _ = staging.approve(notes.filter("doc_id % 5 = 0"), notes.filter("doc_id % 10 = 0").select("id"))
    return promoted.select("id", F.lit("canon").alias("layer"), "path").unionByName(left.select("id", F.lit("staged").alias("layer"), "path"))


# the queries of the other module register themselves
from lodestone.plans import team_oracles, team_queries  # noqa: E402, F401

ORACLES.update(team_oracles.ORACLES)
