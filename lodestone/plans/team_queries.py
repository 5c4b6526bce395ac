"""Queries of capture, attribution, settings, reports and renderings over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import scalars
from lodestone.operators import attribution, buckets, capture, clusters, coverage, flow, health, listings, render, routing, search, secrets, set_join, similarity, staging
from lodestone.plans import settings as S
from lodestone.plans import team_fixtures as T
from lodestone.plans.queries import _query_vector, kept_index, query
from lodestone.session import shared_folder, stash
from lodestone.sources import files, replies
from lodestone.sources import knowledge as K
from lodestone.sources import settings_files as config


def table(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """A fixture: one SELECT over one of the given tables."""
    name = sql.rsplit(" FROM ", 1)[1].split()[0]
    return spark.sql(sql.replace(f" FROM {name}", f" FROM parquet.`{d}/{name}.parquet`"))


def _hits(spark, d, limit=20):
    hits = search.search_lexical(K.notes(spark, d), S.QUERY, limit)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*search.fresh_first())))


@query
def snippet(spark, d):
    return search.with_snippets(_hits(spark, d), K.notes(spark, d), S.QUERY).select("rank", "id", "excerpt")


def _context(spark, d):
    return search.query_context(K.notes(spark, d), K.vectors(spark, d), S.QUERY, _query_vector(spark, d))


@query
def context_query(spark, d):
    return _context(spark, d).select("rank", "id", "kind", "title", "tier")


@query
def context_render(spark, d):
    return render.context_text(_context(spark, d))


@query
def recall_diagnostics(spark, d):
    return render.diagnostics_lines(_context(spark, d))


@query
def retrieval_without_vectors(spark, d):
    return search.retrieve(K.notes(spark, d), None, S.QUERY, None).select("id", "lexical_rank", "tier", F.round("score", 6).alias("score"))


@query
def answer_render(spark, d):
    return render.answer(search.with_snippets(_hits(spark, d, 8), K.notes(spark, d), S.QUERY), S.QUERY)


@query
def who_is_named(spark, d):
    return search.who_is(K.notes(spark, d).withColumn("name", F.concat(F.lit("Name of "), "author")), "of USER3").select("id", "name")


def _identities(spark, d):
    return attribution.with_identity(table(spark, d, T.IDENTITIES))


@query
def contributor_match(spark, d):
    return attribution.find_people(_identities(spark, d), table(spark, d, T.PEOPLE)).select("ident", "name", "email", "key", "person")


@query
def contributor_ensure(spark, d):
    return attribution.ensure_people(_identities(spark, d), table(spark, d, T.PEOPLE))[0]


@query
def contributor_new_people(spark, d):
    return attribution.ensure_people(_identities(spark, d), table(spark, d, T.PEOPLE))[1].select("id", "kind", "title", "name", "attribution_key", F.array_join("tags", ",").alias("tags"))


def _sessions(spark, d):
    """Candidates with the number of the contributor whose session they come from."""
    return K.candidates(K.notes(spark, d)).withColumn("ident", F.col("doc_id") % 150)


@query
def attribute_candidates(spark, d):
    found = attribution.find_people(_identities(spark, d), table(spark, d, T.PEOPLE))
    who = found.withColumn("person", F.coalesce("person", attribution.person_id(F.col("name"), F.col("key"))))
    return attribution.attribute(_sessions(spark, d), who).select("id", "author", "author_ref", F.array_join("relates", ",").alias("relates"))


@query
def stamp_candidates(spark, d):
    rows = K.candidates(K.notes(spark, d)).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")))
    customer = F.when(F.col("doc_id") % 2 == 1, "Big Corp")
    return attribution.stamp(rows, F.lit("session"), F.lit("eng-x"), customer).select("id", "source", "project", F.array_join("tags", ",").alias("tags"))


@query
def extraction_replies(spark, d):
    loose, strict = replies.extraction(table(spark, d, T.REPLIES)), replies.extraction(table(spark, d, T.REPLIES), strict=True)
    return loose.select("reply", "ok", F.size("candidates").alias("n")).join(strict.select("reply", F.col("ok").alias("ok_strict")), "reply").withColumn("n", F.when(F.col("ok"), F.col("n")))


@query
def extraction_candidates(spark, d):
    return replies.candidates_of(replies.extraction(table(spark, d, T.REPLIES))).select("reply", "index", "kind", "title", "body", F.array_join("tags", ",").alias("tags"))


@query
def classifier_verdicts(spark, d):
    return replies.verdicts(table(spark, d, T.VERDICT_REPLIES))


@query
def verdict_join(spark, d):
    asked = table(spark, d, T.VERDICT_REPLIES).select("reply", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("index"))
    return replies.annotate(asked, replies.verdicts(table(spark, d, T.VERDICT_REPLIES))).select("reply", "index", "judge", "consolidation", "target_id")


@query
def receipt_lines(spark, d):
    return replies.capture_lines(table(spark, d, T.OUTPUTS))


@query
def verdict_clauses(spark, d):
    found = replies.verdict_summary(table(spark, d, T.OUTPUTS))
    return found.select("reply", render.verdict_clause(*[F.col(c) for c in ("superseded", "contradicted", "trivia", "duplicate", "clamped")]).alias("clause"))


@query
def capture_receipts(spark, d):
    notes = K.notes(spark, d).filter("doc_id % 5 = 0").select((F.col("doc_id") % 40).alias("run"), "title", (F.col("doc_id") % 80 < 40).alias("promoted"), F.col("doc_id").alias("place"))
    return render.receipt(notes)


def _captured(spark, d):
    notes = K.notes(spark, d)
    verdicts = K.verdicts(notes).select("id", "judge", "consolidation", "target_id", "neighbor_ids")
    candidates = K.candidates(notes).join(verdicts, "id")
    waiting = notes.filter("doc_id % 4 <> 3 AND doc_id % 5 = 0")
    return candidates, notes.filter("doc_id % 4 <> 3 AND doc_id % 5 <> 0"), waiting


def _existing(spark, d, name, canon, waiting):
    return set_join.open_index(spark, kept_index(spark, d, name, lambda folder: flow.existing_index(canon, waiting, folder)))


@query
def capture_flow(spark, d):
    candidates, canon, waiting = _captured(spark, d)
    return flow.capture(candidates, canon, waiting, index=_existing(spark, d, "existing-sets", canon, waiting)).select("id", "outcome", "reason", "duplicate_of", "supersedes", "contradicts", "clamped", F.array_join("tags", ",").alias("tags"))


@query
def capture_applied(spark, d):
    candidates, canon, waiting = _captured(spark, d)
    outcome = flow.capture(candidates, canon, waiting, auto_promote=False, index=_existing(spark, d, "existing-sets", canon, waiting))
    after, staged = flow.apply_capture(canon, waiting, candidates, outcome)
    return after.select(F.lit("canon").alias("layer"), "id", "status").unionByName(staged.select(F.lit("staged").alias("layer"), "id", "status"))


@query
def remember_note(spark, d):
    notes = K.notes(spark, d)
    canon, waiting = notes.filter("doc_id % 4 <> 3"), notes.filter("false")
    return flow.remember(notes.filter("doc_id = 3"), canon, waiting)


@query
def log_entries(spark, d):
    runs = table(spark, d, T.RUNS).withColumn("promoted_flags", F.transform(F.sequence(F.lit(1), F.col("captured") + 1), lambda i: (F.col("run") + i) % 2 == 0))
    return flow.log_entry(runs.withColumn("promoted_flags", F.slice("promoted_flags", 1, F.col("captured"))))


@query
def capture_line_text(spark, d):
    kind = F.col("run") % 5
    outcome = F.when(kind == 0, "extraction-failed").when(kind == 1, "skipped").when(kind == 2, "curate-failed").when(kind == 3, "ok").otherwise("odd")
    reason = F.when(F.col("run") % 2 == 0, "extractor-timeout")
    n = F.col("captured")
    line = render.capture_line(outcome, reason, n, F.when(F.col("run") % 3 == 0, n), F.when(F.col("run") % 3 != 0, n), F.col("extracted"), F.when(F.col("run") % 13 != 0, F.col("seconds")))
    return table(spark, d, T.RUNS).select("run", line.alias("line"), render.fix_hint(reason, S.HINTS).alias("hint"), scalars.human_age(F.col("seconds")).alias("age"))


@query
def guard_calls(spark, d):
    return flow.guarded(table(spark, d, T.CALLS), F.lit(True), F.col("call") % 5 != 0).select("call", "summary")


@query
def config_load(spark, d):
    read = config.read_config(table(spark, d, T.CONFIGS))
    return config.set_feature(read, "llmCurator", False).select("brain", "name", "provider", "dedup_threshold", "guard_mode", "guard_threshold", *[config.feature(F.col("features"), k).alias(f"is_{k}") for k in (*config.FEATURES, "extra", "unknown")])


@query
def project_sources(spark, d):
    return table(spark, d, T.FOLDERS).select("doc_id", config.project_source(F.col("path"), F.col("root"), F.col("remote")).alias("source"))


@query
def project_manifests(spark, d):
    found = config.nearest_manifest(table(spark, d, T.FOLDERS).select("doc_id", "path", "root"), table(spark, d, T.MANIFESTS).dropDuplicates(["dir"]).filter("dir <> ''"))
    return found.select("doc_id", "project", attribution.customer_tag(F.col("customer")).alias("tag"))


def _resolved(spark, d):
    return config.resolve_in_order(table(spark, d, T.FOLDERS))


@query
def brain_resolution(spark, d):
    return _resolved(spark, d)


@query
def scoped_destination(spark, d):
    explicit = F.when(F.col("doc_id") % 2 == 0, "/brains/asked")
    rows = _resolved(spark, d)
    forced = config.scoped_destination(rows, explicit, force=True).select("doc_id", F.col("destination").alias("forced"))
    return config.scoped_destination(rows, explicit).join(forced, "doc_id")


@query
def resolution_fallback(spark, d):
    """The folders of a session in turn; the best resolution among five of them."""
    rows = _resolved(spark, d).withColumn("place", F.col("doc_id")).withColumn("doc_id", F.floor(F.col("doc_id") / 5))
    return routing.fallback(rows).select("doc_id", "kind", "brain")


@query
def wire_folders(spark, d):
    return config.wire_folder(table(spark, d, T.FOLDERS).withColumn("brain", F.lit("/brains/new")))


@query
def wired_brains(spark, d):
    return config.wired_brains(K.rules(spark), "/brains/../default", "/brain-shared")


@query
def rule_projection(spark, d):
    rules = config.normal_rule(K.rules(spark))
    parsed = config.parse_matcher(F.col("matcher"))
    return rules.select("ord", "matcher", "brain", "deny", parsed["kind"].alias("kind"), parsed["value"].alias("value"))


@query
def note_resources(spark, d):
    return render.note_resource(K.notes(spark, d)).select("id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("chars"))


@query
def kind_listings(spark, d):
    return listings.kind_listing(K.notes(spark, d))


@query
def folder_listings(spark, d):
    return listings.folder_listing(K.notes(spark, d))


@query
def brain_map_resources(spark, d):
    rows = health.map_listing(K.notes(spark, d))
    return rows.withColumn("uri", render.resource_uri(F.lit("b"), F.col("kind"), F.col("id")))


@query
def brain_statuses(spark, d):
    notes = K.notes(spark, d)
    found = health.brain_status(health.flags(notes, K.TODAY, group="brain"), notes.filter("doc_id % 5 = 0 AND brain <> 'brain1'"))
    return found.withColumn("line", render.status_line(F.col("brain"), F.col("score"), F.col("pending"), F.col("brain") == "brain2"))


@query
def health_by_resolved_project(spark, d):
    notes = routing.resolve_project(K.notes(spark, d), K.alias_map(spark)).withColumn("label", F.coalesce("resolved", F.lit("(unattributed)")))
    scored = health.score(health.flags(notes, K.TODAY, group="label"), "label")
    return scored.withColumn("place", F.row_number().over(Window.orderBy(*render.label_order(F.col("label")))))


@query
def index_freshness(spark, d):
    notes = K.notes(spark, d)
    changed = F.coalesce("updated", "created")
    return health.index_freshness(notes, changed, health.signature(notes.filter("doc_id > 0"), changed))


@query
def verify_report(spark, d):
    notes = K.notes(spark, d)
    broken = F.when(F.col("doc_id") % 40 == 1, F.regexp_replace("text", "kind: '[a-z-]*'", "kind: 'odd'")).otherwise(F.col("text"))
    parsed = files.parse_notes(files.render_notes(notes, "doc_id").select("path", broken.alias("text")))
    now, old = listings.folder_listing(notes), listings.folder_listing(notes.filter("doc_id <> 1 AND kind <> 'person'"))
    checks = health.report(notes, secrets.has_secret(F.col("body")), parsed, old, now)
    whole = health.overall(checks).select(F.lit("overall").alias("check_name"), F.col("checks").alias("findings"), "ok")
    return checks.unionByName(whole)


@query
def recovery_point(spark, d):
    commits = K.table(spark, d, "events").select("ts")
    checks = health.verify(K.notes(spark, d).filter("doc_id < 0"), F.lit(False))
    return health.recovery_point(commits, F.lit(K.LOG_NOW).cast("timestamp"), checks).select("seconds", "ok")


@query
def pending_annotations(spark, d):
    plan = K.verdicts(K.notes(spark, d))
    as_list = lambda r: F.when(F.col("consolidation") == r, F.array(F.trim("target_id")))
    return plan.select("id", render.pending_note(as_list("contradicts"), as_list("supersedes")).alias("note"))


@query
def contradiction_payloads(spark, d):
    n = K.notes(spark, d).filter("kind = 'decision'")
    told = render.contradiction_payload(F.col("id"), F.when(F.col("doc_id") % 2 == 0, F.col("title")), F.col("path"), F.when(F.col("doc_id") % 4 == 2, "ask").otherwise("warn"))
    return n.select("id", told["context"].alias("context"), told["decision"].alias("decision"), told["reason"].alias("reason"))


@query
def sync_lines(spark, d):
    r = table(spark, d, T.RUNS)
    withheld = F.when(F.col("run") % 4 == 0, F.array(F.lit("a.md"), F.lit("b.md"))).otherwise(F.array().cast("array<string>"))
    yes = lambda m: F.col("run") % m == 0
    return r.select("run", render.sync_summary(yes(2), yes(3), yes(5), F.col("captured"), yes(7), withheld).alias("line"))


@query
def promotion_texts(spark, d):
    return render.promotion_text(K.notes(spark, d).filter("doc_id % 5 = 0"))


@query
def coverage_text(spark, d):
    return render.coverage_lines(coverage.windows(K.capture_log(spark, d), K.brains(spark), K.LOG_NOW))


@query
def contributor_bars(spark, d):
    return render.bars(health.contributor_counts(K.notes(spark, d)), "n")


@query
def managed_block(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("mine\n\n\n\n<!-- BEGIN TEAM BRAIN -->\nold\n<!-- END TEAM BRAIN -->\nafter "), F.col("id"))).when(F.col("doc_id") % 3 == 1, F.concat("id", F.lit(" text\n\n"))).otherwise("")
    return K.notes(spark, d).select("id", render.upsert_block(text, F.concat(F.lit("block of "), F.col("id"), F.lit("\n\n"))).alias("text"))


def _fake_embedder(text):
    """Deterministic: length, words, and the first letter's code."""
    return F.array(F.length(text).cast("double"), F.size(F.split(text, " ")).cast("double"), F.ascii(text).cast("double"))


@query
def embedding_rows(spark, d):
    return flow.embedded(K.notes(spark, d), _fake_embedder).select("id", *[F.col("vec")[i].alias(f"v{i}") for i in range(3)])


@query
def agent_configs(spark, d):
    return files.config_candidates(table(spark, d, T.REPO_FILES)).select("path", "kind", "title", "body", F.array_join("tags", ",").alias("tags"))


@query
def seed_preview(spark, d):
    configs = files.config_candidates(table(spark, d, T.REPO_FILES))
    commits = capture.mine_commits(K.commits(K.notes(spark, d))).withColumn("tags", F.split("tags", ","))
    return files.seed_counts(files.seed_candidates(config=configs, git=commits), ("adr", "config", "git"))


@query
def framed_commits(spark, d):
    commits, folder = K.commits(K.notes(spark, d)), f"{shared_folder(spark)}/lodestone/log-{uuid.uuid4().hex}"
    record = F.concat(F.lit("\n"), "subject", F.lit("\x1f"), F.lit("body of "), F.col("ord").cast("string"))
    commits.filter("subject IS NOT NULL").select(record.alias("value")).write.option("lineSep", "\x1e").text(folder)
    return files.framed_commits(files.read_records(spark, folder)).select("subject", "body")


@query
def rules_states(spark, d):
    text = F.when(F.col("n_nationkey") % 4 == 0, '{"rules":[]}').when(F.col("n_nationkey") % 4 == 1, "[1]").when(F.col("n_nationkey") % 4 == 2, "{oops")
    return files.rules_state(K.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), text.alias("text")))


@query
def note_keys(spark, d):
    return K.notes(spark, d).select("id", scalars.note_key(F.col("created"), F.col("title"), F.col("id")).alias("key"), scalars.first_line(F.col("body")).alias("first"))


@query
def log_of_brain(spark, d):
    entry = F.concat(F.lit("/brains/./"), F.col("brain"), F.when(F.col("log_ord") % 2 == 0, "/x/../").otherwise(""))
    rows = K.capture_log(spark, d).withColumn("folder", F.when(F.col("log_ord") % 7 == 0, "").otherwise(entry))
    return rows.filter(config.same_brain(F.col("folder"), F.lit("/brains/brain1/"))).select("log_ord", "folder", config.synthetic_cwd(F.concat(F.lit("/t/"), "brain", F.when(F.col("log_ord") % 2 == 0, "-pty-cwd").otherwise(""))).alias("made_up"))


@query
def scannable_files(spark, d):
    path = F.when(F.col("doc_id") % 5 == 0, "INDEX.md").when(F.col("doc_id") % 5 == 1, F.regexp_replace("path", "md$", "txt")).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("a/"), "path")).otherwise(F.regexp_replace("path", "^[a-z-]+", "other"))
    rows = K.notes(spark, d).select("id", path.alias("file"))
    return rows.filter(secrets.scannable(F.col("file"), tuple(K.KIND_FOLDERS.values())))


@query
def point_reads(spark, d):
    notes = K.notes(spark, d)
    inside = render.point_read(notes, "memory/n00000001.md")
    return inside.unionByName(render.point_read(notes, "../memory/n00000002.md")).unionByName(render.point_read(notes, "/memory/n00000003.md")).select("id", "path")


@query
def nearest_verdict(spark, d):
    c = similarity.token_sets(K.table(spark, d, "benchmark"), "item_id", "text")
    docs = similarity.token_sets(K.table(spark, d, "documents"), "doc_id", "text")
    return flow.nearest_duplicate(similarity.neighbours_lexical(c, docs)).withColumn("score", F.round("score", 9))


@query
def suppressed_count(spark, d):
    notes = K.notes(spark, d)
    # read three times
    found = stash(clusters.graduation_candidates(notes, clusters.recurrence_clusters(notes, K.vectors(spark, d), S.RECUR_COSINE)), "graduated")
    tombstones = found.select("cluster_key").filter(F.substring("cluster_key", 1, 1).isin(*"0369cf"))
    gone = found.join(tombstones, "cluster_key", "left_semi").agg(F.count("*").alias("suppressed"))
    return gone.join(F.broadcast(found.agg(F.count("*").alias("with_rejected"))))


@query
def staging_created(spark, d):
    notes = K.notes(spark, d)
    new = notes.filter("doc_id % 6 = 0").unionByName(notes.filter("doc_id % 12 = 0"))
    made, refused = staging.create(new, notes.filter("doc_id % 18 = 0"))
    return made.select("id", F.lit("created").alias("state")).unionByName(refused.select("id", F.lit("refused").alias("state")))


def _graduates(spark, d):
    refs = F.when(F.col("doc_id") % 15 == 0, F.array(F.concat("source", F.lit("/"), "id"), F.lit("x/y"))).otherwise(F.array().cast("array<string>"))
    return K.notes(spark, d).filter("doc_id % 5 = 0").withColumn("graduated_from", refs)


@query
def staging_rejected(spark, d):
    staged = _graduates(spark, d)
    empty = staging.tombstones_of(staged.filter("false"))
    left, stones = staging.reject(staged, staged.filter("doc_id % 10 = 0").select("id"), empty)
    return left.select(F.lit("left").alias("what"), F.col("id").alias("key")).unionByName(stones.select(F.lit("tombstone").alias("what"), F.col("cluster_key").alias("key")))


@query
def staging_reassigned(spark, d):
    staged = K.notes(spark, d).filter("doc_id % 5 = 0").withColumn("author_ref", F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string"))).withColumn("relates", F.array_union("relates", F.array("author_ref")))
    moved = spark.createDataFrame([("p0", "q0"), ("p2", "q2")], "predicted string, actual string")
    return staging.reassign(staged, moved).select("id", "author_ref", F.array_join("relates", ",").alias("relates"))


_NEW_RULES = [(0, "ORG1/repo1", None, None, "b-new", False, "local"), (1, None, None, "/work/t9", "b-t9", False, "local"), (2, None, None, "/work/t9", "b-last", False, "local")]


@query
def rules_edited(spark, d):
    rules = K.rules(spark)
    put = staging.add_rules(rules, spark.createDataFrame(_NEW_RULES, rules.schema))
    gone = spark.createDataFrame([(0, None, "org3", None, None, False, "local")], rules.schema)
    return staging.effective_rules(staging.remove_rules(put, gone)).select("ord", "repo", "org", "prefix", "brain", "deny")


@query
def rules_imported(spark, d):
    rules = K.rules(spark).withColumn("shared_from", F.when(F.col("origin") == "shared", "brain-x"))
    shared = spark.createDataFrame([(0, None, None, "/work/t0", False), (1, "o/r", None, None, False), (2, None, None, "/work/t2/p5", True)], "ord int, repo string, org string, prefix string, deny boolean")
    left, counts = staging.import_shared_rules(rules, shared, "brain-x")
    return left.groupBy("origin").agg(F.count("*").alias("n")).join(F.broadcast(counts))


@query
def aliases_edited(spark, d):
    linked = staging.link_sources(staging.link_sources(K.alias_map(spark), "eng-a", ["src9", "src0"]), "eng-z", ["src8"])
    return staging.unlink_sources(staging.unlink_sources(linked, "eng-b", ["src2", "src3"]), "eng-c", ["src1"]).select("project", F.array_join("sources", ",").alias("sources"))


@query
def conflict_siblings(spark, d):
    side = lambda s, on: F.when(on, F.struct("id", F.concat(F.col("title"), F.lit(f" of {s}")).alias("title"), "created", "kind"))
    n = K.notes(spark, d)
    return staging.conflict_siblings(n.select("path", side("ours", F.col("doc_id") % 3 != 0).alias("ours"), side("theirs", F.col("doc_id") % 3 != 1).alias("theirs")))


@query
def hybrid_excerpts(spark, d):
    hits = search.retrieve(K.notes(spark, d), K.vectors(spark, d), S.QUERY, _query_vector(spark, d))
    return search.with_snippets(hits, K.notes(spark, d), S.QUERY).select("id", "tier", "excerpt")


@query
def notes_overwritten(spark, d):
    notes, folder = K.notes(spark, d).select("id", "title", "status"), f"{shared_folder(spark)}/lodestone/notes-{uuid.uuid4().hex}"
    buckets.create(notes, folder)
    new = notes.filter("id LIKE '%7'").withColumn("title", F.lit("new")).unionByName(spark.createDataFrame([("n-new", "made", "active")], "id string, title string, status string"))
    buckets.upsert(spark, folder, new)
    return buckets.read(spark, folder)


@query
def notes_deleted(spark, d):
    """A change of few notes, in buckets: some go, some are superseded."""
    notes, folder = K.notes(spark, d).select("id", "kind", "title", "status", "superseded_by"), f"{shared_folder(spark)}/lodestone/notes-{uuid.uuid4().hex}"
    buckets.create(notes, folder)
    buckets.delete(spark, folder, notes.filter("id LIKE '%99'"))
    buckets.supersede(spark, folder, notes.filter("id LIKE '%50'").select(F.col("id").alias("duplicate"), F.lit("n00000001").alias("survivor")))
    return buckets.read(spark, folder)


@query
def adopt_counts(spark, d):
    notes = K.notes(spark, d)
    return routing.adopt_counts(notes.filter("doc_id % 5 <> 0"), notes.filter("doc_id % 5 = 0"), K.alias_map(spark), "eng-a")


@query
def adopt_retired(spark, d):
    notes, aliases = K.notes(spark, d).filter("source <> 'src0' OR project IS NULL"), K.alias_map(spark)
    return routing.retire(routing.adopt(notes, aliases, "eng-a"), aliases, "eng-a").select("project", F.array_join("sources", ",").alias("sources"))


@query
def gate_with_fields(spark, d):
    from lodestone.operators import curation

    rows = K.candidates(K.notes(spark, d)).withColumn("note", F.when(F.col("doc_id") % 16 == 3, F.concat(F.lit("key ghp_aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5"), F.lit(""))).otherwise("nothing"))
    return curation.gate(rows, auto_adr=True, fields=("note", "lang")).filter("reason = 'contains-secret'").select("id", "reason")
