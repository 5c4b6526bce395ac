"""Capture as one flow: verdicts, gate, duplicates, staging, promotion and what a new note does to older ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import collapse
from lodestone.operators import curation
from lodestone.operators.set_join import SetIndex, build, most_similar
from lodestone.operators.set_scan import nearest_by_scan, scannable
from lodestone.operators.similarity import DUPLICATE, token_sets
from lodestone.session import stash

#: Tools whose input the guard reads, the shortest and longest text it takes.
GUARD_TOOLS, GUARD_LEAST, GUARD_MOST = ("Write", "Edit", "MultiEdit", "Bash"), 12, 2000
ERROR_CHARS = 200


def like_existing(candidates: DataFrame, existing: DataFrame | SetIndex, threshold: float = DUPLICATE) -> DataFrame:
    """(id, duplicate_of, score): candidates as similar as that to an existing row; the most similar one, the first in order of ids among equals.

    Candidates are (id, text); existing rows too, or an index of their sets. Candidates alone probe, so existing rows are
    never compared with each other.
    """
    if not isinstance(existing, SetIndex):
        existing = build(token_sets(existing, "id", "text"), threshold)
    return most_similar(token_sets(candidates, "id", "text"), existing, threshold)


def batch_accepted(candidates: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    return curation.greedy_dedup(candidates.select("id", "ord", "text"), threshold)


def _older(canon: DataFrame, staged: DataFrame) -> DataFrame:
    """(id, tokens) of all notes that a new one can be like."""
    content = F.concat_ws(" ", "title", "body")
    return token_sets(canon.select("id", content.alias("text")).unionByName(staged.select("id", content.alias("text"))), "id", "text")


def like_older(candidates: DataFrame, canon: DataFrame, staged: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """What `like_existing` says of (id, text), where no index is kept: few candidates meet all notes in one pass, for more an index is built."""
    sets = stash(token_sets(candidates, "id", "text"), "flow-sets")
    if not scannable(sets):
        return most_similar(sets, existing_index(canon, staged), threshold)
    # scores are compared as `most_similar` compares them
    return nearest_by_scan(sets, _older(canon, staged), 1, threshold - 1e-9).select(F.col("candidate").alias("id"), F.col("neighbour").alias("duplicate_of"), "score")


def existing_index(canon: DataFrame, staged: DataFrame, folder: str | None = None) -> SetIndex:
    """The sets of all notes that a new one can be like, for many captures; kept in `folder`."""
    return build(_older(canon, staged), DUPLICATE, folder)


def capture(candidates: DataFrame, canon: DataFrame, staged: DataFrame, auto_promote: bool = True, auto_adr: bool = True, index: SetIndex | None = None) -> DataFrame:
    """Candidates -> (id, outcome, reason, duplicate_of, supersedes, contradicts, clamped, tags): `promoted`, `staged` or `rejected`.

    Candidates have ord, id, kind, title, body, tags, author, source and their verdict (judge, consolidation, target_id,
    neighbor_ids); canon and staged have id, kind, title, body. The order is: verdicts, the gate, likeness to canon and
    staged rows, likeness to accepted earlier candidates. What a note does to others counts only if it got through, and a
    supersession only if it reached canon and its target is there and can be superseded. `index` is that of the existing
    notes, where one is kept; else few candidates meet them all, and for many it is built for this capture.
    """
    known = canon.select("id").unionByName(staged.select("id"))
    plan = stash(curation.verdict_plan(candidates, known), "flow-plan")
    content = F.concat_ws(" ", "title", "body")
    kept = candidates.drop("tags").join(plan.filter("action = 'stage'").select("id", "tags", "supersedes", "contradicts", "clamped"), "id")
    gated = stash(kept.withColumn("why", curation.gate_reason(auto_adr)).withColumn("text", content).select("ord", "id", "why", "text", "supersedes", "contradicts", "clamped", "tags"), "flow-gated")
    through = gated.filter("why IS NULL")
    like = stash(like_existing(through, index) if index else like_older(through, canon, staged), "flow-like")
    fresh = through.join(like.select("id"), "id", "left_anti")
    accepted = batch_accepted(fresh)
    # an id that stands twice in canon is one target
    target = canon.filter(F.col("kind").isin("memory", "decision")).select(F.col("id").alias("supersedes"), F.lit(True).alias("there")).distinct()
    rows = gated.join(like.select("id", "duplicate_of"), "id", "left").join(accepted, "id", "left").join(target, "supersedes", "left")
    ok = F.coalesce("accepted", F.lit(False))
    reason = F.coalesce("why", F.when(~ok, F.lit("duplicate")))
    outcome = F.when(reason.isNotNull(), "rejected").when(F.lit(auto_promote), "promoted").otherwise("staged")
    done = rows.select(
        "id", outcome.alias("outcome"), reason.alias("reason"), "duplicate_of", F.when(reason.isNull() & F.lit(auto_promote) & F.col("there"), F.col("supersedes")).alias("supersedes"),
        F.when(reason.isNull(), F.col("contradicts")).alias("contradicts"), "clamped", "tags",
    )
    nothing = F.lit(None).cast("string")
    dropped = plan.filter("action = 'reject'").select("id", F.lit("rejected").alias("outcome"), "reason", "duplicate_of", nothing.alias("supersedes"), nothing.alias("contradicts"), "clamped", "tags")
    return done.unionByName(dropped)


def apply_capture(canon: DataFrame, staged: DataFrame, candidates: DataFrame, outcome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canon, staged) after a capture: promoted candidates join canon and their targets are superseded, staged ones wait."""
    columns = canon.columns
    new = candidates.drop("tags").join(outcome.filter("outcome <> 'rejected'").select("id", "outcome", "tags"), "id")
    links = outcome.filter("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("_t")).agg(F.max("id").alias("_by"))
    old = canon.join(links, F.col("id") == F.col("_t"), "left")
    old = old.withColumn("status", F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.coalesce("_by", "superseded_by")).select(*columns)
    return old.unionByName(new.filter("outcome = 'promoted'").select(*columns)), stage(staged, new.filter("outcome = 'staged'").select(*staged.columns))


def stage(staged: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows join the staged layer; one whose id waits there already doesn't come twice."""
    return staged.unionByName(rows.join(staged.select("id"), "id", "left_anti").select(*staged.columns))


def remember(note: DataFrame, canon: DataFrame, staged: DataFrame, auto_promote: bool = True, index: SetIndex | None = None) -> DataFrame:
    """One note, without a verdict, through the same flow -> (id, outcome, reason)."""
    nothing = F.lit(None).cast("string")
    bare = note.withColumn("judge", nothing).withColumn("consolidation", nothing).withColumn("target_id", nothing).withColumn("neighbor_ids", F.lit(None).cast("array<string>")).withColumn("ord", F.lit(0))
    return capture(bare, canon, staged, auto_promote, index=index).select("id", "outcome", "reason", "duplicate_of")


def log_entry(results: DataFrame) -> DataFrame:
    """(run, ok, captured, extracted, promoted_flags, error) -> what the capture log says of each run.

    Of a good run the notes that were promoted, those that wait, and what was extracted beyond them; of a failed one the
    head of its error.
    """
    n = F.coalesce(F.size(F.filter("promoted_flags", lambda p: p)), F.lit(0))
    captured = F.coalesce("captured", F.lit(0))
    extracted = F.when(F.col("extracted") >= captured, F.col("extracted")).otherwise(captured)
    fine = F.col("ok")
    return results.select(
        "run", F.when(fine, "ok").otherwise("extraction-failed").alias("outcome"), F.when(fine, extracted).alias("extracted"), F.when(fine, captured).alias("captured"), F.when(fine, n).alias("promoted"),
        F.when(fine, F.coalesce(F.size("promoted_flags"), F.lit(0)) - n).alias("staged"), F.when(fine, F.greatest(F.lit(0), extracted - captured)).alias("rejected"), F.when(~fine, error_head(F.col("error"))).alias("error"),
    )


def error_head(text: Column) -> Column:
    return F.nullif(F.substring(collapse(text), 1, ERROR_CHARS), F.lit(""))


def change_summary(tool: Column, tool_input: Column) -> Column:
    """What a tool is about to change, as one line: its label and payload; null for other tools and trifles."""
    get = lambda key: F.coalesce(F.get_json_object(tool_input, f"$.{key}"), F.lit(""))
    edits = F.from_json(F.get_json_object(tool_input, "$.edits"), "array<struct<new_string: string>>")
    edited = F.when(edits.isNotNull(), F.array_join(F.transform(edits, lambda e: F.coalesce(e["new_string"], F.lit(""))), " ")).otherwise(get("new_string"))
    label = F.when(tool == "Bash", get("description")).otherwise(get("file_path"))
    payload = F.when(tool == "Bash", get("command")).when(tool == "Write", get("content")).when(tool.isin("Edit", "MultiEdit"), edited)
    line = F.substring(collapse(F.concat(label, F.lit(" "), payload)), 1, GUARD_MOST)
    return F.when(F.length(F.trim(payload)) >= GUARD_LEAST, line)


def guarded(calls: DataFrame, enabled: Column, has_provider: Column) -> DataFrame:
    """(call, session, cwd, tool, tool_input, kind) -> calls that the guard looks at, with `summary`: known tools, in a brain's scope, with the flag on and something to say."""
    rows = calls.withColumn("summary", change_summary(F.col("tool"), F.col("tool_input")))
    return rows.filter((F.col("cwd") != "") & F.col("tool").isin(*GUARD_TOOLS) & (F.col("kind") == "brain") & enabled & has_provider & F.col("summary").isNotNull())


def embedding_text(title: Column, body: Column) -> Column:
    return F.concat_ws(" ", title, body)


def embedded(notes: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, vec) of notes by an embedder of columns (a pandas UDF or an expression); all or nothing.

    Rows are written once, and if any note lacks a vector the whole batch raises and nothing is returned.
    """
    out = stash(notes.select("id", embed(embedding_text(F.col("title"), F.col("body"))).alias("vec")), "flow-vectors")
    wanted, got = out.agg(F.count("*"), F.count(F.when(F.size("vec") > 0, 1))).first()
    if wanted != got:
        raise ValueError(f"the embedder returned {got} vectors for {wanted} texts")
    return out


def nearest_duplicate(pairs: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """(candidate, neighbour, score, place) -> one row a candidate: its nearest, the first among equals, and whether it counts as a duplicate."""
    best = pairs.groupBy("candidate").agg(F.min_by(F.struct("neighbour", "score"), F.struct(-F.col("score"), F.col("neighbour"))).alias("b"))
    return best.select("candidate", F.col("b.neighbour").alias("nearest"), F.col("b.score").alias("score"), (F.col("b.score") >= threshold).alias("duplicate"))
