"""The gate that candidates pass, classifiers' verdicts and what they come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import BLANK, blank_to_null
from lodestone.operators.secrets import has_secret
from lodestone.operators.similarity import DUPLICATE, greedy_batch, similar_classes, token_set
from lodestone.session import stash

MIN_BODY = 15


def thin() -> Column:
    trim = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), f"^{BLANK}+|{BLANK}+$", "")
    return (trim("title") == "") | (F.length(trim("body")) < MIN_BODY)


def gate_reason(auto_adr: bool = False, fields: tuple[str, ...] = ()) -> Column:
    """Why a candidate is rejected before any comparison, or null: secret, then decisions if they aren't opted in, then thin content.

    `fields` names further columns that a note carries, which are screened for secrets as well.
    """
    text = F.concat_ws("\n", "title", "body", F.array_join("tags", "\n"), "author", "source", *([F.to_json(F.struct(*fields))] if fields else []))
    reason = F.when(has_secret(text), "contains-secret")
    if not auto_adr:
        reason = reason.when(F.col("kind") == "decision", "auto-adr-disabled")
    return reason.when(thin(), "thin-content")


def gate(candidates: DataFrame, auto_adr: bool = False, fields: tuple[str, ...] = ()) -> DataFrame:
    return candidates.withColumn("reason", gate_reason(auto_adr, fields))


def greedy_dedup(candidates: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """(id, ord, text) in order -> (id, accepted).

    Of rows of one set only the first can be accepted: either it is, and the others are like it, or an accepted row is like
    all of them. So the rounds are over first rows alone. Rows without tokens are like nothing.
    """
    sets = candidates.select("id", "ord", token_set(F.col("text")).alias("tokens"))
    near = stash(similar_classes(sets, threshold, order="ord"), "greedy-classes")
    later = near.filter("similarity = 1").select(F.col("b").alias("id"))
    first = candidates.select("id", "ord").join(later, "id", "left_anti")
    return greedy_batch(first, near.filter("similarity < 1")).unionByName(later.withColumn("accepted", F.lit(False)))


def parsed_verdict() -> list[Column]:
    target = blank_to_null(F.col("target_id"))
    judge = F.when(F.col("judge") == "trivia", "trivia").otherwise("durable")
    known = F.col("consolidation").isin("duplicate", "supersedes", "contradicts") & target.isNotNull()
    return [judge.alias("judge"), F.when(known, F.col("consolidation")).otherwise("distinct").alias("relation"), target.alias("target")]


def verdict_plan(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """What each candidate comes to: reject as trivia or duplicate, or stage, with the relation and why it was clamped.

    A relation counts only for a target among the candidate's neighbours (if they are known), and a duplicate only if
    its target exists.
    """
    parsed = candidates.select("ord", "id", "tags", "neighbor_ids", *parsed_verdict())
    there = existing.select(F.col("id").alias("target"), F.lit(True).alias("exists")).distinct()
    rows = parsed.join(there, "target", "left")
    related = F.col("relation") != "distinct"
    outside = related & F.col("neighbor_ids").isNotNull() & ~F.array_contains("neighbor_ids", F.col("target"))
    missing = (F.col("relation") == "duplicate") & F.col("exists").isNull()
    trivia = F.col("judge") == "trivia"
    clamped = F.when(trivia, None).when(outside, "target-not-in-neighbor-set").when(missing, "duplicate-target-not-in-canon")
    acts = ~trivia & related & F.col("clamped").isNull()
    return rows.withColumn("clamped", clamped).select(
        "ord", "id", F.when(trivia | (acts & (F.col("relation") == "duplicate")), "reject").otherwise("stage").alias("action"),
        F.when(trivia, "llm-trivia").when(acts & (F.col("relation") == "duplicate"), "llm-duplicate").alias("reason"), F.when(acts & (F.col("relation") == "duplicate"), F.col("target")).alias("duplicate_of"),
        F.when(acts & (F.col("relation") == "supersedes"), F.col("target")).alias("supersedes"), F.when(acts & (F.col("relation") == "contradicts"), F.col("target")).alias("contradicts"), "clamped",
        F.when(acts & (F.col("relation") == "contradicts"), F.array_union("tags", F.array(F.lit("contradicted")))).otherwise(F.col("tags")).alias("tags"),
    )


def capture_outcomes(plan: DataFrame) -> DataFrame:
    is_ = lambda c: F.count(F.when(c, 1))
    return plan.agg(
        F.count("*").alias("n"), is_(F.col("action") == "stage").alias("staged"), is_(F.col("reason") == "llm-trivia").alias("trivia"), is_(F.col("reason") == "llm-duplicate").alias("duplicates"),
        is_(F.col("supersedes").isNotNull()).alias("supersedes"), is_(F.col("contradicts").isNotNull()).alias("contradicts"), is_(F.col("clamped").isNotNull()).alias("clamped"),
    )


def contradiction_check(decisions: DataFrame, vectors: DataFrame, query_vec: list[float], threshold: float = 0.82) -> DataFrame:
    """The decision nearest to the query vector, if it is near enough; superseded ones take no part."""
    from lodestone.operators.search import cosine

    live = decisions.filter("kind = 'decision' AND status <> 'superseded'").select("id", "title", "path")
    near = vectors.join(live, "id").withColumn("score", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in query_vec])))
    return near.filter(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(1).select("id", "title", "path", "score")
