"""What models and commands answer, read as rows: extracted candidates, classifiers' verdicts, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import BLANK
from lodestone.sources.knowledge import KINDS

#: What a verdict may say; the first is what anything else counts as.
JUDGES = ("durable", "trivia")
RELATIONS = ("distinct", "duplicate", "supersedes", "contradicts")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def strip_fence(text: Column) -> Column:
    """The inside of a text that is one fenced block, else the text."""
    bare = _trim(text)
    fenced = "(?i)^```(?:json)?[ \\t\\n\\r]*([\\s\\S]*?)[ \\t\\n\\r]*```$"
    return F.when(bare.rlike(fenced), F.regexp_extract(bare, fenced, 1)).otherwise(bare)


def recovered(text: Column, strict: bool = False) -> Column:
    """The reply as JSON: as it is, or what stands between the outermost brackets, then braces; null if nothing parses."""
    if strict:
        return F.try_parse_json(_trim(text))
    inner = strip_fence(text)
    part = lambda a, b: F.regexp_extract(inner, f"(\\{a}[\\s\\S]*\\{b})", 1)
    return F.coalesce(F.try_parse_json(inner), F.try_parse_json(part("[", "]")), F.try_parse_json(part("{", "}")))


def _items(v: Column, key: str, bare: bool = True) -> Column:
    keyed = F.try_variant_get(v, f"$.{key}", "array<variant>")
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), keyed) if bare else keyed


def _text(v: Column, key: str) -> Column:
    """A field that is a text, else null."""
    field = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def extraction(replies: DataFrame, strict: bool = False) -> DataFrame:
    """(reply, text) -> (reply, ok, candidates): a reply counts as a whole or not at all, so an empty list isn't mistaken for a failure.

    A candidate needs a kind, and a title and body that aren't blank; tags, if given, are texts. An unknown kind is a
    memory. `strict` takes the exact object {candidates: [...]} only, with known kinds and tags.
    """
    rows = replies.select("reply", _items(recovered(F.col("text"), strict), "candidates", bare=not strict).alias("items"))

    def fine(c: Column) -> Column:
        tags = F.try_variant_get(c, "$.tags", "variant")
        is_list = F.exists(F.try_variant_get(c, "$.tags", "array<variant>"), lambda t: F.schema_of_variant(t) != "STRING")
        good_tags = F.coalesce(~is_list, F.lit(False)) if strict else (tags.isNull() | F.coalesce(~is_list, F.lit(False)))
        said = lambda k: F.coalesce(_trim(_text(c, k)) != "", F.lit(False))
        kind = F.coalesce(_text(c, "kind").isin(*KINDS), F.lit(False)) if strict else _text(c, "kind").isNotNull()
        return kind & said("title") & said("body") & good_tags

    ok = F.coalesce(F.forall("items", fine), F.lit(False))

    def normal(c: Column) -> Column:
        kind = F.when(_text(c, "kind").isin(*KINDS), _text(c, "kind")).otherwise("memory")
        return F.struct(kind.alias("kind"), _text(c, "title").alias("title"), _text(c, "body").alias("body"), F.try_variant_get(c, "$.tags", "array<string>").alias("tags"))

    return rows.withColumn("ok", ok).select("reply", "ok", F.when(F.col("ok"), F.transform("items", normal)).alias("candidates"))


def candidates_of(read: DataFrame) -> DataFrame:
    return read.filter("ok").select("reply", F.posexplode("candidates").alias("index", "c")).select("reply", "index", "c.*")


def verdicts(replies: DataFrame) -> DataFrame:
    """(reply, text) -> (reply, index, judge, consolidation, target_id, why): one verdict an index, the last given; what isn't known counts as durable and distinct."""
    rows = replies.select("reply", F.posexplode(_items(recovered(F.col("text")), "verdicts")).alias("place", "v"))
    whole = F.try_variant_get("v", "$.index", "double")
    is_number = F.schema_of_variant(F.try_variant_get("v", "$.index", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    one = lambda key, known: F.when(_text(F.col("v"), key).isin(*known), _text(F.col("v"), key)).otherwise(known[0])
    rows = rows.filter(F.coalesce(is_number & (whole == F.floor(whole)), F.lit(False))).select(
        "reply", whole.cast("int").alias("index"), "place", one("judge", JUDGES).alias("judge"), one("consolidation", RELATIONS).alias("consolidation"),
        F.coalesce(_text(F.col("v"), "targetId"), F.lit("")).alias("target_id"), F.coalesce(_text(F.col("v"), "reason"), F.lit("")).alias("why"),
    )
    last = F.max_by(F.struct("judge", "consolidation", "target_id", "why"), "place")
    return rows.groupBy("reply", "index").agg(last.alias("v")).select("reply", "index", "v.*")


def annotate(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates (reply, index, ...) with their verdicts; those without one keep nulls, which count as distinct."""
    return candidates.join(found, ["reply", "index"], "left")


def capture_lines(outputs: DataFrame) -> DataFrame:
    """(reply, text) -> (reply, line_no, kind, title, promoted): lines `... [kind] title` of a command's output."""
    lines = outputs.select("reply", F.posexplode(F.split("text", "\\n")).alias("line_no", "line")).withColumn("line", _trim(F.col("line")))
    shape = "\\[([^\\]]+)\\][ \\t]+(.+)$"
    return lines.filter(F.col("line").rlike(shape)).select("reply", "line_no", F.regexp_extract("line", shape, 1).alias("kind"), _trim(F.regexp_extract("line", shape, 2)).alias("title"), F.startswith("line", F.lit("promoted")).alias("promoted"))


def verdict_summary(outputs: DataFrame, prefix: str = "##verdicts ") -> DataFrame:
    """(reply, superseded, contradicted, trivia, duplicate, clamped) of the last line that begins with the prefix and parses."""
    lines = F.transform(F.split("text", "\\n"), _trim)
    parsed = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.try_parse_json(F.substring(x, F.lit(len(prefix) + 1), F.length(x))))
    last = F.element_at(F.filter(parsed, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))), -1)
    rows = outputs.select("reply", F.when(F.size(F.filter(parsed, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))) > 0, last).alias("v")).filter("v IS NOT NULL")
    return rows.select("reply", *[F.coalesce(F.try_variant_get("v", f"$.{k}", "int"), F.lit(0)).alias(k) for k in ("superseded", "contradicted", "trivia", "duplicate", "clamped")])
