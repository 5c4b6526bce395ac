"""What people read: receipts, status lines, listings, reports and answers as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import bar, first_line, percent_text, trend_arrow

#: Titles that a receipt names.
RECEIPT_TITLES = 3
def age(seconds: Column) -> Column:
    """A coarse age: just now, minutes, hours below two days, days; `unknown time` for null."""
    minutes = F.floor(F.greatest(F.lit(0), seconds) / 60)
    hours = F.floor(minutes / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds.isNull(), "unknown time").when(minutes < 1, "just now").when(minutes < 60, text(minutes, "m")).when(hours < 48, text(hours, "h")).otherwise(text(F.floor(hours / 24), "d"))


def capture_line(outcome: Column, reason: Column, captured: Column, promoted: Column, staged: Column, rejected: Column, seconds: Column) -> Column:
    """One line on a capture attempt."""
    head = F.concat(F.lit("Last capture ("), age(seconds), F.lit("): "))
    why = F.concat(F.lit(" ("), F.coalesce(reason, F.lit("unknown")), F.lit(")."))
    count = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}")))
    detail = F.concat_ws(", ", count(promoted, "promoted"), count(staged, "staged"))
    filtered = F.when(rejected > 0, F.concat(F.lit(" ("), rejected.cast("string"), F.lit(" candidate(s) filtered by curation)"))).otherwise("")
    ok = F.when(F.coalesce(captured, F.lit(0)) == 0, F.concat(F.lit("reviewed, captured nothing"), F.coalesce(filtered, F.lit("")), F.lit("."))).otherwise(
        F.concat(F.lit("✓ "), captured.cast("string"), F.lit(" note(s)"), F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""), F.lit("."))
    )
    said = F.when(outcome == "ok", ok).when(outcome == "extraction-failed", F.concat(F.lit("✗ extraction failed"), why)).when(outcome == "curate-failed", F.concat(F.lit("✗ curate failed"), why)).when(outcome == "skipped", F.concat(F.lit("skipped"), why))
    return F.concat(head, F.coalesce(said, F.concat(outcome, F.lit("."))))


def status_line(brain: Column, score: Column, pending: Column, syncing: Column) -> Column:
    part = F.when(pending > 0, F.concat(pending.cast("string"), F.lit(" pending")))
    return F.concat_ws(" · ", F.concat(F.lit("🧠 "), brain), F.when(score.isNotNull(), F.concat(score.cast("string"), F.lit("/100"))), part, F.when(syncing, F.lit("⇅")))


def fix_hint(reason: Column, hints: dict[str, str]) -> Column:
    """What the caller's table of hints says to a class of failure; null for a class that it doesn't have."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in hints.items() for x in kv]), reason) if hints else F.lit(None).cast("string")


def resource_uri(brain: Column, kind: Column | None = None, id: Column | None = None, scheme: str = "brain") -> Column:
    """The map of a brain, the listing of a kind, or a note."""
    parts = [F.concat(F.lit(f"{scheme}://"), brain)]
    parts += [F.lit("MAP.md")] if kind is None else [kind] if id is None else [kind, id]
    return F.concat_ws("/", *parts)


def note_resource(notes: DataFrame) -> DataFrame:
    """(id, text): title and body; a superseded note begins with a banner that names what replaced it."""
    by = F.when(F.length("superseded_by") > 0, F.concat(F.lit(" by `"), F.col("superseded_by"), F.lit("`"))).otherwise("")
    banner = F.when(F.coalesce(F.col("status") == "superseded", F.lit(False)), F.concat(F.lit("> ⚠️ **Superseded**"), F.coalesce(by, F.lit("")), F.lit(" — kept for history; prefer the note that replaced it.\n\n"))).otherwise("")
    return notes.select("id", F.concat(banner, F.lit("# "), "title", F.lit("\n\n"), "body").alias("text"))


def point_read(notes: DataFrame, path: str) -> DataFrame:
    """The note of a path; a path that leads out of the folder has none."""
    depth = 0
    for part in path.split("/"):
        depth += {"..": -1, ".": 0, "": 0}.get(part, 1)
        if depth < 0 or path.startswith("/"):
            return notes.filter(F.lit(False))
    return notes.filter(F.col("path") == path)


def receipt(notes: DataFrame, most: int = RECEIPT_TITLES) -> DataFrame:
    """(run, title, promoted, place) -> (run, receipt): the first titles, how many more there are, and what became of them."""
    shown = notes.withColumn("nth", F.row_number().over(Window.partitionBy("run").orderBy("place"))).filter(F.col("nth") <= most)
    titles = shown.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: F.concat(F.lit('• "'), x["title"], F.lit('"'))), "\n").alias("list"))
    counts = notes.groupBy("run").agg(F.count("*").alias("n"), F.bool_or("promoted").alias("any"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n(+"), (F.col("n") - most).cast("string"), F.lit(" more)"))).otherwise("")
    head = F.when(F.col("any"), F.lit("🧠 Team brain remembered:\n")).otherwise(F.concat(F.lit("🧠 Team brain staged "), F.col("n").cast("string"), F.lit(" note(s) for review:\n")))
    return counts.join(titles, "run").select("run", F.concat(head, "list", more).alias("receipt"))


def verdict_clause(superseded: Column, contradicted: Column, trivia: Column, duplicate: Column, clamped: Column) -> Column:
    """What curation did, in brackets, or nothing."""
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}")))
    flagged = F.when(contradicted > 0, F.concat(contradicted.cast("string"), F.lit(" flagged as a contradiction"), F.when(contradicted == 1, "").otherwise("s")))
    text = F.concat_ws(", ", part(superseded, "superseded an older note"), flagged, part(trivia, "filtered as trivia"), part(duplicate, "dropped as duplicate(s)"), part(clamped, "verdict(s) clamped to distinct (unsafe target)"))
    return F.when(text != "", F.concat(F.lit(" ("), text, F.lit(")"))).otherwise("")


def pending_note(contradicts: Column, supersedes: Column) -> Column:
    """What a staged note would do, behind its line."""
    mark = lambda ids, sign: F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.concat(F.lit(sign), x))
    parts = F.concat(mark(contradicts, "⚠ contradicts "), mark(supersedes, "↳ supersedes "))
    return F.when(F.size(parts) > 0, F.concat(F.lit("  "), F.array_join(parts, "  "))).otherwise("")


def contradiction_payload(id: Column, title: Column, path: Column, mode: Column) -> Column:
    """A struct (message, context, decision, reason): a warning that lets the tool run, or a question; null without a match."""
    named = F.coalesce(F.nullif(title, F.lit("")), id)
    cited = F.coalesce(F.nullif(path, F.lit("")), id)
    message = F.concat(F.lit("⚠ This change may contradict decision [["), id, F.lit("]]: "), named, F.lit(" — your pending change is close to this recorded decision. Cited: "), cited)
    ask = mode == "ask"
    return F.when(F.coalesce(id != "", F.lit(False)), F.struct(F.when(~ask, message).alias("context"), F.when(ask, F.lit("ask")).alias("decision"), F.when(ask, message).alias("reason")))


def sync_summary(committed: Column, pulled: Column, pushed: Column, conflicts: Column, locked: Column, withheld: Column) -> Column:
    yes = lambda c: c.cast("string")
    line = F.concat(F.lit("sync: committed="), yes(committed), F.lit(" pulled="), yes(pulled), F.lit(" pushed="), yes(pushed), F.lit(" conflicts="), yes(conflicts), F.when(locked, " (skipped: another sync held the lock)").otherwise(""))
    return F.concat(line, F.when(F.size(withheld) > 0, F.concat(F.lit("\nwithheld "), F.size(withheld).cast("string"), F.lit(" note(s) containing a secret: "), F.array_join(withheld, ", "))).otherwise(""))


def promotion_text(notes: DataFrame) -> DataFrame:
    """(brain, kind, title) of promoted notes -> (brain, headline, by_kind): the title and body of a proposal."""
    counts = notes.groupBy("brain", "kind").agg(F.count("*").alias("n"))
    lines = counts.groupBy("brain").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(F.lit("- "), x["kind"], F.lit(": "), x["n"].cast("string"))), "\n").alias("by_kind"))
    return lines.select("brain", F.concat(F.lit("Promote "), F.col("n").cast("string"), F.when(F.col("n") == 1, " note").otherwise(" notes")).alias("headline"), "by_kind")


def answer(hits: DataFrame, question: str) -> DataFrame:
    """One row: the hits (rank, title, kind, path, excerpt) as cited retrieval, or that nothing is known. Hits are a top-k, so their list is bounded."""
    part = F.concat(F.lit("  • "), "title", F.lit("  ["), "kind", F.lit("]\n    "), "path", F.when(F.col("excerpt") != "", F.concat(F.lit("\n    "), F.col("excerpt"))).otherwise(""), F.lit("\n"))
    listed = hits.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("text")))), lambda x: x["text"]), "\n").alias("list"))
    none = F.lit(f"ask — {question}\n\n  No notes in the brain matched this question.\n")
    return listed.select("n", F.when(F.col("n") == 0, none).otherwise(F.concat(F.lit(f"ask — {question}\n\n  "), F.col("n").cast("string"), F.lit(" relevant note(s) — cite these when you answer:\n\n"), "list")).alias("text"))


def context_text(hits: DataFrame) -> DataFrame:
    """One row: the notes of a context (rank, title, kind, body) for injection; nothing for no notes. The first line tells their number."""
    gist = first_line(F.col("body"))
    line = F.concat(F.lit("- **"), "title", F.lit("** ("), "kind", F.lit(")"), F.when(gist != "", F.concat(F.lit(" — "), gist)).otherwise(""))
    listed = hits.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("list"))
    head = F.concat(F.lit("## Team brain — "), F.col("n").cast("string"), F.lit(' relevant note(s)\n_Cite any note you use inline, e.g. "📖 from the team brain: TITLE"._\n\n'))
    return listed.select("n", F.when(F.col("n") > 0, F.concat(head, "list")).otherwise("").alias("text"))


def diagnostics_lines(hits: DataFrame) -> DataFrame:
    """(id, line) of hits with ranks, tier and score."""
    rank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    return hits.select("id", F.concat(F.lit("  ["), F.coalesce("tier", F.lit("lexical")), F.lit("] lex:"), rank("lexical_rank"), F.lit(" sem:"), rank("semantic_rank"), F.lit(" score:"), F.format_string("%.4f", F.col("score")), F.lit("  "), "title", F.lit(" ("), "id", F.lit(")")).alias("line"))


def coverage_lines(windows: DataFrame) -> DataFrame:
    """(brain, text): ratios, trend and counts of the trailing windows."""
    window = lambda name, k: F.concat(F.lit(f"last {name}: "), percent_text(F.col(f"{k}_ratio")), F.lit(" ("), F.col(f"{k}_productive").cast("string"), F.lit("/"), F.col(f"{k}_seen").cast("string"), F.lit(" sessions landed a note)"))
    return windows.select("brain", F.when(~F.col("has_data"), "no capture activity logged yet").otherwise(F.concat_ws("\n", window("7d", "short"), window("30d", "long"), F.concat(F.lit("trend: "), trend_arrow(F.col("trend"))))).alias("text"))


def bars(counts: DataFrame, n: str, cells: int = 24) -> DataFrame:
    """`counts` with a bar for each row, the longest of `cells`. One row a group of an aggregate; the largest is one broadcast row."""
    most = counts.agg(F.max(n).alias("_most"))
    return counts.join(F.broadcast(most)).withColumn("bar", bar(F.col(n), F.col("_most"), cells)).drop("_most")


def upsert_block(text: Column, block: Column, name: str = "TEAM BRAIN") -> Column:
    """The text with the block between its marks replaced, or put at the end; all else stays as it is."""
    begin, end = f"<!-- BEGIN {name} -->", f"<!-- END {name} -->"
    trimmed = lambda c: F.regexp_replace(c, "[ \\t\\n\\r]+$", "")
    fenced = F.concat(F.lit(begin + "\n"), trimmed(block), F.lit("\n" + end))
    b, e = F.instr(text, begin), F.instr(text, end)
    before = F.substring(text, F.lit(1), b - 1)
    after = F.substring(text, e + len(end), F.length(text))
    replaced = F.concat(trimmed(F.regexp_replace(F.concat(before, fenced, after), "\n{3,}", "\n\n")), F.lit("\n"))
    base = trimmed(text)
    return F.when((b > 0) & (e > b), replaced).when(F.length(base) > 0, F.concat(base, F.lit("\n\n"), fenced, F.lit("\n"))).otherwise(F.concat(fenced, F.lit("\n")))


def label_order(label: Column, last: str = "(unattributed)") -> list[Column]:
    """Labels in order, the sentinel last."""
    return [(label == last).cast("int"), label]
