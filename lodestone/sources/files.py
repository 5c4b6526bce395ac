"""Readers of the files a knowledge base keeps: notes with front matter, logs, rules, alias maps, tombstones, transcripts, decision records.

Files are read by Spark's readers, so paths may be on any store. What doesn't parse is left out, or returned with `error`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import BLANK
from lodestone.sources.knowledge import KIND_FOLDERS, KINDS

#: Folders that never hold notes; a knowledge base may name more.
SKIPPED = (".git", "index", "staging", "node_modules")
#: Statuses of each kind, the default first; None where a kind has none.
STATUS = {"memory": ("active", "superseded", "stale"), "decision": ("proposed", "accepted", "superseded"), "work-state": ("planned", "in-progress", "blocked", "done")}
#: Keys of front matter in the order they are written.
SCALARS = ("id", "kind", "title", "created", "updated", "author", "author_ref", "source", "project", "status", "verified", "superseded_by", "owner", "name", "email", "org", "role")
LISTS = ("tags", "relates", "sources", "supersedes", "deciders", "contradicts")
DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TOOL_RESULT_CHARS, BODY_CHARS = 400, 4000


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def _value(c: Column) -> Column:
    """A scalar without its quotes; null for nothing, null or ~."""
    bare = _strip(c)
    quoted = F.regexp_extract(bare, "^(['\"])([\\s\\S]*)\\1$", 2)
    return F.when(bare.rlike("^(['\"])[\\s\\S]*\\1$"), quoted).when(~bare.isin("", "null", "~"), bare)


def _scalar(front: Column, key: str) -> Column:
    return _value(F.regexp_extract(front, f"(?m)^{key}:[ \\t]*([^\\n]*)$", 1))


def _list(front: Column, key: str) -> Column:
    """Items of `key: [a, b]`, or of the lines `- a` below `key:`."""
    flow = F.regexp_extract(front, f"(?m)^{key}:[ \\t]*\\[([^\\n]*)\\][ \\t]*$", 1)
    block = F.regexp_extract(front, f"(?m)^{key}:[ \\t]*\\n((?:[ \\t]*-[ \\t]+[^\\n]*\\n?)+)", 1)
    items = F.when(block != "", F.transform(F.split(block, "\\n"), lambda x: F.regexp_replace(x, "^[ \\t]*-[ \\t]+", ""))).otherwise(F.regexp_extract_all(flow, F.lit("\"[^\"]*\"|'[^']*'|[^,]+"), F.lit(0)))
    return F.filter(F.transform(items, _value), lambda x: x.isNotNull())


def texts(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """(path, text) of all files below `folder`, paths relative to it, line ends as \\n."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    root = "/" + folder.split("://")[-1].strip("/") + "/"
    relative = F.element_at(F.split(F.col("path"), "\\Q" + root + "\\E", 2), -1)
    return files.select(relative.alias("path"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\\r\\n?", "\n").alias("text"))


def note_texts(spark: SparkSession, folder: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Files whose parent is a kind's folder, but for listings and what lies in folders that hold no notes; `skipped` names more of those."""
    parts = F.split("path", "/")
    in_kind = F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(1)).isin(*KIND_FOLDERS.values()) & (F.size(parts) > 1)
    return texts(spark, folder).filter(in_kind & (F.element_at(parts, -1) != "INDEX.md") & ~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: x.isin(*SKIPPED, *skipped)))


def checked_notes(rows: DataFrame, unread: Column) -> DataFrame:
    """Wide rows of notes with a default `status` and `error`: `unread`, or the first field that a note of its kind can't have."""
    default = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[0])) for k, v in STATUS.items()])
    rows = rows.withColumn("status", F.when(F.col("kind").isin(*STATUS), F.coalesce("status", default)))
    allowed = F.coalesce(*[F.when(F.col("kind") == k, F.col("status").isin(*v)) for k, v in STATUS.items()], F.lit(True))
    bad_id = (F.coalesce("id", F.lit("")) == "") | F.contains("id", F.lit("/")) | F.contains("id", F.lit("\\")) | F.col("id").isin(".", "..")
    bad_date = lambda c: F.col(c).isNotNull() & (~F.col(c).rlike(DATE) | F.try_to_date(c).isNull())
    error = (
        F.when(unread.isNotNull(), unread).when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind").when(bad_id, "id").when(F.coalesce("title", F.lit("")) == "", "title")
        .when(F.col("created").isNull() | bad_date("created"), "created").when(bad_date("updated"), "updated").when((F.col("kind") == "memory") & bad_date("verified"), "verified")
        .when(~allowed, "status").when((F.col("kind") == "person") & (F.coalesce("name", F.lit("")) == ""), "name").when((F.col("kind") == "person") & ~F.coalesce(F.col("email").rlike("^[^@ ]+@[^@ ]+\\.[^@ ]+$"), F.lit(True)), "email")
    )
    return rows.withColumn("error", error)


def parse_notes(files: DataFrame) -> DataFrame:
    """(path, text) -> a wide row a note with `error`: null, or why the file is no note. Keys without a column are kept in `extra`."""
    fence = "^---[ \\t]*\\n([\\s\\S]*?\\n)?---[ \\t]*(?:\\n|$)"
    rows = files.withColumn("front", F.regexp_extract("text", fence, 1)).withColumn("fenced", F.col("text").rlike(fence))
    fields = [*[_scalar(F.col("front"), k).alias(k) for k in SCALARS], *[_list(F.col("front"), k).alias(k) for k in LISTS], (_scalar(F.col("front"), "graduate") == "true").alias("graduate")]
    # a generator, as a filter on `error` would move below plain columns and read every field anew wherever it names one
    rows = rows.select("path", "fenced", "front", _strip(F.regexp_replace("text", fence, "")).alias("body"), F.inline(F.array(F.struct(*fields))))
    rows = checked_notes(rows, F.when(~F.col("fenced"), "no front matter"))
    known = [*SCALARS, *LISTS, "graduate"]
    lines = F.regexp_extract_all(F.col("front"), F.lit("(?m)^([A-Za-z_][A-Za-z0-9_-]*:[^\\n]*)$"), F.lit(1))
    keys = F.array_distinct(F.transform(lines, lambda x: F.substring_index(x, ":", 1)))
    first = lambda k: F.get(F.filter(lines, lambda x: F.startswith(x, F.concat(k, F.lit(":")))), F.lit(0))
    pairs = F.transform(F.filter(keys, lambda k: ~k.isin(*known)), lambda k: F.struct(k, _value(F.regexp_replace(first(k), "^[^:]*:", ""))))
    return rows.withColumn("extra", F.map_from_entries(pairs)).drop("front", "fenced")


def read_notes(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """All valid notes below `folder`; a malformed file costs itself alone."""
    notes = parse_notes(note_texts(spark, folder)).filter("error IS NULL").drop("error")
    return notes.filter(F.col("kind") == kind) if kind else notes


def read_capture_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log of JSON lines; lines that don't parse or have no textual outcome drop. `verdicts` counts by name."""
    schema = (
        "ts BIGINT, cwd STRING, brain STRING, host STRING, boundary STRING, reason STRING, extracted INT, captured INT, staged INT, promoted INT, rejected INT, code INT, timedOut BOOLEAN, error STRING, verdicts MAP<STRING, INT>"
    )
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    outcome = F.try_variant_get(F.try_parse_json("line"), "$.outcome", "string")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), "$.outcome", "variant")) == "STRING"
    return lines.filter(is_text).select(F.from_json("line", schema).alias("e"), outcome.alias("outcome")).select("e.*", "outcome")


def read_alias_map(text: DataFrame) -> DataFrame:
    """(text: a JSON object of project -> {customer, sources}) -> (project, customer, sources); other entries drop, a text that is no object is empty."""
    entries = text.select(F.explode(F.from_json("text", "MAP<STRING, STRING>")).alias("project", "entry")).filter("project <> '' AND entry LIKE '{%'")
    fields = entries.select("project", F.try_parse_json("entry").alias("e"))
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    customer = F.when(is_text(F.try_variant_get("e", "$.customer", "variant")), F.try_variant_get("e", "$.customer", "string"))
    sources = F.transform(F.filter(F.try_variant_get("e", "$.sources", "array<variant>"), is_text), lambda v: v.cast("string"))
    return fields.select("project", F.nullif(customer, F.lit("")).alias("customer"), F.coalesce(F.filter(sources, lambda s: s != ""), F.array().cast("array<string>")).alias("sources"))


def rules_state(text: DataFrame) -> DataFrame:
    """(path, text or null) -> (path, state): `missing`, `corrupt` if it is no JSON object, else `ok`."""
    parsed = F.try_parse_json("text")
    return text.select("path", F.when(F.col("text").isNull(), "missing").when(F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False)), "ok").otherwise("corrupt").alias("state"))


def read_records(spark: SparkSession, path: str, mark: str = "\x1e") -> DataFrame:
    """(ord, record) of logs whose records end with `mark`: a log splits at marks over as many tasks as its size asks for.

    `ord` orders the records as they stand: by file, by where the task's part of the file begins, and within that.
    """
    rows = spark.read.option("lineSep", mark).text(path)
    return rows.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("nth")).alias("ord"), F.col("value").alias("record"))


def newest(records: DataFrame, n: int) -> DataFrame:
    """The last n records of (ord, ...), the newest first; each task keeps n of its own."""
    return records.orderBy(F.desc("ord")).limit(n)


def framed_commits(records: DataFrame) -> DataFrame:
    """(ord, record) whose fields are parted by 0x1f -> (ord, subject, body); records without a subject drop."""
    fields = F.split(F.regexp_replace("record", "^[\r\n]+", ""), "\x1f")
    return records.select("ord", _strip(F.get(fields, F.lit(0))).alias("subject"), _strip(F.coalesce(F.get(fields, F.lit(1)), F.lit(""))).alias("body")).filter("subject <> ''")


#: Files in which a repository tells agents how to work, and a folder of them.
CONFIG_FILES, CONFIG_FOLDER = ("CLAUDE.md", ".cursorrules", "AGENTS.md", ".github/copilot-instructions.md"), ".claude/rules"


def config_candidates(files: DataFrame) -> DataFrame:
    """(path, text) of a repository -> memory candidates of its agent-config files: the first heading is the title, else the file's name."""
    name = F.element_at(F.split("path", "/"), -1)
    in_folder = F.col("path").rlike("^" + CONFIG_FOLDER.replace(".", "\\.") + "/[^/]+\\.[mM][dD]$")
    heading = _strip(F.regexp_extract("text", "(?m)^#[ \\t]+([^\\n]+)$", 1))
    title = F.coalesce(F.nullif(heading, F.lit("")), F.concat(F.lit("Project config: "), name))
    return files.filter(F.col("path").isin(*CONFIG_FILES) | in_folder).select("path", F.lit("memory").alias("kind"), title.alias("title"), F.substring(_strip(F.col("text")), 1, BODY_CHARS).alias("body"), F.array(F.lit("config"), F.lit("seed")).alias("tags"))


def seed_candidates(**sources: DataFrame) -> DataFrame:
    """All sources' candidates (kind, title, body, tags) with the name of their source."""
    out = None
    for name, df in sources.items():
        own = df.select(F.lit(name).alias("seed"), "kind", "title", "body", "tags")
        out = own if out is None else out.unionByName(own)
    return out


def seed_counts(candidates: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(seed, n) of each source, 0 where it gave nothing."""
    table = candidates.sparkSession.createDataFrame([(n,) for n in names], "seed string")
    return table.join(candidates.groupBy("seed").agg(F.count("*").alias("n")), "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("n"))


def read_rules(text: DataFrame) -> DataFrame:
    """(text: a JSON object with `rules`) -> usable rules in authored order. A rule without a matcher drops."""
    fields = ("repo", "org", "prefix", "brain", "remote", "origin", "sharedFrom")
    schema = ", ".join(f"{c} STRING" for c in fields) + ", deny STRING"
    rows = text.select(F.posexplode(F.from_json("text", f"rules ARRAY<STRUCT<{schema.replace(' STRING', ': STRING')}>>")["rules"]).alias("ord", "r")).filter("r IS NOT NULL")
    filled = rows.select("ord", *[F.nullif(F.col(f"r.{c}"), F.lit("")).alias(c) for c in fields], F.coalesce(F.col("r.deny") == "true", F.lit(False)).alias("deny"))
    origin = F.when(F.col("origin") == "shared", "shared").otherwise("local")
    return filled.filter("coalesce(repo, org, prefix) IS NOT NULL").select("ord", "repo", "org", "prefix", "brain", "deny", origin.alias("origin"), "remote", F.col("sharedFrom").alias("shared_from"))


def read_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster_key, refs, title, kind): the key is the file's name; a record without a list of refs drops."""
    rows = texts(spark, folder, "*.json").select(F.regexp_extract("path", "([^/]+)\\.json$", 1).alias("cluster_key"), F.from_json("text", "refs STRING, title STRING, kind STRING").alias("t"))
    return rows.filter(F.startswith("t.refs", F.lit("["))).select("cluster_key", F.from_json("t.refs", "ARRAY<STRING>").alias("refs"), "t.title", "t.kind")


def transcript_lines(lines: DataFrame) -> DataFrame:
    """(conv_id, line_no, json), in either dialect -> (conv_id, line_no, block_no, dialect, line): what was said and done.

    `message` records hold a text or blocks; of `response_item` records the payload counts. Other records and lines that
    don't parse have no rows. Texts of tool results are cut to 400 characters.
    """
    # a content may be a text or a list of blocks
    block = "STRUCT<type: STRING, text: STRING, name: STRING, content: VARIANT>"
    record = F.from_json("json", "type STRING, role STRING, content VARIANT, message STRUCT<role: STRING, content: VARIANT>, payload STRUCT<type: STRING, role: STRING, content: VARIANT, name: STRING, tool_name: STRING, output: VARIANT>")
    rows = lines.withColumn("r", record).filter("r IS NOT NULL")
    is_text = lambda c: F.coalesce(F.schema_of_variant(c) == "STRING", F.lit(False))
    blocks = lambda c: F.from_json(F.when(F.startswith(F.schema_of_variant(c), F.lit("ARRAY")), F.to_json(c)), f"ARRAY<{block}>")
    flat = lambda c: F.coalesce(F.when(is_text(c), c.cast("string")), F.array_join(F.transform(blocks(c), lambda b: b["text"]), "\n"), F.lit(""))
    result = lambda c: F.concat(F.lit("[tool_result] "), F.substring(flat(c), 1, TOOL_RESULT_CHARS))

    message = rows.filter("coalesce(r.type, '') <> 'response_item'").select("conv_id", "line_no", F.coalesce("r.message.role", F.when(F.col("r.message").isNull(), F.col("r.role")), "r.type").alias("role"), F.when(F.col("r.message").isNotNull(), F.col("r.message.content")).otherwise(F.col("r.content")).alias("content"))
    whole = message.filter(is_text(F.col("content")) & F.col("role").isNotNull()).select("conv_id", "line_no", F.lit(0).alias("block_no"), F.lit("message").alias("dialect"), F.concat("role", F.lit(": "), F.col("content").cast("string")).alias("line"))
    parts = message.select("conv_id", "line_no", "role", F.posexplode(blocks(F.col("content"))).alias("block_no", "b"))
    said = (
        F.when(F.col("b.type") == "text", F.concat(F.coalesce("role", F.lit("message")), F.lit(": "), "b.text"))
        .when(F.col("b.type") == "tool_use", F.concat(F.coalesce("role", F.lit("assistant")), F.lit(" [tool_use: "), "b.name", F.lit("]")))
        .when(F.col("b.type") == "tool_result", result(F.col("b.content")))
    )
    parts = parts.select("conv_id", "line_no", "block_no", F.lit("message").alias("dialect"), said.alias("line"))

    p = rows.filter("r.type = 'response_item'").select("conv_id", "line_no", "r.payload.*")
    text = flat(F.col("content"))
    done = (
        F.when((F.col("type") == "message") & F.col("role").isin("user", "assistant") & (text != ""), F.concat("role", F.lit(": "), text))
        .when(F.col("type").isin("function_call", "custom_tool_call", "tool_call", "local_shell_call", "mcp_tool_call", "web_search_call"), F.concat(F.lit("assistant [tool_use: "), F.coalesce("name", "tool_name", "type"), F.lit("]")))
        .when(F.col("type").isin("function_call_output", "custom_tool_call_output", "tool_result"), result(F.coalesce("output", "content")))
    )
    items = p.select("conv_id", "line_no", F.lit(0).alias("block_no"), F.lit("response").alias("dialect"), done.alias("line")).filter("line IS NOT NULL")
    # this dialect repeats its lines; the first of equal ones stays
    first = F.row_number().over(Window.partitionBy("conv_id", "line").orderBy("line_no"))
    items = items.withColumn("n", first).filter("n = 1").drop("n")
    return whole.unionByName(parts).unionByName(items).filter("line IS NOT NULL")


def read_decision_records(spark: SparkSession, folder: str) -> DataFrame:
    """One decision candidate a markdown file of docs/adr, in order of names: its first heading is the title."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = texts(spark, f"{folder.rstrip('/')}/docs/adr", "*.[mM][dD]").filter(~F.contains("path", F.lit("/")) & ~F.lower(name).isin("readme.md", "index.md"))
    heading = _strip(F.regexp_extract("text", "(?m)^#[ \\t]+([^\\n]+)$", 1))
    title = F.coalesce(F.nullif(heading, F.lit("")), F.regexp_replace(name, "(?i)\\.md$", ""))
    return rows.select(name.alias("file"), F.lit("decision").alias("kind"), title.alias("title"), F.substring(_strip(F.col("text")), 1, BODY_CHARS).alias("body"), F.array(F.lit("adr"), F.lit("seed")).alias("tags"))


def render_notes(notes: DataFrame, *carry: str) -> DataFrame:
    """(path, text): notes as files, the inverse of `parse_notes`, and columns that are carried along. Keys in a fixed order, empty ones left out."""
    quote = lambda c: F.concat(F.lit("'"), F.regexp_replace(c, "[\\r\\n]+", " "), F.lit("'"))
    scalar = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), quote(F.col(k)))) for k in SCALARS if k in notes.columns]
    several = [F.when(F.size(k) > 0, F.concat(F.lit(f"{k}:\n"), F.array_join(F.transform(k, lambda x: F.concat(F.lit("  - "), quote(x))), "\n"))) for k in LISTS if k in notes.columns]
    graduate = [F.when(F.col("graduate"), F.lit("graduate: true"))] if "graduate" in notes.columns else []
    front = F.concat_ws("\n", F.lit("---"), *scalar, *several, *graduate, F.lit("---"))
    return notes.select("path", F.concat(front, F.lit("\n"), F.coalesce(_strip(F.col("body")), F.lit("")), F.lit("\n")).alias("text"), *carry)
