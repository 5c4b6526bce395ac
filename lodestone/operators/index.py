"""A stored lexical index in segments: a change adds a segment or a set of deletions, and no other note is read again.

A segment is written once. Its rows are numbered, and for each term and each span of rows there is one block of postings with
the highest count and the shortest note in it, which bound what any posting of the block can add to a score. A search reads the
bounds of its terms' blocks, looks into the most promising spans, and then only into those that can still reach the result.
Deletions are lists of rows with counts of their own; sums over segments less those of deletions are the corpus figures. Which
segments count is said by the newest version of the manifest, which is written last.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lodestone.operators.search import B, IDF_FLOOR, K1, LIMIT, fresh_first, index_rows, query_terms, tokens
from lodestone.session import ship_package, stash

#: Rows of a segment that share a block of each term.
SPAN = 4096
#: Postings that are held before they are put in blocks; a span with more has several blocks of a term.
POSTINGS = 4_000_000
#: Spans that a search looks into first.
FIRST_SPANS = 64
#: Ids and spans that a filter lists for the reader of files; more are joined.
LISTED = 1000
#: Segments of one size class that are merged into one, and how much larger the next class is; notes of the smallest class.
FAN, SMALL = 4, 4096
_NOTE = ["id", "kind", "source", "status", "superseded", "title", "path", "tag_text"]
_MANIFEST = "segment string, kind string, n_docs long, sum_dl long, version int"


@dataclass(frozen=True)
class Answer:
    """The notes found and how many spans of rows the terms' blocks have, and how many of these were looked into."""

    notes: DataFrame
    spans: int
    met: int


def _manifest(spark: SparkSession, folder: str) -> list[Row]:
    """The entries of the newest version: an entry a segment or set of deletions."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    newest = rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == newest).collect()


def _commit(spark: SparkSession, folder: str, entries: list[tuple], version: int) -> None:
    spark.createDataFrame([(*e, version) for e in entries], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def _all(spark: SparkSession, folder: str, entries: list, kind: str, name: str) -> DataFrame | None:
    """`name` of all segments, or sets of deletions, with the segment it belongs to."""
    parts = [spark.read.parquet(f"{folder}/{kind}/{e[0]}/{name}").withColumn("of", F.lit(e[0])) for e in entries if e[1] == kind]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, dl, terms, span) in order of rows -> a row a term and span, in order of terms within a span. A span waits for its rows in the next batch, up to POSTINGS."""

    def closed(rows: pa.Table) -> pa.RecordBatch:
        row, dl, terms = (rows.column(i).combine_chunks() for i in range(3))
        flat, n = terms.flatten(), np.asarray(pc.list_value_length(terms))
        of = np.repeat(np.arange(len(n)), n)
        words, tf = flat.field(0), np.asarray(flat.field(1))
        coded = words.dictionary_encode()
        by_word = np.asarray(pc.sort_indices(coded.dictionary))
        place = np.empty(len(by_word), np.int32)
        place[by_word] = np.arange(len(by_word))
        term = place[np.asarray(coded.indices)]
        # rows stay in order within a term
        order = np.argsort(term, kind="stable")
        term, of, tf = term[order], of[order], tf[order]
        starts = np.flatnonzero(np.append(True, np.diff(term) != 0))
        at, lengths = np.asarray(row)[of], np.asarray(dl)[of]
        offsets = pa.array(np.append(starts, len(term)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (at, tf, lengths)]
        columns = [coded.dictionary.take(pa.array(by_word[term[starts]])), pa.array(np.full(len(starts), rows.column(3)[0].as_py())), pa.array(np.diff(np.append(starts, len(term))))]
        columns += [pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(lengths, starts)), *lists]
        return pa.record_batch(columns, names=["term", "span", "n", "most_tf", "least_dl", "rows", "tfs", "dls"])

    rest: list[pa.RecordBatch] = []
    held, last = 0, -1
    for batch in batches:
        # a row without terms has no postings
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
        span = np.asarray(batch.column(3))
        ends = np.flatnonzero(np.append(np.diff(span) != 0, [True] * (len(span) > 0))) + 1
        for begin, end in zip([0, *ends], ends):  # noqa: B905
            if rest and (last != span[begin] or held > POSTINGS):
                yield closed(pa.Table.from_batches(rest))
                rest, held = [], 0
            rest.append(batch.slice(begin, end - begin))
            held, last = held + len(rest[-1].column(2).flatten()), span[begin]
    if rest:
        yield closed(pa.Table.from_batches(rest))


def _write_segment(rows: DataFrame, folder: str) -> tuple[str, str, int, int]:
    """Notes (what a hit shows, dl, row and counts of terms) and blocks, of rows (note, dl, terms array of (term, tf)) -> an entry of the manifest."""
    name = uuid.uuid4().hex
    path = f"{folder}/add/{name}"
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows.write.parquet(f"{path}/notes")
    rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/notes")
    # rows of a span stand together in one file, so they meet without a shuffle; where a file is read by several tasks, a term may have a block from each
    entries = rows.select("row", "dl", "terms", F.expr(f"row div {SPAN}").alias("span"))
    lists = [StructField("rows", ArrayType(LongType())), StructField("tfs", ArrayType(IntegerType())), StructField("dls", ArrayType(IntegerType()))]
    bounds = [StructField("n", LongType()), StructField("most_tf", IntegerType()), StructField("least_dl", IntegerType())]
    blocks = entries.mapInArrow(_blocks, StructType([StructField("term", StringType()), StructField("span", LongType()), *bounds, *lists]))
    blocks.sortWithinPartitions("term", "span").write.parquet(f"{path}/blocks")
    n, dl = rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return name, "add", n, dl


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, arrays of tokens, becomes `dl` and `terms`; a batch's words are numbered and counted as one array."""
    for batch in batches:
        words = batch.column(batch.num_columns - 1)
        flat = words.flatten().dictionary_encode()
        dl = np.asarray(pc.list_value_length(words))
        kinds = max(1, len(flat.dictionary))
        pairs, counts = np.unique(np.repeat(np.arange(len(dl)), dl) * kinds + np.asarray(flat.indices), return_counts=True)
        offsets = np.searchsorted(pairs // kinds, np.arange(len(dl) + 1)).astype(np.int32)
        struct = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(pairs % kinds)), pa.array(counts.astype(np.int32))], ["term", "tf"])
        names = batch.schema.names[:-1]
        yield pa.record_batch([*batch.columns[:-1], pa.array(dl, pa.int32()), pa.ListArray.from_arrays(offsets, struct)], names=[*names, "dl", "terms"])


def _counted(notes: DataFrame) -> DataFrame:
    """Notes with `dl` and `terms`: an array of (term, tf), counted where the note is read. A null text counts as empty."""
    ship_package(notes.sparkSession)
    rows = index_rows(notes).withColumn("tokens", tokens(F.concat_ws(" ", "id", "kind", "title", "tag_text", "body"))).select(*_NOTE, "tokens")
    schema = StructType([*rows.schema.fields[:-1], StructField("dl", IntegerType()), StructField("terms", ArrayType(StructType([StructField("term", StringType()), StructField("tf", IntegerType())])))])
    return rows.mapInArrow(_term_counts, schema)


def build(notes: DataFrame, folder: str) -> None:
    """A new index of one segment. Rows with equal ids stay rows of their own."""
    _commit(notes.sparkSession, folder, [_write_segment(_counted(notes), folder)], _version(notes.sparkSession, folder) + 1)


def _version(spark: SparkSession, folder: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return -1
    newest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").agg(F.max("version")).first()[0]
    return -1 if newest is None else newest


def _alive(spark: SparkSession, folder: str, entries: list, ids: DataFrame) -> DataFrame:
    """(of, row, dl) of the indexed notes with these ids that aren't deleted. Other notes' columns, and all their terms, stay unread."""
    notes = _all(spark, folder, entries, "add", "notes").select("of", "row", "id", "dl")
    few = [r["id"] for r in ids.select("id").distinct().limit(LISTED + 1).collect()]
    hit = notes.filter(F.col("id").isin(few)) if len(few) <= LISTED else notes.join(ids.select("id").distinct(), "id", "left_semi")
    gone = _all(spark, folder, entries, "delete", "rows")
    hit = hit if gone is None else hit.join(gone.select("segment", "row"), (F.col("of") == F.col("segment")) & (hit["row"] == gone["row"]), "left_anti")
    return hit.select("of", "row", "dl")


def _delete(spark: SparkSession, folder: str, entries: list, ids: DataFrame) -> list[tuple]:
    hit = stash(_alive(spark, folder, entries, ids), "index-deleted")
    n, dl = hit.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if not n:
        return []
    name = uuid.uuid4().hex
    hit.select(F.col("of").alias("segment"), "row").write.parquet(f"{folder}/delete/{name}/rows")
    terms = _all(spark, folder, entries, "add", "notes").select("of", "row", "terms").join(hit.select("of", "row"), ["of", "row"], "left_semi")
    counts = terms.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counts.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/delete/{name}/terms")
    return [(name, "delete", n, dl)]


def update(spark: SparkSession, folder: str, changed: DataFrame | None = None, gone: DataFrame | None = None) -> None:
    """Notes that are new or edited (all their columns), and ids (id) of notes that are no more. Unchanged notes are not read.

    An edited note is one whose id is indexed: its old rows are deleted and its new ones are a part of a new segment. Nothing
    counts before the manifest's new version is written, so an update that was cut off can be run again.
    """
    entries, version = [tuple(e)[:4] for e in _manifest(spark, folder)], _version(spark, folder)
    ids = [df.select("id") for df in (changed, gone) if df is not None]
    if not ids:
        return
    added = _delete(spark, folder, entries, ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1]))
    if changed is not None:
        added.append(_write_segment(_counted(changed), folder))
    if added:
        _commit(spark, folder, entries + added, version + 1)


def merge(spark: SparkSession, folder: str, fan: int = FAN) -> int:
    """Segments of one size class become one, without what was deleted of them, when there are `fan` of them; returns how many were merged.

    Counts of terms come from the segments, so no note's text is read.
    """
    entries, version = [tuple(e)[:4] for e in _manifest(spark, folder)], _version(spark, folder)
    classes: dict[int, list[tuple]] = {}
    for e in entries:
        if e[1] == "add":
            size, n = 0, e[2]
            while n > SMALL:
                n, size = n // fan, size + 1
            classes.setdefault(size, []).append(e)
    due = next((c for _, c in sorted(classes.items()) if len(c) >= fan), None)
    if due is None:
        return 0
    names = [e[0] for e in due]
    notes = _all(spark, folder, due, "add", "notes")
    kept, deletions = [e for e in entries if e[1] == "add" and e[0] not in names], [e for e in entries if e[1] == "delete"]
    gone = _all(spark, folder, deletions, "delete", "rows")
    rest: list[tuple] = []
    if gone is not None:
        of_due = gone.filter(F.col("segment").isin(names)).select("segment", F.col("row").alias("gone_row"))
        live = notes.join(of_due, (F.col("of") == F.col("segment")) & (F.col("row") == F.col("gone_row")), "left_anti")
        others = stash(gone.filter(~F.col("segment").isin(names)).select("segment", "row"), "index-left")
        if others.take(1):
            left = _all(spark, folder, kept, "add", "notes").select("of", "row", "dl", "terms")
            of_left = left.join(others.select("segment", F.col("row").alias("gone_row")), (F.col("of") == F.col("segment")) & (F.col("row") == F.col("gone_row")), "left_semi")
            name = uuid.uuid4().hex
            others.write.parquet(f"{folder}/delete/{name}/rows")
            of_left.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.count("*").alias("df")).write.parquet(f"{folder}/delete/{name}/terms")
            n, dl = of_left.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            rest = [(name, "delete", n, dl)]
        notes = live
    merged = _write_segment(notes.select(*_NOTE, "dl", "terms"), folder)
    _commit(spark, folder, [*kept, merged, *rest], version + 1)
    return len(due)


def answer(spark: SparkSession, folder: str, query: str, limit: int = LIMIT, kind: str | None = None, source: str | None = None, include_superseded: bool = False, first_spans: int = FIRST_SPANS) -> Answer:
    """What `search_lexical` returns over the indexed notes: BM25, all terms or else any, stale notes last.

    A span's bound is the sum of its terms' bounds. Notes that aren't stale come first, so the k-th best of those is what the
    bounds of further spans are held against; while there are fewer than k of them, every span counts.
    """
    terms, entries = query_terms(query), [tuple(e)[:4] for e in _manifest(spark, folder)]
    blocks = _all(spark, folder, entries, "add", "blocks").filter(F.col("term").isin(terms) if terms else F.lit(False))
    heads = blocks.select("of", "term", "span", "n", "most_tf", "least_dl")
    df = dict.fromkeys(terms, 0) | {r["term"]: r["df"] for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    gone = _all(spark, folder, entries, "delete", "rows")
    if gone is not None:
        counted = _all(spark, folder, entries, "delete", "terms").filter(F.col("term").isin(terms))
        for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] -= r["df"]
    sign = {"add": 1, "delete": -1}
    n_docs, length = (sum(sign[e[1]] * e[i] for e in entries) for i in (2, 3))
    average = length / n_docs if n_docs else 1.0

    weights = {t: max(IDF_FLOOR, math.log((n_docs - n + 0.5) / (n + 0.5))) for t, n in df.items()}
    idf = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("term")) if terms else F.lit(0.0)
    part = lambda tf, dl: idf * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.lit(average)))
    spans = heads.groupBy("of", "span").agg(F.sum(part("most_tf", "least_dl")).alias("bound"), F.count_distinct("term").alias("n_terms"))
    passes = F.lit(True) if include_superseded else ~F.col("superseded")
    for name, value in (("kind", kind), ("source", source)):
        if value:
            passes = passes & (F.col(name) == value)

    def best(chosen: DataFrame, places: list[Row] | None, every: bool) -> list[Row]:
        """The `limit` best hits (of, row, id, stale, n_match, score) of these spans; few spans are listed, so that the reader skips other blocks."""
        among = blocks
        if places is not None:
            among = blocks.filter(F.col("span").isin(sorted({p["span"] for p in places})))
            chosen = F.broadcast(spark.createDataFrame([(p["of"], p["span"]) for p in places], "of string, span long"))
        inside = among.join(chosen, ["of", "span"], "left_semi")
        found = inside.select("of", "term", F.inline(F.arrays_zip("rows", "tfs", "dls"))).toDF("of", "term", "row", "tf", "dl")
        if gone is not None:
            found = found.join(gone.select(F.col("segment").alias("of"), "row"), ["of", "row"], "left_anti")
        hits = found.groupBy("of", "row").agg(F.count("*").alias("n_match"), F.sum(part("tf", "dl")).alias("score"))
        if every:
            hits = hits.filter(F.col("n_match") == len(terms))
        shown = _all(spark, folder, entries, "add", "notes").select("of", "row", "id", "kind", "source", "status", "superseded").filter(passes)
        if places is not None:
            shown = shown.filter(F.expr(f"row div {SPAN}").isin(sorted({p["span"] for p in places})))
        hits = hits.join(shown, ["of", "row"]).select("of", "row", "id", F.coalesce(F.col("status") == "stale", F.lit(False)).alias("stale"), "n_match", "score")
        return hits.orderBy("stale", F.desc("score"), "id").limit(limit).collect()

    total, met, hits = spans.count(), 0, []
    for every in (True, False):
        # all terms can only meet in a span that has blocks of all
        open_ = spans.filter(F.col("n_terms") == len(terms)) if every else spans
        first = open_.orderBy(F.desc("bound"), "of", "span").limit(first_spans).collect()
        if not first:
            continue
        hits, met = best(open_, first, every), met + len(first)
        if len(first) == first_spans:
            seen = F.broadcast(spark.createDataFrame([(p["of"], p["span"]) for p in first], "of string, span long"))
            rest = open_.join(seen, ["of", "span"], "left_anti")
            if len(hits) == limit and not hits[-1]["stale"]:
                rest = rest.filter(F.col("bound") >= hits[-1]["score"] - 1e-9)
            n = rest.count()
            if n:
                more = best(rest, rest.select("of", "span").collect() if n <= LISTED else None, every)
                hits, met = sorted([*hits, *more], key=lambda r: (r["stale"], -r["score"], r["id"]))[:limit], met + n
        if hits:
            break
    if not hits:
        none = _all(spark, folder, entries, "add", "notes").filter(F.col("row") < 0)
        return Answer(none.select("id", "kind", "title", "path", "source", "status", "tag_text", F.lit(0).alias("n_match"), F.lit(0.0).alias("score")), total, met)
    top = F.broadcast(spark.createDataFrame([(h["of"], h["row"], h["n_match"], h["score"]) for h in hits], "of string, row long, n_match int, score double"))
    notes = _all(spark, folder, entries, "add", "notes").select("of", "row", *_NOTE)
    notes = notes.filter(F.col("row").isin([h["row"] for h in hits])) if len(hits) <= LISTED else notes
    shown = notes.join(top, ["of", "row"]).select("id", "kind", "title", "path", "source", "status", "tag_text", "n_match", "score").orderBy(*fresh_first())
    return Answer(shown, total, met)


def search(spark: SparkSession, folder: str, query: str, limit: int = LIMIT, kind: str | None = None, source: str | None = None, include_superseded: bool = False) -> DataFrame:
    return answer(spark, folder, query, limit, kind, source, include_superseded).notes
