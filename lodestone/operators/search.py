"""Lexical, semantic and fused retrieval over notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.scalars import collapse
from lodestone.session import stash

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, CANDIDATES, LIMIT = 60, 50, 20


def tokens(text: Column) -> Column:
    """ASCII letters and digits in lower case; all else parts tokens."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def query_terms(query: str) -> list[str]:
    out: list[str] = []
    for word in query.split():
        for t in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in word).split():
            if t not in out:
                out.append(t)
    return out


def is_superseded() -> Column:
    by = F.col("kind").isin("memory", "decision") & (F.length("superseded_by") > 0)
    return F.coalesce(by, F.lit(False)) | F.coalesce(F.col("status") == "superseded", F.lit(False))


def index_rows(notes: DataFrame) -> DataFrame:
    return notes.withColumn("superseded", is_superseded()).withColumn("tag_text", F.array_join("tags", " "))


def lexical(notes: DataFrame, query: str, kind: str | None = None, source: str | None = None, include_superseded: bool = False) -> DataFrame:
    """id, kind, title, path, source, status, n_match, score: notes that hold all query terms, or any if none holds all.

    BM25 over id, kind, title, tags and body with k1 1.2, b 0.75; document counts and lengths are those of all notes. Term
    counts are made once and written without the texts; an aggregate of one row gives the corpus figures and the most terms
    that a note holds, and is broadcast.
    """
    terms = query_terms(query)
    rows = index_rows(notes).withColumn("tokens", tokens(F.concat_ws(" ", "id", "kind", "title", "tag_text", "body")))
    counts = [(F.size("tokens") - F.size(F.array_remove("tokens", t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = stash(rows.select("id", "kind", "title", "path", "source", "status", "tag_text", "superseded", F.size("tokens").alias("dl"), *counts), "lexical-counts")
    passes = F.lit(include_superseded) | ~F.col("superseded")
    if kind:
        passes = passes & (F.col("kind") == kind)
    if source:
        passes = passes & (F.col("source") == source)
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n_docs") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        matched = matched + (tf > 0).cast("int")
    held = [F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    corpus = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.max(F.when(passes, matched)).alias("most"), *held)
    # corpus is one row; the most terms held are all of them or, if no note holds all, any will do
    hits = rows.filter(passes & (matched > 0)).join(F.broadcast(corpus))
    hits = hits.filter((F.col("most") < len(terms)) | (matched == len(terms)))
    return hits.select("id", "kind", "title", "path", "source", "status", "tag_text", matched.alias("n_match"), score.alias("score"))


def fresh_first() -> list[Column]:
    return [F.coalesce(F.col("status") == "stale", F.lit(False)).cast("int"), F.col("score").desc(), F.col("id")]


def search_lexical(notes: DataFrame, query: str, limit: int = LIMIT, **filters: object) -> DataFrame:
    return lexical(notes, query, **filters).orderBy(*fresh_first()).limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, mismatched and zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    length = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0), dot / length).otherwise(0.0)


def semantic(notes: DataFrame, vectors: DataFrame, query_vec: list[float], limit: int = CANDIDATES, include_superseded: bool = False) -> DataFrame:
    """id, similarity of the notes nearest to the query vector; only positive ones, vectors without a note drop."""
    meta = index_rows(notes).filter(F.lit(include_superseded) | ~F.col("superseded")).select("id", "kind", "title", "path", "source", "status", "tag_text")
    near = vectors.withColumn("similarity", cosine(F.col("vec"), F.array(*[F.lit(float(x)) for x in query_vec]))).filter("similarity > 0").select("id", "similarity")
    return near.join(meta, "id").orderBy(F.desc("similarity"), "id").limit(limit)


def hybrid(notes: DataFrame, vectors: DataFrame, query: str, query_vec: list[float], limit: int = LIMIT, min_support: int = 0, **filters: object) -> DataFrame:
    """Reciprocal-rank fusion of both lists, with ranks and tier; stale notes last."""
    lex = lexical(notes, query, **filters).orderBy(*fresh_first()).limit(max(limit, CANDIDATES))
    sem = semantic(notes, vectors, query_vec)
    l = lex.withColumn("lexical_rank", F.row_number().over(Window.orderBy(*fresh_first())))
    s = sem.withColumn("semantic_rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))
    meta = ["kind", "title", "path", "source", "status", "tag_text"]
    both = l.select("id", "lexical_rank", *[F.col(c).alias(f"l_{c}") for c in meta]).join(s.select("id", "semantic_rank", *[F.col(c).alias(f"s_{c}") for c in meta]), "id", "full")
    both = both.select("id", "lexical_rank", "semantic_rank", *[F.coalesce(f"l_{c}", f"s_{c}").alias(c) for c in meta])
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    tier = F.when(F.col("lexical_rank").isNotNull() & F.col("semantic_rank").isNotNull(), "hybrid").when(F.col("lexical_rank").isNotNull(), "lexical").otherwise("semantic")
    both = both.withColumn("score", part("lexical_rank") + part("semantic_rank")).withColumn("tier", tier)
    if min_support > 0:
        # query words count as often as they are given
        words = [w.replace('"', "").lower() for w in query.split()]
        hay = F.lower(F.concat_ws(" ", "title", "tag_text"))
        hits = sum((F.contains(hay, F.lit(w)).cast("int") for w in words if w), F.lit(0))
        support = F.when(F.col("lexical_rank").isNotNull(), F.greatest(F.lit(1), hits)).otherwise(hits)
        both = both.filter(support >= min_support)
    return both.orderBy(*fresh_first()).limit(limit)


def with_bodies(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """Hits, a top-k, with `body`: the notes of their ids alone go past this join, whatever is cut from the bodies then."""
    return notes.select("id", "body").join(F.broadcast(hits), "id")


def ask(hits: DataFrame, notes: DataFrame, max_chars: int, query: str) -> DataFrame:
    """Ranked hits with excerpts whose sizes fit the budget, in order; the first always stays. `hits`, a top-k, has rank, id, title, path, score."""
    # what is cut to excerpts is written first, or the cutting would move below the join
    found = stash(with_bodies(hits, notes), "search-bodies")
    sized = found.withColumn("excerpt", snippet(F.col("body"), query)).withColumn("size", F.length("title") + F.length("path") + F.length("excerpt"))
    running = F.sum("size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("used", running).filter((F.col("rank") == 1) | (F.col("used") <= max_chars))


def coverage_signal(hits: DataFrame) -> DataFrame:
    return hits.agg((F.count("*") > 0).alias("matched"), F.coalesce(F.max_by("score", -F.col("rank")), F.lit(0.0)).alias("top_score"), F.count("*").alias("total"))


def plain_snippet(body: Column, most: int = 240) -> Column:
    line = collapse(body)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def snippet(body: Column, query: str, window: int = 12) -> Column:
    """`window` words around the first one that holds a query term: up to five before it, hits in brackets, … where words are left out.

    A body without a hit shows its first words.
    """
    terms = F.array(*[F.lit(t) for t in query_terms(query)]).cast("array<string>")
    hit = lambda w: F.arrays_overlap(F.split(F.lower(w), "[^a-z0-9]+"), terms)
    words = F.filter(F.split(collapse(body), " "), lambda w: w != "")
    first = F.array_position(F.transform(words, hit), True)
    begin = F.greatest(F.lit(1), first - 5).cast("int")
    shown = F.array_join(F.transform(F.slice(words, begin, window), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
    return F.concat(F.when(begin > 1, "…").otherwise(""), shown, F.when(begin + window - 1 < F.size(words), "…").otherwise(""))


def with_snippets(hits: DataFrame, notes: DataFrame, query: str) -> DataFrame:
    """Hits, a top-k, with what surrounds their match; of a hit by meaning alone, how the note begins. Excerpts are cut from the hits' bodies, after the join."""
    rows = stash(with_bodies(hits, notes), "search-bodies")
    around, begin = snippet(F.col("body"), query), plain_snippet(F.col("body"))
    return rows.withColumn("excerpt", F.when(F.col("lexical_rank").isNull(), begin).otherwise(around) if "lexical_rank" in hits.columns else around).drop("body")


def retrieve(notes: DataFrame, vectors: DataFrame | None, query: str, query_vec: list[float] | None, limit: int = LIMIT, semantic_on: bool = True, min_support: int = 0) -> DataFrame:
    """Fused retrieval where there are vectors, a query vector and the flag; else the lexical list alone, with the same columns."""
    if semantic_on and vectors is not None and query_vec:
        return hybrid(notes, vectors, query, query_vec, limit, min_support)
    hits = search_lexical(notes, query, limit).withColumn("lexical_rank", F.row_number().over(Window.orderBy(*fresh_first())))
    return hits.withColumn("semantic_rank", F.lit(None).cast("int")).withColumn("tier", F.lit("lexical")).select("id", "lexical_rank", "semantic_rank", "kind", "title", "path", "source", "status", "tag_text", "score", "tier").orderBy(*fresh_first())


def query_context(notes: DataFrame, vectors: DataFrame | None, query: str, query_vec: list[float] | None, limit: int = 10) -> DataFrame:
    """(rank, id, kind, title, body, tier, ranks, score): the notes themselves of a strict search, in order, for injection. A blank query has the default context's place."""
    hits = retrieve(notes, vectors, query, query_vec, limit, min_support=1).withColumn("rank", F.row_number().over(Window.orderBy(*fresh_first())))
    return hits.select("rank", "id", "tier", "lexical_rank", "semantic_rank", "score").join(notes.select("id", "kind", "title", "body", "path"), "id")


def default_context(notes: DataFrame, limit: int = 10) -> DataFrame:
    """Active work by id, then decisions from the newest; superseded decisions stay, as the rule has it."""
    work = notes.filter("kind = 'work-state' AND status <> 'done'").select(F.lit(0).alias("section"), "id", "kind", "title", "created", F.lit("").alias("newest"))
    decisions = notes.filter("kind = 'decision'").select(F.lit(1).alias("section"), "id", "kind", "title", "created", F.col("created").alias("newest"))
    return work.unionByName(decisions).orderBy("section", F.desc("newest"), "id").limit(limit).drop("newest")


def who_is(notes: DataFrame, query: str) -> DataFrame:
    """People whose name, title, id or a tag holds the query; all of them for a blank one."""
    q = query.strip().lower()
    name = F.col("name") if "name" in notes.columns else F.lit(None).cast("string")
    hit = F.coalesce(F.contains(F.lower(name), F.lit(q)), F.lit(False)) | F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q)))
    return notes.filter(F.col("kind") == "person").filter(hit if q else F.lit(True))
