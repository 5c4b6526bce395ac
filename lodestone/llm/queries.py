"""One thin query per operator, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import best_fit, brown, importance, infill, langid, licenses, minhash, mixing, packing, prefix_forest, sharding, telephony, token_output


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_forest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.store_and_inspect(_table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(_table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(_table(spark, sf_dir, "documents"))
    again = infill.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_shard_documents, op3_language_mixture, op4_prefix_forest, op5_pack_sequences, op6_license_scan, op7_telephony, op8_token_output, op9_minhash, op10_brown_scores,
              op11_best_fit, op12_fill_in_middle, op13_importance_resample)
}

OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(text, chr(0))) AS text_key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), shuffled AS (
  SELECT *, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || text_key) AS shuffle FROM docs
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sources
), levels AS (
  SELECT *, row_number() OVER w AS n,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighted WINDOW w AS (ORDER BY 3 * source_size::DOUBLE / weight::DOUBLE, source NULLS LAST)
), chosen AS (
  SELECT level FROM levels WHERE level * weight <= 3 * source_size ORDER BY n LIMIT 1
), targets AS (
  SELECT source, source_size, least((SELECT level FROM chosen) * weight, (3 * source_size)::DOUBLE) AS target FROM weighted
), placed AS (
  SELECT s.*, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.shuffle, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM shuffled s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), queue AS (
  SELECT p.doc_id, p.shuffle, p.size, nth, (nth * p.source_size + p.before + p.size)::DOUBLE / p.target AS finish
  FROM placed p, (VALUES (0), (1), (2)) AS passes(nth) WHERE p.size > 0 AND p.target > 0
), totals AS (
  SELECT *, sum(size) OVER (ORDER BY finish, shuffle, doc_id, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM queue
), taken AS (
  SELECT doc_id, shuffle, sum(size)::BIGINT AS taken FROM totals WHERE total <= (SELECT sum(size) FROM docs) GROUP BY doc_id, shuffle
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.doc_id IS NOT DISTINCT FROM t.doc_id AND p.shuffle = t.shuffle
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), shingles AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), sizes AS (
  SELECT doc_id, len(s) AS n FROM sets
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sizes s JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) m ON m.d = s.doc_id
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM docs
), cut AS (
  SELECT doc_id, text, n, form, least(c1, c2) AS a, greatest(c1, c2) AS b FROM drawn
), parts AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cut
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM made
"""

OP13_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT 'd' AS kind, doc_id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark
), split AS (
  SELECT kind, doc_id, r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM texts
), tokens AS (
  SELECT kind, r, unnest(w) AS w FROM split
), counted AS (
  SELECT kind, r, w, count(*) AS k FROM tokens GROUP BY kind, r, w
), vocabulary AS (
  SELECT w, hex(encode(w)) AS x FROM counted GROUP BY w
), buckets AS (
  SELECT w, (xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(t[((xor(c, b) & 255) + 1)::BIGINT], c >> 8))) % 10000)::BIGINT AS bucket FROM vocabulary, crc_table
), freq AS (
  SELECT bucket, coalesce(sum(k) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counted JOIN buckets USING (w) GROUP BY bucket
), totals AS (
  SELECT sum(s) AS big_s, sum(t) AS big_t FROM freq
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain FROM freq, totals
), weights AS (
  SELECT r, sum(k * gain)::BIGINT AS total FROM counted JOIN buckets USING (w) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, r, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(coalesce(total, 0)::DOUBLE / len(w))::BIGINT END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM split LEFT JOIN weights USING (r) WHERE kind = 'd'
), final AS (
  SELECT doc_id, r, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place FROM final WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM ranked) THEN place END AS rank
FROM final LEFT JOIN ranked USING (r)
"""

ORACLES: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op9_minhash": OP9_SQL, "op12_fill_in_middle": OP12_SQL, "op13_importance_resample": OP13_SQL}
