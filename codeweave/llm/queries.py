"""Registered queries of the training-data operators: thin wrappers that read
the whole table, call the operator and keep the contract's columns, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, ship_code
from . import (embed_dedup, exact_dedup, html_text, lexical_search, mixing, near_dedup, ngram, packing, periodic_runs, pieces,
               quality, substring_dedup, suffix_dedup)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return read_table(spark, sf_dir, name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.score(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), size=35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS t
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM rep),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("n_chunks")


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)"""

def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(_table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"), limit=0.93)


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), "kept")


def _mixing_sql(docs: str, share: float = 0.5, sweeps: int = 25) -> str:
    """CTEs that end in ``mixed``: rows of the view ``docs`` with their rates."""
    topics = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in mixing.TOPICS)
    parts = [f"""feat AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE {topics} ELSE 'prose' END AS topic, len(regexp_extract_all(t, '{mixing.WORD}')) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM {docs})),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM feat GROUP BY ALL)"""]
    for dim, power in (("source", 0.5), ("lang", 0.5), ("topic", 0.7)):
        parts.append(f"""t_{dim} AS (SELECT {dim}, pow(m, {power}) / sum(pow(m, {power})) OVER ()
  * (SELECT sum(n) FROM cells) AS target FROM (SELECT {dim}, sum(n) AS m FROM cells GROUP BY 1) WHERE m > 0)""")
    last = "(SELECT *, n AS w FROM cells)"
    for k in range(sweeps):
        for dim in mixing.DIMS:
            parts.append(f"""s_{dim}_{k} AS MATERIALIZED (SELECT source, lang, topic, n,
  CASE WHEN sum(w) OVER (PARTITION BY {dim}) > 0
    THEN w * coalesce(target, 0) / sum(w) OVER (PARTITION BY {dim}) ELSE 0 END AS w
  FROM {last} LEFT JOIN t_{dim} USING ({dim}))""")
            last = f"s_{dim}_{k}"
    parts.append(f"""r AS (SELECT *, CASE WHEN n > 0 THEN w / n ELSE 1 END AS weight FROM {last}),
o AS (SELECT *, {share} * sum(n) OVER () AS budget, coalesce(sum(n) OVER before, 0) AS full_n,
  sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest FROM r
  WINDOW before AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT (budget - full_n) / rest AS c FROM o WHERE rest > 0 AND (budget - full_n) / rest * weight < 1
  ORDER BY weight DESC, source, lang, topic LIMIT 1),
mixed AS (SELECT doc_id, source, lang, topic, n_tokens, weight, least(1.0, weight * c) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < weight * c AS kept
  FROM feat JOIN r USING (source, lang, topic), c)""")
    return ",\n".join(parts)


OP7_SQL = f"""WITH {_mixing_sql('documents')}
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, kept
FROM mixed"""


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b USING (sh)
      WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""

def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"), size=400).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def _terms_sql(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


OP11_SQL = f"""
WITH d AS (SELECT doc_id, ts, len(ts)::BIGINT AS n FROM (SELECT doc_id, {_terms_sql('text')} AS ts FROM documents) WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM d),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS r FROM (SELECT item_id, unnest({_terms_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in (
        "start", "length", "period"))), F.lit("\n")))
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": (pipeline, None),
    "op1_quality": (op1_quality, None),
    "op2_substring_dedup": (op2_substring_dedup, OP2_SQL),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_lm_score": (op4_lm_score, None),
    "op5_pack": (op5_pack, None),
    "op6_embedding_dedup": (op6_embedding_dedup, OP6_SQL),
    "op7_mixing": (op7_mixing, OP7_SQL),
    "op8_near_dedup": (op8_near_dedup, OP8_SQL),
    "op9_suffix_dedup": (op9_suffix_dedup, None),
    "op10_main_text": (op10_main_text, None),
    "op11_lexical_search": (op11_lexical_search, OP11_SQL),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_pieces": (op13_pieces, None),
}
