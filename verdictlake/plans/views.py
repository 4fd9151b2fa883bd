"""The driver's tables seen as corpora, predictions, records and findings; each
view also as DuckDB's SQL, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictlake import vocab
from verdictlake.functions import columns as C

_CLASSES = ", ".join(f"'{c}'" for c in vocab.CLASSES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _class(number: str):
    return F.expr(f"array(element_at(array({_CLASSES}), cast(({number}) % 8 + 1 as int)))")


def samples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("sample_id"), F.expr("source || '/' || lang || '/' || doc_id || '.txt'").alias("file"), F.expr("coalesce(toxic, 0) = 1 or coalesce(quality, 1) = 0").alias("vulnerable"), _class("doc_id").alias("cwe"), F.expr("case when doc_id % 5 <> 0 then cast(n_chars % 50 as int) end").alias("line"), F.col("lang").alias("language"), F.col("source").alias("group_id")
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """All decisions, with their status."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    n = docs.count()
    events = table(spark, d, "events").withColumn("doc_id", F.col("event_id") % max(1, n))
    status = F.expr("case when event_type in ('purchase', 'signup') then 'CONFIRMED' when event_type = 'click' then 'UNCERTAIN' when event_type = 'view' then 'REJECTED' else 'ERROR' end")
    return events.join(docs, "doc_id").select(
        F.col("event_id").alias("ord"), F.col("doc_id").cast("string").alias("sample_id"), F.expr("case when event_id % 3 = 0 then '/abs/' else '' end || source || '/' || lang || '/' || doc_id || '.txt'").alias("file"), _class("event_id * 7").alias("cwe"), F.expr("cast(floor(value) as int) % 50").alias("line"), (F.col("value") / 100).alias("confidence"), status.alias("status"), F.col("event_type").alias("source")
    )


def confirmed(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).where("status = 'CONFIRMED'")


def records(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("case when event_type in ('purchase', 'signup') then 'CONFIRMED' when event_type = 'click' then 'UNCERTAIN' when event_type = 'view' then 'REJECTED' else 'ERROR' end")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("sample_id"), F.col("event_id").alias("lineno"), status.alias("decision"), F.col("value").alias("elapsed"), F.expr("'m' || event_id % 3").alias("model"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    sev = F.expr("case when l_quantity > 40 then 'CRITICAL' when l_quantity > 30 then 'HIGH' when l_quantity > 20 then 'MEDIUM' when l_quantity > 10 then 'LOW' else 'information' end")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.expr("l_suppkey || '.c'").alias("file"), F.expr("cast(l_partkey % 200 as int)").alias("line"), F.col("l_returnflag").alias("tool"), F.expr("l_linestatus || '.' || l_linenumber").alias("rule_id"), sev.alias("severity"), _class("l_partkey").alias("cwe"), F.expr("'part ' || l_partkey").alias("message")
    )


def functions_of(spark: SparkSession, d: str) -> DataFrame:
    """Functions of files: nested spans, made from suppliers."""
    spans = F.expr("inline(array(named_struct('ord', 0, 'name', 'outer', 'start_line', 0, 'end_line', 150), named_struct('ord', 1, 'name', 'inner', 'start_line', cast(s_suppkey % 40 as int), 'end_line', cast(s_suppkey % 40 + 60 as int)), named_struct('ord', 2, 'name', 'tail', 'start_line', 120, 'end_line', 190)))")
    return table(spark, d, "supplier").select(F.expr("s_suppkey || '.c'").alias("file"), spans)


def tools(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", C.fingerprint("tool", "rule_id", "file", "line", "message"))


_FAMILY = ", ".join(f"('{c}', [{', '.join(repr(f) for f in vocab.families().get(c, [c]))}])" for c in sorted({*vocab.CLASSES}))
_STATUS = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'CONFIRMED' WHEN event_type = 'click' THEN 'UNCERTAIN' WHEN event_type = 'view' THEN 'REJECTED' ELSE 'ERROR' END"
SQL = {
    "fam": f"fam(c, fs) AS (VALUES {_FAMILY})",
    "samples": f"samples AS (SELECT doc_id AS ord, doc_id::VARCHAR AS sample_id, source || '/' || lang || '/' || doc_id || '.txt' AS file, coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 AS vulnerable, [{_CLASSES}][doc_id % 8 + 1] AS c, CASE WHEN doc_id % 5 <> 0 THEN (n_chars % 50)::INTEGER END AS line, lang AS language, source AS group_id FROM documents LEFT JOIN labels USING (doc_id))",
    "preds": f"preds AS (SELECT event_id AS ord, doc_id::VARCHAR AS sample_id, CASE WHEN event_id % 3 = 0 THEN '/abs/' ELSE '' END || d.source || '/' || lang || '/' || doc_id || '.txt' AS file, [{_CLASSES}][event_id * 7 % 8 + 1] AS c, floor(value)::INTEGER % 50 AS line, value / 100 AS confidence, {_STATUS} AS status, event_type AS source FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))",
    "records": f"records AS (SELECT user_id::VARCHAR AS sample_id, event_id AS lineno, {_STATUS} AS decision, value AS elapsed, 'm' || event_id % 3 AS model FROM events)",
    "findings": f"findings AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_suppkey || '.c' AS file, (l_partkey % 200)::INTEGER AS line, l_returnflag AS tool, l_linestatus || '.' || l_linenumber AS rule_id, CASE WHEN l_quantity > 40 THEN 'CRITICAL' WHEN l_quantity > 30 THEN 'HIGH' WHEN l_quantity > 20 THEN 'MEDIUM' WHEN l_quantity > 10 THEN 'LOW' ELSE 'information' END AS severity, [{_CLASSES}][l_partkey % 8 + 1] AS c, 'part ' || l_partkey AS message FROM lineitem)",
    "funcs": "funcs AS (SELECT s_suppkey || '.c' AS file, unnest([{'ord': 0, 'name': 'outer', 'start_line': 0, 'end_line': 150}, {'ord': 1, 'name': 'inner', 'start_line': (s_suppkey % 40)::INTEGER, 'end_line': (s_suppkey % 40 + 60)::INTEGER}, {'ord': 2, 'name': 'tail', 'start_line': 120, 'end_line': 190}], recursive := true) FROM supplier)",
    # candidates of confirmed predictions and vulnerable truth, on these views
    "cand": "cand AS (SELECT p.ord AS pi, g.ord AS gi, p.sample_id AS p_sample, least(1.0::DOUBLE, 0.65::DOUBLE + CASE WHEN g.line IS NULL OR p.line IS NULL THEN 0.1::DOUBLE ELSE (1 - abs(p.line - g.line) / 5.0::DOUBLE) * 0.35::DOUBLE END) AS score FROM pos p JOIN samples g ON g.vulnerable AND (p.file = g.file OR p.file = '/abs/' || g.file) JOIN fam a ON a.c = p.c JOIN fam b ON b.c = g.c WHERE list_has_any(a.fs, b.fs) AND coalesce(abs(p.line - g.line) <= 5, true))",
    "cand_any": "cand AS (SELECT p.ord AS pi, g.ord AS gi, p.sample_id AS p_sample, least(1.0::DOUBLE, 0.4::DOUBLE + CASE WHEN g.line IS NULL OR p.line IS NULL THEN 0.1::DOUBLE ELSE (1 - abs(p.line - g.line) / 5.0::DOUBLE) * 0.35::DOUBLE END) AS score FROM pos p JOIN samples g ON g.vulnerable AND (p.file = g.file OR p.file = '/abs/' || g.file) WHERE coalesce(abs(p.line - g.line) <= 5, true))",
    "pos": "pos AS (SELECT * FROM preds WHERE status = 'CONFIRMED')",
    "matches": "ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, pi DESC, gi DESC) AS k FROM cand), walk(k, ps, gs) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT r.k, CASE WHEN list_contains(ps, pi) OR list_contains(gs, gi) THEN ps ELSE list_append(ps, pi) END, CASE WHEN list_contains(ps, pi) OR list_contains(gs, gi) THEN gs ELSE list_append(gs, gi) END FROM walk w JOIN ranked r ON r.k = w.k + 1), final AS (SELECT ps, gs FROM walk ORDER BY k DESC LIMIT 1), taken AS (SELECT unnest(ps) AS pi, unnest(gs) AS gi FROM final), matches AS (SELECT t.pi, t.gi, c.score, c.p_sample FROM taken t JOIN cand c USING (pi, gi))",
    "conf": "conf AS (SELECT tp, fp_off + fp_on AS fp, fn, n_benign - s_fp AS tn, s_tp, s_fp, n_vulnerable - s_tp AS s_fn, n_benign - s_fp AS s_tn FROM (SELECT (SELECT count(*) FROM matches) AS tp, (SELECT count(*) FROM pos p WHERE ord NOT IN (SELECT pi FROM matches) AND sample_id NOT IN (SELECT sample_id FROM samples WHERE NOT vulnerable)) AS fp_off, (SELECT count(*) FROM pos WHERE sample_id IN (SELECT sample_id FROM samples WHERE NOT vulnerable)) AS fp_on, (SELECT count(*) FROM samples WHERE vulnerable AND ord NOT IN (SELECT gi FROM matches)) AS fn, (SELECT count(*) FROM samples WHERE NOT vulnerable) AS n_benign, (SELECT count(DISTINCT sample_id) FROM pos WHERE sample_id IN (SELECT sample_id FROM samples WHERE NOT vulnerable)) AS s_fp, (SELECT count(DISTINCT p_sample) FROM matches WHERE p_sample IN (SELECT sample_id FROM samples WHERE vulnerable)) AS s_tp, (SELECT count(*) FROM samples WHERE vulnerable) AS n_vulnerable))",
}


def sql(names: str, body: str) -> str:
    """WITH the named views: a query."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body


MATCHED = "fam samples preds pos cand matches"
