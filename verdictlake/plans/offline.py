"""Queries on stored results: policies, misses, queues, paired tests, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake.functions import columns as C
from verdictlake.operators import matching as M
from verdictlake.operators import offline as O
from verdictlake.plans import views as V
from verdictlake.plans.views import MATCHED, sql


def policy_counterfactual(spark, d):
    r = O.policy_counterfactual(V.predictions(spark, d).where("status <> 'ERROR'"), V.samples(spark, d))
    return r.select("policy", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "benign_flag_rate")])


def miss_decomposition(spark, d):
    truth = V.samples(spark, d)
    e = M.evaluate(V.confirmed(spark, d), truth)
    detected = e.matches.select(F.col("p_sample").alias("sample_id"))
    reports = V.predictions(spark, d).groupBy("sample_id").agg(F.expr("bool_or(ord % 3 = 0)").alias("has_findings"), F.expr("collect_set(case when status <> 'ERROR' and (ord % 5 > 0 or status = 'CONFIRMED') then status end)").alias("statuses"))
    return O.miss_decomposition(truth, detected, reports).withColumn("label", F.coalesce("label", F.lit("total")))


def triage_queue(spark, d):
    return O.triage_queue(V.predictions(spark, d).where("status <> 'ERROR'")).select("ord", F.col("rank").cast("long").alias("rank"))


def _run(spark, d, modulo: int):
    """A run over all samples that sees the predictions of one kind."""
    p = V.confirmed(spark, d).where(f"ord % 3 <> {modulo}")
    hit = p.select("sample_id").distinct().withColumn("hit", F.lit(True))
    return V.samples(spark, d).join(hit, "sample_id", "left").select("sample_id", F.coalesce("hit", F.lit(False)).alias("flagged"), (F.coalesce("hit", F.lit(False)) & F.col("vulnerable")).alias("detected"))


def paired_discordance(spark, d):
    return O.paired(_run(spark, d, 0), _run(spark, d, 1), V.samples(spark, d)).select("stratum", "n", "a_only", "b_only")


def paired_strata(spark, d):
    r = O.paired(_run(spark, d, 0), _run(spark, d, 1), V.samples(spark, d))
    return r.select("stratum", F.round("rate_a", 6).alias("rate_a"), F.round("rate_b", 6).alias("rate_b"), F.round(F.col("rate_b") - F.col("rate_a"), 6).alias("delta"), F.round("p_value", 6).alias("p_value"))


def _pairs(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("user_id").alias("pair")).agg(F.count_if(F.expr("event_type = 'click'")).alias("b"), F.count_if(F.expr("event_type = 'view'")).alias("c"))


def mcnemar_exact(spark, d):
    return _pairs(spark, d).select("pair", "b", "c", F.round(C.mcnemar_exact(F.col("b"), F.col("c")), 6).alias("p"))


def mcnemar_chi2(spark, d):
    return _pairs(spark, d).select("pair", "b", "c", F.round(O.chi_square_p(F.col("b").cast("double"), F.col("c").cast("double")), 9).alias("p"))


def provenance_rollup(spark, d):
    return O.provenance_rollup(V.records(spark, d), ["sample_id"]).withColumn("elapsed", F.round("elapsed", 4))


def decision_counts(spark, d):
    """Decisions of each sample by status, absent ones as 0."""
    r = V.predictions(spark, d).withColumn("status", C.verdict("status"))
    return r.groupBy("sample_id").pivot("status", ["CONFIRMED", "REJECTED", "UNCERTAIN"]).count().fillna(0)


def merge_reports(spark, d):
    s = V.samples(spark, d).select("sample_id", "language")
    p = V.predictions(spark, d).join(s, "sample_id")
    return O.merge_reports(p, F.element_at(F.split(F.regexp_replace("file", "^/abs/", ""), "/"), 1))


def _flags(spark, d):
    s = V.samples(spark, d)
    p = V.predictions(spark, d).groupBy("sample_id").agg(F.expr("bool_or(status = 'CONFIRMED')").alias("any"), F.expr("bool_or(status = 'CONFIRMED' and confidence > 1)").alias("strict"), F.expr("case when bool_or(status = 'ERROR') then null else bool_or(status = 'UNCERTAIN') end").alias("baseline"))
    return s.join(p, "sample_id", "left").withColumns({"any": F.coalesce("any", F.lit(False)), "strict": F.coalesce("strict", F.lit(False))})


def detector_tally(spark, d):
    return O.tally(_flags(spark, d), {"any": F.col("any"), "strict": F.col("strict")})


def baseline_union_tally(spark, d):
    """A failed baseline is out of its own table and of the union's."""
    union = F.when(F.col("baseline").isNotNull(), F.col("baseline") | F.col("strict"))
    return O.tally(_flags(spark, d), {"baseline": F.col("baseline"), "union": union})


def recall_by_label(spark, d):
    f = _flags(spark, d).where("vulnerable").withColumn("label", C.primary_label("cwe"))
    return f.groupBy("label").agg(F.count("*").alias("total"), F.count_if("any").alias("hits")).withColumn("recall", F.round(C.safe_div("hits", "total"), 6))


def metrics_by_language(spark, d):
    t = O.tally(_flags(spark, d), {"any": F.col("any")}, ["language"])
    return t.select("language", "tp", "fp", "fn", "tn", F.round(C.safe_div("tp", F.expr("tp + fp")), 6).alias("precision"), F.round(C.safe_div("tp", F.expr("tp + fn")), 6).alias("recall"))


def category_histogram(spark, d):
    return V.predictions(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first")


def matcher_policies(spark, d):
    """Whether runs differ in their settings."""
    return V.records(spark, d).groupBy("model").agg((F.count_distinct(F.struct(F.expr("lineno % 2"), F.expr("lineno % 3"))) > 1).alias("differs"))


QUERIES = {f.__name__: f for f in (policy_counterfactual, miss_decomposition, triage_queue, paired_discordance, paired_strata, mcnemar_exact, mcnemar_chi2, provenance_rollup, decision_counts, merge_reports, detector_tally, baseline_union_tally, recall_by_label, metrics_by_language, category_histogram, matcher_policies)}

_RUNS = "samples preds pos"
_PAIRED = """, x AS (SELECT s.sample_id, vulnerable AS v, sample_id IN (SELECT sample_id FROM pos WHERE ord % 3 <> 0) AS a, sample_id IN (SELECT sample_id FROM pos WHERE ord % 3 <> 1) AS b FROM samples s),
l AS (SELECT 'positive_detection' AS stratum, a, b FROM x WHERE v UNION ALL SELECT 'benign_flagging', a, b FROM x WHERE NOT v UNION ALL SELECT 'accuracy', a = v, b = v FROM x),
g AS (SELECT stratum, count(*) AS n, count_if(a)::BIGINT AS na, count_if(b)::BIGINT AS nb, count_if(a AND NOT b)::BIGINT AS a_only, count_if(b AND NOT a)::BIGINT AS b_only FROM l GROUP BY 1)
"""
_EXACT = "least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda k: exp(lgamma({b} + {c} + 1) - lgamma(k + 1) - lgamma({b} + {c} - k + 1) - ({b} + {c}) * ln(2.0)))))"
_FLAGS = """, p AS (SELECT sample_id, bool_or(status = 'CONFIRMED') AS a, bool_or(status = 'CONFIRMED' AND confidence > 1) AS s, CASE WHEN bool_or(status = 'ERROR') THEN NULL ELSE bool_or(status = 'UNCERTAIN') END AS b FROM preds GROUP BY 1),
f AS (SELECT s.*, coalesce(a, false) AS any, coalesce(p.s, false) AS strict, b AS baseline FROM samples s LEFT JOIN p USING (sample_id))
"""
_CELLS = "count_if(vulnerable AND {0})::BIGINT AS tp, count_if(NOT vulnerable AND {0})::BIGINT AS fp, count_if(vulnerable AND NOT {0})::BIGINT AS fn, count_if(NOT vulnerable AND NOT {0})::BIGINT AS tn"


def _with(names: str, more: str, body: str) -> str:
    return sql(names, "").rstrip() + more + body


ORACLE_SQL = {
    "policy_counterfactual": _with("fam samples preds", """, kept AS (SELECT *, unnest(CASE status WHEN 'CONFIRMED' THEN ['confirmed', 'confirmed_uncertain', 'all'] WHEN 'UNCERTAIN' THEN ['confirmed_uncertain', 'all'] ELSE ['all'] END) AS policy FROM preds WHERE status <> 'ERROR'),
cand AS (SELECT policy, p.ord AS pi, g.ord AS gi, 0.65::DOUBLE + CASE WHEN g.line IS NULL OR p.line IS NULL THEN 0.1::DOUBLE ELSE (1 - abs(p.line - g.line) / 5.0::DOUBLE) * 0.35::DOUBLE END AS score FROM kept p JOIN samples g ON g.vulnerable AND p.sample_id = g.sample_id JOIN fam a ON a.c = p.c JOIN fam b ON b.c = g.c WHERE list_has_any(a.fs, b.fs) AND coalesce(abs(p.line - g.line) <= 5, true)),
m AS (SELECT policy, count(DISTINCT gi) AS tp FROM cand GROUP BY 1),
k AS (SELECT policy, count(*) AS n, count(DISTINCT CASE WHEN NOT vulnerable THEN sample_id END) AS flagged FROM kept JOIN samples USING (sample_id) GROUP BY 1)
""", "SELECT policy, coalesce(tp, 0) AS tp, n - coalesce(tp, 0) AS fp, round(coalesce(tp, 0) / n, 9) AS precision, round(coalesce(tp, 0) / (SELECT count_if(vulnerable) FROM samples), 9) AS recall, round(flagged / (SELECT count_if(NOT vulnerable) FROM samples), 9) AS benign_flag_rate FROM k LEFT JOIN m USING (policy)"),
    "miss_decomposition": _with(MATCHED, """, rep AS (SELECT sample_id, bool_or(ord % 3 = 0) AS has, list_distinct(list(CASE WHEN status <> 'ERROR' AND (ord % 5 > 0 OR status = 'CONFIRMED') THEN status END) FILTER (WHERE status <> 'ERROR' AND (ord % 5 > 0 OR status = 'CONFIRMED'))) AS st FROM preds GROUP BY 1),
t AS (SELECT s.c, CASE WHEN s.sample_id IN (SELECT p_sample FROM matches) THEN 'matched' WHEN rep.sample_id IS NULL THEN 'no_report' WHEN coalesce(len(st), 0) = 0 AND NOT has THEN 'candidate_ceiling' WHEN coalesce(len(st), 0) = 0 THEN 'agent_silent' WHEN list_contains(st, 'CONFIRMED') THEN 'confirmed_unmatched' WHEN list_contains(st, 'UNCERTAIN') THEN 'dropped_uncertain' ELSE 'dropped_rejected' END AS b FROM samples s LEFT JOIN rep USING (sample_id) WHERE vulnerable)
""", "SELECT coalesce(c, 'total') AS label, " + ", ".join(f"count_if(b = '{b}')::BIGINT AS {b}" for b in O.BUCKETS) + ", count(*) AS positives FROM t GROUP BY ROLLUP (c)"),
    "triage_queue": sql("preds", "SELECT ord, row_number() OVER (ORDER BY confidence DESC, sample_id, line::VARCHAR, ord) AS rank FROM preds WHERE status = 'UNCERTAIN'"),
    "paired_discordance": _with(_RUNS, _PAIRED, "SELECT stratum, n, a_only, b_only FROM g"),
    "paired_strata": _with(_RUNS, _PAIRED, "SELECT stratum, round(na / n, 6) AS rate_a, round(nb / n, 6) AS rate_b, round(nb / n - na / n, 6) AS delta, round(" + _EXACT.format(b="a_only", c="b_only") + ", 6) AS p_value FROM g"),
    "mcnemar_exact": "SELECT pair, b, c, round(" + _EXACT.format(b="b", c="c") + ", 6) AS p FROM (SELECT user_id AS pair, count_if(event_type = 'click')::BIGINT AS b, count_if(event_type = 'view')::BIGINT AS c FROM events GROUP BY 1)",
    "provenance_rollup": sql("records", "SELECT sample_id, string_agg(DISTINCT model, ',' ORDER BY model) AS models, round(sum(elapsed), 4) AS elapsed, count_if(decision = 'CONFIRMED')::BIGINT AS confirmed, count_if(decision = 'REJECTED')::BIGINT AS rejected, count_if(decision = 'UNCERTAIN')::BIGINT AS uncertain, count_if(decision = 'ERROR')::BIGINT AS error FROM records GROUP BY 1"),
    "decision_counts": sql("preds", "SELECT sample_id, count_if(status = 'CONFIRMED')::BIGINT AS \"CONFIRMED\", count_if(status = 'REJECTED')::BIGINT AS \"REJECTED\", count_if(status IN ('UNCERTAIN', 'ERROR'))::BIGINT AS \"UNCERTAIN\" FROM preds GROUP BY 1"),
    "merge_reports": sql("samples preds", "SELECT s.group_id AS folder, count(*) AS decisions, count(DISTINCT p.file) AS files, CASE WHEN count(DISTINCT language) > 1 THEN 'mixed' ELSE max(language) END AS language FROM preds p JOIN samples s USING (sample_id) GROUP BY 1"),
    "detector_tally": _with("samples preds", _FLAGS, "SELECT 'any' AS detector, " + _CELLS.format("\"any\"") + ", 0::BIGINT AS unavailable FROM f UNION ALL SELECT 'strict', " + _CELLS.format("strict") + ", 0::BIGINT FROM f"),
    "baseline_union_tally": _with("samples preds", _FLAGS, "SELECT 'baseline' AS detector, " + _CELLS.format("baseline") + ", count_if(baseline IS NULL)::BIGINT AS unavailable FROM f UNION ALL SELECT 'union', " + _CELLS.format("(baseline OR strict)") + ", (SELECT count_if(baseline IS NULL)::BIGINT FROM f) FROM f WHERE baseline IS NOT NULL"),
    "recall_by_label": _with("samples preds", _FLAGS, "SELECT c AS label, count(*) AS total, count_if(\"any\")::BIGINT AS hits, round(count_if(\"any\") / count(*), 6) AS recall FROM f WHERE vulnerable GROUP BY 1"),
    "metrics_by_language": _with("samples preds", _FLAGS, "SELECT language, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM (SELECT language, " + _CELLS.format("\"any\"") + " FROM f GROUP BY 1)"),
    "category_histogram": sql("preds", "SELECT source, count(*) AS n, min(ord) AS first FROM preds GROUP BY 1"),
    "matcher_policies": sql("records", "SELECT model, count(DISTINCT (lineno % 2, lineno % 3)) > 1 AS differs FROM records GROUP BY 1"),
}
