"""Queries on matching and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake.functions import columns as C
from verdictlake.operators import matching as M
from verdictlake.plans import views as V
from verdictlake.plans.views import MATCHED, sql

_AGNOSTIC = MATCHED.replace("cand", "cand_any")


def _e(spark, d, config=M.MatchConfig()):
    return M.evaluate(V.confirmed(spark, d), V.samples(spark, d), config)


def _confusion(spark, d, config=M.MatchConfig()):
    return _e(spark, d, config).confusion()


def metrics_rates(spark, d):
    return M.rates(_confusion(spark, d)).select(*[F.round(r, 9).alias(r) for r in M.RATES])


def wilson_ci(spark, d):
    return M.intervals(_confusion(spark, d)).select("rate", "successes", "trials", "low", "high")


def match_candidates(spark, d):
    return M.candidates(V.confirmed(spark, d), V.samples(spark, d).where("vulnerable")).select("pi", "gi", F.round("score", 9).alias("score"))


def greedy_match(spark, d):
    return _e(spark, d).matches.select("pi", "gi", F.round("score", 9).alias("score"))


def confusion_finding(spark, d):
    return _confusion(spark, d).select("tp", "fp", "fn", "tn")


def confusion_sample(spark, d):
    return _confusion(spark, d).select("s_tp", "s_fp", "s_fn", "s_tn")


def match_score(spark, d):
    """Scores of every decision, whatever its status, against its own sample."""
    p = V.predictions(spark, d).select("ord", "sample_id", "file", "cwe", "line").alias("p")
    g = V.samples(spark, d).alias("g")
    s = C.match_score(C.same_file("p.file", "g.file"), F.col("p.cwe"), F.col("g.cwe"), F.col("p.line"), F.col("g.line"))
    return p.join(g, F.col("p.sample_id") == F.col("g.sample_id")).select("p.ord", F.round(s, 9).alias("score"))


def same_file(spark, d):
    """Files of decisions against the files of their samples' neighbours."""
    p = V.predictions(spark, d).select("ord", "sample_id", F.col("file").alias("a")).withColumn("other", (F.col("sample_id").cast("long") + F.col("ord") % 2).cast("string"))
    g = V.samples(spark, d).select(F.col("sample_id").alias("other"), F.col("file").alias("b"))
    return p.join(g, "other").select("ord", C.same_file("a", "b").alias("same"))


def line_band_join(spark, d):
    """Findings of one file whose lines differ by at most one: a band join over
    blocks of lines, so that no file is compared as a whole."""
    f = V.findings(spark, d).select("ord", "file", "line")
    a = f.select(F.col("ord").alias("a"), "file", F.col("line").alias("a_line"), F.explode(F.expr("array(line div 2 - 1, line div 2, line div 2 + 1)")).alias("block"))
    b = f.select(F.col("ord").alias("b"), "file", F.col("line").alias("b_line"), F.expr("line div 2").alias("block"))
    return a.join(b, ["file", "block"]).where("a < b and abs(a_line - b_line) <= 1").groupBy("file").agg(F.count("*").alias("pairs"), F.sum(F.col("a_line") - F.col("b_line")).cast("long").alias("drift"))


def cwe_family_closure(spark, d):
    """Pairs of labels that share a family, with how many samples have each."""
    n = V.samples(spark, d).select(F.col("cwe")[0].alias("c")).groupBy("c").count()
    f = n.select("c", "count", F.explode(C.families_of(F.array("c"))).alias("family"))
    return f.groupBy("family").agg(F.count("*").alias("classes"), F.sum("count").alias("samples"))


def unmatched_predictions(spark, d):
    return _e(spark, d).unmatched_predictions.select("ord", "sample_id")


def unmatched_ground_truth(spark, d):
    return _e(spark, d).unmatched_truth.select("ord", "sample_id")


def benign_flagged(spark, d):
    return _e(spark, d).benign_flagged.select("sample_id")


def failure_kind(spark, d):
    return _e(spark, d).failures().select("ord", "sample_vulnerable", "failure")


def sample_level_summary(spark, d):
    return M.sample_level(_e(spark, d))


def per_cwe_metrics(spark, d):
    """Confusion cells by class; their rates are those of metrics_rates."""
    return M.per_class(V.confirmed(spark, d), V.samples(spark, d))


def recompute_strict(spark, d):
    return M.rates(_confusion(spark, d)).select("tp", "fp", "fn", "tn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def recompute_agnostic(spark, d):
    return M.rates(_confusion(spark, d, M.MatchConfig(require_cwe=False))).select("tp", "fp", "fn", "tn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def rebuild_predictions(spark, d):
    """Matched and unmatched predictions put together again, none missing."""
    e = _e(spark, d)
    matched = e.matches.select(F.col("pi").alias("ord"), F.lit("matched").alias("origin"))
    return matched.unionByName(e.unmatched_predictions.select("ord", F.lit("unmatched").alias("origin")))


def canonical_order(spark, d):
    """Place of each positive prediction by sample, line, class, source, id."""
    from pyspark.sql import Window

    p = V.confirmed(spark, d)
    w = Window.partitionBy("sample_id").orderBy(F.coalesce("line", F.lit(-1)), F.col("cwe")[0], "source", "ord")
    return p.select("ord", "sample_id", F.row_number().over(w).alias("place"))


def intersect_detected(spark, d):
    e = _e(spark, d)
    return e.matches.select(F.col("p_sample").alias("sample_id")).intersect(e.truth.where("vulnerable").select("sample_id"))


def except_benign(spark, d):
    benign = V.samples(spark, d).where("not vulnerable").select("sample_id")
    return benign.exceptAll(V.confirmed(spark, d).select("sample_id").distinct())


QUERIES = {f.__name__: f for f in (metrics_rates, wilson_ci, match_candidates, greedy_match, confusion_finding, confusion_sample, match_score, same_file, line_band_join, cwe_family_closure, unmatched_predictions, unmatched_ground_truth, benign_flagged, failure_kind, sample_level_summary, per_cwe_metrics, recompute_strict, recompute_agnostic, rebuild_predictions, canonical_order, intersect_detected, except_benign)}

_RATES = """, r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
CASE WHEN s_tn + s_fp > 0 THEN s_tn::DOUBLE / (s_tn + s_fp) ELSE 0 END AS specificity, CASE WHEN s_fp + s_tn > 0 THEN s_fp::DOUBLE / (s_fp + s_tn) ELSE 0 END AS false_positive_rate, CASE WHEN s_fn + s_tp > 0 THEN s_fn::DOUBLE / (s_fn + s_tp) ELSE 0 END AS false_negative_rate, CASE WHEN s_tp + s_tn + s_fp + s_fn > 0 THEN (s_tp + s_tn)::DOUBLE / (s_tp + s_tn + s_fp + s_fn) ELSE 0 END AS accuracy FROM conf)
"""


def _rates(names: str, body: str) -> str:
    return sql(names + " conf", "").rstrip() + _RATES + body


ORACLE_SQL = {
    "metrics_rates": _rates(MATCHED, "SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1, round(specificity, 9) AS specificity, round(false_positive_rate, 9) AS false_positive_rate, round(false_negative_rate, 9) AS false_negative_rate, round(accuracy, 9) AS accuracy, round(CASE WHEN s_tp + s_fn > 0 AND s_tn + s_fp > 0 THEN (recall + specificity) / 2 ELSE 0 END, 9) AS balanced_accuracy FROM r"),
    "wilson_ci": sql(MATCHED + " conf", "").rstrip() + """, x AS (SELECT unnest([{'rate': 'precision', 'successes': tp, 'trials': tp + fp}, {'rate': 'recall', 'successes': tp, 'trials': tp + fn}, {'rate': 'false_positive_rate', 'successes': s_fp, 'trials': s_fp + s_tn}, {'rate': 'specificity', 'successes': s_tn, 'trials': s_tn + s_fp}, {'rate': 'false_negative_rate', 'successes': s_fn, 'trials': s_fn + s_tp}, {'rate': 'accuracy', 'successes': s_tp + s_tn, 'trials': s_tp + s_tn + s_fp + s_fn}], recursive := true) FROM conf),
y AS (SELECT *, successes::DOUBLE / trials AS p, trials::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM x WHERE trials > 0),
w AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half FROM y)
SELECT rate, successes, trials, round(CASE WHEN successes = 0 THEN 0 ELSE greatest(0, mid - half) END, 6) AS low, round(CASE WHEN successes = trials THEN 1 ELSE least(1, mid + half) END, 6) AS high FROM w""",
    "match_candidates": sql("fam samples preds pos cand", "SELECT pi, gi, round(score, 9) AS score FROM cand"),
    "greedy_match": sql(MATCHED, "SELECT pi, gi, round(score, 9) AS score FROM matches"),
    "confusion_finding": sql(MATCHED + " conf", "SELECT tp, fp, fn, tn FROM conf"),
    "confusion_sample": sql(MATCHED + " conf", "SELECT s_tp, s_fp, s_fn, s_tn FROM conf"),
    "match_score": sql("fam samples preds", "SELECT p.ord, round(CASE WHEN NOT list_has_any(a.fs, b.fs) OR coalesce(abs(p.line - g.line) > 5, false) THEN 0::DOUBLE ELSE least(1.0::DOUBLE, 0.65::DOUBLE + CASE WHEN g.line IS NULL OR p.line IS NULL THEN 0.1::DOUBLE ELSE (1 - abs(p.line - g.line) / 5.0::DOUBLE) * 0.35::DOUBLE END) END, 9) AS score FROM preds p JOIN samples g USING (sample_id) JOIN fam a ON a.c = p.c JOIN fam b ON b.c = g.c"),
    "same_file": sql("samples preds", "SELECT p.ord, p.file = g.file OR p.file = '/abs/' || g.file AS same FROM preds p JOIN samples g ON g.sample_id = (p.sample_id::BIGINT + p.ord % 2)::VARCHAR"),
    "line_band_join": sql("findings", "SELECT a.file, count(*) AS pairs, sum(a.line - b.line)::BIGINT AS drift FROM findings a JOIN findings b ON a.file = b.file AND a.ord < b.ord AND abs(a.line - b.line) <= 1 GROUP BY 1"),
    "cwe_family_closure": sql("fam samples", "SELECT family, count(*) AS classes, sum(n)::BIGINT AS samples FROM (SELECT s.c, n, unnest(fs) AS family FROM (SELECT c, count(*) AS n FROM samples GROUP BY 1) s JOIN fam USING (c)) GROUP BY 1"),
    "unmatched_predictions": sql(MATCHED, "SELECT ord, sample_id FROM pos WHERE ord NOT IN (SELECT pi FROM matches)"),
    "unmatched_ground_truth": sql(MATCHED, "SELECT ord, sample_id FROM samples WHERE vulnerable AND ord NOT IN (SELECT gi FROM matches)"),
    "benign_flagged": sql("samples preds pos", "SELECT sample_id FROM samples WHERE NOT vulnerable AND sample_id IN (SELECT sample_id FROM pos)"),
    "failure_kind": sql(MATCHED, "SELECT ord, v AS sample_vulnerable, CASE WHEN v THEN 'wrong_class_on_vulnerable_file' ELSE 'reported_on_benign_file' END AS failure FROM (SELECT ord, sample_id IN (SELECT sample_id FROM samples WHERE vulnerable AND ord NOT IN (SELECT gi FROM matches)) AS v FROM pos WHERE ord NOT IN (SELECT pi FROM matches))"),
    "sample_level_summary": sql(MATCHED, """, x AS (SELECT (SELECT count(*) FROM samples WHERE vulnerable) AS vulnerable_samples, (SELECT count(DISTINCT p_sample) FROM matches) AS vulnerable_detected, (SELECT count(DISTINCT sample_id) FROM pos WHERE sample_id IN (SELECT sample_id FROM samples WHERE vulnerable)) AS vulnerable_flagged, (SELECT count(*) FROM pos WHERE sample_id IN (SELECT sample_id FROM samples WHERE vulnerable)) AS f, (SELECT count(DISTINCT sample_id) FROM pos WHERE sample_id IN (SELECT sample_id FROM samples WHERE vulnerable) AND sample_id NOT IN (SELECT p_sample FROM matches)) AS class_mismatch_count, (SELECT count(*) FROM samples WHERE NOT vulnerable) AS benign_samples, (SELECT count(DISTINCT sample_id) FROM pos WHERE sample_id IN (SELECT sample_id FROM samples WHERE NOT vulnerable)) AS benign_flagged, (SELECT count(*) FROM pos WHERE ord NOT IN (SELECT pi FROM matches) AND sample_id NOT IN (SELECT sample_id FROM samples WHERE NOT vulnerable)) AS unmatched_findings_on_vulnerable)
SELECT * EXCLUDE (f), vulnerable_detected / vulnerable_samples AS vulnerable_detection_rate, vulnerable_flagged / vulnerable_samples AS vulnerable_flag_rate, benign_flagged / benign_samples AS benign_flag_rate, f / vulnerable_samples AS findings_per_vulnerable_file FROM x""").replace("\n, x AS", ", x AS"),
    "per_cwe_metrics": sql("fam samples preds pos", """, pp AS (SELECT g.c AS class, p.*, p.c AS pc FROM pos p JOIN samples g USING (sample_id) JOIN fam a ON a.c = p.c JOIN fam b ON b.c = g.c WHERE list_has_any(a.fs, b.fs)),
cand AS (SELECT g.c AS class, p.ord AS pi, g.ord AS gi, p.sample_id AS p_sample, 0.65::DOUBLE + CASE WHEN g.line IS NULL OR p.line IS NULL THEN 0.1::DOUBLE ELSE (1 - abs(p.line - g.line) / 5.0::DOUBLE) * 0.35::DOUBLE END AS score FROM pp p JOIN samples g ON g.vulnerable AND g.c = p.class AND (p.file = g.file OR p.file = '/abs/' || g.file) WHERE coalesce(abs(p.line - g.line) <= 5, true)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class, gi ORDER BY score DESC, pi DESC) AS k FROM cand) WHERE k = 1),
k AS (SELECT DISTINCT c AS class FROM samples)
SELECT class, tp, fp, nv - tp AS fn, nb - s_fp AS tn, s_tp, s_fp, nv - s_tp AS s_fn, nb - s_fp AS s_tn FROM (SELECT class, (SELECT count(*) FROM m WHERE m.class = k.class) AS tp, (SELECT count(*) FROM pp WHERE pp.class = k.class AND ord NOT IN (SELECT pi FROM m WHERE m.class = k.class)) AS fp, (SELECT count(*) FROM samples WHERE c = k.class AND vulnerable) AS nv, (SELECT count(*) FROM samples WHERE c = k.class AND NOT vulnerable) AS nb, (SELECT count(DISTINCT p_sample) FROM m WHERE m.class = k.class) AS s_tp, (SELECT count(DISTINCT pp.sample_id) FROM pp JOIN samples s USING (sample_id) WHERE pp.class = k.class AND NOT s.vulnerable) AS s_fp FROM k)""").replace("\n, pp AS", ", pp AS"),
    "recompute_strict": _rates(MATCHED, "SELECT tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall FROM r"),
    "recompute_agnostic": _rates(_AGNOSTIC, "SELECT tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall FROM r"),
    "rebuild_predictions": sql(MATCHED, "SELECT ord, CASE WHEN ord IN (SELECT pi FROM matches) THEN 'matched' ELSE 'unmatched' END AS origin FROM pos"),
    "canonical_order": sql("preds pos", "SELECT ord, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY coalesce(line, -1), c, source, ord)::INTEGER AS place FROM pos"),
    "intersect_detected": sql(MATCHED, "SELECT DISTINCT p_sample AS sample_id FROM matches WHERE p_sample IN (SELECT sample_id FROM samples WHERE vulnerable)"),
    "except_benign": sql("samples preds pos", "SELECT sample_id FROM samples WHERE NOT vulnerable AND sample_id NOT IN (SELECT sample_id FROM pos)"),
}
