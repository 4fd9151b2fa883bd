"""Queries on findings and on the flow from hypotheses to decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake.operators import findings as N
from verdictlake.operators import verdicts as D
from verdictlake.plans import views as V
from verdictlake.plans.views import sql, table


def dedup_findings(spark, d):
    return N.dedup(V.tools(V.findings(spark, d))).select("fingerprint", "ord")


def enclosing_function(spark, d):
    f = V.findings(spark, d).select("file", "line").distinct().withColumn("ord", F.expr("cast(split(file, '[.]')[0] as bigint) * 1000 + line"))
    return N.enclosing_function(f, V.functions_of(spark, d))


def first_function(spark, d):
    f = V.findings(spark, d).select("file", "line").distinct().withColumn("ord", F.expr("cast(split(file, '[.]')[0] as bigint) * 1000 + line"))
    return N.first_function(f, V.functions_of(spark, d))


def canonical_member(spark, d):
    return N.canonical_member(V.findings(spark, d), ["file", "tool"]).select("file", "tool", "line", "severity")


def _correlated(spark, d):
    f = V.findings(spark, d).select("file", "line", "cwe", "rule_id").distinct()
    key = F.expr("cast(split(file, '[.]')[0] as bigint) * 1000000 + line * 1000 + (case when rule_id like 'O%' then 100 else 0 end) + cast(split(rule_id, '[.]')[1] as int)")
    f = f.withColumn("ord", key)
    return f.join(N.enclosing_function(f, V.functions_of(spark, d)), "ord", "left")


def correlate_findings(spark, d):
    g = N.correlate(_correlated(spark, d))
    return g.groupBy("file").agg(F.count_distinct("group").alias("groups"), F.count("*").alias("findings"))


def group_members(spark, d):
    f = V.tools(V.findings(spark, d))
    g = f.select(F.col("file").alias("group_id"), "fingerprint")
    return N.group_members(g, f.select("fingerprint", "ord")).select("group_id", "fingerprint", "ord")


def _hypotheses(spark, d):
    return V.predictions(spark, d).select("ord", F.expr("(ord % 100 + 1) || '.c'").alias("file"), F.col("line"), "cwe", F.expr("case when ord % 11 = 0 then '' else cwe[0] end").alias("class"), "status", "confidence")


def echo_antijoin(spark, d):
    return D.echo_antijoin(_hypotheses(spark, d), V.findings(spark, d)).select("ord")


def near_or_all(spark, d):
    asked = _hypotheses(spark, d).select(F.col("ord").alias("id"), "file", "line")
    ev = V.functions_of(spark, d).select("file", F.col("start_line").alias("line"), F.col("ord").alias("chain"))
    return D.near_or_all(ev, asked, 12).select("id", "chain")


def nearest_chain(spark, d):
    asked = _hypotheses(spark, d).select(F.col("ord").alias("id"), "file", "line")
    chains = V.functions_of(spark, d).select("file", F.col("end_line").alias("sink_line"), "ord")
    return D.nearest_chain(chains, asked)


def claim_groups(spark, d):
    return D.claim_groups(_hypotheses(spark, d)).select("ord", "claim")


def claim_sites(spark, d):
    return D.claim_sites(D.claim_groups(_hypotheses(spark, d))).select("ord", "site")


def until_first_confirmed(spark, d):
    return D.until_first_confirmed(_hypotheses(spark, d), ["file"]).select("ord")


def topn_per_group(spark, d):
    return D.top_n(_hypotheses(spark, d), ["file"], 12).select("ord", "place", "truncated")


def _verified(spark, d):
    return V.predictions(spark, d).selectExpr("ord", "case when status = 'ERROR' then 'UNCERTAIN' else status end as decision", "status <> 'ERROR' as usable", "ord % 3 > 0 as verified", "confidence", "if(ord % 7 = 0, array('x'), array()) as missing", "cwe[0] as class", "ord % 4 as n_proven", "ord % 5 = 0 as silent", "ord % 6 = 0 as mitigated")


def resolve_hedge(spark, d):
    r = D.resolve_hedge(F.col("decision"), F.col("usable"), F.col("verified"), F.col("confidence"))
    return _verified(spark, d).select("ord", r.alias("decision"))


def evidence_gate(spark, d):
    v = _verified(spark, d)
    g = D.evidence_gate(F.col("verified"), F.col("missing"), D.taint_modelled(F.col("class")), F.col("n_proven"), F.col("silent"), F.col("mitigated"), F.col("confidence"), reject_mitigated=True)
    return v.select("ord", g.alias("reason"))


def resolved_class(spark, d):
    r = D.resolved_class(F.expr("if(ord % 2 = 0, array(class), cast(array() as array<string>))"), F.expr("if(ord % 3 = 0, '', 'CWE-1')"))
    return _verified(spark, d).select("ord", F.array_join(r, ",").alias("class"))


def fallback_reason(spark, d):
    h = _hypotheses(spark, d).groupBy("file", F.col("cwe")[0].alias("class")).agg(F.count_if(F.expr("status = 'CONFIRMED'")).alias("n"), F.count_if(F.expr("ord % 3 = 0")).alias("p"), F.expr("bool_or(ord % 7 = 0)").alias("failed"))
    n = V.findings(spark, d).groupBy("file").agg(F.count("*").alias("f"))
    return h.join(n, "file", "left").select("file", "class", D.fallback_reason(F.col("n"), F.col("failed"), F.col("p"), F.coalesce("f", F.lit(0))).alias("reason"))


def merge_confirmed(spark, d):
    m = D.merge_confirmed(_hypotheses(spark, d))
    return m.groupBy("file").agg(F.count("*").alias("kept"), F.sum("merged").alias("decisions"))


def latest_nonerror(spark, d):
    return D.latest_nonerror(V.records(spark, d)).select("sample_id", "lineno", "decision")


def last_answer(spark, d):
    calls = table(spark, d, "conversations").selectExpr("conv_id", "role", "turn as call_index", "md5(cast(text as binary)) as answer", "if(turn % 5 = 4, 'timeout', null) as error")
    return D.last_answer(calls, ["conv_id", "role"])


def failure_kind_of_call(spark, d):
    e = F.expr("element_at(array('TimeoutError: 300 s', 'TruncatedResponse: cut off', 'json.JSONDecodeError: no JSON', 'RuntimeError: refused', 'KeyError: x'), cast(event_id % 5 + 1 as int))")
    return table(spark, d, "events").select("event_id", D.failure_kind_of_call(e).alias("kind"))


def replay_decisions(spark, d):
    """Recorded verdicts through hedges and gates to counts of decisions."""
    v = _verified(spark, d)
    decided = v.withColumn("decision", D.resolve_hedge(F.col("decision"), F.col("usable"), F.col("verified"), F.col("confidence")))
    gate = D.evidence_gate(F.col("verified"), F.col("missing"), D.taint_modelled(F.col("class")), F.col("n_proven"), F.col("silent"), F.col("mitigated"), F.col("confidence"))
    final = F.when((F.col("decision") == "CONFIRMED") & (gate != ""), "REJECTED").otherwise(F.col("decision"))
    return decided.groupBy("class", final.alias("status")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (dedup_findings, enclosing_function, first_function, canonical_member, correlate_findings, group_members, echo_antijoin, near_or_all, nearest_chain, claim_groups, claim_sites, until_first_confirmed, topn_per_group, resolve_hedge, evidence_gate, resolved_class, fallback_reason, merge_confirmed, latest_nonerror, last_answer, failure_kind_of_call, replay_decisions)}

_H = "hyp AS (SELECT ord, (ord % 100 + 1) || '.c' AS file, line, c, CASE WHEN ord % 11 = 0 THEN '' ELSE c END AS class, status, confidence FROM preds)"
_V = "ver AS (SELECT ord, CASE WHEN status = 'ERROR' THEN 'UNCERTAIN' ELSE status END AS decision, status <> 'ERROR' AS usable, ord % 3 > 0 AS verified, confidence, ord % 7 = 0 AS missing, c AS class, ord % 4 AS n_proven, ord % 5 = 0 AS silent, ord % 6 = 0 AS mitigated FROM preds)"
_MODELLED = "class IN ('CWE-78', 'CWE-94', 'CWE-1336', 'CWE-502', 'CWE-89', 'CWE-22', 'CWE-120', 'CWE-118', 'CWE-119', 'CWE-121', 'CWE-122', 'CWE-123', 'CWE-124', 'CWE-131', 'CWE-787', 'CWE-788')"
_HEDGE = "CASE WHEN decision = 'UNCERTAIN' AND usable THEN CASE WHEN verified AND confidence >= 0.5 THEN 'CONFIRMED' ELSE 'REJECTED' END ELSE decision END"
_GATE = f"CASE WHEN NOT verified THEN 'chain_unverified' WHEN missing THEN 'missing_evidence' WHEN n_proven = 0 AND NOT silent AND {_MODELLED} THEN 'no_path' {{0}}WHEN confidence < 0.5 THEN 'low_confidence' ELSE '' END"
_PLACES = ", places AS (SELECT DISTINCT file, line, string_split(file, '.')[1]::BIGINT * 1000 + line AS ord FROM findings)\n"


def _with(names: str, more: str, body: str) -> str:
    return sql(names, "").rstrip() + (", " + more if not more.startswith(",") else more) + "\n" + body


ORACLE_SQL = {
    "dedup_findings": sql("findings", "SELECT sha256(tool || '|' || rule_id || '|' || file || '|' || CASE WHEN line = 0 THEN '' ELSE line::VARCHAR END || '|' || trim(message)) AS fingerprint, min(ord) AS ord FROM findings GROUP BY 1"),
    "enclosing_function": _with("findings funcs", _PLACES, "SELECT p.ord, arg_min(name, (end_line - start_line) * 10 + f.ord) AS function FROM places p JOIN funcs f ON p.file = f.file AND line BETWEEN start_line AND end_line GROUP BY 1"),
    "first_function": _with("findings funcs", _PLACES, "SELECT p.ord, arg_min(name, f.ord) AS function FROM places p JOIN funcs f ON p.file = f.file AND line BETWEEN start_line AND end_line GROUP BY 1"),
    "canonical_member": sql("findings", "SELECT file, tool, line, severity FROM (SELECT *, row_number() OVER (PARTITION BY file, tool ORDER BY CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END DESC, line, ord) AS k FROM findings) WHERE k = 1"),
    "group_members": sql("findings", "").rstrip() + ", t AS (SELECT *, sha256(tool || '|' || rule_id || '|' || file || '|' || CASE WHEN line = 0 THEN '' ELSE line::VARCHAR END || '|' || trim(message)) AS fingerprint FROM findings), g AS (SELECT DISTINCT file AS group_id, fingerprint FROM t) SELECT group_id, fingerprint, ord FROM g JOIN t USING (fingerprint)",
    "echo_antijoin": _with("preds findings", _H, "SELECT ord FROM hyp h WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.file = h.file AND f.line = h.line AND f.c = h.c)"),
    "near_or_all": _with("preds funcs", _H, ", pairs AS (SELECT h.ord AS id, f.ord AS chain, abs(f.start_line - h.line) <= 12 AS near FROM hyp h JOIN funcs f USING (file)) SELECT id, chain FROM (SELECT *, bool_or(near) OVER (PARTITION BY id) AS n FROM pairs) WHERE near OR NOT n"),
    "nearest_chain": _with("preds funcs", _H, "SELECT h.ord AS id, arg_min(f.ord, abs(end_line - line) * 10 + f.ord)::INTEGER AS chain FROM hyp h JOIN funcs f USING (file) GROUP BY 1"),
    "claim_groups": _with("preds", _H, ", k AS (SELECT *, CASE WHEN class = '' THEN '0' || ord ELSE class END AS key FROM hyp), f AS (SELECT file, key, row_number() OVER (PARTITION BY file ORDER BY min(ord)) AS claim FROM k GROUP BY file, key) SELECT ord, claim::INTEGER AS claim FROM k JOIN f USING (file, key)"),
    "claim_sites": _with("preds", _H, ", k AS (SELECT *, CASE WHEN class = '' THEN '0' || ord ELSE class END AS key FROM hyp), r AS (SELECT ord, line, file, key, row_number() OVER (PARTITION BY file, key ORDER BY ord) AS n FROM k), walk(file, key, n, ord, heads, site) AS (SELECT DISTINCT file, key, 0::BIGINT, NULL::BIGINT, []::INTEGER[], NULL::BIGINT FROM r UNION ALL SELECT file, key, n, ord, CASE WHEN hit > 0 THEN heads ELSE list_append(heads, line) END, CASE WHEN hit > 0 THEN hit - 1 ELSE len(heads) END::BIGINT FROM (SELECT r.*, heads, coalesce(list_position(list_transform(heads, lambda h: r.line IS NULL OR h IS NULL OR abs(r.line - h) <= 5), true), 0) AS hit FROM walk w JOIN r ON r.file = w.file AND r.key = w.key AND r.n = w.n + 1)) SELECT ord, site FROM walk WHERE n > 0"),
    "merge_confirmed": _with("fam preds", _H, ", c AS (SELECT ord, file, line, fs FROM hyp JOIN fam USING (c) WHERE status = 'CONFIRMED'), e AS (SELECT a.file, a.ord AS a, b.ord AS b FROM c a JOIN c b USING (file) WHERE list_has_any(a.fs, b.fs) OR abs(a.line - b.line) <= 5), reach(file, a, b) AS (SELECT file, a, b FROM e UNION SELECT r.file, r.a, e.b FROM reach r JOIN e ON e.a = r.b), root AS (SELECT file, a, min(b) AS r FROM reach GROUP BY 1, 2) SELECT file, count(DISTINCT r) AS kept, count(*)::BIGINT AS decisions FROM root GROUP BY 1"),
    "until_first_confirmed": _with("preds", _H, "SELECT ord FROM (SELECT ord, max((status = 'CONFIRMED')::INT) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM hyp) WHERE coalesce(s, 0) = 0"),
    "topn_per_group": _with("preds", _H, "SELECT * FROM (SELECT ord, row_number() OVER (PARTITION BY file ORDER BY ord)::INTEGER AS place, count(*) OVER (PARTITION BY file) > 12 AS truncated FROM hyp) WHERE place <= 12"),
    "resolve_hedge": _with("preds", _V, f"SELECT ord, {_HEDGE} AS decision FROM ver"),
    "evidence_gate": _with("preds", _V, f"SELECT ord, {_GATE.format('WHEN mitigated THEN ' + repr('mitigated') + ' ')} AS reason FROM ver"),
    "resolved_class": _with("preds", _V, "SELECT ord, CASE WHEN ord % 2 = 0 THEN class WHEN ord % 3 = 0 THEN '' ELSE 'CWE-1' END AS class FROM ver"),
    "fallback_reason": _with("preds findings", _H, "SELECT file, class, CASE WHEN n > 0 THEN '' WHEN failed THEN 'scanner_failed' WHEN p > 0 THEN 'all_hypotheses_dropped_as_echoes' WHEN f > 0 THEN 'scanner_declined_but_tools_flagged_the_file' ELSE '' END AS reason FROM (SELECT c AS class, file, count_if(status = 'CONFIRMED') AS n, count_if(ord % 3 = 0) AS p, bool_or(ord % 7 = 0) AS failed, (SELECT count(*) FROM findings x WHERE x.file = hyp.file) AS f FROM hyp GROUP BY file, c)"),
    "latest_nonerror": sql("records", "SELECT sample_id, lineno, decision FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY decision = 'ERROR', lineno DESC) AS k FROM records) WHERE k = 1"),
    "last_answer": "SELECT conv_id, role, arg_max(md5(text), turn) AS answer FROM conversations WHERE turn % 5 <> 4 GROUP BY 1, 2",
    "failure_kind_of_call": "SELECT event_id, ['timeout', 'none', 'parse', 'transport', 'none'][event_id % 5 + 1] AS kind FROM events",
    "replay_decisions": _with("preds", _V, f"SELECT class, CASE WHEN d = 'CONFIRMED' AND g <> '' THEN 'REJECTED' ELSE d END AS status, count(*) AS n FROM (SELECT class, {_HEDGE} AS d, {_GATE.format('')} AS g FROM ver) GROUP BY 1, 2"),
}
