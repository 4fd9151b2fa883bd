"""Queries on source code: facts, taint, mitigation, redaction, parsing.

The driver's tables hold no code, so each supplier gives a small program."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake.functions import columns as C
from verdictlake.operators import redact, taint
from verdictlake.operators.facts import facts
from verdictlake.plans.views import table

_PYTHON = "import os, sys\\n\\ndef bad{n}(path):\\n    name = sys.argv[1]  # goodSource\\n    cmd = 'ls ' + name\\n    os.system(cmd)\\n    return open(os.path.basename(path))\\n"
_C = "#include <stdio.h>\\nvoid copy{n}(char *src) {\\n  char dst[10]; /* bad */\\n  char *x = getenv(\\\"A\\\");\\n  strcpy(dst, x);\\n  memcpy(dst, src, {n});\\n  if (src) { system(src); }\\n}\\n"


def programs(spark, d):
    text = F.expr(f"replace(case when s_suppkey % 2 = 0 then '{_PYTHON.replace(chr(39), chr(92) + chr(39))}' else '{_C}' end, '{{n}}', cast(s_suppkey as string))")
    return table(spark, d, "supplier").select(F.expr("s_suppkey || if(s_suppkey % 2 = 0, '.py', '.c')").alias("path"), F.expr("if(s_suppkey % 2 = 0, 'python', 'c')").alias("language"), text.alias("text"))


def code_facts(spark, d):
    f = facts(programs(spark, d))
    return f.select("path", *[F.size(c).cast("long").alias(c) for c in ("functions", "calls", "assignments", "imports")], "branch_count", "parse_has_errors")


def taint_chains(spark, d):
    return taint.taint_chains(programs(spark, d)).where("proven").select("path", "cwe", "sink_line", "source_line", "origin")


def mitigation_rule(spark, d):
    return taint.taint_chains(programs(spark, d)).groupBy("category", "mitigation_rule").agg(F.count("*").alias("n"))


def pattern_match(spark, d):
    """The longest pattern that a call's name ends with, by a join."""
    names = table(spark, d, "events").select("event_id", F.expr("element_at(array('os.system', 'x.os.system', 'system', 'io.open', 'std::system'), cast(event_id % 5 + 1 as int))").alias("name"))
    patterns = spark.createDataFrame([("os.system",), ("system",), ("open",)], "pattern string")
    hit = (F.col("name") == F.col("pattern")) | F.endswith("name", F.concat(F.lit("."), "pattern")) | F.endswith("name", F.concat(F.lit("::"), "pattern"))
    return names.join(F.broadcast(patterns), hit).groupBy("event_id").agg(F.max_by("pattern", F.length("pattern")).alias("pattern"))


def strip_comments(spark, d):
    return programs(spark, d).select("path", redact.strip_comments("text", "language").alias("text"))


def repair_json(spark, d):
    text = F.expr("'{\"a\": \"say \"' || event_type || '\" now\", \"n\": ' || event_id || '}'")
    fixed = table(spark, d, "events").select("event_id", redact.repair_json(text).alias("t"))
    return fixed.select("event_id", F.get_json_object("t", "$.a").alias("a"), F.get_json_object("t", "$.n").cast("long").alias("n"))


def json_object(spark, d):
    """Objects found in prose around them."""
    text = F.expr("if(event_id % 2 = 0, props, 'Here: ' || props || ' done')")
    v = C.parse_json_object(text)
    return table(spark, d, "events").select("event_id", v.isNotNull().alias("parsed"))


QUERIES = {f.__name__: f for f in (code_facts, taint_chains, mitigation_rule, pattern_match, strip_comments, repair_json, json_object)}
ORACLE_SQL = {
    "code_facts": "SELECT s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.c' END AS path, 1::BIGINT AS functions, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 4 END::BIGINT AS calls, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS assignments, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS imports, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS branch_count, false AS parse_has_errors FROM supplier",
    "taint_chains": "SELECT s_suppkey || '.py' AS path, 'CWE-78' AS cwe, 6 AS sink_line, 4 AS source_line, 'external-source' AS origin FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey || '.c', unnest(['CWE-120', 'CWE-120', 'CWE-78']), unnest([5, 6, 7]), unnest([4, 6, 7]), unnest(['external-source', 'parameter', 'parameter']) FROM supplier WHERE s_suppkey % 2 = 1",
    "mitigation_rule": "SELECT category, rule AS mitigation_rule, count(*) AS n FROM (SELECT unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['command_injection', 'path_traversal'] ELSE ['buffer_overflow', 'buffer_overflow', 'command_injection'] END) AS category, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['', ''] ELSE ['', 'constant-length', ''] END) AS rule FROM supplier) GROUP BY 1, 2",
    "pattern_match": "SELECT event_id, ['os.system', 'os.system', 'system', 'open', 'system'][event_id % 5 + 1] AS pattern FROM events",
    "strip_comments": "SELECT s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.c' END AS path, replace(CASE WHEN s_suppkey % 2 = 0 THEN concat('import os, sys', chr(10), chr(10), 'def bad{n}(path):', chr(10), '    name = sys.argv[1]  ', repeat(' ', 12), chr(10), '    cmd = ''ls '' + name', chr(10), '    os.system(cmd)', chr(10), '    return open(os.path.basename(path))', chr(10)) ELSE concat('#include <stdio.h>', chr(10), 'void copy{n}(char *src) {', chr(10), '  char dst[10]; ', repeat(' ', 9), chr(10), '  char *x = getenv(\"A\");', chr(10), '  strcpy(dst, x);', chr(10), '  memcpy(dst, src, {n});', chr(10), '  if (src) { system(src); }', chr(10), '}', chr(10)) END, '{n}', s_suppkey::VARCHAR) AS text FROM supplier",
    "repair_json": "SELECT event_id, 'say \"' || event_type || '\" now' AS a, event_id AS n FROM events",
    "json_object": "SELECT event_id, true AS parsed FROM events",
}
