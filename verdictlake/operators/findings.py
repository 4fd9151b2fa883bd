"""Tool findings: normalization, duplicates, enclosing functions, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdictlake import vocab
from verdictlake.functions import columns as C
from verdictlake.operators.streams import fold_groups


def normalize(df: DataFrame) -> DataFrame:
    """Severity in capitals, classes ascending and distinct, a fingerprint."""
    known = F.when(F.upper("severity").isin(*vocab.SEVERITIES), F.upper("severity")).otherwise("UNKNOWN")
    return df.withColumns({"severity": known, "cwe": F.array_sort(F.array_distinct("cwe")), "fingerprint": C.fingerprint("tool", "rule_id", "file", "line", "message")})


def dedup(df: DataFrame) -> DataFrame:
    """The first finding of each fingerprint, in the order of ord."""
    rest = [c for c in df.columns if c not in ("fingerprint", "ord")]
    first = df.groupBy("fingerprint").agg(F.min(F.struct("ord", *rest)).alias("f"))
    return first.select("fingerprint", "f.*")


def enclosing_function(df: DataFrame, functions: DataFrame) -> DataFrame:
    """The innermost function around each finding: the least span, the first of
    equals.  Joined by file, so that only a file's functions are compared."""
    f = functions.select("file", F.col("name").alias("function"), "start_line", "end_line", F.col("ord").alias("f_ord"))
    inside = df.select("ord", "file", "line").join(f, "file").where("start_line <= line and line <= end_line")
    return inside.groupBy("ord").agg(F.min_by("function", F.struct(F.expr("end_line - start_line"), "f_ord")).alias("function"))


def first_function(df: DataFrame, functions: DataFrame) -> DataFrame:
    """The first function in the list around each finding, whatever its span."""
    f = functions.select("file", F.col("name").alias("function"), "start_line", "end_line", F.col("ord").alias("f_ord"))
    inside = df.select("ord", "file", "line").join(f, "file").where("start_line < end_line and start_line <= line and line <= end_line")
    return inside.groupBy("ord").agg(F.min_by("function", "f_ord").alias("function"))


def source_context(df: DataFrame, functions: DataFrame, radius: int = 8, most: int = 400) -> DataFrame:
    """ord, start_line, end_line, truncated and snippet of each row (ord, file,
    line, text): its window, widened to the first function around it."""
    f = functions.select("file", "start_line", "end_line", F.col("ord").alias("f_ord"))
    inside = df.select("ord", "file", "line").join(f, "file").where("start_line < end_line and start_line <= line and line <= end_line")
    bounds = inside.groupBy("ord").agg(F.min_by(F.struct("start_line", "end_line"), "f_ord").alias("bounds"))
    window = (radius, most, "bounds")
    return df.join(bounds, "ord", "left").select("ord", C.context_span("text", "line", *window).alias("span"), C.context_window("text", "line", *window).alias("snippet")).select("ord", "span.*", "snippet")


def canonical_member(df: DataFrame, group: list[str]) -> DataFrame:
    """The most severe member, the earliest line of those, the first of those."""
    key = F.struct(C.severity_rank("severity"), -F.coalesce("line", F.lit(1_000_000_000)), -F.col("ord"))
    return df.groupBy(*group).agg(F.max_by(F.struct("ord", "line", "severity"), key).alias("m")).select(*group, "m.*")


def correlate(df: DataFrame, tolerance: int = 2) -> DataFrame:
    """ord and group of each finding (file, line, cwe, rule_id, function).

    In the order of ord a finding joins the first group of its file with a
    member in the same function that shares a class, or at most `tolerance`
    lines away that shares a class or the rule's first part; else it opens one.
    The order matters, so a file is a group of its own.  Findings without a
    file, null or empty, stand alone, each numbered by its ord.
    """

    rows = df.select("file", "ord", "line", "cwe", "rule_id", "function")
    placed = F.coalesce(F.col("file") != "", F.lit(False))
    alone = rows.where(~placed).select("file", F.col("ord").cast("long").alias("ord"), F.col("ord").cast("long").alias("group"))

    def step(groups: dict, row: tuple) -> list[tuple]:
        """groups: the groups that each mark has been seen in, and how many."""
        file, o, line, cwes, rule, fn = row
        marks = [("class", c) for c in cwes or ()] + [("rule", (rule or "").split(".")[0])]
        here = [(fn, m) for m in marks[:-1]] if fn is not None else []
        near = [groups[m] for m in here if m in groups]
        if line is not None:
            near += [groups[line + k, m] for k in range(-tolerance, tolerance + 1) for m in marks if (line + k, m) in groups]
        if near:
            g = min(near)
        else:
            g = groups["n"] = groups.get("n", -1) + 1
        # of the groups with a mark only the first can be joined
        for m in here + ([(line, m) for m in marks] if line is not None else []):
            groups[m] = min(g, groups.get(m, g))
        return [(file, o, g)]

    return fold_groups(rows.where(placed), ["file"], ["ord"], dict, step, "file string, ord long, group long").unionAll(alone)


def group_summary(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with the canonical member's place and what their members name."""
    joined = groups.join(df.drop("file"), "ord")
    canon = canonical_member(joined, ["file", "group"])
    facts = joined.groupBy("file", "group").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cwe")))).alias("cwe"), F.array_sort(F.collect_set("tool")).alias("tools"), F.count("*").alias("members"))
    return canon.join(facts, ["file", "group"])


def group_members(groups: DataFrame, findings: DataFrame) -> DataFrame:
    """The findings whose fingerprint a group lists: groups (group_id,
    fingerprints array), or a row for each fingerprint of a group.  One that is
    listed again counts once.

    Fingerprints travel packed, and the lists are dealt by them once, which
    serves both distinct and the join; the findings stream past the lists."""
    listed = groups.select("group_id", F.explode("fingerprints").alias("fingerprint")) if "fingerprints" in groups.columns else groups.select("group_id", "fingerprint")
    key = F.coalesce(C.packed("fingerprint"), F.lit(b""))  # never null: else the join would compute it again to test that
    dealt = listed.where("fingerprint is not null").select("group_id", key.alias("fingerprint")).repartition("fingerprint").distinct()
    rows = findings.where("fingerprint is not null").withColumn("fingerprint", key)
    return rows.join(dealt, "fingerprint").select(C.unpacked("fingerprint").alias("fingerprint"), "group_id", *[c for c in findings.columns if c != "fingerprint"])
