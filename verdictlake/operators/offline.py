"""Scores of stored results: policies, lost findings, queues, paired tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from verdictlake.functions import columns as C
from verdictlake.operators import matching as M

POLICIES = {"confirmed": ("CONFIRMED",), "confirmed_uncertain": ("CONFIRMED", "UNCERTAIN"), "all": ("CONFIRMED", "UNCERTAIN", "REJECTED")}


def policy_counterfactual(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and benign flag rate under each policy of statuses;
    all policies are matched in one pass, each a group of its own."""
    rows = F.array(*[F.struct(F.lit(p).alias("policy"), F.array(*map(F.lit, s)).alias("wanted")) for p, s in POLICIES.items()])
    kept = decisions.withColumn("status", C.verdict("status")).select("*", F.inline(rows)).where(F.array_contains("wanted", F.col("status"))).drop("wanted")
    found = M.candidates(kept.select("ord", "sample_id", "file", "cwe", "line").distinct(), truth.where("vulnerable"))
    matches = M.greedy(kept.select("policy", F.col("ord").alias("pi")).join(found, "pi"), ("policy",))
    benign = truth.where("not vulnerable").select("sample_id")
    n = truth.agg(F.count_if("vulnerable").alias("n_vulnerable"), F.count_if(~F.col("vulnerable")).alias("n_benign"))
    count = kept.groupBy("policy").agg(F.count("*").alias("findings"))
    flagged = kept.join(benign, "sample_id", "left_semi").groupBy("policy").agg(F.count_distinct("sample_id").alias("flagged"), F.count("*").alias("on_benign"))
    matched_benign = matches.join(benign.withColumnRenamed("sample_id", "p_sample"), "p_sample", "left_semi").groupBy("policy").agg(F.count("*").alias("matched_benign"))
    tp = matches.groupBy("policy").agg(F.count("*").alias("tp"))
    out = count.join(flagged, "policy", "left").join(tp, "policy", "left").join(matched_benign, "policy", "left").fillna(0).join(F.broadcast(n))
    fp = F.col("findings") - F.col("tp") + F.col("matched_benign")
    return out.select("policy", "tp", fp.alias("fp"), C.safe_div("tp", F.col("tp") + fp).alias("precision"), C.safe_div("tp", "n_vulnerable").alias("recall"), C.safe_div("flagged", "n_benign").alias("benign_flag_rate"))


BUCKETS = ("matched", "no_report", "candidate_ceiling", "agent_silent", "confirmed_unmatched", "dropped_uncertain", "dropped_rejected")


def miss_decomposition(truth: DataFrame, detected: DataFrame, reports: DataFrame) -> DataFrame:
    """For each vulnerable sample's primary class, and over all (class null),
    how many samples each stage lost.  reports: sample_id, has_findings,
    statuses (array)."""
    t = truth.where("vulnerable").join(detected.select("sample_id").distinct().withColumn("hit", F.lit(True)), "sample_id", "left").join(reports.withColumn("there", F.lit(True)), "sample_id", "left")
    none = F.size(F.coalesce("statuses", F.array())) == 0
    bucket = (
        F.when(F.col("hit"), "matched").when(F.col("there").isNull(), "no_report").when(none & ~F.coalesce("has_findings", F.lit(False)), "candidate_ceiling").when(none, "agent_silent")
        .when(F.array_contains("statuses", "CONFIRMED"), "confirmed_unmatched").when(F.array_contains("statuses", "UNCERTAIN"), "dropped_uncertain").otherwise("dropped_rejected")
    )
    return t.withColumn("bucket", bucket).withColumn("label", C.primary_label("cwe")).rollup("label").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS], F.count("*").alias("positives"))


def triage_queue(decisions: DataFrame, steps: int = 1000) -> DataFrame:
    """Uncertain decisions by confidence, sample and line, numbered from 1.

    Numbered within steps of confidence, with the sizes of the higher steps
    added, so that no task holds the whole queue."""
    q = decisions.withColumn("status", C.verdict("status")).where("status = 'UNCERTAIN'").withColumns({"__c": F.coalesce("confidence", F.lit(0.0)), "__l": F.coalesce(F.col("line").cast("string"), F.lit("None"))}).withColumn("__step", F.floor(F.col("__c") * steps))
    sizes = q.groupBy("__step").agg(F.count("*").alias("__n"))
    above = sizes.withColumn("__above", F.sum("__n").over(Window.orderBy(F.desc("__step"))) - F.col("__n")).drop("__n")
    w = Window.partitionBy("__step").orderBy(F.desc("__c"), "sample_id", "__l", "ord")
    return q.join(above, "__step").withColumn("rank", F.row_number().over(w) + F.col("__above")).drop("__c", "__l", "__step", "__above")


def paired(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Two runs by stratum: n, rates, discordant pairs b and c, exact p.  A run
    is (sample_id, detected, flagged) over all samples."""
    both = truth.select("sample_id", "vulnerable").join(a.select("sample_id", F.col("detected").alias("da"), F.col("flagged").alias("fa")), "sample_id", "full_outer").join(b.select("sample_id", F.col("detected").alias("db"), F.col("flagged").alias("fb")), "sample_id", "full_outer")
    rows = F.array(
        F.struct(F.lit("positive_detection").alias("stratum"), F.col("vulnerable").alias("member"), F.col("da").alias("a"), F.col("db").alias("b")),
        F.struct(F.lit("benign_flagging").alias("stratum"), (~F.col("vulnerable")).alias("member"), F.col("fa").alias("a"), F.col("fb").alias("b")),
        F.struct(F.lit("accuracy").alias("stratum"), F.lit(True).alias("member"), F.when(F.col("vulnerable"), F.col("da")).otherwise(~F.col("fa")).alias("a"), F.when(F.col("vulnerable"), F.col("db")).otherwise(~F.col("fb")).alias("b")),
    )
    long = both.select(F.inline(rows)).where("member")
    check = F.assert_true(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit("the runs cover different samples"))
    out = long.withColumn("ok", check).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"), F.max("ok").alias("ok"))
    return out.select("stratum", "n", C.safe_div("n_a", "n").alias("rate_a"), C.safe_div("n_b", "n").alias("rate_b"), "a_only", "b_only", C.mcnemar_exact(F.col("a_only"), F.col("b_only")).alias("p_value"))


@F.pandas_udf(DoubleType())
def chi_square_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """McNemar's chi-square with continuity correction; erfc is not built in."""

    def one(x: float, y: float) -> float:
        return 1.0 if x + y == 0 else math.erfc(math.sqrt(max(0.0, abs(x - y) - 1) ** 2 / (x + y) / 2))

    return pd.Series([one(x, y) for x, y in zip(b, c)])


def provenance_rollup(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    s = lambda name: F.count_if(F.col("decision") == name).alias(name.lower())
    return records.groupBy(*(by or [])).agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.sum("elapsed").alias("elapsed"), *[s(x) for x in ("CONFIRMED", "REJECTED", "UNCERTAIN", "ERROR")])


def tally(flags: DataFrame, detectors: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """2x2 counts of every detector in one pass, long: a null flag leaves a row
    out of that detector's table and is counted as unavailable."""
    parts = []
    for name, flag in detectors.items():
        v = F.col("vulnerable")
        parts.append(F.struct(F.lit(name).alias("detector"), F.count_if(v & flag).alias("tp"), F.count_if(~v & flag).alias("fp"), F.count_if(v & ~flag).alias("fn"), F.count_if(~v & ~flag).alias("tn"), F.count_if(flag.isNull()).alias("unavailable")))
    wide = flags.groupBy(*(by or [])).agg(*[p.alias(f"d{i}") for i, p in enumerate(parts)])
    return wide.select(*(by or []), F.inline(F.array(*[F.col(f"d{i}") for i in range(len(parts))])))


def merge_reports(decisions: DataFrame, folder: Column) -> DataFrame:
    """Per folder: decisions, files, statuses and the language, 'mixed' for more."""
    lang = F.when(F.count_distinct("language") > 1, F.lit("mixed")).otherwise(F.max("language"))
    return decisions.withColumn("folder", folder).groupBy("folder").agg(F.count("*").alias("decisions"), F.count_distinct("file").alias("files"), lang.alias("language"))
