"""Predictions against ground truth: candidates, one-to-one matching, metrics.

Predictions have ord, sample_id, file, cwe (array), line; ground truth has the
same and vulnerable.  ord is the row's place in its list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from verdictlake.functions import columns as C
from verdictlake.operators.streams import fold_groups


@dataclass(frozen=True)
class MatchConfig:
    line_tolerance: int = 5
    require_cwe: bool = True


def candidates(predictions: DataFrame, truth: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """(pi, gi, base, score) of all pairs that may match.

    Equal files have equal base names, so the pairs are found by an equi-join;
    path, class and line decide among them.
    """
    p = predictions.select(F.col("ord").alias("pi"), F.col("sample_id").alias("p_sample"), F.col("cwe").alias("p_cwe"), F.col("line").alias("p_line"), F.col("file").alias("p_file"), C.base_name("file").alias("base"))
    g = truth.select(F.col("ord").alias("gi"), F.col("sample_id").alias("g_sample"), F.col("cwe").alias("g_cwe"), F.col("line").alias("g_line"), F.col("file").alias("g_file"), C.base_name("file").alias("base"))
    pairs = p.join(g, "base")
    score = C.match_score(C.same_file("p_file", "g_file"), "p_cwe", "g_cwe", "p_line", "g_line", config.line_tolerance, config.require_cwe)
    return pairs.withColumn("score", score).where("score > 0").select("pi", "gi", "base", "score", "p_sample", "g_sample")


def greedy(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates taken best first: by score, then the larger pi, then gi, if
    neither side is taken.  Pairs of different base names never compete, so each
    base name (within `by`) is a group of its own; of its pairs only the sides
    that are taken are held."""
    keys = [*by, "base"]
    columns = [*keys, *(c for c in found.columns if c not in keys)]
    pi, gi = columns.index("pi"), columns.index("gi")

    def step(taken: tuple[set, set], row: tuple) -> list[tuple]:
        if row[pi] in taken[0] or row[gi] in taken[1]:
            return []
        taken[0].add(row[pi])
        taken[1].add(row[gi])
        return [row]

    picked = fold_groups(found.select(*columns), keys, [F.desc("score"), F.desc("pi"), F.desc("gi")], lambda: (set(), set()), step, found.select(*columns).schema)
    return picked.select(*found.columns)


@dataclass
class Evaluation:
    positives: DataFrame  #: positive predictions
    truth: DataFrame
    matches: DataFrame

    @property
    def unmatched_predictions(self) -> DataFrame:
        return self.positives.join(self.matches.select(F.col("pi").alias("ord")), "ord", "left_anti")

    @property
    def unmatched_truth(self) -> DataFrame:
        return self.truth.where("vulnerable").join(self.matches.select(F.col("gi").alias("ord")), "ord", "left_anti")

    @property
    def benign_flagged(self) -> DataFrame:
        """Benign samples with a positive prediction."""
        return self.truth.where("not vulnerable").join(self.positives.select("sample_id").distinct(), "sample_id", "left_semi")

    def failures(self) -> DataFrame:
        """Unmatched predictions with the reason: the sample's label is among
        the unmatched, or it is not."""
        missed = self.unmatched_truth.select("sample_id").distinct().withColumn("missed", F.lit(True))
        kind = F.when(F.col("missed"), "wrong_class_on_vulnerable_file").otherwise("reported_on_benign_file")
        return self.unmatched_predictions.join(missed, "sample_id", "left").withColumn("sample_vulnerable", F.coalesce("missed", F.lit(False))).withColumn("failure", kind).drop("missed")

    def confusion(self) -> DataFrame:
        """One row: the cells by finding (tp fp fn tn) and by sample (s_*)."""
        benign = self.truth.where("not vulnerable").select("sample_id").distinct()
        on_benign = self.positives.join(benign, "sample_id", "left_semi")
        one = lambda df, what: df.agg(what)
        vulnerable = self.truth.where("vulnerable")
        detected = self.matches.select(F.col("p_sample").alias("sample_id")).join(vulnerable.select("sample_id"), "sample_id", "left_semi")
        off_benign = self.unmatched_predictions.join(benign, "sample_id", "left_anti")
        parts = [
            one(self.matches, F.count("*").alias("tp")),
            one(off_benign, F.count("*").alias("fp_off")),
            one(on_benign, F.count("*").alias("fp_on")),
            one(self.unmatched_truth, F.count("*").alias("fn")),
            one(benign, F.count("*").alias("n_benign")),
            one(on_benign, F.count_distinct("sample_id").alias("s_fp")),
            one(detected, F.count_distinct("sample_id").alias("s_tp")),
            one(vulnerable, F.count("*").alias("n_vulnerable")),
        ]
        row = parts[0]
        for part in parts[1:]:
            row = row.join(part)  # single rows
        return row.selectExpr("tp", "fp_off + fp_on as fp", "fn", "n_benign - s_fp as tn", "s_tp", "s_fp", "n_vulnerable - s_tp as s_fn", "n_benign - s_fp as s_tn")


def evaluate(predictions: DataFrame, truth: DataFrame, config: MatchConfig = MatchConfig()) -> Evaluation:
    """Greedy matching of the positive predictions to the vulnerable truth."""
    found = candidates(predictions, truth.where("vulnerable"), config)
    return Evaluation(predictions, truth, greedy(found))


def rates(confusion: DataFrame) -> DataFrame:
    """Rates of confusion rows: precision, recall and f1 by finding, the others
    by sample; balanced accuracy is the mean of the finding recall and the
    sample specificity where both classes are there; intervals beside them."""
    d = C.safe_div
    out = confusion.withColumns({"precision": d("tp", F.col("tp") + F.col("fp")), "recall": d("tp", F.col("tp") + F.col("fn"))})
    out = out.withColumns({
        "f1": d(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")),
        "specificity": d("s_tn", F.col("s_tn") + F.col("s_fp")),
        "false_positive_rate": d("s_fp", F.col("s_fp") + F.col("s_tn")),
        "false_negative_rate": d("s_fn", F.col("s_fn") + F.col("s_tp")),
        "accuracy": d(F.col("s_tp") + F.col("s_tn"), F.expr("s_tp + s_tn + s_fp + s_fn")),
    })
    both = F.expr("s_tp + s_fn > 0 and s_tn + s_fp > 0")
    return out.withColumn("balanced_accuracy", F.when(both, (F.col("recall") + F.col("specificity")) / 2).otherwise(F.lit(0.0)))


RATES = ["precision", "recall", "f1", "specificity", "false_positive_rate", "false_negative_rate", "accuracy", "balanced_accuracy"]
#: Rates with an interval: successes and trials.
INTERVALS = {"precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "false_positive_rate": ("s_fp", "s_fp + s_tn"), "specificity": ("s_tn", "s_tn + s_fp"), "false_negative_rate": ("s_fn", "s_fn + s_tp"), "accuracy": ("s_tp + s_tn", "s_tp + s_tn + s_fp + s_fn")}


def intervals(confusion: DataFrame) -> DataFrame:
    """A row per rate that has trials: successes, trials, low, high."""
    rows = F.array(*[F.struct(F.lit(name).alias("rate"), F.expr(s).alias("successes"), F.expr(n).alias("trials")) for name, (s, n) in INTERVALS.items()])
    long = confusion.select(F.explode(rows).alias("r")).select("r.*").where("trials > 0")
    return long.withColumn("ci", C.wilson("successes", "trials")).select("rate", "successes", "trials", F.col("ci.low").alias("low"), F.col("ci.high").alias("high"))


def sample_level(e: Evaluation) -> DataFrame:
    """One row of eleven measures in files."""
    vulnerable, benign = e.truth.where("vulnerable"), e.truth.where("not vulnerable")
    on_vulnerable = e.positives.join(vulnerable.select("sample_id").distinct(), "sample_id", "left_semi")
    matched = e.matches.select(F.col("p_sample").alias("sample_id")).distinct()
    off_benign = e.unmatched_predictions.join(benign.select("sample_id"), "sample_id", "left_anti")
    row = (
        vulnerable.agg(F.count("*").alias("vulnerable_samples"))
        .join(matched.agg(F.count("*").alias("vulnerable_detected")))
        .join(on_vulnerable.agg(F.count_distinct("sample_id").alias("vulnerable_flagged"), F.count("*").alias("findings_on_vulnerable")))
        .join(on_vulnerable.select("sample_id").distinct().join(matched, "sample_id", "left_anti").agg(F.count("*").alias("class_mismatch_count")))
        .join(benign.agg(F.count("*").alias("benign_samples")))
        .join(e.benign_flagged.agg(F.count_distinct("sample_id").alias("benign_flagged")))
        .join(off_benign.agg(F.count("*").alias("unmatched_findings_on_vulnerable")))
    )
    d = C.safe_div
    return row.withColumns({"vulnerable_detection_rate": d("vulnerable_detected", "vulnerable_samples"), "vulnerable_flag_rate": d("vulnerable_flagged", "vulnerable_samples"), "benign_flag_rate": d("benign_flagged", "benign_samples"), "findings_per_vulnerable_file": d("findings_on_vulnerable", "vulnerable_samples")}).drop("findings_on_vulnerable")


def per_class(predictions: DataFrame, truth: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Confusion cells for each class named in the truth.

    A class's population are the samples labelled with it, its predictions
    those on them whose families meet the class's; matching is run again for
    each class, all classes at once.
    """
    g = truth.withColumn("class", F.explode("cwe"))
    members = g.select("class", "sample_id", "vulnerable").distinct()
    pairs = predictions.join(members.select("class", "sample_id").distinct(), "sample_id").where(F.arrays_overlap(C.families_of(F.array("class")), C.families_of("cwe")))
    p = pairs.select("class", F.col("ord").alias("pi"), F.col("sample_id").alias("p_sample"), F.col("cwe").alias("p_cwe"), F.col("line").alias("p_line"), F.col("file").alias("p_file"), C.base_name("file").alias("base"))
    t = g.where("vulnerable").select("class", F.col("ord").alias("gi"), F.col("sample_id").alias("g_sample"), F.col("cwe").alias("g_cwe"), F.col("line").alias("g_line"), F.col("file").alias("g_file"), C.base_name("file").alias("base"))
    score = C.match_score(C.same_file("p_file", "g_file"), "p_cwe", "g_cwe", "p_line", "g_line", config.line_tolerance, config.require_cwe)
    found = p.join(t, ["class", "base"]).withColumn("score", score).where("score > 0").select("class", "pi", "gi", "base", "score", "p_sample", "g_sample")
    matches = greedy(found, ("class",))
    count = lambda df, name: df.groupBy("class").agg(F.count("*").alias(name))
    benign, vulnerable = members.where("not vulnerable"), g.where("vulnerable")
    left = pairs.join(matches.select("class", F.col("pi").alias("ord")), ["class", "ord"], "left_anti")
    flagged = pairs.select("class", "sample_id").distinct().join(benign.select("class", "sample_id"), ["class", "sample_id"], "left_semi")
    detected = matches.select("class", F.col("p_sample").alias("sample_id")).distinct().join(vulnerable.select("class", "sample_id"), ["class", "sample_id"], "left_semi")
    out = g.select("class").distinct()
    for df, name in ((matches, "tp"), (left, "fp"), (vulnerable, "n_vulnerable"), (benign, "n_benign"), (flagged, "s_fp"), (detected, "s_tp")):
        out = out.join(count(df, name), "class", "left")
    out = out.fillna(0)
    return out.selectExpr("class", "tp", "fp", "n_vulnerable - tp as fn", "n_benign - s_fp as tn", "s_tp", "s_fp", "n_vulnerable - s_tp as s_fn", "n_benign - s_fp as s_tn")
