"""Corpora: filters, first-seen rows, samples, summaries and digests.

Rows carry ord, their place in the input, wherever order matters."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictlake.functions import columns as C


def skip_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is more than white space."""
    return df.where(F.coalesce(F.col(text).rlike(r"\S"), F.lit(False)))


def cwe_filter(df: DataFrame, wanted: list[str], vulnerable_only: bool = True) -> DataFrame:
    """Rows with a wanted class; by default the filter spares benign rows."""
    hit = F.arrays_overlap("cwe", F.array(*map(F.lit, wanted)))
    return df.where((~F.col("vulnerable") | hit) if vulnerable_only else hit)


def normalize_filter(values: Column) -> Column:
    """Filter values without prefix and leading zeros."""
    return F.transform(values, lambda x: C.canonical_cwe(F.regexp_replace(x, r"(?i)^\s*cwe-", "")))


def filter_manifest(df: DataFrame, classes: list[str], languages: list[str], limit: int | None = None) -> DataFrame:
    """Rows by class and language, the first `limit` of the input's order."""
    out = df.where(F.arrays_overlap("cwe", F.array(*map(F.lit, classes))) & F.col("language").isin(*languages))
    return out if limit is None else out.orderBy("ord").limit(limit)


def manifest_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("sample_count"), F.count_if("vulnerable").alias("vulnerable_count"), F.count_if(~F.col("vulnerable")).alias("benign_count"), F.count_distinct("language").alias("languages"))


def per_class_counts(df: DataFrame) -> DataFrame:
    """A row with k classes counts for each."""
    return df.select(F.explode("cwe").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def manifest_digest(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First 16 hex digits of the SHA-256 of the ascending ids, one a line.

    A digest of one text is made from its beginning to its end: over the whole
    table the sorted ids stream through the driver, a part at a time, and none
    is kept; by groups each is an aggregate of its ids."""
    if not by:
        digest, n = hashlib.sha256(), 0
        for row in df.select("sample_id").where("sample_id is not null").orderBy("sample_id").toLocalIterator():
            digest.update(("\n" if n else "").encode() + row["sample_id"].encode())
            n += 1
        return df.sparkSession.createDataFrame([(digest.hexdigest()[:16], df.count())], "digest string, n long")
    text = F.array_join(F.sort_array(F.collect_list("sample_id")), "\n")
    return df.groupBy(*(by or [])).agg(F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("digest"), F.count("*").alias("n"))


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def dedup_first(df: DataFrame, text: str = "text", ident: str = "ord") -> DataFrame:
    """ord of the first row of each text: an aggregate with partial sums, so a
    text that is most of the table costs one row per task."""
    return df.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("key")).agg(F.min(ident).alias(ident), F.count("*").alias("copies"))


def unique_ids(df: DataFrame, ident: str, order: str = "ord") -> DataFrame:
    """id, id_2, id_3 in the input's order."""
    n = F.row_number().over(Window.partitionBy(ident).orderBy(order))
    return df.withColumn("unique_id", F.when(n > 1, F.concat(F.col(ident), F.lit("_"), n.cast("string"))).otherwise(F.col(ident)))


def seeded(ident: str, seed: int) -> Column:
    """An order that is random but the same everywhere."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(ident)).cast("binary"), 256)


def stratified_subset(df: DataFrame, per_stratum: int, seed: int = 7) -> DataFrame:
    """The first rows of each (primary class, label) in seeded order."""
    w = Window.partitionBy(C.primary_label("cwe", "none"), "vulnerable").orderBy(seeded("sample_id", seed), "ord")
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_stratum).drop("__rn")


def first_seeded(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The first n rows in seeded order.  Sums over 65,536 ranges of the order
    tell the range in which the n-th row lies; only that range is sorted."""
    mark, part = "__place", F.substring(seeded("sample_id", seed), 1, 4)
    sums = df.groupBy(part.alias("part")).count().withColumn("upto", F.sum("count").over(Window.orderBy("part")))
    end = sums.where(F.col("upto") >= n).orderBy("part").first()
    if end is None:
        return df
    within = Window.partitionBy(part).orderBy(seeded("sample_id", seed), "ord")
    last = df.where(part == end["part"]).withColumn(mark, F.row_number().over(within)).where(F.col(mark) <= n - (end["upto"] - end["count"])).drop(mark)
    return df.where(part < end["part"]).unionByName(last)


def balanced_sample(df: DataFrame, limit: int | None = None, seed: int = 7, balanced: bool = True) -> DataFrame:
    """Vulnerable and benign rows in seeded order, at most the limit.

    balanced: as many of each where there are both, half the limit, rounded up,
    of each; a limit that is odd costs a benign row.  Else, or where a class is
    missing, all rows of both, vulnerable ones first."""
    n = df.agg(F.count_if("vulnerable").alias("v"), F.count_if(~F.col("vulnerable")).alias("b")).first()
    v, b = n["v"], n["b"]
    both = balanced and v and b
    if both:
        v = b = min(v, b)
    if limit is not None and v + b > limit:
        v = min(v, max(1, -(-limit // 2)) if both else limit)
        b = min(b, limit - v)
    take = lambda of, k: first_seeded(df.where(of), k, seed) if k else df.where(of).limit(0)
    return take(F.col("vulnerable"), v).unionByName(take(~F.col("vulnerable"), b))


def top_classes(df: DataFrame, n: int = 10) -> DataFrame:
    return per_class_counts(df).orderBy(F.desc("n"), "class").limit(n)


def union_variants(df: DataFrame) -> DataFrame:
    """One row for each variant that a row holds: bad where vulnerable, good
    always, each with an id of its own."""
    variants = F.array(F.struct(F.lit("good").alias("variant"), F.lit(False).alias("label")), F.struct(F.lit("bad").alias("variant"), F.lit(True).alias("label")))
    return df.select("*", F.inline(variants)).where("label = false or vulnerable").withColumn("variant_id", F.concat("sample_id", F.lit("_"), "variant"))


def missing(df: DataFrame, have: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(have.select(key).distinct(), key, "left_anti")


def verdict_filter(df: DataFrame, wanted: tuple[str, ...] = ("CONFIRMED",)) -> DataFrame:
    unknown = set(wanted) - {"CONFIRMED", "REJECTED", "UNCERTAIN"}
    if unknown:
        raise ValueError(f"unknown statuses: {sorted(unknown)}")
    return df.withColumn("status", C.verdict("status")).where(F.col("status").isin(*wanted))


def sard_label(path: Column) -> Column:
    """A sample's label from its folders, the nearest first: false for a safe
    word, true for a vulnerable one, null where none is found."""
    from verdictlake import vocab

    parts = F.split(path, "/")
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    word = lambda x, words: C.has_marker(x, words)
    return (
        F.when(word(folder, vocab.SAFE_MARKERS), F.lit(False)).when(word(folder, vocab.VULNERABLE_MARKERS), F.lit(True))
        .when(word(path, vocab.SAFE_MARKERS), F.lit(False)).when(word(path, vocab.VULNERABLE_MARKERS), F.lit(True))
    )
