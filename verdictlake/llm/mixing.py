"""Mixing sources to target weights by hierarchical budgets.

Weights stand at the nodes of a tree (domain, language, source).  A node's
budget is dealt to its children in proportion to their weights; a child takes
at most what it can supply (its tokens, times the epochs allowed), and what it
cannot take goes to its siblings by their weights.  Since a node's supply is
its children's, a shortage reaches an ancestor's siblings only when all
siblings are full.  Each leaf then gives whole epochs, and the first tokens of
one more in an order seeded by epoch.

Budgets are integers: shares are the differences of rounded-down running sums,
so they add up to the token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from . import common

#: Words, as runs outside ASCII white space: the tokens that budgets count.
WORD_COUNT = r"size(filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x <> ''))"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Leaves up to this count are broadcast to the documents; more are joined by shuffle.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """The levels as (name, SQL expression), weights by level and value, and
    the token budget as a share of all tokens (num / den)."""

    levels: tuple[tuple[str, str], ...] = (
        ("domain", "case when source is null then 'unknown' when source = 'src0' then 'crawl' else 'curated' end"),
        ("language", "coalesce(lang, 'unknown')"),
        ("origin", "coalesce(source, 'unknown')"),
    )
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"crawl": 1, "curated": 3}, "language": {"en": 4, "de": 2, "fr": 2, "es": 2}})
    default_weight: int = 1
    share: tuple[int, int] = (1, 2)
    max_epochs: int = 2
    seed: int = 17
    tokens: str = WORD_COUNT

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.levels]

    def weight(self, level: str) -> Column:
        out = F.lit(self.default_weight)
        for value, w in self.weights.get(level, {}).items():
            out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
        return out.cast("long")


def leaf_of(mix: Mix) -> list[Column]:
    return [F.expr(e).alias(n) for n, e in mix.levels]


def digest() -> Column:
    return F.md5(common.text_bytes())


def deal(nodes: DataFrame, mix: Mix, budget_share: tuple[int, int]) -> DataFrame:
    """Budgets of leaves (the levels and tokens): level by level, a window over
    siblings in the order of supply for weight, in which the full come first."""
    num, den = budget_share
    names = mix.names
    tree = nodes.withColumn("supply", F.col("tokens") * mix.max_epochs)
    total = nodes.agg(F.sum("tokens")).first()[0] or 0
    level_budget = tree.select(*names, "tokens", "supply", F.lit(total * num // den).cast("long").alias("budget"))
    for depth, name in enumerate(names):
        above, here = names[:depth], names[: depth + 1]
        siblings = level_budget.groupBy(*here).agg(F.sum("supply").alias("s"), F.first("budget").alias("b")).withColumn("w", mix.weight(name)).where("w > 0 and s > 0")
        order = Window.partitionBy(*(above or [F.lit(0)])).orderBy(F.expr("s / w"), name)
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*(above or [F.lit(0)]))
        dealt = (
            siblings.withColumn("s_before", F.sum("s").over(upto) - F.col("s"))
            .withColumn("w_from", F.sum("w").over(whole) - F.sum("w").over(upto) + F.col("w"))
            .withColumn("full", F.expr("cast(s as decimal(19,0)) * w_from <= cast(b - s_before as decimal(19,0)) * w"))
            .withColumn("rest", F.col("b") - F.sum(F.expr("if(full, s, 0)")).over(whole))
            .withColumn("w_rest", F.sum(F.expr("if(full, 0, w)")).over(whole))
            .withColumn("w_upto", F.sum(F.expr("if(full, 0, w)")).over(upto))
            .withColumn("got", F.expr("if(full, s, cast(cast(rest as decimal(19,0)) * w_upto div w_rest as bigint) - cast(cast(rest as decimal(19,0)) * (w_upto - w) div w_rest as bigint))"))
            .select(*here, "got")
        )
        level_budget = level_budget.drop("budget").join(dealt, here).withColumnRenamed("got", "budget")
    return level_budget.select(*names, "tokens", "budget", F.expr("budget div tokens").alias("whole_epochs"), F.expr("budget % tokens").alias("rest"))


def order_key(mix: Mix, epoch: Column, doc_id: Column, text_digest: Column) -> Column:
    """A document's place in an epoch: a hash of seed, epoch, doc_id and text.
    Rows that agree in all of these follow each other."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")), text_digest).cast("binary"))


def sizes_of(docs: DataFrame, mix: Mix) -> DataFrame:
    """leaf, tokens, doc_id and digest of the rows with tokens."""
    return common.materialize(docs.select(*leaf_of(mix), F.expr(mix.tokens).cast("long").alias("tokens"), "doc_id", digest().alias("digest")).where("tokens > 0"), "mix-sizes")


def hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def plan(sizes: DataFrame, mix: Mix) -> DataFrame:
    """The leaves with budget, whole_epochs, rest and where the rest ends:
    cut_key, and the tokens before it, cut_before.

    The running sum over a leaf is taken in three steps, so that no task sees a
    whole leaf: over sums of key ranges, within the one range where the budget
    ends over finer ones, and there over the keys.
    """
    names = mix.names
    totals = common.materialize(sizes.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mix-totals")
    leaves = common.materialize(deal(totals, mix, mix.share), "mix-leaves")
    small = leaves.count() <= BROADCAST_LEAVES
    partial = leaves.where("rest > 0").select(*names, "whole_epochs", "rest")
    keyed = sizes.join(hint(partial, small), names).withColumn("key", order_key(mix, F.col("whole_epochs"), F.col("doc_id"), F.col("digest")))
    # 4,096 ranges of a leaf, then 256 times finer within the one that the budget ends in
    ends = partial.withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(""))
    upto = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for digits in (3, 5, 32):
        inside = keyed.join(hint(ends.select(*names, "prefix", "before"), small), names).where("startswith(key, prefix)")
        ranges = inside.groupBy(*names, "rest", "before", F.substring("key", 1, digits).alias("range")).agg(F.sum("tokens").alias("t"))
        ends = ranges.withColumn("upto", F.col("before") + F.sum("t").over(upto)).where("upto - t < rest and upto >= rest").select(*names, F.col("range").alias("prefix"), (F.col("upto") - F.col("t")).alias("before"))
        ends = common.materialize(ends, "mix-ends")
    found = ends.select(*names, F.col("prefix").alias("cut_key"), F.col("before").alias("cut_before"))
    return common.materialize(leaves.join(found, names, "left"), "mix-plan")


def taken(rows: DataFrame, mix: Mix, leaves: DataFrame, doc_id: Column, text_digest: Column, leaf: list[Column], tokens: Column) -> tuple[DataFrame, str]:
    """(rows by epoch, name of a struct column of epoch, tokens, take): the
    columns of rows stay as they are, whatever their names.

    Rows that share the place where a leaf's budget ends are numbered, so that
    the budget is met to the token: within 1,024 parts by a hash, with the
    parts' offsets, so that copies of one document are not one task.
    """
    small = leaves.count() <= BROADCAST_LEAVES
    own, to = (common.free_name(rows, x) for x in ("mix", "plan"))
    planned = leaves.select(F.struct(*leaves.columns).alias(to))
    marked = rows.withColumn(own, F.struct(*[c.alias(n) for c, n in zip(leaf, mix.names)], doc_id.alias("doc_id"), text_digest.alias("digest"), tokens.alias("tokens")))
    same = [F.col(f"{own}.{n}") == F.col(f"{to}.{n}") for n in mix.names]
    joined = marked.join(hint(planned, small), same).where(F.col(f"{own}.tokens") > 0)
    key = order_key(mix, F.col(f"{to}.whole_epochs"), F.col(f"{own}.doc_id"), F.col(f"{own}.digest"))
    part = F.when(F.col(f"{to}.rest") == 0, 1).when(key < F.col(f"{to}.cut_key"), -1).when(key == F.col(f"{to}.cut_key"), 0).otherwise(1)
    joined = joined.withColumn(own, F.struct(f"{own}.*", part.alias("part")))
    what = lambda epoch, take: F.struct(*[F.col(f"{own}.{n}").alias(n) for n in mix.names], epoch.alias("epoch"), F.col(f"{own}.tokens").alias("tokens"), take.alias("take"))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    epochs = F.expr(f"sequence(0L, {to}.whole_epochs - if({own}.part < 0, 0, 1))")
    whole = joined.where(F.expr(f"{to}.whole_epochs > 0 or {own}.part < 0")).select(*columns, own, F.explode(epochs).alias(to))
    whole = whole.select(*columns, what(F.col(to), F.col(f"{own}.tokens")).alias(own))
    number = common.free_name(rows, "number")
    there = joined.where(F.col(f"{own}.part") == 0).select(*columns, own, to, F.struct(F.monotonically_increasing_id().alias("id")).alias(number))
    there = common.materialize(there.withColumn(number, F.expr(f"struct({number}.id as id, pmod(xxhash64({number}.id), 1024) as part)")), "mix-cut")
    leaf_names = [f"{own}.{n}" for n in mix.names]
    counts = there.groupBy(*[F.col(c) for c in leaf_names], F.col(f"{number}.part").alias("part")).agg(F.count("*").alias("n"))
    offsets = counts.withColumn("n", F.sum("n").over(Window.partitionBy(*mix.names).orderBy("part")) - F.col("n"))
    offsets = offsets.select(F.struct("*").alias(to + "_offset"))
    placed = there.withColumn(number, F.struct(f"{number}.*", F.row_number().over(Window.partitionBy(*leaf_names, f"{number}.part").orderBy(f"{number}.id")).alias("at")))
    placed = placed.join(offsets, [*[F.col(f"{own}.{n}") == F.col(f"{to}_offset.{n}") for n in mix.names], F.col(f"{number}.part") == F.col(f"{to}_offset.part")])
    left = F.expr(f"{to}.rest - {to}.cut_before - ({to}_offset.n + {number}.at - 1) * {own}.tokens")
    cut = placed.where(left > 0).select(*columns, what(F.col(f"{to}.whole_epochs"), F.least(F.col(f"{own}.tokens"), left)).alias(own))
    return whole.unionAll(cut), own


def mix_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """One row per document and epoch taken: doc_id, the levels, epoch, tokens
    and take_tokens, how many of its first tokens the budget takes.

    Budgets are met to the token.  Texts without tokens, null or empty, are
    never taken; very long ones count whole.  Null languages and sources are
    leaves of their own; a null doc_id is an id like others.  Repeated rows are
    taken each; where the budget ends at them, so many are taken as it covers,
    and one of them in part.  A weight of 0 leaves a subtree out.  An empty
    table gives no rows; other columns, of whatever name, are ignored.
    """
    mix = mix or Mix()
    names = mix.names
    sizes = sizes_of(docs, mix)
    rows, own = taken(sizes.select("doc_id", "digest", *names, "tokens"), mix, plan(sizes, mix), F.col("doc_id"), F.col("digest"), [F.col(n) for n in names], F.col("tokens"))
    return rows.select("doc_id", *[F.col(f"{own}.{n}").alias(n) for n in names], F.col(f"{own}.epoch").alias("epoch"), F.col(f"{own}.tokens").alias("tokens"), F.col(f"{own}.take").alias("take_tokens"))


@F.pandas_udf(StringType())
def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """Texts up to the end of their n-th word."""

    def cut(t: str, most: int) -> str:
        for k, m in enumerate(_WORD.finditer(t), 1):
            if k == most:
                return t[: m.end()]
        return t

    return pd.Series([cut(t, k) for t, k in zip(text, n)], dtype=object)


def keep_mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of docs that the mix takes, with their columns; the row at
    which a leaf's budget ends has its text cut to the tokens taken.

    Each row is taken once, so mix.max_epochs should be 1, and mix.tokens must
    count words.  Nulls, empty texts, repeated rows and empty tables are as in
    mix_documents; columns keep their values, whatever their names.
    """
    leaves = plan(sizes_of(docs, mix), mix)
    rows, own = taken(docs, mix, leaves, F.col("doc_id"), digest(), leaf_of(mix), F.expr(mix.tokens).cast("long"))
    first = rows.where(F.col(f"{own}.epoch") == 0)
    whole = first.where(F.col(f"{own}.take") == F.col(f"{own}.tokens")).select(*[F.col(f"`{c}`") for c in docs.columns])
    part = first.where(F.col(f"{own}.take") < F.col(f"{own}.tokens"))
    return whole.unionAll(part.select(*[first_words(F.col("text"), F.col(f"{own}.take")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]))


def oracle(mix: Mix | None = None) -> str:
    """The same rows in DuckDB's SQL."""
    mix = mix or Mix()
    names = mix.names
    num, den = mix.share
    parts = ["docs AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, " + ", ".join(f"{e} AS {n}" for n, e in mix.levels) + r", len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents)"]
    parts.append(f"leaves AS (SELECT {', '.join(names)}, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {mix.max_epochs} AS supply FROM docs WHERE tokens > 0 GROUP BY ALL)")
    parts.append(f"n0 AS (SELECT *, ((SELECT sum(tokens) FROM leaves)::HUGEINT * {num} // {den})::BIGINT AS budget FROM leaves)")
    for d, name in enumerate(names):
        here, by = ", ".join(names[: d + 1]), ", ".join(names[:d]) or "1"
        weights = mix.weights.get(name, {})
        case = ("CASE " + " ".join(f"WHEN {name} = '{v}' THEN {w}" for v, w in weights.items()) + f" ELSE {mix.default_weight} END") if weights else str(mix.default_weight)
        order = f"PARTITION BY {by} ORDER BY s / w, {name} ROWS UNBOUNDED PRECEDING"
        parts.append(f"s{d} AS (SELECT * FROM (SELECT {here}, sum(supply)::BIGINT AS s, any_value(budget) AS b, {case} AS w FROM n{d} GROUP BY {here}) WHERE w > 0 AND s > 0)")
        parts.append(f"f{d} AS (SELECT *, s::HUGEINT * (sum(w) OVER (PARTITION BY {by}) - sum(w) OVER ({order}) + w) <= (b - (sum(s) OVER ({order}) - s))::HUGEINT * w AS f FROM s{d})")
        parts.append(f"r{d} AS (SELECT *, b - sum(if(f, s, 0)) OVER (PARTITION BY {by}) AS rest, sum(if(f, 0, w)) OVER (PARTITION BY {by}) AS w_rest, sum(if(f, 0, w)) OVER ({order}) AS w_upto FROM f{d})")
        parts.append(f"g{d} AS (SELECT {here}, (CASE WHEN f THEN s ELSE rest::HUGEINT * w_upto // w_rest - rest::HUGEINT * (w_upto - w) // w_rest END)::BIGINT AS got FROM r{d})")
        on = " AND ".join(f"n{d}.{n} = g{d}.{n}" for n in names[: d + 1])
        parts.append(f"n{d + 1} AS (SELECT n{d}.* EXCLUDE (budget), g{d}.got AS budget FROM n{d} JOIN g{d} ON {on})")
    last = f"n{len(names)}"
    on = " AND ".join(f"d.{n} = l.{n}" for n in names)
    parts.append(f"p AS (SELECT d.*, budget // l.tokens AS q, budget % l.tokens AS rest, md5(concat('{mix.seed}:', budget // l.tokens, ':', coalesce(doc_id::VARCHAR, 'null'), ':', digest)) AS k, row_number() OVER () AS row FROM docs d JOIN {last} l ON {on} WHERE d.tokens > 0)")
    parts.append(f"o AS (SELECT *, sum(tokens) OVER (PARTITION BY {', '.join(names)} ORDER BY k, row ROWS UNBOUNDED PRECEDING) - tokens AS before FROM p)")
    cols = "doc_id, " + ", ".join(names)
    return "WITH " + ",\n".join(parts) + (
        f"\nSELECT {cols}, unnest(range(q))::BIGINT AS epoch, tokens::BIGINT AS tokens, tokens::BIGINT AS take_tokens FROM o"
        f"\nUNION ALL SELECT {cols}, q::BIGINT AS epoch, tokens::BIGINT AS tokens, least(tokens, rest - before)::BIGINT AS take_tokens FROM o WHERE before < rest"
    )
