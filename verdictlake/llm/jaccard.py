"""Near-duplicate join: MinHash bands find pairs, full n-gram sets decide.

Texts with equal n-gram sets are one set.  A set's MinHash signature is cut
into bands, and sets with an equal band share a bucket.  Buckets with the same
members are one.  The members' n-gram sets are then brought to their bucket,
which counts the pairs at or above the threshold; a pair in several buckets is
counted in the first.  A bucket of many members is cut into blocks, each pair
of blocks a task of its own, so pairs are compared in bounded memory and never
leave a task: what does is, for each set, its number of links and an edge to
the least set that it is connected to.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, textvec
from .textvec import U


@dataclass(frozen=True)
class Settings:
    ngram: int = 5
    threshold: Fraction = Fraction(4, 5)
    recall: float = 0.9999  #: of a pair at the threshold, at least
    most_hashes: int = 128
    block_sets: int = 768  #: sets, and n-grams, of a block of a bucket, about
    block_ngrams: int = 2_000_000

    def bands(self) -> tuple[int, int]:
        """(bands, rows) that reach the recall: 1 - (1 - t^rows)^bands, with
        the most rows, so the fewest false candidates, that the hashes allow."""
        best = None
        for rows in range(1, self.most_hashes + 1):
            hit = float(self.threshold) ** rows
            if hit >= 1 or hit < 1e-9:
                continue
            n = max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - hit)))
            if n * rows <= self.most_hashes:
                best = (n, rows)
        if best is None:
            raise ValueError("no bands reach the recall with so many hashes")
        return best


_RANDOM = np.random.Generator(np.random.PCG64(977))
_MULTIPLY = _RANDOM.integers(0, 2**31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RANDOM.integers(0, 2**32, 4096, dtype=np.uint64).astype(np.uint32)


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct n-gram hashes of each text in turn, their ends).

    A text of fewer than n words has one n-gram, all its words; a text without
    words has none.  A-Z count as a-z.
    """
    w = textvec.words_of(texts)
    h, doc = textvec.windows(w, n, short=True)
    begin = np.searchsorted(doc, np.arange(w.n_docs + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(begin, begin[1:])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.cumsum([len(p) for p in parts], dtype=np.int64)


def set_keys(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """A 128-bit name for each set; the empty set's is zero."""
    with np.errstate(over="ignore"):
        sums = []
        for salt in (U(0x3C79AC492BA7B653), U(0x1C69B3F74AC4AE35)):
            run = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(textvec.mix(values ^ salt), out=run[1:])
            sums.append(run[ends] - run[np.concatenate([[0], ends[:-1]])] if len(ends) else run[:0])
    return [x.tobytes() for x in np.column_stack(sums)]


def band_hashes(values: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row for each non-empty set in order."""
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    begin = begin[ends > begin]
    out = np.zeros((len(begin), bands), dtype=np.uint64)
    if not len(begin):
        return out
    x = (values >> U(32)).astype(np.uint32) ^ values.astype(np.uint32)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(begin), (b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                y = x * _MULTIPLY[k] + _ADD[k]
                y ^= y >> np.uint32(15)
                h = textvec.mix(h + np.minimum.reduceat(y * _MULTIPLY[-1 - k], begin))
            out[:, b] = h
    return out


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, digest of the text, key of its set, n_ngrams and its bands."""
    bands, rows = settings.bands()
    body = common.text_bytes()
    source = docs.select("doc_id", F.md5(body).alias("digest"), body.alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in textvec.cut(batch.column(2)):
                values, ends = ngram_sets(batch.column(2).slice(at, end - at), settings.ngram)
                sizes = np.diff(np.concatenate([[0], ends]))
                signatures = iter(band_hashes(values, ends, bands, rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(set_keys(values, ends), pa.binary()), pa.array(sizes, pa.int64()), pa.array([next(signatures).tobytes() if s else b"" for s in sizes], pa.binary())], names=["doc_id", "digest", "key", "n_ngrams", "bands"])

    return common.mapped(source, run, "doc_id long, digest string, key binary, n_ngrams long, bands binary", rows_per_batch=4096)


def bucket_rows(sets: DataFrame) -> DataFrame:
    """(bucket, key, n_ngrams) for each band of each set."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
            where = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)), batch.column(0).take(where), batch.column(1).take(where)], names=["bucket", "key", "n_ngrams"])

    return sets.select("key", "n_ngrams", "bands").mapInArrow(run, "bucket long, key binary, n_ngrams long")


def needed_filter(needed: DataFrame, n: int) -> np.ndarray:
    """A bitmap of at most 8 MB over the keys in need of verification: a key
    outside it is not among them."""
    words = 1 << min(20, max(10, math.ceil(math.log2(max(1, n / 2)))))
    place = "conv(hex(substr(key, 9, 7)), 16, 10)"
    rows = needed.selectExpr(f"cast({place} as bigint) as h").selectExpr(f"cast(h % {words} as int) as w", f"shiftleft(1L, cast((h div {words}) % 64 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(words, dtype=np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out


def in_filter(bitmap: np.ndarray, keys: list[bytes]) -> np.ndarray:
    h = np.array([int.from_bytes(k[8:15], "big") for k in keys], dtype=np.int64)
    return (bitmap[h % len(bitmap)] >> ((h // len(bitmap)) % 64)) & 1 > 0


def needed_sets(docs: DataFrame, bitmap: np.ndarray, settings: Settings) -> DataFrame:
    """(key, grams) of the texts whose key may be needed; a task sends a key
    once for as many keys as it can remember."""
    source = docs.select(common.text_bytes().alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at, end in textvec.cut(batch.column(0)):
                values, ends = ngram_sets(batch.column(0).slice(at, end - at), settings.ngram)
                keys = set_keys(values, ends)
                begin = np.concatenate([[0], ends[:-1]])
                got = []
                for k in np.flatnonzero(in_filter(bitmap, keys)):
                    if keys[k] not in seen:
                        seen.add(keys[k])
                        got.append(k)
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in got], pa.binary()), pa.array([values[begin[k] : ends[k]].tobytes() for k in got], pa.binary())], names=["key", "grams"])

    return common.mapped(source, run, "key binary, grams binary", rows_per_batch=4096)


def linked(grams: list[np.ndarray], side: np.ndarray | None, earlier: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which sets of a group are linked: at or above the threshold, on
    different sides where there are two, and in no earlier bucket together."""
    n = len(grams)
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    if n == 2:
        if len(np.intersect1d(earlier[0], earlier[1])):
            return np.zeros((2, 2), dtype=bool)
        common_n = np.array([[0, 1], [1, 0]]) * len(np.intersect1d(grams[0], grams[1], assume_unique=True))
    else:
        common_n = shared_counts(grams)
    union = sizes[:, None] + sizes[None] - common_n
    out = common_n * threshold.denominator >= union * threshold.numerator
    np.fill_diagonal(out, False)
    if side is not None:
        out &= side[:, None] != side[None]
    if n > 2 and out.any() and any(len(e) for e in earlier):
        out &= shared_counts(earlier) == 0
    return out


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the values
    that more than one set has."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    out = np.zeros((n, n), dtype=np.float64)
    if len(values):
        order = np.argsort(values)
        values, owner = values[order], owner[order]
        new = np.concatenate([[True], values[1:] != values[:-1]])
        number = np.cumsum(new) - 1
        many = np.bincount(number) > 1
        column = np.cumsum(many) - 1
        use = many[number]
        column, owner = column[number[use]], owner[use]
        for at in range(0, int(many.sum()), width):
            a, b = np.searchsorted(column, [at, at + width])
            x = np.zeros((n, width), dtype=np.float32)
            x[owner[a:b], column[a:b] - at] = 1
            out += x @ x.T
    return np.rint(out).astype(np.int64)


def roots(adjacent: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    out = np.arange(len(adjacent))
    done = np.zeros(len(adjacent), dtype=bool)
    for k in range(len(adjacent)):
        if done[k]:
            continue
        member = np.zeros(len(adjacent), dtype=bool)
        edge = member.copy()
        member[k] = edge[k] = True
        while edge.any():
            edge = adjacent[edge].any(axis=0) & ~member
            member |= edge
        out[member], done[member] = k, True
    return out


def verify(tasks: DataFrame, settings: Settings) -> DataFrame:
    """For each member with a link: key, n_links (documents), n_text_links
    (sets) and root, the least set it is connected to, in its task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        schema = pa.schema([("key", pa.binary()), ("n_links", pa.int64()), ("n_text_links", pa.int64()), ("root", pa.binary())])
        for group in common.groups_of(batches, ["bucket", "p", "q"]):
            if group.num_rows < 2:
                continue
            keys = group["key"].to_pylist()
            if len(keys) != len(set(keys)):
                raise AssertionError("a set came twice to a bucket")
            bucket, p, q = (group[c][0].as_py() for c in ("bucket", "p", "q"))
            grams = [np.frombuffer(x, dtype=np.uint64) for x in group["grams"].to_pylist()]
            earlier = [np.array([b for b in x if b < bucket], dtype=np.int64) for x in group["buckets"].to_pylist()]
            side = group["block"].to_numpy() == q if p != q else None
            adjacent = linked(grams, side, earlier, settings.threshold)
            if not adjacent.any():
                continue
            copies = group["copies"].to_numpy()
            root = roots(adjacent)
            for k in np.flatnonzero(adjacent.any(axis=1)):
                out.append((keys[k], int(copies[adjacent[k]].sum()), int(adjacent[k].sum()), keys[root[k]]))
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return tasks.mapInArrow(run, "key binary, n_links long, n_text_links long, root binary")


def connected(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): the least node of each
    component, by alternating large and small stars until nothing changes.
    Where that takes more than most_rounds, it is an error."""
    edges = common.materialize(edges.where("a <> b").distinct(), "cc")
    before = None
    for done in itertools.count():
        if done == most_rounds:
            raise RuntimeError(f"components are not settled after {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = common.materialize(small, "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def join(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, the table of sets): a set has key, rep (its least
    doc_id), copies, n_links, n_text_links, class_key and class_id."""
    rows = common.materialize(sketches(docs, settings), "sketches", texts=True)
    sets = common.materialize(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_ngrams").alias("n_ngrams"), F.first("bands").alias("bands")), "sets")
    in_bucket = bucket_rows(sets)
    shared = in_bucket.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"), F.sum("n_ngrams").alias("w")).where("n > 1")
    # of buckets with the same members one will do
    kept = common.materialize(shared.groupBy("n", "who").agg(F.min("bucket").alias("bucket"), F.first("w").alias("w")), "buckets")
    blocks = f"cast(ceil(greatest(n / {settings.block_sets}, w / {settings.block_ngrams})) as int)"
    members = in_bucket.join(kept.select("bucket", F.expr(blocks).alias("blocks")), "bucket").select("key", F.struct("bucket", "blocks").alias("b"))
    needed = common.materialize(members.groupBy("key").agg(F.sort_array(F.collect_list("b")).alias("b")).join(sets.select("key", "copies"), "key"), "needed")
    bitmap = needed_filter(needed, needed.count())
    grams = needed_sets(docs, bitmap, settings).groupBy("key").agg(F.first("grams").alias("grams"))
    block = F.expr("cast(pmod(xxhash64(key), b.blocks) as int)")
    tasks = (
        grams.join(needed.select("key", "copies", F.col("b.bucket").alias("buckets"), F.explode("b").alias("b")), "key")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.expr("sequence(0, b.blocks - 1)")))
        .select(F.col("b.bucket").alias("bucket"), F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "copies", "buckets", "grams")
    )
    dealt = tasks.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "key")
    links = common.materialize(verify(dealt, settings), "links", texts=True)
    roots_of = connected(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("n_links").alias("n_links"), F.sum("n_text_links").alias("n_text_links"))
    out = sets.select("key", "rep", "copies").join(counts, "key", "left").join(roots_of.withColumnRenamed("node", "key"), "key", "left")
    out = out.select("key", "rep", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), "copies", F.coalesce("root", "key").alias("class_key"))
    out = common.materialize(out, "set-classes")
    ids = out.groupBy("class_key").agg(F.min("rep").alias("class_id"))
    return rows, out.join(ids, "class_key")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of all that
    links lead to), copy_of (the least doc_id with the same n-gram set),
    n_copies (rows with that set), n_links (other rows at or above the
    threshold) and n_text_links (other sets at or above it).

    Texts without words, null or empty, are copies of each other; texts of any
    length are compared whole.  N-grams are compared by 64-bit hashes.  Rows that
    repeat are copies.  A null doc_id takes part; an id that stands for a class
    is null only if all ids of the class are.  An empty table gives no rows;
    other columns are ignored.
    """
    rows, sets = join(docs, settings)
    return rows.select("doc_id", "key").join(sets, "key").select("doc_id", "class_id", F.col("rep").alias("copy_of"), F.col("copies").alias("n_copies"), "n_links", "n_text_links")


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class, the least by doc_id (nulls last) and text digest,
    with all columns of docs, whatever their names.

    Texts without words, null or empty, are one class; texts of any length are
    compared whole.  Of rows that repeat one is kept.  An empty table gives no
    rows.
    """
    rows, sets = join(docs, settings)
    least = rows.join(sets.select("key", "class_key"), "key").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k"))
    own, other = common.free_name(docs, "own"), common.free_name(docs, "keep")
    keep = least.select(F.struct("k.doc_id", "k.digest").alias(other))
    repeated = rows.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count()
    marked = docs.withColumn(own, F.struct("doc_id", F.md5(common.text_bytes()).alias("digest")))
    out = marked.join(keep, F.col(f"{own}.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col(f"{own}.digest") == F.col(f"{other}.digest")), "left_semi")
    if repeated:
        out = out.dropDuplicates([own])
    return out.drop(own)
