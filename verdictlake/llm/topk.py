"""Exact top-k by inner product with a pivot table.

Vectors are integers, floor(256 * x).  Distances of every vector to many pivots
are computed once and stored.  Together they place a vector in the space that
the pivots span, but for the length of what stands upright on it; so the
greatest lower bound that they allow for a distance is that of the two places
and lengths, and an inner product is at most that of the places plus the
product of the lengths.  A query takes the candidates of a slab in the order of
that bound and stops once its k-th score, which it brings along from earlier
slabs and from a sample, is above all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from . import common

SCALE = 256
_STEP = 64  #: candidates evaluated between two looks at the bound
_LOW = -(2**63)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    finite = f"embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and {SCALE} * abs(double(x)) < double('Infinity'))"
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(finite)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of integers in doubles; short ones end in zeros."""
    offsets = column.offsets.to_numpy()
    values = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for k, (at, n) in enumerate(zip(offsets, sizes)):
        out[k, : min(n, width)] = values[at : at + min(n, width)]
    return out


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with q; doubles where they are exact."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if top < 2.0**53:
        return (x @ q).astype(np.int64)
    whole = [[int(v) for v in row] for row in x]
    other = [int(v) for v in q]
    most = 2**63 - 1
    return np.array([max(-most, min(most, sum(a * b for a, b in zip(row, other)))) for row in whole], dtype=np.int64)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next pivot is the farthest from those
    before it."""
    if not len(sample):
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


@dataclass
class PivotSpace:
    """The space that pivots span: from distances to places in it."""

    norms: np.ndarray  #: squared, of the pivots
    turn: np.ndarray  #: inner products with the pivots -> orthonormal places

    @classmethod
    def of(cls, pivots: np.ndarray) -> PivotSpace:
        if not pivots.size:
            return cls(np.zeros(len(pivots)), np.zeros((len(pivots), 0)))
        u, s, _ = np.linalg.svd(pivots, full_matrices=False)
        use = s > max(1e-6 * s[0], 1e-300)
        return cls((pivots * pivots).sum(1), u[:, use] / s[use])

    def places(self, x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, lengths upright on them, lengths) of vectors by their
        distances d to the pivots."""
        square = (x * x).sum(1)
        at = (square[:, None] + self.norms[None] - d * d) / 2 @ self.turn
        return at, np.sqrt(np.maximum(square - (at * at).sum(1), 0)), np.sqrt(square)


@dataclass
class Best:
    """The k best of a block of queries so far; least: a score that k
    candidates are known to reach, where one is known."""

    k: int
    least: np.ndarray
    scores: list[np.ndarray]
    ids: list[np.ndarray]

    @classmethod
    def of(cls, least: np.ndarray, k: int) -> Best:
        return cls(k, least.astype(np.float64), [np.zeros(0, np.int64)] * len(least), [np.zeros(0, np.int64)] * len(least))

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[top], ids[top]
        if len(top) == self.k:
            self.least[q] = max(self.least[q], float(scores[top[-1]]))


def search_slab(ids: np.ndarray, x: np.ndarray, placed: tuple, query_ids: np.ndarray, q: np.ndarray, q_placed: tuple, best: Best, lines: int = 256) -> int:
    """Bring the best of a block of queries up to date with a slab of
    candidates; how many pairs were evaluated."""
    evaluated = 0
    for at in range(0, len(query_ids), lines):
        part = slice(at, at + lines)
        with np.errstate(over="ignore", invalid="ignore"):
            upper = q_placed[0][part] @ placed[0].T + q_placed[1][part, None] * placed[1][None]
            # places are rounded: leave a margin far above their error
            upper += 1e-6 * q_placed[2][part, None] * placed[2][None] + 1
        upper[np.isnan(upper)] = np.inf
        upper[query_ids[part, None] == ids[None]] = -np.inf
        for k in range(len(upper)):
            line, n = upper[k], at + k
            left = np.flatnonzero((line >= best.least[n]) & (line > -np.inf))
            left = left[np.argsort(-line[left], kind="stable")]
            for i in range(0, len(left), _STEP):
                some = left[i : i + _STEP]
                some = some[line[some] >= best.least[n]]
                if not len(some):
                    break
                evaluated += len(some)
                best.add(n, exact_scores(x[some], q[n]), ids[some])
    return evaluated


def _rows(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(n, -1)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, n_pivots: int = 48, pivot_sample: int = 4096, query_block: int = 8192, slab_rows: int = 32_768) -> DataFrame:
    """The k best vec_ids of each query by integer inner product, ties to the
    smaller vec_id: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates all
    rows but those with the query's vec_id.  Vectors that are null or hold null
    or non-finite components, or such as 256 times which is not finite, take no
    part; scores beyond a long are its ends.  Vectors of different lengths
    compare as if the shorter ended in zeros.  Of query rows with one vec_id
    the smallest vector asks; repeated candidates are each listed.  An empty
    table gives no rows; other columns are ignored.

    Pivots, and the first score that a query must beat, come from a sample of
    at most pivot_sample rows; the table of distances covers all rows.  Queries
    are files of at most query_block rows in the shared folder: a task reads
    them one after the other for each slab of its candidates, so neither the
    driver nor a broadcast holds them.
    """
    spark = vectors.sparkSession
    good = usable(vectors)
    facts = good.agg(F.max(F.size("embedding")).alias("width"), F.count_if(F.expr(f"vec_id % {every} = 0")).alias("n"), F.count("*").alias("rows")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    width = max(1, facts["width"] or 0)
    drawn = common.sample_of(good, "vec_id", pivot_sample, facts["rows"]).toArrow().combine_chunks()
    sample = matrix(drawn["embedding"].combine_chunks(), width)
    sample_ids = drawn["vec_id"].to_numpy()
    pivots = choose_pivots(sample, n_pivots)
    space = PivotSpace.of(pivots)

    def measured(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), width)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel())) for y in (x, distances(x, pivots))]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *lists], names=["vec_id", "x", "d"])

    stored = common.materialize(good.mapInArrow(measured, "vec_id long, x array<double>, d array<double>"), "pivot-table")

    def begun(batches) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th best score among the sample, the row's own left out."""
        for batch in batches:
            ids, least = batch.column(0).to_numpy(), []
            for qid, v in zip(ids, _rows(batch.column(1), len(ids))):
                scores = np.sort(exact_scores(sample[sample_ids != qid], v))
                least.append(int(scores[-k]) if len(scores) >= k else _LOW)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["vec_id", "x", "d", "least"])

    asked = stored.where(F.expr(f"vec_id % {every} = 0")).groupBy("vec_id").agg(F.min(F.struct("x", "d")).alias("v")).select("vec_id", "v.x", "v.d")
    folder = common.work_path(spark, "queries")
    asked.mapInArrow(begun, "vec_id long, x array<double>, d array<double>, least long").write.option("maxRecordsPerFile", query_block).parquet(folder)

    def search(batches) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, base = common.arrow_fs(folder)
        files = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(base)) if i.base_name.startswith("part-"))
        known: dict[str, np.ndarray] = {}  # a query's least score, from slab to slab
        for slab in common.slabs_of(batches, slab_rows):
            n = slab.num_rows
            ids, x = slab["vec_id"].to_numpy(), _rows(slab["x"], n)
            placed = space.places(x, _rows(slab["d"], n))
            for path in files:
                with fs.open_input_file(path) as f:
                    t = pq.read_table(f)
                if not t.num_rows:
                    continue
                q = _rows(t["x"], t.num_rows)
                query_ids = t["vec_id"].to_numpy()
                best = Best.of(known.get(path, t["least"].to_numpy()), k)
                search_slab(ids, x, placed, query_ids, q, space.places(q, _rows(t["d"], t.num_rows)), best)
                known[path] = best.least
                sizes = [len(s) for s in best.scores]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, sizes), pa.int64()), pa.array(np.concatenate(best.ids), pa.int64()), pa.array(np.concatenate(best.scores), pa.int64())], names=["query_id", "vec_id", "score"])

    found = stored.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
