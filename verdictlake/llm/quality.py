"""Quality rules: statistics of whole texts, fixed limits on two of them, and
an isolation forest over all, with a threshold calibrated from labelled rows.

A tree of the forest splits a few statistics of a sample of rows at random
places; a row that is alone after few splits is unlike the rest.  The score is
2^(-mean path length / expected length), near 1 for the odd ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, textvec
from .textvec import U

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest looks at: rates, so that long and short texts compare.
RATES = ["symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "word_length", "long_words", "stutter_rate", "top_word_rate", "markless_words"]
STATS = ", ".join([f"{x} long" for x in BASE] + [f"{x} double" for x in RATES])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_SYMBOL = _table(b"#*$%&|<>")
_MARK = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_HEAD = np.ones(256, dtype=bool)
_HEAD[0x80:0xC0] = False  # not the first byte of a character
_LINE = _table(b"\n")
WINDOW = 8


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of a binary array."""
    w = textvec.words_of(texts, fold=False)
    n, doc, size = w.n_docs, w.doc, len(w.hash)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[w.offsets[1:]] - total[w.offsets[:-1]]

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flags], minlength=n).astype(np.int64)

    n_words = np.diff(w.first)
    word_chars = per_doc(_HEAD[w.data] & ~textvec.SPACE[w.data])
    # lines with a word, and those that differ
    lines = textvec.words_of(texts, fold=False, space=_LINE)
    real = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    with np.errstate(over="ignore"):
        keys = textvec.mix(lines.hash + lines.doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        _, where = np.unique(np.where(real, keys, U(0)), return_index=True)
    n_lines = np.bincount(lines.doc[real], minlength=n)
    where = where[real[where]] if len(real) else where
    n_dup = n_lines - np.bincount(lines.doc[where], minlength=n)
    # words in windows that occur twice
    covered = np.zeros(size, dtype=bool)
    m = max(0, size - WINDOW + 1)
    inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :]) if m else np.zeros(0, dtype=np.int64)
    if len(inside):
        with np.errstate(over="ignore"):
            run = np.zeros(m, dtype=np.uint64)
            for k in range(WINDOW):
                run = run * U(0xD6E8FEB86659FD93) + w.hash[k : k + m]
            run = textvec.mix(run[inside] + doc[inside].astype(np.uint64) * U(0xA0761D6478BD642F))
        order = np.argsort(run)
        same = run[order][1:] == run[order][:-1]
        twice = np.zeros(len(run), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        steps = np.zeros(size + 1, dtype=np.int64)
        np.add.at(steps, inside[twice], 1)
        np.add.at(steps, inside[twice] + WINDOW, -1)
        covered = np.cumsum(steps[:-1]) > 0
    n_repeat = of_words(covered)
    # the commonest word of a text
    with np.errstate(over="ignore"):
        keys = np.sort(textvec.mix(w.hash) & ~U(0xFFFFF) | (doc.astype(np.uint64) & U(0xFFFFF)))
    top = np.zeros(n, dtype=np.int64)
    if size:
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [size]])
        np.maximum.at(top, (keys[edges[:-1]] & U(0xFFFFF)).astype(np.int64), np.diff(edges))
    again = np.zeros(size, dtype=bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    length = w.end - w.start
    marks = _MARK[w.data]
    chars, words = np.maximum(word_chars, 1), np.maximum(n_words, 1)
    n_symbols = per_doc(_SYMBOL[w.data])
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "symbol_rate": n_symbols / chars, "dup_line_rate": n_dup / np.maximum(n_lines, 1), "repeat_rate": n_repeat / words, "upper_rate": per_doc(_UPPER[w.data]) / chars, "digit_rate": per_doc(_DIGIT[w.data]) / chars, "mark_rate": per_doc(marks) / chars, "word_length": word_chars / words, "long_words": of_words(length > 24) / words, "stutter_rate": of_words(again) / words, "top_word_rate": top / words, "markless_words": of_words(~marks[w.end - 1]) / words if size else np.zeros(n),
    }


def base_failed(n_words, n_repeat_words):
    """The fixed rules, on arrays or columns."""
    return (n_words < 20) | (n_repeat_words * 100 > n_words * 30)


class IsolationForest:
    """Trees as arrays, so that many rows walk down at once."""

    def __init__(self, rows: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.sample = max(2, min(sample, len(rows)))
        self.depth = int(np.ceil(np.log2(self.sample)))
        self.trees = [self._tree(rows[rng.choice(len(rows), self.sample, replace=False)] if len(rows) > 1 else np.zeros((2, rows.shape[1])), rng) for _ in range(trees)]

    @staticmethod
    def expected(n) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, dtype=np.float64)
        m = np.maximum(n, 2)
        return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))

    def _tree(self, rows: np.ndarray, rng):
        feature, place, child, length = [], [], [], []

        def grow(part: np.ndarray, depth: int) -> int:
            me = len(feature)
            for x, v in ((feature, 0), (place, 0.0), (child, [me, me]), (length, depth + float(self.expected(len(part))))):
                x.append(v)
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 and depth < self.depth else []
            if len(spread):
                f = int(rng.choice(spread))
                at = rng.uniform(part[:, f].min(), part[:, f].max())
                feature[me], place[me] = f, at
                child[me] = [grow(part[part[:, f] < at], depth + 1), grow(part[part[:, f] >= at], depth + 1)]
            return me

        grow(rows, 0)
        return np.array(feature), np.array(place), np.array(child), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, place, child, length in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                at = child[at, (rows[every, feature[at]] >= place[at]).astype(np.int64)]
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(float(self.expected(self.sample)), 1e-9))


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Statistics of every row: the kept columns, then those of STATS."""
    keep = keep or ["doc_id"]
    source = docs.select(*keep, common.text_bytes().alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for at, end in textvec.cut(texts):
                got = statistics(texts.slice(at, end - at))
                columns = [batch.column(k).slice(at, end - at) for k in range(len(keep))] + [pa.array(got[x], pa.int64()) for x in BASE] + [pa.array(got[x], pa.float64()) for x in RATES]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *BASE, *RATES])

    return common.mapped(source, run, f"{types}, {STATS}", rows_per_batch=4096)


def fit(measured: DataFrame, labels: DataFrame, most_rows: int = 20_000, odd_share: float = 0.015, least_odd: int = 4, good_lost: float = 0.003, candidates: int = 4, bins: int = 2000) -> tuple[IsolationForest, float]:
    """(forest, threshold) from labels (doc_id, quality).

    The forest is fitted on at most most_rows labelled rows, the first by a
    hash of doc_id: good ones, and as odd_share of them, but at least least_odd,
    bad ones, so that the odd kinds are there but rare.  The threshold is the least score, in steps
    of 1/bins, above which at most good_lost of all good rows lie; all labelled
    rows count.  Of `candidates` forests with other bad rows that which finds
    most bad rows is kept.  Where no row is labelled good, nothing is odd.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = common.materialize(measured.join(marks, "doc_id").where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("doc_id", "quality", *RATES), "labelled")
    total = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    first = lambda q, n: common.sample_of(known.where(F.col("quality") == q), "doc_id", n, total.get(q, 0)).select(*RATES).toPandas().to_numpy(dtype=np.float64)
    good = first(1, most_rows)
    if not len(good):
        return IsolationForest(np.zeros((2, len(RATES)))), 2.0
    n_odd = max(least_odd, int(len(good) * odd_share))
    bad = first(0, n_odd * candidates)
    forests = [IsolationForest(np.concatenate([good, bad[k::candidates]]), seed=7 + k) for k in range(candidates)]

    def scored(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(RATES))])
            for k, forest in enumerate(forests):
                place = pa.array(np.floor(forest.score(rows) * bins).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k), pa.int64()), batch.column(0).cast(pa.int64()), place], names=["forest", "quality", "bin"])

    counts = known.where("quality in (0, 1)").select("quality", *RATES).mapInArrow(scored, "forest long, quality long, bin long").groupBy("forest", "quality", "bin").count().toPandas()
    best = (-1.0, forests[0], 2.0)
    for k, forest in enumerate(forests):
        line = np.zeros((2, bins + 2))
        own = counts[counts["forest"] == k]
        line[own["quality"].to_numpy(), own["bin"].to_numpy()] = own["count"]
        above = line[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows at or above a bin
        at = int(np.flatnonzero(above[1] <= good_lost * line[1].sum())[0])
        if above[0][at] > best[0]:
            best = (above[0][at], forest, at / bins)
    return best[1], best[2]


def verdicts(measured: DataFrame, forest: IsolationForest, threshold: float) -> DataFrame:
    """The base columns, base_failed, anomaly and kept of measured rows."""
    names = ["doc_id", *BASE]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {x: batch.column(k).to_numpy(zero_copy_only=False) for k, x in enumerate([*names, *RATES]) if k}
            failed = base_failed(got["n_words"], got["n_repeat_words"])
            score = forest.score(np.column_stack([got[x] for x in RATES]))
            columns = [batch.column(k) for k in range(len(names))] + [pa.array(failed), pa.array(score), pa.array(~failed & (score < threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "base_failed", "anomaly", "kept"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, anomaly double, kept boolean"
    return measured.select(*names, *RATES).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with its statistics and verdict.

    A null or empty text has no words and fails; texts of any length are
    measured whole.  Repeated rows give repeated
    rows; rows with a null doc_id are judged but never labelled.  Empty tables
    give no rows.  Other columns, of whatever name, are ignored.
    """
    measured = common.materialize(measure(docs), "measured", texts=True)
    return verdicts(measured, *fit(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their
    names.  Null, empty and very short texts go; repeated rows are judged each;
    texts of any length are measured whole.  An empty table gives no rows.

    A row's verdict depends on its text alone, so the second pass judges and
    filters where the row is, without a shuffle of texts.
    """
    forest, threshold = fit(common.materialize(measure(docs), "measured", texts=True), labels)
    schema = docs.schema
    where = schema.fieldNames().index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(where).cast(pa.binary()).fill_null(b"")
            for at, end in textvec.cut(raw):
                got = statistics(raw.slice(at, end - at))
                score = forest.score(np.column_stack([got[x] for x in RATES]))
                kept = ~base_failed(got["n_words"], got["n_repeat_words"]) & (score < threshold)
                yield batch.slice(at, end - at).filter(pa.array(kept))

    return common.mapped(docs, run, schema, rows_per_batch=4096)
