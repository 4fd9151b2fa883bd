"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the
words that it has, a document's is their noisy-or: 1 - prod(1 - p).  Weights
are learned from document labels alone, and the sentences with a high p are
the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common, textvec
from .textvec import U

#: Between words: every ASCII byte but letters and digits.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[c for c in range(128) if not chr(c).isalnum()]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n")] = True
_HEAD = np.ones(256, dtype=bool)
_HEAD[0x80:0xC0] = False


#: Bytes of the beginnings of words that are looked at beside whole words.
STEMS = (4, 5, 6, 7, 8)


@dataclass
class Model:
    words: np.ndarray  #: hashes of words and beginnings with a weight, ascending
    weights: np.ndarray
    bias: float

    def sentences(self, w: textvec.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, document, probability) of each sentence with words."""
        first, doc = sentences_of(w)
        if not len(first):
            return first, doc, np.zeros(0)
        z = np.full(len(first), self.bias)
        for hashes, sentence, _ in features(w, first):
            at, hit = found(self.words, hashes)
            z += np.bincount(sentence[hit], weights=self.weights[at[hit]], minlength=len(first))
        return first, doc, 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def found(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and where the value is really there."""
    if not len(sorted_values):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return at, sorted_values[at] == values


def features(w: textvec.Words, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, sentence, document) of whole words, then of beginnings."""
    mark = np.zeros(len(w.hash), dtype=np.int64)
    mark[first] = 1
    sentence = np.cumsum(mark) - 1
    yield w.hash, sentence, w.doc
    for n in STEMS:
        h, word = w.prefixes(n)
        yield textvec.mix(h + U(n)), sentence[word], w.doc[word]


def sentences_of(w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of the sentences that have words, and their documents."""
    if not len(w.start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    stops = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(_STOP[w.data], out=stops[1:])
    number = stops[w.start]
    new = np.ones(len(number), dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    return first, w.doc[first]


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def train(feature: np.ndarray, sentence: np.ndarray, sentence_doc: np.ndarray, label: np.ndarray, size: int, share: float = 0.5, steps: int = 400, rate: float = 0.15, l1: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) from the labels of documents.

    feature, sentence: where each feature occurs; sentence_doc: document of
    each sentence; share: weight of all toxic documents.  Adam, with weights drawn to zero by l1, so that features
    which explain nothing beyond others keep none.
    """
    n, toxic, n_sentences = len(label), label > 0, len(sentence_doc)
    x = np.concatenate([np.zeros(size), [-6.0]])
    m, u = np.zeros(size + 1), np.zeros(size + 1)
    weight = np.where(toxic, share / max(1, toxic.sum()), (1 - share) / max(1, (~toxic).sum()))
    for step in range(1, steps + 1):
        z = np.bincount(sentence, weights=x[feature], minlength=n_sentences) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(sentence_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
        q = np.maximum(-np.expm1(log_clean), 1e-9)
        # d loss / d z of a sentence: p for a clean document, -p (1-q)/q for a toxic one
        outer = np.where(toxic, -np.exp(log_clean) / q, 1.0) * weight
        g = outer[sentence_doc] * p
        grad = np.concatenate([np.bincount(feature, weights=g[sentence], minlength=size), [g.sum()]])
        grad[:-1] += l1 * (x[:-1] > 0)
        m, u = 0.9 * m + 0.1 * grad, 0.99 * u + 0.01 * grad * grad
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8)
        x[:-1] = np.maximum(x[:-1], 0)
    return x[:-1], float(x[-1])


def sampled_labels(labels: DataFrame, most_each: int) -> tuple[DataFrame, float]:
    """At most so many toxic and as many clean doc_ids, the first by a hash, of
    the rows that may be learned from: crc32(doc_id) mod 5 is not 0; and the
    share of toxic ones among all of those."""
    free = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in free.groupBy("toxic").count().collect()}
    first = lambda t: common.sample_of(free.where(F.col("toxic") == t), "doc_id", most_each, total.get(t, 0))
    return first(1).unionAll(first(0)), total.get(1, 0) / max(1, sum(total.values()))


def fit(docs: DataFrame, labels: DataFrame, most_each: int = 2500, least_docs: int = 4, ratio: float = 4.0, tilt: float = 2.0) -> Model:
    """A model from at most most_each toxic and as many clean labelled
    documents.  Features that least_docs toxic documents have, at ratio times
    the rate of the clean ones, are candidates; where they occur is gathered on
    the driver and weighed there, toxic documents tilt times as much as their share."""
    empty = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -20.0)
    sample, share = sampled_labels(labels, most_each)
    chosen = common.materialize(docs.select("doc_id", common.text_bytes().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text"), "toxic-sample")
    size = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if not size.get(1):
        return empty

    def occurrences(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for at, end in textvec.cut(batch.column(2)):
                w = textvec.words_of(batch.column(2).slice(at, end - at), space=_BETWEEN)
                for hashes, _, doc in features(w, sentences_of(w)[0]):
                    order = np.lexsort((doc, hashes))
                    h, d = hashes[order], doc[order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    h, t = h[new], toxic[at:end][d[new]]
                    values, where = np.unique(h, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.bincount(where, weights=t, minlength=len(values)).astype(np.int64)), pa.array(np.bincount(where, minlength=len(values)).astype(np.int64))], names=["feature", "n_toxic", "n_all"])

    counts = common.mapped(chosen, occurrences, "feature long, n_toxic long, n_all long", 4096).groupBy("feature").agg(F.sum("n_toxic").alias("t"), F.sum("n_all").alias("n"))
    rate = f"t / {size[1]} > {ratio} * (n - t) / {max(1, size.get(0, 0))}"
    vocabulary = np.sort(counts.where(f"t >= {least_docs} and {rate}").select("feature").toPandas()["feature"].to_numpy(dtype=np.int64).view(np.uint64))
    if not len(vocabulary):
        return empty

    def places(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in textvec.cut(batch.column(2)):
                w = textvec.words_of(batch.column(2).slice(at, end - at), space=_BETWEEN)
                first, doc = sentences_of(w)
                n = np.bincount(doc, minlength=w.n_docs)
                begin = np.concatenate([[0], np.cumsum(n)])
                got: list[list[np.ndarray]] = [[] for _ in range(w.n_docs)]
                for hashes, sentence, where in features(w, first):
                    k, hit = found(vocabulary, hashes)
                    k, sentence, where = k[hit], sentence[hit], where[hit]
                    for d in np.unique(where):
                        a, b = np.searchsorted(where, [d, d + 1])
                        got[d].append(np.column_stack([k[a:b], sentence[a:b] - begin[d]]))
                rows = [np.concatenate(x).astype(np.int32).tobytes() if x else b"" for x in got]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at).cast(pa.int64()), batch.column(1).slice(at, end - at).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "n_sentences", "places"])

    got = common.mapped(chosen, places, "doc_id long, toxic long, n_sentences long, places binary", 4096).toArrow().sort_by([("doc_id", "ascending"), ("places", "ascending")])
    n = got["n_sentences"].to_numpy()
    begin = np.concatenate([[0], np.cumsum(n)])
    parts = [np.frombuffer(x, dtype=np.int32).reshape(-1, 2).astype(np.int64) + [0, b] for x, b in zip(got["places"].to_pylist(), begin)]
    where = np.concatenate(parts)
    weights, bias = train(where[:, 0], where[:, 1], np.repeat(np.arange(len(n)), n), got["toxic"].to_numpy(), len(vocabulary), min(0.5, tilt * share))
    strong = weights > 0.05
    return Model(vocabulary[strong], weights[strong], bias)


def score_batch(model: Model, texts: pa.Array, least: float = 0.5):
    """(score, number of sentences, offending spans) of each text; a span is
    the place in characters and the probability."""
    w = textvec.words_of(texts, space=_BETWEEN)
    first, doc, p = model.sentences(w)
    score = np.clip(noisy_or(p, doc, w.n_docs), 0.0, 1.0)
    spans: list[list[dict]] = [[] for _ in range(w.n_docs)]
    last = np.concatenate([first[1:], [len(w.hash)]]) - 1 if len(first) else first
    for k in np.flatnonzero(p >= least):
        a, b, d = int(w.start[first[k]]), int(w.end[last[k]]), int(doc[k])
        begin = int(_HEAD[w.data[w.offsets[d] : a]].sum())
        spans[d].append({"start": begin, "end": begin + int(_HEAD[w.data[a:b]].sum()), "p": float(p[k])})
    return score, np.bincount(doc, minlength=w.n_docs), spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def toxicity(docs: DataFrame, labels: DataFrame, **knobs) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, the number
    of sentences and the offending ones as spans of characters.

    A null or empty text has no sentence and scores 0; texts of any length are
    scored whole.  Repeated rows give
    repeated rows.  A null doc_id is held out of nothing and never learned
    from.  Without toxic labels every score is near 0.  Other columns, of
    whatever name, are ignored.
    """
    model = fit(docs, labels, **knobs)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in textvec.cut(batch.column(2)):
                score, n, spans = score_batch(model, batch.column(2).slice(at, end - at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n, pa.int64()), pa.array(spans, _SPANS)], names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    source = docs.select("doc_id", held.alias("held_out"), common.text_bytes().alias("text"))
    return common.mapped(source, run, "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending array<struct<start:long,end:long,p:double>>", rows_per_batch=4096)


def keep_clean(docs: DataFrame, labels: DataFrame, **knobs) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns,
    whatever their names.  A null or empty text is clean; repeated rows are
    judged each; texts of any length are judged whole.  An empty table gives no
    rows, and without toxic labels all rows stay."""
    model = fit(docs, labels, **knobs)
    where = docs.schema.fieldNames().index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.fill_null(batch.column(where).cast(pa.binary()), b"")
            for at, end in textvec.cut(raw):
                w = textvec.words_of(raw.slice(at, end - at), space=_BETWEEN)
                _, doc, p = model.sentences(w)
                yield batch.slice(at, end - at).filter(pa.array(noisy_or(p, doc, w.n_docs) < 0.5))

    return common.mapped(docs, run, docs.schema, rows_per_batch=4096)
