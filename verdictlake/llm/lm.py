"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels, 1 + floor(log_b c), and
an n-gram of level j is put into the filter as (n-gram, 1) .. (n-gram, j).  A
count is read back by probing one level after another until one is missing.
The filter is built in blocks, each by the task that has all counts of a range
of hashes, with so many bits for each entry, so that it grows with the corpus
and false positives stay as rare.  No process holds more than a block: texts
are cut into chunks, each chunk's n-grams go to their blocks with their counts,
and the levels read there come back to the chunk.

The model interpolates: P(w|h) = max(c(h,w)-D, 0)/c(h) + backoff(h) * P(w), with
an absolute discount D, and P(w) likewise with the mass of the words seen once
for unknown words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from . import common, textvec
from .textvec import U

#: Hash of the end of a text, counted as a token.
END = int(textvec.mix(np.array([0x656E64], dtype=np.uint64))[0])
_PAIR = U(0xC2B2AE3D27D4EB4F)
_FOLLOW = U(0x165667B19E3779F9)
#: Separates the counts of words, pairs and distinct followers in one filter.
_SALT = (U(0x1B873593), U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25))


@dataclass(frozen=True)
class Settings:
    base: float = 1.5  #: of the levels' logarithm
    probes: int = 4  #: bits of an entry
    bits_per_entry: float = 6.0  #: about probes / ln 2: half of the bits are set
    common_words: int = 1 << 21  #: words whose exact counts are broadcast
    discount: float = 0.9
    block_rows: int = 2_000_000  #: n-gram occurrences of a block, about


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray, base: float) -> np.ndarray:
    """A count for each level: the middle of its range; 0 for level 0."""
    low = base ** (np.maximum(levels, 1) - 1.0)
    whole = np.ceil(low - 1e-9)
    high = np.maximum(whole, np.ceil(low * base - 1e-9) - 1)
    return np.where(levels > 0, (whole + high) / 2, 0.0)


def _bits(hashes: np.ndarray, level: int, k: int, n_bits) -> np.ndarray:
    step = U((level * 0xA24BAED4963EE407 + k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        h = textvec.mix(hashes + step)
        # the high 32 bits, scaled, so that any size below 2^32 will do
        return ((h >> U(32)) * np.asarray(n_bits, dtype=np.uint64)) >> U(32)


def build_block(hashes: np.ndarray, counts: np.ndarray, settings: Settings) -> tuple[bytes, int, int]:
    """(bytes, number of bits, highest level) of a block that holds n-grams
    with their counts."""
    levels = level_of(counts, settings.base)
    n_bits = max(64, int(settings.bits_per_entry * float(levels.sum())))
    if n_bits >= 2**32:
        raise ValueError("a block of more than 2^32 bits: block_rows is too large")
    filled = np.zeros(n_bits, dtype=bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        part = hashes[levels >= j]
        for k in range(settings.probes):
            filled[_bits(part, j, k, n_bits)] = True
    return np.packbits(filled, bitorder="little").tobytes(), n_bits, int(levels.max(initial=0))


@dataclass
class LogFrequencyBloom:
    """A block's bits, their number, and the highest level put into it."""

    bits: np.ndarray
    n_bits: int
    top: int
    settings: Settings

    @classmethod
    def of(cls, block: tuple[bytes, int, int], settings: Settings) -> LogFrequencyBloom:
        return cls(np.frombuffer(block[0], dtype=np.uint8), block[1], block[2], settings)

    def levels(self, hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
        """Levels are probed until one is missing, or the highest is there."""
        out = np.zeros(len(hashes), dtype=np.int64)
        left, h = np.arange(len(hashes)), hashes ^ salt
        for level in range(1, self.top + 1):
            for k in range(self.settings.probes):
                at = _bits(h, level, k, self.n_bits)
                there = (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
                left, h = left[there], h[there]
            if not len(left):
                break
            out[left] = level
        return out

    def counts(self, hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
        """Quantised counts."""
        return count_of(self.levels(hashes, salt), self.settings.base)


def block_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((textvec.mix(hashes ^ U(0x5851F42D4C957F2D)) >> U(32)) * U(n) >> U(32)).astype(np.int64)


def tokens(w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every token, each text's end after its words."""
    n = len(w.hash)
    ends = w.first[1:] + np.arange(w.n_docs)
    h = np.empty(n + w.n_docs, dtype=np.uint64)
    doc = np.empty(n + w.n_docs, dtype=np.int64)
    is_end = np.zeros(len(h), dtype=bool)
    is_end[ends] = True
    h[is_end], h[~is_end] = U(END), w.hash
    doc[is_end], doc[~is_end] = np.arange(w.n_docs), w.doc
    return h, doc


def pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each pair, hash of its history): a key's high half stands for
    the history, so that pairs of one history can be told from the keys.  A
    text's first token follows the end mark."""
    before = np.empty_like(h)
    if len(h):
        before[0] = U(END)
        before[1:] = np.where(doc[1:] == doc[:-1], h[:-1], U(END))
    with np.errstate(over="ignore"):
        low = textvec.mix(before * _PAIR + h) >> U(32)
    return (history(before) << U(32)) | low, before


def history(before: np.ndarray) -> np.ndarray:
    return textvec.mix(before ^ _FOLLOW) >> U(32)


def _unique_counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    return h[new], np.diff(np.concatenate([new, [len(h)]]))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    order = np.argsort(h)
    h, c = h[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    return h[new], np.add.reduceat(c, new, dtype=np.int64) if len(new) else c.astype(np.int64)


_PACKED_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_PACKED = "chunk long, kind int, block int, hashes binary, counts binary"
#: ASK: histories whose followers a chunk asks for.  SEEN + kind: levels read.
WORD, PAIR, FOLLOW, ASK, SEEN = 0, 1, 2, 3, 10


def deal(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, list[int], list[int]]:
    """(order of hashes by block, blocks that get some, where each one's begin
    and the last end): as many as there are hashes, at most."""
    where = block_of(h, n_blocks)
    order = np.argsort(where, kind="stable")
    used, begin = np.unique(where[order], return_index=True)
    return order, used.tolist(), [*begin.tolist(), len(h)]


def pack(kind: int, h: np.ndarray, c: np.ndarray, n_blocks: int, chunk: int = -1) -> pa.RecordBatch:
    """Counts by hash, dealt to blocks: one row for each block that gets any."""
    order, used, ends = deal(h, n_blocks)
    cut = [order[a:b] for a, b in zip(ends, ends[1:])]
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(used), pa.int64()), pa.array([kind] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([h[i].tobytes() for i in cut], pa.binary()), pa.array([c[i].astype("<u4").tobytes() for i in cut], pa.binary())], schema=_PACKED_ARROW)


def unpack(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of one kind, summed by hash."""
    rows = zip(table["kind"].to_pylist(), table["hashes"], table["counts"])
    parts = [(np.frombuffer(h.as_buffer(), dtype="<u8"), np.frombuffer(c.as_buffer(), dtype="<u4")) for k, h, c in rows if k == kind]
    return _merge(parts or [(np.zeros(0, np.uint64), np.zeros(0, np.uint32))])


def answers(table: pa.Table, kind: int, seen: int, values: np.ndarray, levels: np.ndarray) -> pa.RecordBatch:
    """For each row of a kind the levels of its hashes, as bytes."""
    rows = [(c, b, levels[np.searchsorted(values, np.frombuffer(h.as_buffer(), dtype="<u8"))].astype(np.uint8).tobytes()) for c, k, b, h in zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["block"].to_pylist(), table["hashes"]) if k == kind]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([SEEN + seen] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.nulls(len(rows), pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=_PACKED_ARROW)


_CHUNK = "chunk long, path string, place int, learned long"
_CHUNK_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("words", pa.binary()), ("places", pa.binary()), ("learned", pa.int64())])


def chunks_of(source: DataFrame, chunk_tokens: int = 2_000_000) -> DataFrame:
    """Rows (doc_id, held_out, text as bytes) in chunks of about so many tokens:
    the chunk's distinct words ascending, the places of its tokens among them,
    and each document's number of tokens.

    The workers write and read the chunks in the shared folder.  The table says
    where each one lies, and how many of its tokens are learned from.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            words, places = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
            one = lambda values, kind: pa.array([[v for x in values for v in x.to_pylist()]], pa.list_(kind))
            sizes = np.concatenate([x[3] for x in held])
            out = one([x[1] for x in held], pa.bool_())
            learned = int(sizes[~out.flatten().to_numpy(zero_copy_only=False)].sum())
            return pa.RecordBatch.from_arrays([one([x[0] for x in held], pa.int64()), out, *[pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype("<i4"), words.astype("<u8"), places.astype("<u4"))], pa.array([learned], pa.int64())], schema=_CHUNK_ARROW)

        for batch in batches:
            for at, end in textvec.cut(batch.column(2)):
                h, doc = tokens(textvec.words_of(batch.column(2).slice(at, end - at)))
                held.append((batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), h, np.bincount(doc, minlength=end - at)))
                n += len(h)
                if n >= chunk_tokens:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    folder, files = common.written(source, run, _CHUNK_ARROW, "lm-chunks", "learned", rows_per_batch=4096)
    places = [(f"{folder}/{file}", place, learned) for file, told in files for place, learned in enumerate(told)]
    return source.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(places)], _CHUNK)


def one_a_task(chunks: DataFrame) -> DataFrame:
    n = chunks.count()
    return chunks.repartitionById(max(1, min(n, MOST_TASKS)), F.col("chunk").cast("int"))


def chunk_columns(path: str, place: int, columns: list[str] | None = None) -> pa.Table:
    """A chunk's row, or some columns of it."""
    fs, name = common.arrow_fs(path)
    with fs.open_input_file(name) as f:
        return pq.ParquetFile(f).read_row_group(place, columns=columns, use_threads=False)


@dataclass
class Chunk:
    """A row of chunks_of."""

    number: int
    ids: pa.Array  #: of documents
    held: np.ndarray
    doc: np.ndarray  #: of each token
    words: np.ndarray
    at: np.ndarray  #: place of each token among the words

    @classmethod
    def of(cls, number: int, path: str, place: int) -> Chunk:
        rows = chunk_columns(path, place)
        sizes, words, at = (np.frombuffer(rows[c][0].as_buffer(), dtype=t) for c, t in (("sizes", "<i4"), ("words", "<u8"), ("places", "<u4")))
        return cls(number, rows["doc_ids"][0].values, np.array(rows["held"][0].as_py(), dtype=bool), np.repeat(np.arange(len(sizes)), sizes), words, at)

    def pairs(self) -> np.ndarray:
        return pairs(self.words[self.at], self.doc)[0]

    def before(self) -> np.ndarray:
        """Place of each token's history among the words."""
        out = np.empty_like(self.at)
        end = np.searchsorted(self.words, U(END))
        out[:1] = end
        out[1:] = np.where(self.doc[1:] == self.doc[:-1], self.at[:-1], end)
        return out


def count_ngrams(chunks: DataFrame, n_blocks: int) -> DataFrame:
    """Words and pairs of each chunk with their counts in the texts learned from
    (0 where only a held-out text has them), dealt to blocks by their own
    hashes, so that no word is too common for a block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk.of(row["chunk"], row["path"], row["place"])
                learned = ~c.held[c.doc]
                yield pack(WORD, c.words, np.bincount(c.at[learned], minlength=len(c.words)), n_blocks, c.number)
                two = c.pairs()
                common.release()  # of what hashing took
                values, n = _unique_counts(two[learned])
                if not learned.all():
                    others = _unique_counts(two[~learned])[0]
                    values, n = _merge([(values, n), (others, np.zeros(len(others), dtype=np.int64))])
                yield pack(PAIR, values, n, n_blocks, c.number)

    return common.mapped(one_a_task(chunks), run, _PACKED, rows_per_batch=1)


def ask_follows(chunks: DataFrame, n_blocks: int) -> DataFrame:
    """The histories of each chunk, dealt to blocks."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = chunk_columns(row["path"], row["place"], ["words"])["words"][0]
                asked = np.unique(history(np.frombuffer(words.as_buffer(), dtype="<u8")))
                yield pack(ASK, asked, np.zeros(len(asked), dtype=np.int64), n_blocks, row["chunk"])

    return common.mapped(one_a_task(chunks), run, _PACKED, rows_per_batch=1)


_COUNTED = _PACKED + ", n_tokens long, n_types long, n_once long"
_COUNTED_ARROW = pa.schema([*_PACKED_ARROW, ("n_tokens", pa.int64()), ("n_types", pa.int64()), ("n_once", pa.int64())])


@dataclass
class Model:
    settings: Settings
    n_tokens: int
    n_types: int
    n_once: int
    common_hashes: np.ndarray
    common_counts: np.ndarray

    def log10(self, word: np.ndarray, given: np.ndarray, pair: np.ndarray, follow: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token, from the counts of the word,
        its history, both, and the history's distinct followers.

        Unknown words share the mass of the words seen once.
        """
        d = self.settings.discount
        total = max(1, self.n_tokens)
        unknown = max(1, self.n_once) / total
        single = np.where(word > 0, np.maximum(word - unknown, 0.05) / total * (1 - unknown), unknown)
        given = np.maximum.reduce([given, pair, follow])
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.where(given > 0, np.maximum(pair - d, 0) / given, 0.0)
            back = np.where(given > 0, np.minimum(1.0, d * np.maximum(follow, 1) / given), 1.0)
        return np.log10(np.maximum(np.minimum(1.0, seen + back * single), 1e-30))


def blocks_for(chunks: DataFrame, settings: Settings) -> int:
    """Number of blocks for the tokens learned from."""
    size = chunks.agg(F.sum("learned")).first()[0] or 0
    return max(1, -(-size // settings.block_rows))


#: Beyond so many blocks or chunks a task has several, one after the other.
MOST_TASKS = 20_000


def train(chunks: DataFrame, n_blocks: int, settings: Settings = Settings()) -> tuple[Model, DataFrame, DataFrame]:
    """(model, exact counts of all words, levels of each chunk's n-grams)."""

    def block(entries: list[tuple[int, np.ndarray, np.ndarray]]) -> LogFrequencyBloom:
        hashes = np.concatenate([h[c > 0] ^ _SALT[kind] for kind, h, c in entries])
        return LogFrequencyBloom.of(build_block(hashes, np.concatenate([c[c > 0] for _, _, c in entries]), settings), settings)

    def gather(batches) -> Iterator[pa.RecordBatch]:
        """For each block its words, its answers, and followers dealt anew."""
        whole = lambda part: pa.RecordBatch.from_arrays([*part.columns, *[pa.nulls(part.num_rows, pa.int64())] * 3], schema=_COUNTED_ARROW)
        for group in common.groups_of(batches, ["block"]):
            words, counts = unpack(group, WORD)
            two, times = unpack(group, PAIR)
            bloom = block([(WORD, words, counts), (PAIR, two, times)])
            yield whole(answers(group, WORD, WORD, words, bloom.levels(words, _SALT[WORD])))
            yield whole(answers(group, PAIR, PAIR, two, bloom.levels(two, _SALT[PAIR])))
            del bloom
            common.release()
            words, counts = words[counts > 0], counts[counts > 0]
            row = {"chunk": [-1], "kind": [WORD], "block": [group["block"][0].as_py()], "hashes": [words.tobytes()], "counts": [counts.astype("<i8").tobytes()], "n_tokens": [int(counts.sum())], "n_types": [len(words)], "n_once": [int((counts == 1).sum())]}
            yield pa.RecordBatch.from_pydict(row, schema=_COUNTED_ARROW)
            yield whole(pack(FOLLOW, *_unique_counts(two[times > 0] >> U(32)), n_blocks))

    def gather_follows(batches) -> Iterator[pa.RecordBatch]:
        for group in common.groups_of(batches, ["block"]):
            values, n = unpack(group, FOLLOW)
            asked = unpack(group, ASK)[0]
            yield answers(group, ASK, FOLLOW, asked, block([(FOLLOW, values, n)]).levels(asked, _SALT[FOLLOW]))

    # block b goes to task b: by a hash some tasks would have several
    by_block = lambda df: df.repartitionById(min(n_blocks, MOST_TASKS), F.col("block")).sortWithinPartitions("block")
    counted = common.stored(by_block(count_ngrams(chunks, n_blocks)), gather, _COUNTED_ARROW, _COUNTED, "lm-counts")
    own = counted.where(F.col("kind") == WORD)
    facts = own.agg(F.sum("n_tokens"), F.sum("n_types"), F.sum("n_once")).first()
    n_tokens, n_types, n_once = (int(x or 0) for x in facts)
    packed = _PACKED_ARROW.names
    follows = by_block(counted.where(F.col("kind") == FOLLOW).select(packed).unionByName(ask_follows(chunks, n_blocks))).mapInArrow(gather_follows, _PACKED)
    levels = counted.where(F.col("kind") >= SEEN).select(packed).unionByName(follows).drop("hashes")

    def each_word(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, dtype="<i8")), pa.array(np.frombuffer(c, dtype="<i8"))], names=["word", "c"])

    counts = own.select("hashes", "counts").mapInArrow(each_word, "word long, c long")
    least = 1
    if n_types > settings.common_words:  # the least count of which so many words have it or more
        line = counts.groupBy("c").count().orderBy(F.desc("c")).toPandas()
        fits = line["count"].cumsum() <= settings.common_words
        least = int(line["c"][fits].min()) if fits.any() else int(line["c"].max()) + 1
    known = counts.where(F.col("c") >= least).toArrow()
    h, c = known["word"].to_numpy().view(np.uint64), known["c"].to_numpy()
    order = np.argsort(h)
    return Model(settings, n_tokens, n_types, n_once, h[order], c[order]), counts, levels


def levels_in(table: pa.Table, kind: int, values: np.ndarray, n_blocks: int) -> np.ndarray:
    """The levels that blocks have answered for a chunk's ascending hashes."""
    told = sorted((b, x.as_buffer()) for k, b, x in zip(table["kind"].to_pylist(), table["block"].to_pylist(), table["counts"]) if k == SEEN + kind)
    out = np.empty(len(values), dtype=np.uint8)
    out[deal(values, n_blocks)[0]] = np.concatenate([np.frombuffer(x, dtype=np.uint8) for _, x in told])
    return out


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"
_SCORED_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64()))])


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score.

    Learns from the rows whose crc32(doc_id) mod 10 is not 0; a null doc_id is
    learned from.  A null or empty text is its end alone; texts of any length
    are scored whole.  Repeated rows count
    and are scored each.  An empty table gives no rows; other columns are
    ignored.  The base score is exact: the commonest words' counts are
    broadcast, and the rarer words of each row are joined with theirs.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    source = docs.select("doc_id", held.alias("held_out"), common.text_bytes().alias("text"))
    chunks = chunks_of(source)
    n_blocks = blocks_for(chunks, settings)
    model, counts, levels = train(chunks, n_blocks, settings)
    sent = spark.sparkContext.broadcast(model)
    n, v = model.n_tokens, model.n_types
    below = math.log10(n + 0.1 * (v + 1))
    all_known = v <= settings.common_words

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for group in common.groups_of(batches, ["chunk"]):
            at = group["kind"].to_pylist().index(-1)
            chunk = Chunk.of(*(group[c][at].as_py() for c in ("chunk", "path", "place")))
            doc, size = chunk.doc, len(chunk.held)
            count = lambda kind, values: count_of(levels_in(group, kind, values, n_blocks).astype(np.int64), settings.base)
            before = chunk.before()
            word = count(WORD, chunk.words)
            asked, place = np.unique(history(chunk.words), return_inverse=True)
            follow = count(FOLLOW, asked)[place]
            two, place = np.unique(chunk.pairs(), return_inverse=True)
            common.release()  # of what sorting took
            two = count(PAIR, two)
            logs = np.empty(len(place))
            for a in range(0, len(place), 1 << 18):  # a dozen arrays of numbers are made on the way
                part = slice(a, a + (1 << 18))
                logs[part] = m.log10(word[chunk.at[part]], word[before[part]], two[place[part]], follow[before[part]])
            del place, two, before
            common.release()
            score = np.bincount(doc, weights=logs, minlength=size)
            h = chunk.words
            i = np.minimum(np.searchsorted(m.common_hashes, h), max(0, len(m.common_hashes) - 1))
            c = np.where(m.common_hashes[i] == h, m.common_counts[i], 0) if len(m.common_hashes) else np.zeros(len(h), dtype=np.int64)
            c = c[chunk.at]
            rare = np.zeros(len(c), dtype=bool) if all_known else c == 0
            base = np.bincount(doc[~rare], weights=np.log10(c[~rare] + 0.1) - below, minlength=size)
            n_known = np.bincount(doc[c > 0], minlength=size)
            ends = np.searchsorted(doc[rare], np.arange(size + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[chunk.at[rare]].view(np.int64)))
            row = chunk.number << 23
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + size)), chunk.ids, pa.array(chunk.held), pa.array(np.bincount(doc, minlength=size), pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), lists], schema=_SCORED_ARROW)

    together = levels.unionByName(chunks.drop("learned").withColumns({"kind": F.lit(-1), "block": F.lit(-1)}), allowMissingColumns=True)
    dealt = together.repartitionById(max(1, min(chunks.count(), MOST_TASKS)), F.col("chunk").cast("int")).sortWithinPartitions("chunk")
    final = [F.lit(n).cast("long").alias("train_tokens")]
    if all_known:
        return dealt.mapInArrow(run, _SCORED).select("doc_id", "held_out", "n_tokens", "n_known", *final, F.col("base").alias("base_score"), "score")
    scored = common.stored(dealt, run, _SCORED_ARROW, _SCORED, "lm-scored")
    words = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").count()
    found = words.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("count")).otherwise(0)).alias("more_known"), F.sum(F.col("count") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - below)).alias("more"))
    joined = scored.drop("rare").join(found, "row", "left")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), *final, (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
