"""Token ids as Arrow files of fixed-size-list batches.

Documents, in ascending doc_id order, are one stream of ids.  Each partition
of that order is an Arrow IPC file whose rows are sequences of equal length
with a mask (false: padding after the last id of the file), and a second file
with the place of each document.  Through a memory map any sequence and mask
is read without a copy, and any document by its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, textvec

INDEX = "part long, file string, n_docs long, n_ids long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
SEQUENCES_PER_BATCH = 256


def sequence_schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Streams ids into one file, a batch of sequences at a time."""

    def __init__(self, sink, length: int):
        self.length, self.schema = length, sequence_schema(length)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * SEQUENCES_PER_BATCH:
            self._write(self.length * SEQUENCES_PER_BATCH)

    def _write(self, batch: int) -> None:
        flat = np.concatenate(self.held)
        whole = len(flat) - len(flat) % batch
        for at in range(0, whole, batch):
            self._batch(flat[at : at + batch], batch)
        self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _batch(self, ids: np.ndarray, n_real: int) -> None:
        mask = np.zeros(len(ids), dtype=bool)
        mask[:n_real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, dtype=np.uint16)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.writer.close()


class TokenFile:
    """Random access to one file of sequences."""

    def __init__(self, path: str):
        fs, name = common.arrow_fs(path)
        local = fs.type_name == "local"
        self.source = pa.memory_map(name) if local else fs.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.span = self.length * SEQUENCES_PER_BATCH
        self._at, self._batch = -1, None

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.file.get_batch(k)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids, as a view of the file, and mask of sequence i."""
        b, r = self.batch(i // SEQUENCES_PER_BATCH), i % SEQUENCES_PER_BATCH
        return b.column("ids")[r].values.to_numpy(), b.column("mask")[r].values

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids from a place in the file; a view where they lie in one batch."""
        parts = []
        while n:
            k, at = divmod(start, self.span)
            values = self.batch(k).column("ids").flatten().to_numpy()[at : at + n]
            parts.append(values)
            start, n = start + len(values), n - len(values)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint16)

    def n_real(self) -> int:
        return sum(self.batch(k).column("mask").flatten().true_count for k in range(self.file.num_record_batches))


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 0, length: int = 2048) -> DataFrame:
    """Write all documents (doc_id, text) to a folder; the table of its files.

    Null and empty texts are the end id alone; null ids come first, and rows
    with equal doc_id follow each other in the order of their texts' MD5, by
    which a frequent id is dealt to several files.  Texts of any length are
    encoded whole.  Other columns are ignored; an empty table has no files.  A
    task that is run again writes a file of another name, and the table lists
    each part once, so readers never see a torn or doubled file.
    """
    path = common.vocabulary("byte_bpe_50k.json", vocabulary)
    body = common.text_bytes()
    keyed = docs.select("doc_id", F.md5(body).alias("digest"), body.alias("text"))
    ordered = keyed.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")

    def write(batches) -> Iterator[pa.RecordBatch]:
        coder = common.coder(path, keep_space=True)
        fs, base = common.arrow_fs(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, n_docs, start = None, 0, 0
        end = np.array([end_id], dtype="<u2")
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(base)
                sinks = fs.open_output_stream(f"{base}/{name}.arrow"), fs.open_output_stream(f"{base}/{name}.docs.arrow")
                out, places = SequenceWriter(sinks[0], length), pa.ipc.new_file(sinks[1], DOCS)
            sizes = []
            for at, until in textvec.cut(batch.column(1), 1 << 24):
                for ids in coder.encode(batch.column(1).slice(at, until - at)):
                    out.add(ids)
                    out.add(end)
                    sizes.append(len(ids) + 1)
            ends = start + np.cumsum(sizes, dtype=np.int64)
            starts = np.concatenate([[start], ends[:-1]])
            places.write_batch(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS))
            start, n_docs = int(ends[-1]), n_docs + batch.num_rows
        if out is not None:
            out.close()
            places.close()
            for s in sinks:
                s.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [name], "n_docs": [n_docs], "n_ids": [start]}, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return common.materialize(common.mapped(ordered, write, INDEX, rows_per_batch=4096), "token-index")


def read_tokens(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens,
    ids_crc32, null and repeated doc_ids included; no rows where there are no
    files.  The table of files is collected; it has a row per partition."""
    files, base_of = [], 0
    for row in index.orderBy("part").collect():
        files.append((row["file"], base_of))
        base_of += row["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches) -> Iterator[pa.RecordBatch]:
        fs, base = common.arrow_fs(folder)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = TokenFile(f"{folder}/{name}.arrow")
                with fs.open_input_file(f"{base}/{name}.docs.arrow") as f:
                    places = pa.ipc.open_file(f)
                    for k in range(places.num_record_batches):
                        docs = places.get_batch(k)
                        starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                        crcs = [zlib.crc32(tokens.ids(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(starts + first), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(files, "file string, first long").mapInArrow(read, schema)
