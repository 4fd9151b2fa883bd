"""What the operators of this subpackage share: the shared folder, reading
tables, the tokenizers' word cache and streams of groups."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import math
import os
import re
import sys
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textvec

_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the
    one that the session was given by setCheckpointDir.

    Only where both are unset and everything runs on one machine, as in tests,
    a temporary folder is made.
    """
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = context.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="verdictlake-")
    return _FOLDERS[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/verdictlake/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in itertools.count() if (n := f"{name}_{k}" if k else name).lower() not in taken)


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as an object."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work folder; at the driver's end the session may be gone."""
    if spark.sparkContext._jsc is None:
        return
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2048) -> Iterator[None]:
    """While it lasts, Arrow batches have at most so many rows.

    Ten thousand long texts fill tens of MB in the JVM and again in Python, in
    each task.  The setting is the session's: a query that another thread
    plans meanwhile gets small batches too, and the same rows.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and
    a lost executor costs no recomputation.  texts: rows that go to Python hold
    whole texts, or what is made of them, and so go in small batches."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with small_batches(spark) if texts else contextlib.nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_fs(path: str):
    """(pyarrow file system, path on it) for a URI or a plain path."""
    import pyarrow.fs as pafs

    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


def text_bytes(column: str = "text"):
    """A text column as bytes, null as empty: Arrow then ships it undecoded."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def release() -> None:
    """Give freed memory back: a worker lives on, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of one C library only
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, fn: Callable, schema: str, rows_per_batch: int = 512) -> DataFrame:
    """mapInArrow over batches of few rows, since a row may hold a long text.

    The batch size is a session setting read when the plan runs, so the
    batches are cut here instead.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut():
            for batch in batches:
                for at in range(0, batch.num_rows, rows_per_batch):
                    yield batch.slice(at, rows_per_batch)

        try:
            yield from fn(cut())
        finally:
            release()

    return df.mapInArrow(run, schema)


def written(df: DataFrame, fn: Callable, schema: pa.Schema, name: str, told: str | None = None, rows_per_batch: int = 512) -> tuple[str, list[tuple[str, list]]]:
    """What fn makes of df's batches, in Parquet files of the shared folder,
    which the workers write themselves: (folder, its files, and of each of their
    batches the first value of the column told).

    Each batch is a row group, so that a reader holds no more than one, however
    many a task has; none of them passes through the JVM.  A task that is run
    again writes another file, and only those of tasks that count are moved to
    the folder.
    """
    spark = df.sparkSession
    folder = work_path(spark, name)

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs(folder)
        context = TaskContext.get()
        file = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.parquet"
        out, values = None, []
        for batch in fn(batches):
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(f"{base}/_tries")
                sink = fs.open_output_stream(f"{base}/_tries/{file}")
                out = pq.ParquetWriter(sink, schema, compression="zstd", use_dictionary=False)
            out.write_batch(batch, row_group_size=batch.num_rows)
            values.append(batch.column(told)[0].as_py() if told else None)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([values], pa.list_(pa.int64()))], names=["file", "told"])

    with small_batches(spark):
        rows = mapped(df, run, "file string, told array<long>", rows_per_batch).collect()
    fs, base = arrow_fs(folder)
    for row in rows:
        fs.move(f"{base}/_tries/{row['file']}", f"{base}/{row['file']}")
    return folder, sorted((row["file"], row["told"]) for row in rows)


def stored(df: DataFrame, fn: Callable, schema: pa.Schema, columns: str, name: str, rows_per_batch: int = 512) -> DataFrame:
    """The table that written() has written."""
    spark = df.sparkSession
    folder, files = written(df, fn, schema, name, rows_per_batch=rows_per_batch)
    return spark.read.schema(columns).parquet(folder) if files else spark.createDataFrame([], columns)


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from a stream that is sorted by the keys.

    Only one group is held at a time.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k) for k in keys]
        starts = [0]
        if n > 1:
            new = None
            for c in columns:
                a, b = c.slice(1), c.slice(0, n - 1)
                ne = pc.fill_null(pc.not_equal(a, b), False)
                ne = pc.or_(ne, pc.not_equal(pc.is_null(a), pc.is_null(b)))
                new = ne if new is None else pc.or_(new, ne)
            starts += [int(i) + 1 for i in pc.indices_nonzero(new).to_numpy()]
        for at, end in zip(starts, starts[1:] + [n]):
            key = tuple(c[at].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def slabs_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows from a stream of batches."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def sample_of(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """At most n of total rows, the same ones every time: those whose key's
    hash is below a cut that lets about n through, and of them the first n.
    Without the cut each task would send n rows to the merge."""
    if total > n:
        df = df.where(F.expr(f"pmod(xxhash64({key}), {1 << 30})") < math.ceil((1 << 30) * min(1.0, (n + 4 * n**0.5) / total)))
    return df.orderBy(F.xxhash64(key), key).limit(n)


# ---- tokenizers -------------------------------------------------------------

#: UTF-8 of white space outside the ASCII six, and of separators on which
#: libraries differ; binary columns are matched byte by byte.
_ODD_SPACE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_SPACE, _LETTER, _MARK, _APOSTROPHE = 1, 2, 3, 4
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_CLASS[[c for c in range(128) if chr(c).isdigit()]] = 0
_CLASS[ord("'")] = _APOSTROPHE
_CLASS[textvec.SPACE] = _SPACE
#: Whether a unit starts between bytes of two classes: before white space,
#: between letters and marks, but not in what an apostrophe begins.
_CUT = np.zeros(64, dtype=bool)
for _a, _b in [(c, _SPACE) for c in (0, _LETTER, _MARK, _APOSTROPHE)] + [(_LETTER, _MARK), (_LETTER, _APOSTROPHE), (_MARK, _LETTER)]:
    _CUT[_a * 8 + _b] = True
_CODERS: dict[tuple, WordCoder] = {}


class WordCoder:
    """Encodes whole texts with a tokenizers file, each distinct unit once.

    Both vocabularies split a text before merging: before a run of white space,
    which stays with what follows it, and between plain letters and marks.  So
    the ids of a text are those of such units in order.  The units are cut as
    views of the texts' bytes, Arrow finds the distinct ones, the tokenizer
    encodes those that are not known yet, and Arrow puts the ids in the units'
    places.  What is known, at most so many units, is two Arrow arrays, which
    take a tenth of what a dictionary of Python's would.  Texts with unusual
    white space are encoded as one.
    """

    def __init__(self, path: str, keep_space: bool, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keep_space, self.most = keep_space, most
        self.known = self.ids = pa.array([], pa.large_binary())

    def _raw(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids; bytes that are no UTF-8 are replaced."""
        out = []
        for at in range(0, len(texts), 4096):  # an encoding is far larger than its ids
            part = [x.decode("utf-8", "replace") for x in texts[at : at + 4096]]
            for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                ids = array("H", e.ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                out.append(ids.tobytes())
        return out

    def _of_units(self, units: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, the place of each unit's among them)."""
        at = pc.index_in(units, value_set=self.known)
        missing = at.is_null()
        learn = units.filter(missing)
        ids = pa.concat_arrays([self.ids, pa.array(self._raw(learn.to_pylist()), pa.large_binary())])
        at = at.to_numpy(zero_copy_only=False)
        new = missing.to_numpy(zero_copy_only=False)
        where = np.where(new, 0, at).astype(np.int64)
        where[new] = len(self.ids) + np.arange(len(learn))
        if len(self.known) + len(learn) > self.most:  # begin anew with what is used now
            self.known, self.ids = units, ids.take(pa.array(where))
        else:
            self.known, self.ids = pa.concat_arrays([self.known, learn]), ids
        return ids, pa.array(where)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a binary array without nulls."""
        out: list[np.ndarray] = []
        for at, end in textvec.cut(texts, 1 << 22):
            out += self._encode(texts.slice(at, end - at))
        return out

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        data, offsets = textvec.bytes_of(texts)
        n = len(data)
        kinds = _CLASS[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[1:n] = _CUT[(kinds[:-1] << 3) | kinds[1:]]
        edge[offsets] = True
        starts = np.flatnonzero(edge)  # the last is n
        if not self.keep_space:
            # this vocabulary folds case; before a combining mark that may depend on more
            plain = np.ones(n, dtype=bool)
            plain[:-1] = data[1:] < 128
            data = np.where(plain, textvec.FOLD[data], data)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        collecting = gc.isenabled()
        gc.disable()  # very many units live for a moment, none in a cycle
        try:
            ids, where = self._of_units(coded.dictionary)
            ids = ids.take(where.take(coded.indices))
        finally:
            if collecting:
                gc.enable()
        flat, ends = textvec.bytes_of(ids)
        flat = flat.view("<u2")
        ends = (ends[np.searchsorted(starts, offsets)] // 2).tolist()
        out = [flat[a:b] for a, b in zip(ends, ends[1:])]
        whole = pc.indices_nonzero(pc.match_substring_regex(texts, _ODD_SPACE)).to_pylist()
        for k, got in zip(whole, self._raw([texts[k].as_py() for k in whole])):
            out[k] = np.frombuffer(got, dtype="<u2")
        return out


def coder(path: str, keep_space: bool) -> WordCoder:
    """The worker's coder of a vocabulary; it outlives tasks."""
    key = (path, keep_space)
    if key not in _CODERS:
        _CODERS[key] = WordCoder(path, keep_space)
    return _CODERS[key]


def vocabulary(name: str, path: str | None = None) -> str:
    """Place of a public vocabulary file; a path of one's own wins."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
