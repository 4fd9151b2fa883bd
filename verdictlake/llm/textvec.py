"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes outside \\x20 and \\x09-\\x0D.  Its hash is a
polynomial over 64-bit values drawn for each byte, so that equal words have
equal hashes and different ones differ but for chances of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240611))
#: A 64-bit value for each byte, with A-Z as a-z in the folded table.
BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE^0 .. BASE^(n-1) modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(16, (n - 1).bit_length())
        p = np.full(size, BASE, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; a bijection."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Words:
    n_docs: int
    data: np.ndarray  #: all bytes
    offsets: np.ndarray  #: of documents in data, n_docs + 1
    start: np.ndarray  #: of words in data
    end: np.ndarray
    doc: np.ndarray  #: document of each word, ascending
    hash: np.ndarray  #: uint64
    first: np.ndarray  #: words before each document, n_docs + 1
    run: np.ndarray  #: sums of the polynomial up to each byte

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the first n bytes, word) of the words that have more."""
        long = np.flatnonzero(self.end - self.start > n)
        at, size = self.start[long], len(self.data)
        with np.errstate(over="ignore"):
            h = (self.run[at + n] - self.run[at]) * powers(size + 1)[size - at] * _inverse_power(size)
        return mix(h), long


def cut(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or one row."""
    sizes = np.diff(_offsets(texts))
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += int(n)
    if len(sizes) > at:
        yield at, len(sizes)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    n = len(texts)
    if not n:
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the rows in them) of a binary array."""
    offsets = _offsets(texts)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, fold: bool = True, space: np.ndarray = SPACE) -> Words:
    """The words of a binary array without nulls."""
    n_docs = len(texts)
    data, offsets = bytes_of(texts)
    n = len(data)
    word = ~space[data]
    # a word starts where a space, or another document, is before
    edge = np.empty(n + 1, dtype=bool)
    edge[1:] = ~word
    edge[offsets] = True
    start = np.flatnonzero(edge[:n] & word)
    # and ends before a space or another document
    edge[: n - 1 if n else 0] = ~word[1:]
    edge[offsets[1:] - 1] = True
    end = np.flatnonzero(edge[:n] & word) + 1
    with np.errstate(over="ignore"):
        p = powers(n + 1)
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((BYTE[FOLD] if fold else BYTE)[data] * p[:n], out=run[1:])
        h = (run[end] - run[start]) * p[n - start]
        # relative to the end of the buffer: bring every buffer to one scale
        h = h * _inverse_power(n)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return Words(n_docs, data, offsets, start, end, doc, mix(h), first, run)


_INVERSE = pow(BASE, -1, 1 << 64)


def _inverse_power(n: int) -> np.uint64:
    return U(pow(_INVERSE, n, 1 << 64))


def windows(words: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document) of all runs of n words within a document, in order;
    the run that starts at word i is at place i of those kept.  short: a
    document of 1 to n-1 words gives one run of all its words."""
    h, size = words.hash, len(words.hash)
    with np.errstate(over="ignore"):
        m = max(0, size - n + 1)
        run = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            run = run * U(0x9E3779B97F4A7C15) + h[k : k + m]
    whole = words.doc[:m] == words.doc[n - 1 :] if m else np.zeros(0, dtype=bool)
    got, doc = mix(run[whole]), words.doc[:m][whole]
    if short:
        counts = np.diff(words.first)
        few = np.flatnonzero((counts > 0) & (counts < n))
        if len(few):
            extra = []
            for d in few:
                x = 0x51ED270B
                for v in h[words.first[d] : words.first[d + 1]]:
                    x = (x * 0x9E3779B97F4A7C15 + int(v)) & 0xFFFFFFFFFFFFFFFF
                extra.append(x)
            got = np.concatenate([got, mix(np.array(extra, dtype=np.uint64))])
            doc = np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            got, doc = got[order], doc[order]
    return got, doc
