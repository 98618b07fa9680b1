"""Helpers that the operators of this package share: shared storage, word hashing, folds and small batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir
from ..session import ship

#: Documents and bytes of text that a Python worker works on at once; memory bounds only, results don't depend on them.
STEP, STEP_BYTES = 256, 1 << 20
#: Rows and bytes of an Arrow batch; memory bounds only.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1500", "spark.sql.execution.arrow.maxBytesPerBatch": "6m"}
#: Entries after which a worker's cache of words starts anew; a memory bound only.
CACHE = 120_000
#: ASCII white space of the contracts, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
GOLD = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, after which each task's worker releases its memory."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for results that are read lazily."""
    return Scratch(df.sparkSession, name).store(df, name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % n


def text_key(text: str) -> list[Column]:
    """t1 and t2: 128 bits that name a text; null is the empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit("text"), t).alias("t2")]


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those of the smallest hashes of key: the same rows in every run and order."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def sampled_texts(df: DataFrame, n: int) -> DataFrame:
    """At most n different rows of df (_i, _t, further columns), the same in every run. The rows are chosen without their
    texts, and copies of a row meet before they reach the driver, so no more than n texts do."""
    rest = [c for c in df.columns if c not in ("_i", "_t")]
    keyed = df.select("*", *text_key("_t"))
    picked = F.broadcast(keyed.select("_i", "t1", "t2").distinct().orderBy(F.xxhash64("_i"), "_i", "t1", "t2").limit(n))  # at most n rows
    both = keyed.join(picked, ["_i", "t1", "t2"], "left_semi")
    return both.groupBy("_i", "t1", "t2", *rest).agg(F.first("_t").alias("_t")).select("_i", "_t", *rest)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space beyond ASCII, as UTF-8 read in big-endian order; fixed values of Unicode.
BLANK2 = np.array([0xC285, 0xC2A0])
BLANK3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


@dataclass
class Words:
    """The words of a batch of texts, lower-cased and split at white space."""

    h: np.ndarray  # 64-bit hashes
    at: np.ndarray  # where each text's words begin, and the end
    start: np.ndarray  # the words' first bytes and the bytes after their last ones, in data
    stop: np.ndarray
    data: np.ndarray  # all texts' bytes
    offsets: np.ndarray  # where each text begins in data, and the end

    def places(self) -> np.ndarray | None:
        """Code points of data before each byte; None if all bytes are code points."""
        if not len(self.data) or self.data.max() < 0x80:
            return None
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])


def blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    out = BLANK[data]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return out
    b = np.concatenate([data, np.zeros(2, np.uint8)])
    two = lead[b[lead] == 0xC2]
    two = two[np.isin((0xC2 << 8) | b[two + 1].astype(np.int64), BLANK2)]
    three = lead[(b[lead] >= 0xE1) & (b[lead] <= 0xE3)]
    three = three[np.isin((b[three].astype(np.int64) << 16) | (b[three + 1].astype(np.int64) << 8) | b[three + 2], BLANK3)]
    for p in (two, two + 1, three, three + 1, three + 2):
        out[p] = True
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null is the empty text."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def hashed_words(texts: pa.Array | list[str | None]) -> Words:
    """Hashes of all words: eight bytes at a time, each word from its own first byte."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    data, offsets = flat(pc.utf8_lower(texts.fill_null("") if texts.null_count else texts))
    full = ~blanks(data)
    first = full.copy()
    first[1:] &= ~full[:-1]
    last = full.copy()
    last[:-1] &= ~full[1:]
    cut = offsets[1:-1]  # a text's end ends a word
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = full[cut]
    last[cut - 1] = full[cut - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(word_hashes(data, start, stop), np.searchsorted(start, offsets), start, stop, data, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    n = stop - start
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def part(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at] & (np.uint64(MASK) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64))

    with np.errstate(over="ignore"):
        h = mix(part(start, n) ^ (n.astype(np.uint64) * GOLD))
        some = np.flatnonzero(n > 8)
        for k in range(8, LONG_WORD, 8):
            if not len(some):
                break
            h[some] = mix(h[some] * np.uint64(3) + part(start[some] + k, n[some] - k))
            some = some[n[some] > k + 8]
    for i in some.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]].tobytes())
    return h


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-word shingles of hashed words; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(3) + words[i : n - k + 1 + i])
    return h


def sequence_ids(h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each of the word sequences that begin at starts and have n words, one at least."""
    order = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    x, first = h[np.repeat(starts, n) + order], np.cumsum(n) - n
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        a = mix(x + (order + 1).astype(np.uint64) * GOLD)
        b = mix(a ^ np.uint64(0xD1B54A32D192ED03))
        size = n.astype(np.uint64) * GOLD
        return mix(np.add.reduceat(a, first) + size), mix(np.add.reduceat(b, first) ^ size)


def steps(batch: pa.RecordBatch, n: int = STEP, text: int | str | None = None, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most n rows and, by the text column, about `most` bytes of text, one row at least."""
    if text is None:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    i = 0
    while i < batch.num_rows:
        some = np.cumsum(size[i : i + n])
        j = i + max(1, int(np.searchsorted(some, most)))
        yield batch.slice(i, min(j, batch.num_rows) - i)
        i = j


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's values, null as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
