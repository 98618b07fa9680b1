"""BagMinHash near-duplicates: weighted-Jaccard signatures of 5-word shingle multisets, banded, then verified exactly.

For each shingle, Poisson processes of unit rate run over its weight axis, cut at the powers of two. Whole intervals
below the shingle's count give all their points; the interval that the count cuts is split further by each point's own
place. A point falls on one of the signature's places, which keeps its earliest point. Two texts agree in a place with
the probability of their weighted Jaccard similarity, without bias. Only points before a time that fills all places with
high probability are made; a text with an empty place runs on with doubled time.

Rows are classed by their words: texts of equal lower-cased words share a class at once, known by 128 bits. Null, empty
and blank texts form one class of their own (no shingles, similarity 1 to each other). Texts under five words have one
shingle, all their words. Each row is judged by its own text, whatever its id: rows of null id, rows that repeat an id
with another text, and repeated rows all get a class. A class is named by its least (doc_id, null last, content): class_id
is that doc_id, and class_key, its content's hash, tells classes apart whose least doc_id is the same. An empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, MASK, Scratch, hashed_words, map_arrow, mix, read, sequence_ids, shingles, steps, text_key
from .linkage import linked

THRESHOLD, SHINGLE = 0.8, 5
#: 20 bands of 4: a pair at 0.8 is missed with probability 3e-5.
BANDS, ROWS = 20, 4
SIZE = BANDS * ROWS
EMPTY = MASK


def unit(h: np.ndarray) -> np.ndarray:
    """(0, 1] from 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740992.0


def intervals(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, low, high) of the dyadic intervals (0,1], (1,2], (2,4], ... that reach into (0, weight]."""
    n = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64), 0) + 1
    e = np.repeat(np.arange(len(weights)), n)
    level = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
    high = np.exp2(level)
    return e, np.where(level > 0, high / 2, 0.0), high


def bag_minhash(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Signatures, docs x SIZE, of uint64: the time of each place's first point (float32 bits) and 32 bits naming it."""
    sig = np.full(docs * SIZE, EMPTY, np.uint64)
    total = np.bincount(doc, weight, docs)
    limit = SIZE * (np.log(SIZE) + 2) / np.maximum(total, 1)  # one in eight texts goes on with doubled time
    with np.errstate(over="ignore"):
        e, low, high = intervals(weight)
        todo = np.ones(docs, bool)
        todo[total == 0] = False
        while todo.any():
            some = todo[doc[e]]
            i, lo, hi = e[some], low[some], high[some]
            key = mix(element[i] + mix((hi * 2 + 1).astype(np.uint64) * GOLD))
            t, d, w, k = np.zeros(len(i)), doc[i], weight[i], 0
            while len(key):
                k += 1
                h = mix(key + np.uint64(k) * GOLD)
                t = t - np.log(unit(h)) / (hi - lo)
                on = t <= limit[d]
                key, t, d, w, lo, hi, h = key[on], t[on], d[on], w[on], lo[on], hi[on], h[on]
                place = mix(h ^ GOLD)
                there = (hi <= w) | (lo + (hi - lo) * unit(mix(place + GOLD)) <= w)
                value = (t[there].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h[there] & np.uint64(0xFFFFFFFF))
                np.minimum.at(sig, d[there] * SIZE + ((place[there] >> np.uint64(16)) % np.uint64(SIZE)).astype(np.int64), value)
            todo &= (sig.reshape(docs, SIZE) == EMPTY).any(1)
            limit[todo] *= 2
    return sig.reshape(docs, SIZE)


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket ids, docs x BANDS."""
    with np.errstate(over="ignore"):
        s = sig.reshape(len(sig), BANDS, ROWS)
        out = np.broadcast_to(mix((np.arange(1, BANDS + 1, dtype=np.uint64)) * GOLD), (len(sig), BANDS)).copy()
        for i in range(ROWS):
            out = mix(out * np.uint64(5) + s[:, :, i])
    return out


def signatures(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(doc_id, t1, t2, c1, c2, bands) of each row: t names the text, c its words; without words c is 0 and there are no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 64, 3):
                w = hashed_words(part.column(3))
                n = np.diff(w.at)
                some = np.flatnonzero(n)
                names = np.zeros((2, len(n)), np.uint64)
                names[:, some] = sequence_ids(w.h, w.at[some], n[some])
                es, ws = [], []
                for i in some.tolist():
                    u, k = np.unique(shingles(w.h[w.at[i] : w.at[i + 1]], SHINGLE), return_counts=True)
                    es.append(u), ws.append(k)
                sets = np.array([len(u) for u in es], np.int64)
                sig = bag_minhash(np.concatenate([*es, np.zeros(0, np.uint64)]), np.concatenate([*ws, np.zeros(0)]).astype(np.float64), np.repeat(np.arange(len(some)), sets), len(some))
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bands(sig).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x.view(np.int64)) for x in names), lists], names=["doc_id", "t1", "t2", "c1", "c2", "bands"])

    base = df.select(F.col(id_col).alias("doc_id"), *text_key(text), F.col(text).alias("_t"))
    zero = F.lit(0).cast("long")
    return map_arrow(base, run, base.select("doc_id", "t1", "t2", zero.alias("c1"), zero.alias("c2"), F.array(zero).alias("bands")).schema)


def near_rows(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, t1, t2, class_id, class_key, is_representative) of every row; t1 and t2 are the row's text_key."""
    scratch = Scratch(df.sparkSession, "near")
    sig = scratch.store(signatures(df, text, id_col), "signatures")
    # of exact copies, the row of the least doc_id speaks for all; their number is fixed once they are written
    place = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("at")
    one = sig.groupBy("c1", "c2").agg(place, F.first("bands").alias("bands"))
    distinct = scratch.store(one.select("c1", "c2", "at.*", "bands").withColumn("id", F.monotonically_increasing_id()), "distinct")

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = distinct.join(ids, "id", "left_semi").select("id", F.col("doc_id").alias("_d"), F.col("t1").alias("_1"), F.col("t2").alias("_2"))
        base = df.select(F.col(id_col).alias("doc_id"), *text_key(text), F.col(text).alias("text"))
        same = base.doc_id.eqNullSafe(wanted["_d"]) & (base.t1 == wanted["_1"]) & (base.t2 == wanted["_2"])
        return base.join(wanted, same).groupBy("id").agg(F.first("text").alias("text"))  # repeated rows meet here

    _, classes = linked(distinct.select("id", F.explode("bands").alias("bucket")), fetch, threshold, True, SHINGLE, scratch)
    named = distinct.drop("bands").join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    key = F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0")).alias("key")
    least = named.groupBy("class_id").agg(F.min(F.struct("no_id", "doc_id", key, "t1", "t2")).alias("least"))
    names = scratch.store(named.select("c1", "c2", "class_id").join(least, "class_id").select("c1", "c2", "least"), "names")
    both = sig.select("doc_id", "t1", "t2", "c1", "c2").join(names, ["c1", "c2"])
    scratch.drop("distinct", "classes")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("t1") == F.col("least.t1")) & (F.col("t2") == F.col("least.t2"))
    return both.select("doc_id", "t1", "t2", F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("class_key"), first.alias("is_representative"))


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_key, is_representative) of every row."""
    return near_rows(df, text, id_col, threshold).drop("t1", "t2")


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
