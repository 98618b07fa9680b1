"""Substring dedup: paragraphs are MinHash-banded, verified by exact Jaccard and clustered; exact windows find passages that
stand inside other paragraphs.

A paragraph is a line of SHINGLE words or more; shorter lines are left out. Paragraphs that share one of SIEVE minima of
their 5-word shingles with another one are banded by further minima, tuned for high recall; paragraphs that collide are
verified by exact Jaccard similarity, and components are classes. Equal lines share a class at once.
A window is PASSAGE_WORDS words in a row, across lines; equal windows form a class. The anchor of a window is the least
hash of its GRAM-word sequences: equal windows have equal anchors, so only windows whose anchor stands elsewhere too are
made and compared, and none is missed. Neighbouring repeated windows form a passage: exactly the words that lie in a
stretch of PASSAGE_WORDS words or more which another place has word for word. Places within one document count too, where
they don't overlap: of a text that repeats a short period, the first two windows' worth at most stays.

Result: one row for each repeated span (doc_id, kind paragraph or passage, start and end in code points, n_words,
class_id, first_doc, removed). The first occurrence by (doc_id, start) stays (removed false). Windows that stand earlier and
windows that stand here first make spans of their own, so a span that stays can reach into one that goes; every word that
goes has a copy in an earlier place that stays. A passage's class_id is its least window, the same for passages of the
same extent; what stays of a document that has exact copies has the class_id of the whole text. Words are lower-cased and
split at white space. Null and empty texts have no spans; rows that repeat a doc_id are one document; rows of null id can't
be named and have no result; further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHE, GOLD, Scratch, Words, hashed_words, mix, read, sequence_ids, shingles, steps, text_key
from .linkage import MAPS, SETS, linked, token_batch, tokens, tune_bands

THRESHOLD, SHINGLE = 0.8, 5
#: Words of a passage at least, and of the sequences that anchor it.
PASSAGE_WORDS, GRAM = 50, 10
#: A near paragraph shares one of so many minima with probability 0.9997 or more, and then a band with 0.9995 or more.
SIEVE = 5
BANDS, ROWS = tune_bands(THRESHOLD, 0.9995, 64)


def fused(x: np.ndarray, n: int, pair) -> np.ndarray:
    """All n neighbours of x made one by pair, in doubling steps; the last two may overlap."""
    k = 1
    while 2 * k <= n:
        x, k = pair(x[:-k], x[k:]), 2 * k
    return x if k == n else pair(x[: k - n], x[n - k :])


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, hash) of each window of PASSAGE_WORDS words; h has so many at least."""
    with np.errstate(over="ignore"):
        both = lambda a, b: mix(a * np.uint64(3) + b)
        grams = fused(h, GRAM, both)
        # the windows' hashes go on from the grams' ones: five in a row, side by side
        wide = PASSAGE_WORDS // GRAM
        n = len(h) - PASSAGE_WORDS + 1
        w = grams[:n].copy()
        for i in range(1, wide):
            w = mix(w * np.uint64(3) + grams[i * GRAM : i * GRAM + n])
        return fused(grams, PASSAGE_WORDS - GRAM + 1, np.minimum), w


def minima(flat: np.ndarray, starts: np.ndarray, n: np.ndarray, first: int, count: int) -> np.ndarray:
    """MinHash values first.. of the sets that begin at starts of flat and have n elements, sets x count."""
    out = np.empty((len(starts), count), np.uint64)
    if not len(starts):
        return out
    ends = np.stack([starts, starts + n], 1).ravel()
    with np.errstate(over="ignore"):
        for k in range(count):
            x = (flat ^ mix(np.array([first + k + 1], np.uint64) * GOLD)[0]) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            out[:, k] = np.minimum.reduceat(np.append(x, np.uint64(0)), ends)[::2]
    return out


def banded(m: np.ndarray) -> np.ndarray:
    """Band buckets of minima, sets x BANDS."""
    with np.errstate(over="ignore"):
        m = m.reshape(len(m), BANDS, ROWS)
        out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD), (len(m), BANDS)).copy()
        for r in range(ROWS):
            out = mix(out * np.uint64(7) + m[:, :, r])
    return out


def lists_of(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))


class Page:
    """Words, code point offsets and lines of a batch of texts."""

    def __init__(self, texts: pa.Array):
        w: Words = hashed_words(texts)
        places = w.places()
        self.h, self.at, self.n = w.h, w.at, np.diff(w.at)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        begin = w.offsets[:-1] if places is None else places[w.offsets[:-1]]
        point = lambda x, doc: (x if places is None else places[x]) - begin[doc]
        self.start, self.stop = point(w.start, self.doc), point(w.stop, self.doc)
        breaks = np.flatnonzero(w.data == 10)
        line = np.searchsorted(breaks, w.start)
        new = np.append(True, (line[1:] != line[:-1]) | (self.doc[1:] != self.doc[:-1]))[: len(line)]
        self.line = np.flatnonzero(new)  # first words of lines that have words
        self.line_words = np.diff(np.append(self.line, len(line)))
        first, doc = w.start[self.line], self.doc[self.line]
        head, tail = np.union1d(breaks + 1, w.offsets[:-1]), np.union1d(breaks, w.offsets[1:])
        self.line_start = point(head[np.searchsorted(head, first, "right") - 1], doc) if len(first) else first
        self.line_end = point(tail[np.searchsorted(tail, first, "right")], doc) if len(first) else first


UNITS = "t1 long, t2 long, kind int, start int, stop int, n_words int, x1 long, x2 long, minima array<long>"


def all_units(df: DataFrame) -> DataFrame:
    """Of (t1, t2, text): kind 0: runs of windows with one anchor (x1), start and stop are the first and last window's words;
    kind 1: paragraphs, x is the hash of their words, with minima; kind 2: the text, x1 its least window or 0. A text that a
    task has met before is passed over."""
    names = [x.split()[0] for x in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for part in steps(whole, 256, 2):
                keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
                if len(seen) > CACHE:
                    seen.clear()
                part = part.take(pa.array(fresh, pa.int32()))
                page = Page(part.column(2))
                out = []

                def add(kind, doc, start, stop, n, x1, x2, out=out):
                    out.append((doc, np.full(len(doc), kind), start, stop, n, x1, x2))

                zero = np.zeros(1, np.uint64)
                least = np.zeros(len(fresh), np.uint64)
                if len(page.h) >= PASSAGE_WORDS:
                    anchor, w = windows(page.h)
                    at = np.flatnonzero(page.doc[: len(w)] == page.doc[PASSAGE_WORDS - 1 :])  # windows within one text
                    if len(at):
                        anchor, w, doc = anchor[at], w[at], page.doc[at]
                        head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
                        tail = np.append(head[1:], len(at)) - 1
                        first = page.at[doc]
                        add(0, doc[head], (at - first)[head], (at - first)[tail], np.full(len(head), GRAM), anchor[head], np.broadcast_to(zero, len(head)))
                        texts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                        least[doc[texts]] = np.minimum.reduceat(w, texts)
                some = np.flatnonzero(page.n)
                add(2, some, page.start[page.at[some]], page.stop[page.at[some + 1] - 1], page.n[some], least[some], np.broadcast_to(zero, len(some)))
                para = np.flatnonzero(page.line_words >= SHINGLE)
                first, n = page.line[para], page.line_words[para]
                add(1, page.doc[first], page.line_start[para], page.line_end[para], n, *sequence_ids(page.h, first, n))
                m = minima(shingles(page.h, SHINGLE), first, n - SHINGLE + 1, 0, SIEVE) if len(para) else np.zeros((0, SIEVE), np.uint64)
                doc, kind, start, stop, n, x1, x2 = (np.concatenate(x) for x in zip(*out, strict=True))
                values = [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in (kind, start, stop, n)), pa.array(x1.view(np.int64)), pa.array(x2.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*values, lists_of(m.view(np.int64).ravel(), np.where(kind == 1, SIEVE, 0))], names=names)

    return df.select("t1", "t2", "_t").mapInArrow(run, UNITS)


FOUND = "kind int, ord long, pos int, again int, w array<long>, start int, starts array<int>, stop int, stops array<int>, bands array<long>, " + SETS
#: What a window's own text says of it: nothing; it stands there again, apart; it has stood there before, apart.
ONCE, FIRST, AGAIN = 0, 1, 2


def window_runs(h: np.ndarray, start: np.ndarray, stop: np.ndarray, anchors: list[int], ord_: int) -> list[tuple]:
    """Neighbouring windows whose anchor is wanted, as runs (ord, first word, again, hashes, where the first word starts and
    how far it's from each word's start to the next one's; the same of the ends of the windows, from the one before)."""
    anchor, w = windows(h)
    at = np.flatnonzero(np.isin(anchor.view(np.int64), np.array(anchors, np.int64)))
    _, first, same = np.unique(w[at], return_index=True, return_inverse=True)
    far = at - at[first[same]]
    furthest = np.zeros(len(first), np.int64)
    np.maximum.at(furthest, same, far)
    again = np.where(far >= PASSAGE_WORDS, AGAIN, np.where(furthest[same] >= PASSAGE_WORDS, FIRST, ONCE))
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(again) != 0)) + 1
    out = []
    for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        if x < y:
            a, b = int(at[x]), int(at[y - 1]) + 1
            last = PASSAGE_WORDS - 2
            out.append((ord_, a, int(again[x]), w[a:b].view(np.int64), int(start[a]), np.diff(start[a : b + 1]), int(stop[a + last]), np.diff(stop[a + last : b + last + 1])))
    return out


def found_in(df: DataFrame) -> DataFrame:
    """Of (text, ord, anchors, spots): kind 0: runs of windows whose anchor is wanted; kind 1: the paragraphs at spots, as
    sets and bands."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in FOUND.split(", ")]
    numbers = names.index("bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for whole in batches:
            for part in steps(whole, 256, 0):
                page = Page(part.column(0))
                rows, ids, sets = [], [], []
                for i, (ord_, anchors, spots) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    if ord_ == before:
                        continue  # a repeated row
                    before = ord_
                    a, b = page.at[i], page.at[i + 1]
                    h, start, stop = page.h[a:b], page.start[a:b], page.stop[a:b]
                    if anchors and len(h) >= PASSAGE_WORDS:
                        rows += window_runs(h, start, stop, anchors, ord_)
                    for spot in spots or []:
                        x, y = np.searchsorted(start, [spot["start"], spot["stop"]])
                        ids.append(spot["id"])
                        sets.append(tokens(shingles(h[x:y], SHINGLE), False))
                if rows:
                    ord_, pos, again, w, start, starts, stop, stops = zip(*rows, strict=True)
                    n = np.array([len(x) for x in w])
                    short = lambda x: lists_of(np.concatenate(x).astype(np.int32), n)
                    values = [pa.array(ord_, pa.int64()), *(pa.array(x, pa.int32()) for x in (pos, again)), lists_of(np.concatenate(w), n), pa.array(start, pa.int32()), short(starts), pa.array(stop, pa.int32()), short(stops)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), *values, *(pa.nulls(len(n), t) for t in types[numbers:])], names=names)
                if ids:
                    n = np.array([len(t) for t in sets])
                    m = banded(minima(np.concatenate(sets), np.cumsum(n) - n, n, SIEVE, BANDS * ROWS))
                    nothing = [pa.nulls(len(ids), t) for t in types[1:numbers]]
                    bands = lists_of(m.view(np.int64).ravel(), np.full(len(ids), BANDS))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(ids), np.int32)), *nothing, bands, *token_batch(pa.array(ids, pa.int64()), sets).columns], names=names)

    return df.mapInArrow(run, FOUND)


def repeated_passages(runs: DataFrame, texts: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans of the windows in runs that stand in other places, and of texts that have copies."""
    each = runs.select("ord", "pos", "again", F.posexplode("w").alias("i", "w")).select("ord", "again", (F.col("pos") + F.col("i")).alias("pos"), "w")
    classes = each.groupBy("w").agg(F.min("ord").alias("o"), F.max("ord").alias("last"), F.max("again").alias("again")).where(f"o <> last or again > {ONCE}").select("w", "o")
    classes = scratch.store(classes, "window_classes")
    scratch.sweep()
    # a window that overlaps its own first copy is not yet a repeat of it
    hit = each.join(classes, "w").select("ord", "pos", "w", "o", ((F.col("ord") != F.col("o")) | (F.col("again") == AGAIN)).alias("later"))
    island = F.col("pos") - F.dense_rank().over(Window.partitionBy("ord", "later").orderBy("pos"))
    ends = [F.min("pos").alias("low"), F.max("pos").alias("high"), F.min("w").alias("class_id"), F.min("o").alias("o")]
    islands = scratch.store(hit.withColumn("island", island).groupBy("ord", "later", "island").agg(*ends).drop("island"), "islands")
    # code points of their ends, and of the words just outside
    offset = lambda first, steps_, k: F.col(first) + F.aggregate(F.slice(steps_, F.lit(1), k), F.lit(0), lambda a, x: a + x)
    run = runs.select("ord", "pos", F.size("w").alias("n"), "start", "starts", "stop", "stops")
    left = islands.join(run, "ord").where("low >= pos and low < pos + n")
    k = F.col("low") - F.col("pos")
    left = left.select(*islands.columns, offset("start", "starts", k).alias("start"), offset("stop", "stops", k).alias("stop_before"))
    both = left.join(run.withColumnRenamed("start", "at"), "ord").where("high >= pos and high < pos + n")
    k = F.col("high") - F.col("pos") + 1
    spans = scratch.store(both.select(*left.columns, offset("stop", "stops", k).alias("end"), offset("at", "starts", k).alias("start_after")), "spans")
    scratch.drop("window_classes", "islands")
    copied = texts.where(f"copies > 1 and n_words >= {PASSAGE_WORDS}")
    words = (F.col("high") - F.col("low") + PASSAGE_WORDS).cast("int").alias("n_words")
    kind = F.lit("passage").alias("kind")
    first = texts.select(F.col("ord").alias("o"), F.col("doc_id").alias("first_doc"))
    alone = spans.join(texts.select("ord", "doc_id", "copies"), "ord").where("copies = 1 or later")
    alone = alone.join(first, "o").select("doc_id", kind, "start", "end", words, "class_id", "first_doc", F.col("later").alias("removed"))
    # the first document of a copied text keeps what lies between the windows that stand earlier: a row before each of them
    none = F.lit(None).cast("int")
    stops = spans.where("later").join(copied.select("ord"), "ord", "left_semi").select("ord", "low", "high", "stop_before", "start_after")
    stops = stops.unionByName(copied.select("ord", (F.col("n_words") - PASSAGE_WORDS + 1).alias("low"), none.alias("high"), F.col("stop").alias("stop_before"), none.alias("start_after")))
    order = Window.partitionBy("ord").orderBy("low")
    low = F.coalesce(F.lag("high").over(order) + 1, F.lit(0))
    gaps = stops.select("ord", "stop_before", low.alias("low"), (F.col("low") - 1).alias("high"), F.lag("start_after").over(order).alias("after")).where("low <= high")
    kept = gaps.join(copied.select("ord", "doc_id", F.col("start").alias("text_start"), F.col("w").alias("class_id")), "ord").select(
        "doc_id", kind, F.coalesce("after", "text_start").alias("start"), F.col("stop_before").alias("end"), words, "class_id", F.col("doc_id").alias("first_doc"), F.lit(False).alias("removed"))
    others = docs.join(copied.withColumnRenamed("doc_id", "first_doc"), ["t1", "t2"]).where("doc_id <> first_doc")
    gone = others.select("doc_id", kind, "start", F.col("stop").alias("end"), "n_words", F.col("w").alias("class_id"), "first_doc", F.lit(True).alias("removed"))
    return alone.unionByName(kept).unionByName(gone)


def repeated_paragraphs(lines: DataFrame, known: DataFrame, items: DataFrame, docs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Spans of paragraphs that are near to others or equal them; known: (id, x1, x2) of those that items has as sets and bands."""
    _, classes = linked(items.select("id", F.explode("bands").alias("bucket")), items, threshold, False, SHINGLE, scratch)
    named = known.join(classes, "id")
    heads = named.groupBy("class_id").agg(F.min(F.struct("x1", "x2")).alias("head"))
    near = named.join(heads, "class_id").select("x1", "x2", F.col("head.x1").alias("k1"), F.col("head.x2").alias("k2"))
    own = lines.join(near, ["x1", "x2"], "left").select("t1", "t2", "start", "stop", "n_words", F.coalesce("k1", "x1").alias("k1"), F.coalesce("k2", "x2").alias("k2"))
    placed = scratch.store(own.join(docs, ["t1", "t2"]).drop("t1", "t2"), "placed")
    several = placed.groupBy("k1", "k2").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("doc_id", "start") for f in (F.min, F.max)]).where("min_doc_id <> max_doc_id or min_start <> max_start")
    some = scratch.store(placed.join(several.select("k1", "k2"), ["k1", "k2"], "left_semi").distinct(), "repeated")
    place = F.struct("doc_id", "start")
    first = some.groupBy("k1", "k2").agg(F.min(place).alias("first"))
    return some.join(first, ["k1", "k2"]).select("doc_id", F.lit("paragraph").alias("kind"), "start", F.col("stop").alias("end"), "n_words", F.col("k1").alias("class_id"), F.col("first.doc_id").alias("first_doc"), (place != F.col("first")).alias("removed"))


def repeated_spans(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    scratch = Scratch(df.sparkSession, "substring")
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text), F.col(text).alias("_t")).where("doc_id is not null and _t is not null")
    units = scratch.store(all_units(base), "units")
    docs = scratch.store(base.select("doc_id", "t1", "t2").distinct(), "docs")
    # texts in the order of their first documents
    whole = units.where("kind = 2").groupBy("t1", "t2").agg(*[F.first(c).alias(c) for c in ("start", "stop", "n_words")], F.first("x1").alias("w"))
    texts = docs.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).join(whole, ["t1", "t2"])
    texts = scratch.store(texts.orderBy("doc_id", "t1", "t2").withColumn("ord", F.monotonically_increasing_id()), "texts")
    # anchors that stand in several texts, or far apart in one
    anchors = units.where("kind = 0").select(F.col("x1").alias("id"), "t1", "t2", "start", "stop")
    shared = anchors.groupBy("id").agg(F.min("t1").alias("x"), F.max("t1").alias("y"), F.min("start").alias("low"), F.max("stop").alias("high")).where(f"x <> y or high - low >= {PASSAGE_WORDS}").select("id")
    wanted = scratch.store(anchors.join(shared, "id", "left_semi").groupBy("t1", "t2").agg(F.collect_set("id").alias("anchors")), "anchors")
    scratch.sweep()
    # paragraphs that share a minimum with another one, each at one of its places
    lines = units.where("kind = 1").drop("kind")
    values = lines.select("x1", F.explode("minima").alias("m"))
    shared = scratch.store(values.groupBy("m").agg(F.min("x1").alias("x"), F.max("x1").alias("y")).where("x <> y").select("m"), "shared")
    scratch.sweep()
    sieved = values.join(shared, "m", "left_semi").select("x1").distinct()
    known = lines.join(sieved, "x1", "left_semi").groupBy("x1", "x2").agg(*[F.first(c).alias(c) for c in ("t1", "t2", "start", "stop")])
    known = scratch.store(known.withColumn("id", F.monotonically_increasing_id()), "known")
    lines = scratch.store(lines.drop("minima"), "lines")
    scratch.drop("units", "shared")
    scratch.sweep()
    spots = known.groupBy("t1", "t2").agg(F.collect_list(F.struct("id", "start", "stop")).alias("spots"))
    wanted = wanted.join(spots, ["t1", "t2"], "full").join(texts.select("t1", "t2", "doc_id", "ord"), ["t1", "t2"])
    wanted = scratch.store(wanted, "wanted")
    found = scratch.store(found_in(base.join(wanted, ["doc_id", "t1", "t2"]).select("_t", "ord", "anchors", "spots")), "found")
    scratch.drop("anchors", "wanted")
    scratch.sweep()
    passages = repeated_passages(found.where("kind = 0"), texts, docs, scratch)
    scratch.sweep()
    items = found.where("kind = 1").select("id", "bands", "tokens", "size", *MAPS)
    paragraphs = repeated_paragraphs(lines, known.select("id", "x1", "x2"), items, docs, threshold, scratch)
    scratch.drop("found", "known", "lines", "placed", "classes")
    scratch.sweep()
    return paragraphs.unionByName(passages)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))
