"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of both sides become typed placeholders; windows of WINDOW template words are hash-joined. For
each document and item, matched windows that lie on one diagonal (the same distance between both places) form a run, in
which each benchmark slot value must always stand for the same document value. A run convicts if it covers RUN_WORDS
template words and its slots are consistent, and so does any consistent stretch of BROKEN_WORDS in a run whose slots aren't;
a diagonal of consistent slots also convicts if it covers nearly all of a shorter item. So questions with other numbers or
names are caught as well as exact copies.

Words are case-folded and stripped of edge punctuation; words without letters or digits vanish. A name is a capitalised
word that doesn't begin a sentence or a line; every window with a name also counts with its names as plain words, so copies
in capitals or in title case match, and a window of too few literal words counts as it is written. An item under WINDOW
words matches as a whole, without placeholders; one under SHORT_WORDS words stands in too many texts by chance and
matches only a text that consists of it; null and empty texts on either side match nothing; rows that repeat an id are treated as one text's further copies; null ids
can't be named: their rows are never convicted. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, flat, map_arrow, mix, read, steps, stored, word_hashes

WINDOW, RUN_WORDS, COVER = 8, 13, 0.8
#: A window of placeholders needs so many words that aren't placeholders, else its words count as they are.
LITERALS = 4
#: Items of fewer words match whole texts only.
SHORT_WORDS = 4
#: Tells the hash of a whole short text from that of a window.
WHOLE = np.uint64(0x9D8A7C6B5E4F3A21)
#: Rows of the benchmark's windows that are broadcast at most (about 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1 << 15
#: In a run whose slots contradict each other, a consistent stretch convicts from so many words: two windows side by side.
BROKEN_WORDS = 2 * WINDOW
#: Window hashes of the benchmark that are sent to all executors at most (8 bytes each); beyond, windows are joined by shuffle alone.
BROADCAST_WINDOWS = 1 << 21
#: In the syntax of Arrow's patterns.
NUMBER = r"^[+-]?[$€£]?\p{Nd}[\p{Nd}.,:/]*%?$"
#: Units of measure that become a placeholder; fixed values.
UNITS = set("mm cm m km kg g mg lb lbs oz ml l litre litres liter liters inch inches ft foot feet mile miles yard yards hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees kmh mph".split())
EDGE = " \t.,;:!?\"'()[]{}<>|*#$%&=/\\-–—…«»“”‘’"
WORD_TYPE, NUMBER_TYPE, UNIT_TYPE, NAME_TYPE = range(4)


def word_rows(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of its form or 0 if it vanishes, hash of its value, type, may be a name, ends a sentence) of words as written."""
    flags = lambda x: x.to_numpy(zero_copy_only=False)

    def hashed(x: pa.Array) -> np.ndarray:
        data, offsets = flat(x)
        return word_hashes(data, offsets[:-1], offsets[1:]) | np.uint64(1)

    bare = pc.utf8_trim(words, EDGE)
    low = pc.utf8_lower(bare)
    value = hashed(low)
    wide = pa.array(np.flatnonzero(~flags(pc.string_is_ascii(bare))))
    value[wide] = hashed(pa.array([x.casefold() for x in bare.take(wide).to_pylist()], words.type))  # so that ß and SS are the same
    kind = np.where(flags(pc.is_in(low, pa.array(sorted(UNITS), words.type))), UNIT_TYPE, WORD_TYPE)
    mixed = np.flatnonzero(~flags(pc.utf8_is_alpha(bare)))  # few words aren't all letters
    rest = bare.take(pa.array(mixed))
    kind[mixed[flags(pc.match_substring_regex(rest, NUMBER))]] = NUMBER_TYPE
    form = np.where(kind == WORD_TYPE, value, kind.astype(np.uint64))
    nothing = mixed[~flags(pc.match_substring_regex(rest, r"[\p{L}\p{N}]"))]
    form[nothing] = value[nothing] = 0
    capital = flags(pc.utf8_is_upper(pc.utf8_slice_codeunits(bare, 0, 1)))
    stop = flags(pc.match_substring_regex(words, "[.!?:][\"')\\]»”’]*$"))
    return form, value, kind, capital, stop


def templates(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(form hashes, value hashes, is a slot, is a name) of each text's template words. Each different word of the batch is
    looked at once."""
    if not len(texts):
        return []
    lines = pc.split_pattern(texts.fill_null(""), "\n")
    lists = pc.utf8_split_whitespace(lines.flatten())
    size = lambda x: pc.list_value_length(x).to_numpy(zero_copy_only=False)
    line = np.repeat(np.arange(len(lists)), size(lists))
    doc = np.repeat(np.arange(len(texts)), size(lines))
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy()
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:
        full = at != blank
        at, line = at[full], line[full]
    h, v, kind, cap, stop = (x[at] for x in word_rows(words))
    first = np.append(True, (line[1:] != line[:-1]) | stop[:-1])[: len(line)]
    name = cap & ~first & (kind == WORD_TYPE)
    h = np.where(name & (h > 0), np.uint64(NAME_TYPE), h)
    keep = h > 0
    slot = name | (kind != WORD_TYPE)
    ends = np.cumsum(np.bincount(doc[line[keep]], minlength=len(texts)))[:-1]
    return list(zip(*(np.split(x[keep], ends) for x in (h, v, slot, name)), strict=True))


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return templates(pa.array([text], pa.large_string()))[0]


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n words in a row, in doubling steps; the last two may overlap."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        k = 1
        while 2 * k <= n:
            h, k = mix(h[:-k] * np.uint64(3) + h[k:]), 2 * k
        return h if k == n else mix(h[: k - n] * np.uint64(3) + h[n - k :] + np.uint64(n))


def windows(h: np.ndarray, v: np.ndarray, slot: np.ndarray, name: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of all windows: with names as placeholders, where there is one, and with names as plain words; a
    window of too few literal words is plain altogether. Then plain ones of the short lengths."""
    xs, at = [], []
    if len(h) >= WINDOW:
        names, slots = (np.concatenate([[0], np.cumsum(x)]) for x in (name, slot))
        names, slots = names[WINDOW:] - names[:-WINDOW], slots[WINDOW:] - slots[:-WINDOW]
        spelled = sequences(np.where(name, v, h), WINDOW)
        plain = np.flatnonzero(WINDOW - slots + names < LITERALS)
        if len(plain):
            spelled[plain] = sequences(v, WINDOW)[plain]
        named = np.flatnonzero((names > 0) & (WINDOW - slots >= LITERALS))
        xs += [spelled, sequences(h, WINDOW)[named] if len(named) else spelled[:0]]
        at += [np.arange(len(spelled)), named]
    for n in short:
        xs.append(sequences(v, n))
        at.append(np.arange(len(xs[-1])))
    if not xs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(xs), np.concatenate(at)


SCHEMA = "id long, w long, pos int, n int, slots array<long>"


def window_rows(df: DataFrame, text: str, id_col: str, only: np.ndarray | None = None, short: list[int] | None = None) -> DataFrame:
    """(id, window hash, place, template words of the text, value hashes of the window's words). Items, which short is
    None for, have values at slots and else -1; of an item shorter than a window all words are one plain window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if only is not None:  # most windows fall on an empty place of the table, the others are looked up
            mask = np.uint64((1 << min(24, max(16, (16 * len(only)).bit_length()))) - 1)
            table = np.zeros(int(mask) + 1, bool)
            table[(only & mask).view(np.int64)] = True
        for whole in batches:
            for batch in steps(whole, 2048, 1, 4 * STEP_BYTES):
                ids, ws, ps, ns, ss = [], [], [], [], []
                for key, (h, v, slot, name) in zip(batch.column(0).to_pylist(), templates(batch.column(1)), strict=True):
                    if key is None or not len(h):
                        continue
                    own = [len(h)] if SHORT_WORDS <= len(h) < WINDOW else []
                    x, at = windows(h, v, slot, name, own if short is None else short)
                    if len(h) < SHORT_WORDS:
                        x, at = sequences(v, len(h)) ^ WHOLE, np.zeros(1, np.int64)
                    if only is not None:
                        some = np.flatnonzero(table[(x & mask).view(np.int64)])
                        if not len(some):
                            continue
                        some = some[only[np.minimum(np.searchsorted(only, x[some]), len(only) - 1)] == x[some]]
                        x, at = x[some], at[some]
                    values = np.where(slot, v.view(np.int64), np.int64(-1)) if short is None else v.view(np.int64)
                    for w, p in zip(x.view(np.int64).tolist(), at.tolist(), strict=True):
                        ids.append(key), ws.append(w), ps.append(p), ns.append(len(h)), ss.append(values[p : p + WINDOW].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ws, pa.int64()), pa.array(ps, pa.int32()), pa.array(ns, pa.int32()), pa.array(ss, pa.list_(pa.int64()))], names=["id", "w", "pos", "n", "slots"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("_t")), run, SCHEMA)


def judge(at: list[int], words: int, slots: list[tuple[int, int, int]]) -> tuple[int, int, bool]:
    """(covered words, longest consistent stretch, convicted) of a diagonal: its windows' places in the item and slots (place, value, document's value), both sorted."""
    runs: list[list[int]] = []
    for p in at:
        end = min(p + WINDOW, words)
        if runs and p <= runs[-1][1]:
            runs[-1][1] = end
        else:
            runs.append([p, end])
    cover, longest, bad, k = sum(e - s for s, e in runs), 0, False, 0
    for s, e in runs:
        left, best, seen = s, 0, {}
        while k < len(slots) and slots[k][0] < e:
            p, a, b = slots[k]
            clash = max((q + 1 for c, q in seen.get(a, {}).items() if c != b), default=left)
            if clash > left:
                best, left = max(best, p - left), clash
            seen.setdefault(a, {})[b] = p
            k += 1
        best = max(best, e - left)
        longest, bad = max(longest, best), bad or best >= (RUN_WORDS if left == s else BROKEN_WORDS)
    one = len({x[1] for x in slots}) == len({x[1:] for x in slots})
    return cover, longest, bad or (one and cover >= COVER * words)


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The convicted diagonals of (id, item_id, item_words, at, slots)."""
    for batch in batches:
        out = []
        for key, item, words, at, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            triples = sorted((x["p"], x["a"], x["b"]) for x in slots)
            cover, longest, bad = judge(at, words, triples)
            if bad:
                out.append((key, item, words, cover, longest, len({x[1:] for x in triples})))
        if out:
            names = ["id", "item_id", "item_words", "covered_words", "longest_run", "slots"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 2 else pa.int32()) for i, x in enumerate(zip(*out, strict=True))], names=names)


def contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each convicted (doc_id, item_id): covered words, the longest run, item words, slots and distinct slot values."""
    items = stored(window_rows(bench, item_text, item_id).distinct(), "items")
    n, n_rows = items.agg(F.count_distinct("w"), F.count("*")).first()
    only = None
    if n <= BROADCAST_WINDOWS:  # its size is proven; the hashes only spare windows that can't match
        only = np.sort(np.array(items.select("w").distinct().toArrow()["w"].to_numpy()).view(np.uint64))
    short = sorted(r.n for r in items.where(F.col("n").between(SHORT_WORDS, WINDOW - 1)).select("n").distinct().collect())
    mine = window_rows(docs, text, id_col, only, short)
    other = items.select("w", F.col("id").alias("item_id"), F.col("pos").alias("ipos"), F.col("n").alias("item_words"), F.col("slots").alias("islots"))
    hits = mine.drop("n").distinct().join(F.broadcast(other) if n_rows <= BROADCAST_ROWS else other, "w").withColumn("diagonal", F.col("pos") - F.col("ipos"))
    pairs = F.filter(F.transform(F.arrays_zip("islots", "slots"), lambda x, i: F.when((x.islots != -1) & x.slots.isNotNull(), F.struct((F.col("ipos") + i).alias("p"), x.islots.alias("a"), x.slots.alias("b")))), lambda x: x.isNotNull())
    g = hits.groupBy("id", "item_id", "diagonal").agg(
        F.max("item_words").alias("item_words"), F.sort_array(F.collect_set("ipos")).alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"))
    bad = map_arrow(g.select("id", "item_id", "item_words", "at", "slots"), judged, "id long, item_id long, item_words int, covered_words int, longest_run int, slots int")
    best = F.max(F.struct("longest_run", "covered_words", "item_words", "slots"))
    return bad.groupBy(F.col("id").alias("doc_id"), "item_id").agg(best.alias("b"), F.count("*").alias("n_places")).select("doc_id", "item_id", "b.longest_run", "b.covered_words", "b.item_words", "b.slots", "n_places")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
