"""LM scoring: a gated recurrent word model with a class-factored output softmax, trained in numpy.

All training documents are counted. The VOCAB most frequent words (with the end of a document) are cut by frequency into
classes of CLASS words; all rarer and unseen words fall into surface classes (alphabet, length, punctuation). The network
predicts the class and, among frequent words, the word; within a surface class a word has its smoothed share of the
class's training counts, so probabilities add up over the same events as the unigram base: V words and one unseen.

The network is trained by truncated backpropagation through WINDOW steps, with state carried across windows of a document,
on every training document once. Shards train side by side, and their weights are averaged by tokens, in two rounds: one
document in FIRST_ROUND gives a common start, from which the shards of all others go on. Scoring carries state over whole
documents.

Null, empty and blank texts have the end token only. Repeated rows are each counted, learned from and scored. Null ids
count as training rows and pass through. Without any training row the counts are 0 and every word is unseen. Further
columns are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, fold, read, stored

VOCAB, CLASS, HIDDEN, WINDOW, STREAMS = 2048, 64, 24, 16, 96
#: One training document in so many is in the first round of training, all others are in the second.
FIRST_ROUND = 16
#: Training documents that a shard takes about, over both rounds, and shards at most: beyond these a shard takes more
#: documents, which stream through it.
SHARD_DOCS, MOST_SHARDS = 6400, 16384
#: Counts of so many words go to all executors at most; rarer words' counts are joined.
KNOWN = 100_000
#: Partial counts that a task holds before it passes them on; tokens scored side by side. Memory bounds only.
FLUSH, SIDE_BY_SIDE = 400_000, 4_000_000
#: Rows of the output layer that are worked on at once, documents scored abreast, and tokens of theirs at once: what these take
#: stays in a processor's cache. Results don't depend on them but for rounding.
CACHED, ABREAST, HELD = 256, 512, 8192
END = b"\n"  # no word holds white space
SURFACE = 4 * 3 * 3
RATE = 0.08


def batch_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, each token's word, tokens of each text) of a batch: lower-cased (A-Z) words between ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:
        keep = at != blank
        n = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
        at = at[keep]
    return words.cast(pa.binary()), at, n


#: The second bytes of letters (after C3) that tell a language; fixed values: es, de, fr.
_TELLING = np.full(256, -1)
for _i, _letters in enumerate(("ñóíáú", "äöüß", "éèêàçùîôâ")):
    for _c in _letters:
        _TELLING[_c.encode()[1]] = _i
_END = np.full(256, 2)
_END[[c for c in range(128) if chr(c).isalpha()]] = 0
_END[128:] = 0
_END[list(b".,;:!?")] = 1


def surfaces(words: pa.Array) -> np.ndarray:
    """The surface classes of words: alphabet, length, last letter."""
    data, offsets = flat(words)
    n = np.diff(offsets)
    if not len(n):
        return np.zeros(0, np.int64)
    last = np.where(n > 0, data[np.maximum(offsets[1:], 1) - 1] if len(data) else 0, 0)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    told = _TELLING[data[lead + 1]]
    of = np.searchsorted(offsets, lead[told >= 0], "right") - 1
    votes = np.bincount(of * 3 + told[told >= 0], minlength=3 * len(n)).reshape(-1, 3)
    high = np.concatenate([[0], np.cumsum(data >= 0x80)])
    kind = np.where(high[offsets[1:]] > high[offsets[:-1]], 1 + votes.argmax(1), 0)
    return (kind * 3 + np.where(n < 6, 0, np.where(n < 11, 1, 2))) * 3 + _END[last]


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(word binary, n): counts of all tokens; each task adds up before it passes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = ends = 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            ws, at, n = batch_words(batch.column(0))
            times = np.bincount(at, minlength=len(ws))
            ends += len(n)
            some = np.flatnonzero(times)  # not the empty word
            held.append(pa.table({"word": ws.take(pa.array(some)), "n": times[some]}))
            rows += len(some)
            if rows > 2 * FLUSH:
                held[:] = [added()]
                rows = held[0].num_rows
                if rows > FLUSH:
                    yield from held.pop().to_batches()
                    rows = 0
        if ends:
            held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())}))
            yield from added().to_batches()

    return df.select(F.col(text).alias("_t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids: frequent words by rank, class = id // CLASS; then surface classes, each an id of its own."""

    def __init__(self, top: list[tuple[bytes, int]], known: dict[bytes, int], total: int, distinct: int, class_mass: list[float]):
        self.top, self.known, self.total, self.distinct = top, known, total, distinct
        self.ids = {w: i for i, (w, _) in enumerate(top)}
        self.n_top = len(top)
        self.heads = math.ceil(self.n_top / CLASS)
        self.classes = self.heads + SURFACE
        self.mass = class_mass  # sum of count + 0.1 over a surface class's words, and 0.1 for one unseen
        self.end = self.ids[END]
        self.denominator = math.log10(total + 0.1 * (distinct + 1))

    def logs(self, n: np.ndarray | int):
        return np.log10(np.asarray(n, np.float64) + 0.1)


def start_weights(v: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """The start: the unigram model with a small random network."""
    rng = np.random.default_rng(seed)
    f = np.float32
    counts = np.full(v.heads * CLASS, 0.0)
    counts[: v.n_top] = [n + 0.1 for _, n in v.top]
    bw = np.full((v.heads, CLASS), -60.0)  # places beyond the vocabulary
    shape = counts.reshape(-1, CLASS)
    bw[shape > 0] = np.log(counts[counts > 0]) - np.repeat(np.log(shape.sum(1)), (shape > 0).sum(1))
    mass = np.concatenate([shape.sum(1), v.mass])
    # the last rows of wc and ww are biases
    return {
        "x": rng.normal(0, 0.1, (v.n_top + SURFACE, 3 * HIDDEN)).astype(f), "u": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(f),
        "wc": np.concatenate([np.zeros((HIDDEN, v.classes)), np.log(np.maximum(mass / mass.sum(), 1e-12))[None]]).astype(f),
        "ww": np.concatenate([np.zeros((v.heads, HIDDEN, CLASS)), bw[:, None]], 1).astype(f),
    }


def parts(u: np.ndarray) -> np.ndarray:
    """The matrices of the reset gate, the update gate and the candidate side by side as three, each without gaps."""
    return np.ascontiguousarray(u.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))


def inputs(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows x of the input table, as three parts like parts(u)."""
    at = 3 * x[None] + np.arange(3).reshape(3, *[1] * x.ndim)
    return np.take(table.reshape(-1, HIDDEN), at, axis=0)


def cell(u: np.ndarray, h: np.ndarray, x: np.ndarray, a: np.ndarray, rz: np.ndarray, n: np.ndarray, new: np.ndarray) -> None:
    """One step from states h and inputs x; u, x, a and the gates rz are in parts. Fills a, rz, n and the new state, which may be h."""
    np.matmul(h, u, out=a)
    np.add(x[:2], a[:2], out=rz)
    np.negative(rz, out=rz)
    np.exp(rz, out=rz)
    rz += 1
    np.reciprocal(rz, out=rz)
    np.multiply(rz[0], a[2], out=n)
    n += x[2]
    np.tanh(n, out=n)
    np.subtract(h, n, out=new)
    new *= rz[1]
    new += n


def softmax(x: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """scale times the probabilities of rows of logits, in place. Logits are log-odds and never near the limits of exp."""
    np.exp(x, out=x)
    x *= (np.float32(scale) / row_sums(x))[:, None]
    return x


def row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def with_ones(h: np.ndarray) -> np.ndarray:
    out = np.ones((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1] = h
    return out


def class_of(ids: np.ndarray, v_top: int, heads: int) -> np.ndarray:
    return np.where(ids < v_top, ids // CLASS, ids - v_top + heads)


def stretches(edges: list[int], rows: int, n: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(from, to, [(class, from, to)]) of consecutive rows in the order of their classes, about n at a time: what is made of them
    stays in the processor's cache. edges: where each class of frequent words begins, and the end of the last; a class isn't split."""
    a, some = 0, []
    for k in range(len(edges) - 1):
        if edges[k] < edges[k + 1]:
            some.append((k, edges[k], edges[k + 1]))
            if edges[k + 1] - a >= n:
                yield a, edges[k + 1], some
                a, some = edges[k + 1], []
    while a < rows:
        b = max(min(a + n, rows), edges[-1])
        yield a, b, some
        a, some = b, []


def log_probs(p: dict, h: np.ndarray, ids: np.ndarray, v_top: int, heads: int) -> np.ndarray:
    """Natural logs of the network's probabilities of ids after states h."""
    c = class_of(ids, v_top, heads)
    order = np.argsort(c.astype(np.int16), kind="stable")
    h, c, ids = with_ones(h[order]), c[order], ids[order]
    edges = np.searchsorted(c, np.arange(heads + 1)).tolist()
    got = np.empty(len(ids), np.result_type(h, p["wc"]))
    for a, b, some in stretches(edges, len(ids), CACHED):
        logits = h[a:b] @ p["wc"]
        part = logits[np.arange(b - a), c[a:b]]
        part -= np.log(row_sums(np.exp(logits, out=logits)))
        got[a:b] = part
        if some:
            m = some[-1][2]
            logits = np.empty((m - a, CLASS), got.dtype)
            for k, i, j in some:
                np.matmul(h[i:j], p["ww"][k], out=logits[i - a : j - a])
            part = logits[np.arange(m - a), ids[a:m] - c[a:m] * CLASS]
            part -= np.log(row_sums(np.exp(logits, out=logits)))
            got[a:m] += part
    out = np.empty(len(ids), got.dtype)
    out[order] = got
    return out


def windows(docs: Iterator[np.ndarray], streams: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole documents laid end to end in streams, WINDOW tokens at a time: (streams that still run, as places among those of
    the window before; inputs; tokens, -1 beyond a stream's end). A stream that ends its document takes the next one, so only
    one document for each stream is held; with long ones first the streams end together."""
    rest: list[np.ndarray] = []
    for d in docs:
        rest.append(d)
        if len(rest) == streams:
            break
    last = np.full(len(rest), end, np.int32)
    run, at = np.arange(len(rest)), [0] * len(rest)
    while len(rest):
        y = np.empty((len(rest), WINDOW), np.int32)
        ended = False
        for k, d in enumerate(rest):
            i = at[k]
            if len(d) > i + WINDOW:  # most often a document fills the window and goes on
                y[k] = d[i : i + WINDOW]
                at[k] = i + WINDOW
                continue
            n = 0
            while n < WINDOW and d is not None:
                some = d[i : i + WINDOW - n]
                y[k, n : n + len(some)] = some
                n, i = n + len(some), i + len(some)
                if i == len(d):
                    d, i = next(docs, None), 0
            y[k, n:] = -1
            rest[k], at[k] = d, i
            ended |= d is None
        y = np.ascontiguousarray(y.T)
        x = np.concatenate([last[None], y[:-1]])
        yield run, np.where(x >= 0, x, end), y
        run, last = np.arange(len(rest)), y[-1]
        if ended:
            run = np.flatnonzero([d is not None for d in rest])
            rest, at, last = [rest[k] for k in run.tolist()], [at[k] for k in run.tolist()], last[run]


def sums_by(ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different ids, sums of their rows of g, which is in parts). Rows of ids that have one are taken as they are; of the others
    two numbers are added at a time, as one complex number."""
    order = np.argsort(ids.astype(np.int16) if ids.max() < 1 << 15 else ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    rows = np.take(g.reshape(-1, HIDDEN), order[:, None] + np.arange(3) * len(ids), axis=0).reshape(len(ids), 3 * HIDDEN)
    n = np.diff(np.append(first, len(ids)))
    out, many = np.take(rows, first, axis=0), np.flatnonzero(n > 1)
    if len(many):
        some = np.take(rows, np.flatnonzero(np.repeat(n > 1, n)), axis=0).view(np.complex64)
        out[many] = np.add.reduceat(some, np.cumsum(n[many]) - n[many]).view(np.float32)
    return ids[first], out


def window_gradients(p: dict, h: np.ndarray, x: np.ndarray, y: np.ndarray, v_top: int, heads: int, end: int, weight: float) -> tuple[dict, np.ndarray, np.ndarray]:
    """(gradients, rows of the input table that they concern, the state after the window) of weight times the negative
    log-likelihood of y (steps x streams, -1 for none) after inputs x, by backpropagation within the window."""
    f4 = np.float32
    steps_, streams = y.shape
    e, u = inputs(p["x"], x), parts(p["u"])
    goes_on = x != end  # else a document begins
    keep, all_go_on = goes_on.astype(f4)[:, :, None], goes_on.all(1).tolist()
    h0, hs, n = (np.empty((steps_, streams, HIDDEN), f4) for _ in range(3))
    rz, a = np.empty((2, steps_, streams, HIDDEN), f4), np.empty((3, steps_, streams, HIDDEN), f4)
    for t in range(steps_):
        if all_go_on[t]:
            h0[t] = h
        else:
            np.multiply(h, keep[t], out=h0[t])
        h = hs[t]
        cell(u, h0[t], e[:, t], a[:, t], rz[:, t], n[t], h)
    flat_y = y.ravel()
    ok = np.flatnonzero(flat_y >= 0)
    # rows in the order of their classes, so that each class is one slice
    c = class_of(flat_y[ok], v_top, heads)
    order = np.argsort(c.astype(np.int16), kind="stable")
    ok, c = ok[order], c[order]
    hh, yy = with_ones(np.take(hs.reshape(-1, HIDDEN), ok, axis=0)), flat_y[ok]
    hT, rows = np.ascontiguousarray(hh.T), np.arange(len(yy))
    edges = np.searchsorted(c, np.arange(heads + 1)).tolist()
    g = softmax(hh @ p["wc"], weight)
    g[rows, c] -= f4(weight)
    grad = {"wc": hT @ g, "ww": np.zeros_like(p["ww"])}
    dh = g @ p["wc"][:-1].T
    m = edges[-1]  # rows of frequent words
    if m:
        g, more, back = np.empty((m, CLASS), f4), np.empty((m, HIDDEN), f4), p["ww"][:, :-1].transpose(0, 2, 1)
        some = [(k, edges[k], edges[k + 1]) for k in range(heads) if edges[k] < edges[k + 1]]
        for k, i, j in some:
            np.matmul(hh[i:j], p["ww"][k], out=g[i:j])
        softmax(g, weight)
        g[rows[:m], yy[:m] - c[:m] * CLASS] -= f4(weight)
        for k, i, j in some:
            np.matmul(hT[:, i:j], g[i:j], out=grad["ww"][k])
            np.matmul(g[i:j], back[k], out=more[i:j])
        dh[:m] += more
    full = np.zeros((steps_ * streams, HIDDEN), f4) if len(ok) < flat_y.size else np.empty((steps_ * streams, HIDDEN), f4)
    full[ok] = dh
    full = full.reshape(steps_, streams, HIDDEN)
    r, z = rz
    da, dn, carry, back = np.empty_like(a), np.empty_like(n), np.zeros((streams, HIDDEN), f4), np.ascontiguousarray(u.transpose(0, 2, 1))
    three = np.empty((3, streams, HIDDEN), f4)
    # the factors of the way back: of n's, z's and r's inputs
    to_n, to_z, to_r, rest = np.multiply(n, n), np.subtract(h0, n), np.subtract(1, r), np.subtract(1, z)
    np.subtract(1, to_n, out=to_n)
    to_n *= rest
    to_z *= z
    to_z *= rest
    to_r *= r
    to_r *= a[2]
    for t in range(steps_ - 1, -1, -1):
        d = full[t]
        d += carry
        np.multiply(d, to_n[t], out=dn[t])
        np.multiply(dn[t], to_r[t], out=da[0, t])
        np.multiply(d, to_z[t], out=da[1, t])
        np.multiply(dn[t], r[t], out=da[2, t])
        np.matmul(da[:, t], back, out=three)
        np.multiply(d, z[t], out=carry)
        for k in three:
            carry += k
        if not all_go_on[t]:
            carry *= keep[t]
    grad["u"] = np.matmul(h0.reshape(-1, HIDDEN).T, da.reshape(3, -1, HIDDEN)).transpose(1, 0, 2).reshape(HIDDEN, 3 * HIDDEN)
    da[2] = dn  # now by the inputs
    rows, grad["x"] = sums_by(x.ravel(), da)
    return grad, rows, h


def train_shard(p: dict, docs: Iterator[np.ndarray], v_top: int, heads: int, end: int) -> tuple[dict, int]:
    """Truncated backpropagation over whole documents, laid end to end in STREAMS streams."""
    p = {k: w.copy() for k, w in p.items()}
    f4 = np.float32
    g2 = {k: np.full_like(w, 5e-4) for k, w in p.items()}
    slow = {k: np.ones((w.shape[-2], 1), f4) for k, w in p.items() if k in ("wc", "ww")}
    for k, w in slow.items():  # biases start from counts and move less
        g2[k][..., -1, :], w[-1] = 1e-2, 0.5
    h, seen = None, 0
    for run, x, y in windows(docs, STREAMS, end):
        h = np.zeros((len(run), HIDDEN), f4) if h is None else h[run]
        tokens = int((y >= 0).sum())
        seen += tokens
        share = tokens / (WINDOW * STREAMS)
        grad, u, h = window_gradients(p, h, x, y, v_top, heads, end, 1 / (WINDOW * STREAMS))
        rate = f4(RATE * share)  # so that a few last tokens move little
        met = np.flatnonzero(np.bincount(y[(y >= 0) & (y < v_top)] // CLASS, minlength=heads))
        for k, g in grad.items():
            at = u if k == "x" else met if k == "ww" and len(met) < heads else ...  # the gradients of all others are 0
            if k == "ww" and at is met:
                g = g[met]
            if k != "x":
                np.clip(g, -0.5, 0.5, out=g)
            old = g2[k] if at is ... else np.take(g2[k], at, axis=0)
            old += g * g
            g *= rate * slow[k] if k in slow else rate
            g /= np.sqrt(old)
            if at is ...:
                p[k] -= g
            else:
                g2[k][at] = old
                p[k][at] = np.subtract(np.take(p[k], at, axis=0), g, out=g)
    return p, seen


class Slots:
    """word -> number; words without one get first + their surface class."""

    def __init__(self, words: list[bytes]):
        self.words, self.first = pa.array(words, pa.binary()), len(words)

    def of(self, words: pa.Array) -> np.ndarray:
        got = pc.index_in(words, value_set=self.words)
        out = got.fill_null(-1).to_numpy().astype(np.int64)
        rest = np.flatnonzero(out < 0)
        out[rest] = self.first + surfaces(words.take(pa.array(rest)))
        return out


def pack(p: dict) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype("<f4").tobytes()


def unpack(raw: bytes, like: dict) -> dict:
    flat, at, out = np.frombuffer(raw, "<f4"), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def averaged(parts: DataFrame) -> DataFrame:
    """(shard, weights, tokens): means by tokens, until at most 16 are left, however many shards there were."""

    def mean(table: pa.Table) -> pa.Table:
        total, acc = 0, None
        for w, t in zip(table["weights"], table["tokens"].to_pylist(), strict=True):
            x = np.frombuffer(w.as_py(), "<f4").astype(np.float64) * t
            acc = x if acc is None else acc + x
            total += t
        return pa.table({"shard": pa.array([table["shard"][0].as_py() // 16], pa.int64()), "weights": pa.array([(acc / max(total, 1)).astype("<f4").tobytes()], pa.binary()), "tokens": pa.array([total], pa.int64())})

    while parts.count() > 16:
        parts = stored(parts.groupBy(F.floor(F.col("shard") / 16)).applyInArrow(mean, "shard long, weights binary, tokens long"), "shards")
    return parts


def fit(docs: DataFrame, text: str, id_col: str) -> tuple[Vocabulary, dict, DataFrame]:
    """The vocabulary, the network's weights and the stored counts (word, n)."""
    counts = stored(token_counts(docs, text), "counts")
    head = counts.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()  # bounded by KNOWN
    pairs = list(zip(head["word"].to_pylist(), head["n"].to_pylist(), strict=True))
    known = dict(pairs)
    total, distinct, n_docs = (x or 0 for x in counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n")))).first())
    known[END] = n_docs
    top = [(w, n) for w, n in pairs[:VOCAB] if w != END]
    top.insert(0, (END, known.get(END, 0)))
    top_words = {w for w, _ in top}

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, slots = np.zeros(SURFACE), Slots(list(top_words))
        for b in batches:
            k = slots.of(b.column(0)) - slots.first
            sums += np.bincount(k[k >= 0], b.column(1).to_numpy()[k >= 0] + 0.1, SURFACE)
        yield pa.RecordBatch.from_arrays([pa.array(range(SURFACE), pa.int32()), pa.array(sums)], names=["k", "m"])

    mass = [0.1] * SURFACE
    for r in counts.mapInArrow(masses, "k int, m double").groupBy("k").agg(F.sum("m").alias("m")).collect():
        mass[r.k] += r.m
    v = Vocabulary(top, known, total, distinct, mass)
    p0 = start_weights(v)
    shards = min(MOST_SHARDS, max(1, round(n_docs / SHARD_DOCS)))
    lot = F.pmod(F.xxhash64(id_col, F.lit("train")), F.lit(FIRST_ROUND))
    p = p0
    for mine in (lot == 0, lot != 0):
        p = round_of_training(docs.where(mine), p, v, shards, text, id_col)
    return v, p, counts


def round_of_training(docs: DataFrame, start: dict, v: Vocabulary, shards: int, text: str, id_col: str) -> dict:
    """The mean, by tokens, of the weights that the shards of docs learn from start; start if there are no docs."""
    top, n_top, heads, end = [w for w, _ in v.top], v.n_top, v.heads, v.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, slots = [None], Slots(top)

        def each() -> Iterator[np.ndarray]:
            for b in batches:
                if b.num_rows and shard[0] is None:
                    shard[0] = b.column(1)[0].as_py()
                ws, at, n = batch_words(b.column(0))
                ids = slots.of(ws).astype(np.int32)[at]
                for d in np.split(ids, np.cumsum(n)[:-1]) if len(n) else []:
                    yield np.append(d, np.int32(end))

        p, n = train_shard(start, each(), n_top, heads, end)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([shard[0]], pa.int64()), pa.array([pack(p)], pa.binary()), pa.array([n], pa.int64())], names=["shard", "weights", "tokens"])

    some = docs.select(F.col(text).alias("_t"), F.col(id_col).alias("_i"))
    order = F.coalesce(F.floor(F.log2(F.length("_t") + 1) / 2), F.lit(0))  # long ones first, so that no stream runs on alone
    # by text as well, so that rows of one id, or of none, don't all meet in one shard
    keyed = some.select("_t", "_i", order.alias("_o"), F.xxhash64("_i", F.lit("deal")).alias("_d"))  # once a row, not in each comparison
    dealt = keyed.repartition(shards, F.xxhash64("_i", "_t")).sortWithinPartitions(F.desc("_o"), "_d", "_i", "_t").select("_t", F.spark_partition_id().cast("long").alias("s"))
    parts = stored(dealt.mapInArrow(run, "shard long, weights binary, tokens long"), "shards")
    last = averaged(parts).collect()  # at most 16 rows
    if not last:
        return start
    weight = sum(r.tokens for r in last)
    mean = sum(np.frombuffer(r.weights, "<f4").astype(np.float64) * (r.tokens / weight) for r in last)
    return unpack(mean.astype("<f4").tobytes(), start)


LN10 = math.log(10)


def score_batch(p: dict, docs: list[np.ndarray], n_top: int, heads: int, end: int) -> np.ndarray:
    """log10 of the network's probabilities of whole documents, side by side, state carried throughout."""
    out = np.zeros(len(docs))
    order = np.argsort(-np.fromiter(map(len, docs), np.int64, len(docs)), kind="stable")
    for i in range(0, len(order), ABREAST):  # documents of about the same length
        out[order[i : i + ABREAST]] = score_abreast(p, [docs[k] for k in order[i : i + ABREAST].tolist()], n_top, heads, end)
    return out / LN10


def score_abreast(p: dict, docs: list[np.ndarray], n_top: int, heads: int, end: int) -> np.ndarray:
    """Natural logs of the probabilities of documents, longest first."""
    lengths = np.array([len(d) for d in docs])
    out, n = np.zeros(len(docs)), len(docs)
    f4 = np.float32
    h, gates, u, k = np.zeros((n, HIDDEN), f4), None, parts(p["u"]), -1
    flat, starts = np.concatenate(docs), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    running = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # documents longer than t
    last, t = np.full(n, end), 0
    while t < len(running):
        # some steps at a time, so that what the words' probabilities are made of stays small
        stop = t + max(1, int(np.searchsorted(np.cumsum(running[t : t + HELD]), HELD, "right")))
        stop = min(stop, len(running))
        many = running[t:stop]
        at = np.concatenate([[0], np.cumsum(many)])
        doc = np.arange(at[-1]) - np.repeat(at[:-1], many)
        y = flat[starts[doc] + np.repeat(np.arange(t, stop), many)]
        x = inputs(p["x"], np.concatenate([last[: many[0]], y[doc_before(many, at)]]))
        hs = np.empty((len(y), HIDDEN), f4)
        edges = at.tolist()
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if j - i != k:
                k = j - i
                gates = [np.empty((m, k, HIDDEN), f4) for m in (3, 2, 1)]
            cell(u, h[:k], x[:, i:j], *gates[:2], gates[2][0], hs[i:j])
            h = hs[i:j]
        out += np.bincount(doc, log_probs(p, hs, y, n_top, heads), n)
        last, t = y[edges[-2] :], stop
    return out


def doc_before(many: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the rows of all steps but the first, the places of the same documents' rows one step before."""
    return np.arange(at[1], at[-1]) - np.repeat(many[:-1], many[1:])


def scored(docs: DataFrame, v: Vocabulary, p: dict, counts: DataFrame, text: str, id_col: str) -> DataFrame:
    known, top, n_top, heads, end = v.known, [w for w, _ in v.top], v.n_top, v.heads, v.end
    n_words = len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of slots: the known words, then the surface classes of all others
        slots = Slots(list(known))
        net_id = np.concatenate([Slots(top).of(slots.words), n_top + np.arange(SURFACE)])
        log = np.concatenate([v.logs(list(known.values())), np.zeros(SURFACE)])
        share = np.where(net_id < n_top, 0.0, log - np.log10(np.append(v.mass, 1.0))[np.maximum(net_id - n_top, -1)])
        last = list(known).index(END)
        pool: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids = [d for x in pool for d in x[-1]]
            net = score_batch(p, ids, n_top, heads, end)
            columns = [pa.concat_arrays([x[k] for x in pool]) for k in range(7)]
            pool.clear()
            net += columns[4].to_numpy()
            rid = pa.array(np.frombuffer(os.urandom(8 * len(ids)), "<i8"))
            return pa.RecordBatch.from_arrays([columns[0], rid, *columns[1:4], pa.array(net), *columns[5:7]], names=["doc_id", "rid", "n_tokens", "n_known", "base", "score", "words", "ns"])

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ws, which, n = batch_words(batch.column(1))
            at = slots.of(ws)[which]
            doc = np.repeat(np.arange(len(n)), n)
            total = lambda x: np.bincount(doc, x, len(n))  # noqa: E731, B023
            rare = np.flatnonzero(at >= n_words)
            pairs, times = np.unique(doc[rare] * max(1, len(ws)) + which[rare], return_counts=True)
            lists = np.searchsorted(pairs, np.arange(len(n) + 1) * max(1, len(ws)))
            names = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), ws.take(pa.array(pairs % max(1, len(ws)))))
            ns = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(times.astype(np.int32)))
            n_known = total((at < n_words).astype(float)).astype(np.int64) + (known[END] > 0)
            ids = [np.append(d, np.int32(end)) for d in np.split(net_id[at].astype(np.int32), np.cumsum(n)[:-1])]
            pool.append((batch.column(0), pa.array(n + 1), pa.array(n_known), pa.array(total(log[at]) + log[last]), pa.array(total(share[at]) + share[last]), names, ns, ids))
            held += len(at) + len(n)
            if held > SIDE_BY_SIDE:
                yield out()
                held = 0
        if pool:
            yield out()

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_t"))
    zero = F.lit(0).cast("long")
    schema = base.select("doc_id", zero.alias("rid"), zero.alias("n_tokens"), zero.alias("n_known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("score"), F.array().cast("array<binary>").alias("words"), F.array().cast("array<int>").alias("ns")).schema
    mine = stored(base.mapInArrow(run, schema), "scores")  # once: rid names a row
    rare = mine.select("doc_id", "rid", F.explode(F.arrays_zip("words", "ns")).alias("x")).select("doc_id", "rid", F.col("x.words").alias("word"), F.col("x.ns").alias("m"))
    c = F.coalesce("c", zero)
    log = F.col("m") * F.log10(c + 0.1)
    found = rare.join(counts.select("word", F.col("n").alias("c")).hint("shuffle_hash"), "word", "left").select("doc_id", "rid", zero.alias("n_tokens"), F.when(c > 0, F.col("m")).otherwise(0).cast("long").alias("n_known"), log.alias("base"), log.alias("score"))
    both = mine.select("doc_id", "rid", "n_tokens", "n_known", "base", "score").unionByName(found).groupBy("doc_id", "rid").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    return both.select("doc_id", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * v.denominator).alias("base_score"), "score")


def language_model(df: DataFrame, train: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Scores every row of df by what it learns from train."""
    v, p, counts = fit(train, text, id_col)
    return scored(df, v, p, counts, text, id_col)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    got = language_model(docs, docs.where(~held))
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
