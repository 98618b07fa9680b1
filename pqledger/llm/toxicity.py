"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of a hashed table: of the word and of its first four and five letters.
Filters of several widths slide over the words, each is max-pooled over the whole text, and a logistic unit reads the
pools. Thresholds are calibrated by language, which is guessed from the text alone (frequent function words), and then
moved to a score of 0.5.

Null, empty and wordless texts get the score that the bias alone gives. Repeated rows get equal scores, whatever their
ids; null ids pass through and count as not held out. Labels that are null or not 0/1 are ignored; several labels of
one id count with their maximum. Without any label of both kinds every score is 0. Rows keep all their columns in
``flag``; result columns replace columns of the same name.
"""

from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE, STEP, bounded_sample, fold, map_arrow, read, release, sampled_texts, steps, texts
from .quality import STOP_WORDS

#: Labelled documents that training takes at most; documented bound, the only sample.
TRAIN_DOCS = 5000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 6, (1, 2, 3)
EPOCHS, BATCH, RATE = 7, 32, 0.1
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-+=/\\"


def _languages() -> dict[bytes, int]:
    """Function words that belong to one language only."""
    count: dict[str, set[str]] = {}
    for lang, ws in STOP_WORDS.items():
        for w in ws:
            count.setdefault(w, set()).add(lang)
    order = sorted(STOP_WORDS)
    return {w.encode(): order.index(next(iter(ls))) for w, ls in count.items() if len(ls) == 1}


LANGUAGE_WORDS = _languages()
N_LANG = len(STOP_WORDS) + 1  # the last: unknown


class Vocabulary(dict):
    """word -> row; rows[row] are the word's three buckets, 0 of them for padding; marks[row] is its language or -1."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.n, self.rows, self.marks = 1, np.zeros((1024, 3), np.int64), np.full(1024, -1)

    def __missing__(self, raw: bytes) -> int:
        word = raw.strip(EDGES)
        text = word.decode("utf-8", "ignore").lower()
        h = lambda s: xxhash.xxh3_64_intdigest(s) % (BUCKETS - 1) + 1
        row = self[raw] = self.n
        if row == len(self.rows):
            self.rows, self.marks = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.marks, np.full_like(self.marks, -1)])
        if text:
            self.rows[row] = h("w" + text), h("4" + text[:4]) if len(text) > 3 else 0, h("5" + text[:5]) if len(text) > 4 else 0
            self.marks[row] = LANGUAGE_WORDS.get(text.encode(), -1)
        self.n += 1
        return row


@dataclass
class Net:
    emb: np.ndarray  # buckets x dim; row 0 is zero
    conv: list[np.ndarray]  # for each width: width x dim x filters
    bias: np.ndarray  # all filters
    out: np.ndarray
    out_bias: float
    shift: np.ndarray  # for each language, what is taken from the logit

    def save(self) -> dict:
        return {"emb": self.emb.astype(np.float16), "conv": self.conv, "bias": self.bias, "out": self.out, "out_bias": self.out_bias, "shift": self.shift}

    @classmethod
    def load(cls, x: dict) -> Net:
        return cls(x["emb"].astype(np.float32), x["conv"], x["bias"], x["out"], x["out_bias"], x["shift"])

    def pools(self, rows: np.ndarray, starts: np.ndarray, full: bool = False):
        """rows: n x 3 buckets of all texts, each text followed by padding; starts: where texts begin."""
        x = self.emb[rows].sum(1)
        pools, where = [], []
        for k, w in enumerate(self.conv):
            n = len(x) - w.shape[0] + 1
            y = x[:n] @ w[0]
            for i in range(1, w.shape[0]):
                y += x[i : n + i] @ w[i]
            pools.append(np.maximum.reduceat(y, starts, axis=0))
            if full:
                ends = np.append(starts[1:], n)
                where.append(np.array([s + y[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)]))
        z = np.concatenate(pools, 1) + self.bias
        return (np.maximum(z, 0), z, where, x) if full else np.maximum(z, 0)

    def logits(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pools(rows, starts) @ self.out + self.out_bias


PAD = max(WIDTHS)


def laid_out(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of all texts with padding after each, and where texts begin."""
    flat: list[int] = []
    starts = []
    for d in docs:
        starts.append(len(flat))
        flat += d
        flat += [0] * PAD
    return np.array(flat, np.int64), np.array(starts, np.int64)


def languages(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text: the language of most function words; the last number if none."""
    doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(marks))))
    hit = marks >= 0
    votes = np.bincount(doc[hit] * N_LANG + marks[hit], minlength=len(starts) * N_LANG).reshape(-1, N_LANG)
    return np.where(votes.sum(1) > 0, votes.argmax(1), N_LANG - 1)


def train(samples: list[str], labels: list[int], seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    vocab = Vocabulary()
    docs = [list(map(vocab.__getitem__, t.encode().split())) for t in samples]
    table, marks = vocab.rows, vocab.marks
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    conv = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = Net(emb, conv, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, np.zeros(N_LANG, np.float32))
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out_bias = -50.0
        return net
    # the first dimension starts as the bucket's smoothed log-odds by documents: max-pooling then finds telling words at once
    df = np.zeros((2, BUCKETS))
    for d, label in zip(docs, labels, strict=True):
        df[label, np.unique(table[d])] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    emb[:, 0] = np.where(df.sum(0) > 0, odds / 4 * np.minimum(1, df.sum(0) / 4), 0)
    emb[0] = 0
    for w in conv:
        w[:, 0] = np.abs(w[:, 0])
    net.out = np.abs(net.out)
    g2 = {"emb": np.full(BUCKETS, 1e-3, np.float32), "conv": [np.full_like(w, 1e-2) for w in conv], "bias": np.full_like(net.bias, 1e-2), "out": np.full_like(net.out, 1e-2), "ob": 1e-2}
    held = rng.random(len(y)) < 0.2  # for calibration
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    fit = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for b in range(0, len(fit), BATCH):
            pick = fit[b : b + BATCH]
            flat, starts = laid_out([docs[i] for i in pick])
            rows = table[flat]
            h, z, where, x = net.pools(rows, starts, full=True)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30)))
            d = (p - y[pick]) * weight[pick] / len(pick)
            dz = np.outer(d, net.out) * (z > 0)
            grads = h.T @ d, float(d.sum()), dz.sum(0)
            at_rows, at_grads = [], []
            for k, (w, spots) in enumerate(zip(net.conv, where, strict=True)):
                dk = dz[:, k * FILTERS : (k + 1) * FILTERS]
                gw = np.zeros_like(w)
                for i in range(w.shape[0]):
                    xi = x[spots + i]  # docs x filters x dim
                    gw[i] = np.einsum("bf,bfd->df", dk, xi)
                    at_rows.append(rows[(spots + i).ravel()])
                    at_grads.append((dk[:, :, None] * w[i].T[None]).reshape(-1, DIM))
                g2["conv"][k] += gw**2
                w -= RATE * gw / np.sqrt(g2["conv"][k])
            g2["out"] += grads[0] ** 2
            net.out -= RATE * grads[0] / np.sqrt(g2["out"])
            g2["ob"] += grads[1] ** 2
            net.out_bias -= RATE * grads[1] / np.sqrt(g2["ob"])
            g2["bias"] += grads[2] ** 2
            net.bias -= RATE * grads[2] / np.sqrt(g2["bias"])
            r, g = np.concatenate(at_rows), np.concatenate(at_grads)
            for c in range(3):
                some = r[:, c] > 0
                u, inv = np.unique(r[some, c], return_inverse=True)
                total = np.zeros((len(u), DIM), np.float32)
                np.add.at(total, inv, g[some])
                g2["emb"][u] += (total**2).mean(1)
                net.emb[u] -= RATE * total / np.sqrt(g2["emb"][u])[:, None]
    # thresholds by language, on what training left out
    keep = np.flatnonzero(held)
    if len(keep):
        flat, starts = laid_out([docs[i] for i in keep])
        logits, lang = net.logits(table[flat], starts), languages(marks[flat], starts)
        general = best_threshold(logits, y[keep], 0.0)
        for k in range(N_LANG):
            own = lang == k
            net.shift[k] = best_threshold(logits[own], y[keep][own], general) if min((y[keep][own] == 0).sum(), (y[keep][own] == 1).sum()) >= 8 else general
    return net


def best_threshold(logits: np.ndarray, y: np.ndarray, default: float) -> float:
    """The middle of the gap of fewest errors; the widest such gap."""
    if len(set(y.tolist())) < 2:
        return default
    order = np.argsort(logits, kind="stable")
    s, t = logits[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([[0], np.cumsum(1 - t)])[-1] - np.concatenate([[0], np.cumsum(1 - t)])
    best = [i for i in np.flatnonzero(errors == errors.min()) if 0 < i < len(s)]
    if not best:
        return default
    i = max(best, key=lambda i: s[i] - s[i - 1])
    return float((s[i] + s[i - 1]) / 2)


def score_texts(net: Net, values: list[str], vocab: Vocabulary | None = None) -> np.ndarray:
    vocab = Vocabulary() if vocab is None else vocab
    if len(vocab) > CACHE:
        vocab.reset()
    get = vocab.__getitem__
    flat, starts = laid_out([list(map(get, t.encode().split())) for t in values])
    z = net.logits(vocab.rows[flat], starts) - net.shift[languages(vocab.marks[flat], starts)]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", label_id: str = "doc_id", n: int = TRAIN_DOCS) -> Net:
    """Trains on a bounded sample of labelled rows; the caller has taken held-out rows from labels."""
    y = labels.select(F.col(label_id).alias("_i"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1) and _i is not null").groupBy("_i").agg(F.max("_y").alias("_y"))
    picked = F.broadcast(bounded_sample(y, "_i", n))  # at most n rows
    rows = df.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(picked, "_i")
    got = sampled_texts(rows, n).toArrow()  # an id may have many texts
    order = sorted(zip(got["_t"].to_pylist(), got["_y"].to_pylist(), strict=True))  # the same model in every run
    net = train([t for t, _ in order], [y for _, y in order])
    del got, order
    release()  # the driver goes on without the sample
    return net


def flag(df: DataFrame, net: Net, text: str = "text", reject: bool = False) -> DataFrame:
    """All columns of df with score and predicted; with reject, only rows that aren't toxic, without the new columns."""
    cols = [c for c in df.columns if c not in ("score", "predicted")]
    base = df if reject else df.select(*[df[c] for c in cols])
    schema = base.schema if reject else base.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    packed_net = net.save()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocab = Net.load(packed_net), Vocabulary()
        for batch in batches:
            for part in steps(batch, STEP, text):
                s = score_texts(own, texts(part, text), vocab)
                if reject:
                    yield part.filter(pa.array(s < 0.5))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return map_arrow(base, run, schema)


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.where(fold("doc_id", 5) != 0)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, train_labels(read(spark, sf_dir, "labels")))
    got = flag(docs, net).select("doc_id", "score", "predicted")
    return got.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
