"""The recurrent language model: gradients against differences, scores step by step, and documents streamed whole."""

import collections
import math
import time

import numpy as np
import pyarrow as pa
import pytest

from pqledger.llm import lm

WORDS = [f"w{i}".encode() for i in range(150)]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    counts = {w: int(n) for w, n in zip(WORDS, rng.integers(1, 50, len(WORDS)), strict=True)} | {lm.END: 20}
    top = [(lm.END, 20), *[(w, counts[w]) for w in WORDS[:100]]]
    v = lm.Vocabulary(top, counts, sum(counts.values()), len(counts), [0.1 + i for i in range(lm.SURFACE)])
    p = lm.start_weights(v)
    # away from the start, where much is zero
    p = {k: w + rng.normal(0, 0.3, w.shape).astype(np.float32) * (np.abs(w) < 50) for k, w in p.items()}
    return v, {k: w.astype(np.float32) for k, w in p.items()}


def log_softmax(x):
    x = x - x.max()
    return x - np.log(np.exp(x).sum())


def step(p, h, i):
    """One step of the cell as its formulas say, in doubles."""
    x, u, n = p["x"][i].astype(float), p["u"].astype(float), lm.HIDDEN
    a = h @ u
    r, z = (1 / (1 + np.exp(-(x[k * n : (k + 1) * n] + a[k * n : (k + 1) * n]))) for k in (0, 1))
    new = np.tanh(x[2 * n :] + r * a[2 * n :])
    return (1 - z) * new + z * h


def log_prob(v, p, h, i):
    one = np.append(h, 1.0)
    c = i // lm.CLASS if i < v.n_top else i - v.n_top + v.heads
    out = log_softmax(one @ p["wc"].astype(float))[c]
    return out + (log_softmax(one @ p["ww"][c].astype(float))[i - c * lm.CLASS] if i < v.n_top else 0.0)


def test_scores_step_by_step(model):
    v, p = model
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(1, v.n_top + lm.SURFACE, n), v.end).astype(np.int32) for n in (0, 1, 7, 40, 40, 300)]
    got = lm.score_batch(p, docs, v.n_top, v.heads, v.end)
    for d, s in zip(docs, got, strict=True):
        h, last, want = np.zeros(lm.HIDDEN), v.end, 0.0
        for i in d.tolist():
            h = step(p, h, last)
            want += log_prob(v, p, h, i)
            last = i
        assert abs(s - want / math.log(10)) < 1e-3 * max(1, abs(want))


def test_gradients_match_differences(model):
    v, p = model
    rng = np.random.default_rng(6)
    streams, steps = 5, 6
    y = rng.integers(0, v.n_top + lm.SURFACE, (steps, streams)).astype(np.int32)
    y[2, 1], y[4:, 3] = v.end, -1
    x = np.concatenate([np.full((1, streams), v.end, np.int32), np.where(y[:-1] >= 0, y[:-1], v.end)])
    h0 = rng.normal(0, 0.5, (streams, lm.HIDDEN)).astype(np.float32)

    def loss(q):
        total = 0.0
        for k in range(streams):
            h = h0[k].astype(float)
            for t in range(steps):
                h = step(q, h * (x[t, k] != v.end), x[t, k])
                if y[t, k] >= 0:
                    total -= log_prob(v, q, h, int(y[t, k]))
        return total * 0.1

    grad, rows, _ = lm.window_gradients(p, h0, x, y, v.n_top, v.heads, v.end, 0.1)
    full = np.zeros(p["x"].shape)
    full[rows] = grad["x"]
    grad = {**grad, "x": full}
    checked = 0
    for name, w in p.items():
        flat = np.argsort(-np.abs(grad[name]).ravel())
        for at in [*flat[:6].tolist(), *rng.integers(0, w.size, 4).tolist()]:
            q = {k: u.astype(float) for k, u in p.items()}
            place = np.unravel_index(at, w.shape)
            if abs(q[name][place]) > 50:
                continue
            q[name][place] += 1e-4
            up = loss(q)
            q[name][place] -= 2e-4
            assert abs((up - loss(q)) / 2e-4 - grad[name][place]) < 2e-3 * max(0.05, abs(grad[name][place])), (name, place)
            checked += 1
    assert checked > 30


@pytest.mark.parametrize("n, streams", [(0, 4), (1, 4), (3, 4), (40, 4), (500, 96)])
def test_windows_hold_every_token_once(n, streams):
    rng = np.random.default_rng(n)
    docs = sorted((np.append(rng.integers(1, 9, rng.integers(0, 70)), 0).astype(np.int32) for _ in range(n)), key=len, reverse=True)
    lanes, at, places = [], None, 0
    for run, x, y in lm.windows(iter(docs), streams, 0):
        at = list(range(len(run))) if at is None else [at[k] for k in run]
        lanes += [[] for _ in range(len(at) - len(lanes))] if not lanes else []
        for k, lane in enumerate(at):
            seen = y[:, k][y[:, k] >= 0].tolist()
            assert x[: len(seen), k].tolist() == [lanes[lane][-1] if lanes[lane] else 0, *seen[:-1]][: len(seen)]
            lanes[lane] += seen
        places += y.size
    text = [d for lane in lanes for d in "".join(map(str, lane)).split("0")[:-1]]
    assert sorted(text) == sorted("".join(map(str, d[:-1].tolist())) for d in docs)
    assert n < 100 or sum(map(len, docs)) > 0.8 * places  # streams end about together


def test_training_learns(model):
    v, _ = model
    rng = np.random.default_rng(8)
    docs = [np.append(np.tile([3, 7, 12, 40], 10), v.end).astype(np.int32) for _ in range(400)]
    p = lm.start_weights(v)
    trained, n = lm.train_shard(p, iter(docs), v.n_top, v.heads, v.end)
    assert n == sum(map(len, docs)) and rng is not None
    before, after = (lm.score_batch(q, docs[:1], v.n_top, v.heads, v.end)[0] for q in (p, trained))
    assert after > before / 3


def test_sums_by():
    rng = np.random.default_rng(9)
    ids = np.concatenate([rng.integers(0, 4, 40), np.arange(4, 20), [7]])
    g = rng.normal(size=(3, len(ids), lm.HIDDEN)).astype(np.float32)
    got_ids, got = lm.sums_by(ids, g)
    rows = g.transpose(1, 0, 2).reshape(len(ids), -1)
    assert got_ids.tolist() == sorted(set(ids.tolist()))
    assert np.allclose(got, [rows[ids == i].sum(0) for i in got_ids], atol=1e-5)


def test_stretches_hold_every_row_once():
    for edges, rows, n in (([0, 5, 5, 12, 30], 44, 8), ([0, 0, 0], 20, 8), ([0, 0, 3], 3, 8), ([0, 0], 0, 8), ([0, 2, 4], 30, 100)):
        got = list(lm.stretches(edges, rows, n))
        assert [i for a, b, _ in got for i in range(a, b)] == list(range(rows))
        assert [x for _, _, some in got for x in some] == [(k, edges[k], edges[k + 1]) for k in range(len(edges) - 1) if edges[k] < edges[k + 1]]
        assert all(a <= i and j <= b for a, b, some in got for _, i, j in some)


def test_counting_adds_up_before_it_passes_on(monkeypatch):
    """Counts of a task's words are added as arrays: no step for each word in Python, and the words of two batches meet."""
    taken = []

    class Frame:
        def __getattr__(self, name):
            return lambda *a: taken.append(a[0]) or self if name == "mapInArrow" else self

    monkeypatch.setattr(lm, "F", type("F", (), {"col": lambda x: Frame(), "sum": lambda x: Frame()}))
    lm.token_counts(Frame(), "t")
    texts = [["B a b", None, " a\tc "], ["", "a"], ["d"]]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["t"]) for x in texts]
    want = collections.Counter({b"a": 3, b"b": 2, b"c": 1, b"d": 1, lm.END: 6})
    for flush in (400_000, 1):  # one flush at the end, and many
        monkeypatch.setattr(lm, "FLUSH", flush)
        got = list(taken[0](iter(batches)))
        total = collections.Counter()
        for b in got:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[w] += n
        assert total == want and (flush == 1 or sum(b.num_rows for b in got) == len(want))
    assert not list(taken[0](iter([])))
    many = pa.array([" ".join(f"w{k}" for k in range(i, i + 20_000)) for i in range(0, 200_000, 20_000)])
    monkeypatch.setattr(lm, "FLUSH", 400_000)
    spent = {}
    for name, f in (("words", lambda b: lm.batch_words(b.column(0))), ("counts", lambda b: list(taken[0](iter([b]))))):
        start = time.process_time()
        for _ in range(3):
            f(pa.RecordBatch.from_arrays([many], names=["t"]))
        spent[name] = time.process_time() - start
    assert spent["counts"] < 4 * spent["words"]
