"""Language ID by hierarchical discrimination: family first, then one-versus-one linear support vector machines.

Features are hashed byte n-grams (1 to 4) of the lower-cased text, white space joined, square-rooted and normalised.
Linear SVMs (one against the rest) choose the family; within it, a linear SVM for each pair of languages votes. Families
are a fixed table; a language that it doesn't name is a family of its own.

Null texts and texts without a letter get ``und`` and score 0. Rows with null language or null text aren't learned from.
With one learned language every text gets it; with none every text is ``und``. Repeated rows get equal results, null ids
pass through and count as not held out, further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, fold, read, sampled_texts, steps

#: Families of languages; fixed values.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "is"],
    "romance": ["es", "fr", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"],
    "uralic": ["fi", "hu", "et"],
}
FAMILY = {lang: f for f, ls in FAMILIES.items() for lang in ls}
#: Labelled documents that training takes at most; documented bound, the only sample.
TRAIN_DOCS = 4000
DIMS, GRAMS = 1 << 12, 4
EPOCHS, REGULAR = 8, 1e-4
UNKNOWN = "und"
#: Bytes that are hashed at a time; a memory bound only, pieces overlap so that no n-gram is lost.
PIECE = 1 << 20


def gram_buckets(raw: bytes) -> np.ndarray:
    """Buckets of all byte n-grams."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code, out = np.zeros(len(b), np.uint32), []
    for n in range(1, GRAMS + 1):
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        h = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(20))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def features(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        raw = (" " + " ".join(t.lower().split()) + " ").encode("utf-8", "ignore")
        for at in range(0, len(raw), PIECE):
            x[i] += np.bincount(gram_buckets(raw[at : at + PIECE + GRAMS - 1]), minlength=DIMS)
    np.sqrt(x, out=x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """A linear SVM for y of -1 and 1: averaged stochastic subgradients of the class-weighted hinge loss."""
    rng = np.random.default_rng(seed)
    w, b, avg, avg_b, n = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float64), 0.0, 0
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-6), 0.5 / max((y < 0).mean(), 1e-6))
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            p = order[at : at + 32]
            t += 1
            rate = 4.0 / (1 + 0.02 * t)
            m = y[p] * (x[p] @ w + b) < 1
            g = (y[p] * weight[p] * m / len(p)).astype(np.float32)
            w *= 1 - rate * REGULAR
            w += rate * (g @ x[p])
            b += rate * float(g.sum()) * 0.1
            if epoch >= EPOCHS // 2:
                avg += w
                avg_b += b
                n += 1
    return (avg / max(n, 1)).astype(np.float32), avg_b / max(n, 1)


class Model:
    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        family = {g: FAMILY.get(g, g) for g in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [g for g in self.langs if family[g] == f] for f in self.families}
        x, y = features(texts), np.array(langs, object)
        fam = np.array([family[g] for g in langs], object)
        names, weights, biases = [], [], []
        if len(self.families) > 1:
            for f in self.families if len(self.families) > 2 else self.families[:1]:
                names.append(("family", f, ""))
                w, b = svm(x, np.where(fam == f, 1.0, -1.0))
                weights.append(w)
                biases.append(b)
        for f in self.families:
            for one, two in combinations(self.members[f], 2):
                some = (y == one) | (y == two)
                names.append(("pair", one, two))
                w, b = svm(x[some], np.where(y[some] == one, 1.0, -1.0))
                weights.append(w)
                biases.append(b)
        self.names, self.w, self.b = names, np.array(weights, np.float32).reshape(-1, DIMS), np.array(biases)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not lettered or not self.langs:
            return langs, scores
        margins = features([texts[i] for i in lettered]) @ self.w.T + self.b
        sure = 1 / (1 + np.exp(-3 * margins))
        at = {n: k for k, n in enumerate(self.names)}
        for row, i in enumerate(lettered):
            p = {f: sure[row, at["family", f, ""]] if ("family", f, "") in at else None for f in self.families}
            if len(self.families) == 2:
                p[self.families[1]] = 1 - p[self.families[0]]
            fam = max(self.families, key=lambda f: p[f] or 0.0)
            total = sum(v for v in p.values() if v is not None)
            score = float(p[fam] / total) if total else 1.0
            own = self.members[fam]
            if len(own) > 1:
                votes = dict.fromkeys(own, 0.0)
                wins = dict.fromkeys(own, 0)
                for one, two in combinations(own, 2):
                    q = float(sure[row, at["pair", one, two]])
                    votes[one] += q
                    votes[two] += 1 - q
                    wins[one if q >= 0.5 else two] += 1
                best = max(own, key=lambda g: (wins[g], votes[g]))
                score *= votes[best] / (len(own) - 1)
            else:
                best = own[0]
            langs[i], scores[i] = best, min(1.0, max(0.0, score))
        return langs, scores


def fit(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", n: int = TRAIN_DOCS) -> Model:
    """Learns from a bounded sample of df, from which the caller has taken held-out rows."""
    rows = df.select(F.col(id_col).alias("_i"), F.col(text).alias("_t"), F.col(lang).alias("_g")).where("_i is not null and _t is not null and _g is not null")
    got = sampled_texts(rows, n).toArrow()
    rows = sorted(zip(got["_t"].to_pylist(), got["_g"].to_pylist(), strict=True))
    return Model([t for t, _ in rows], [g for _, g in rows])


def predict(df: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, STEP, 1):
                langs, scores = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    base = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_t"))
    return base.mapInArrow(run, base.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(fold("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
