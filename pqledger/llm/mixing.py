"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A classifier learned from a labelled table (multinomial naive Bayes over counts of telling letters and of all others,
tempered to a fixed text length) gives each document its posteriors over domains. Documents' rates r minimise

    (s - target)' H^-1 (s - target) / 2 + ridge/2 * sum_d w_d (r_d - r0)^2,    s_k = sum_d w_d r_d p_dk

with w_d the document's share of all tokens and H = sum_d w_d p_d p_d' the metric in which a gradient step of length one
is exact while no bound holds, over r_d >= floor: projected gradient steps. One step needs only the K sums s_k, so each is
one aggregate over a narrow stored table, and the rate of a document is a fold over the steps' K-vectors.

Null, empty and blank texts have no tokens: their posteriors are the prior and they weigh nothing, but get a rate. Labelled
rows of null domain are ignored; several labels of one id all count. Without labelled rows, or with all weight in domains
that no document has, the rates stay at their start. Repeated rows each get a rate; null ids pass through. Target weights
are normalised; a domain that no label names can't be reached and is left out. Further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, read, stored

#: Letters whose counts are the features, besides the count of all other characters; fixed values.
LETTERS = "jkqwyzäöüßéèêçàñóíáú"
#: The text length to which counts are scaled before they become evidence: posteriors stay soft.
TEMPER = 400.0
STEPS, RIDGE = 12, 1e-3
#: Domains at most; what the driver holds is bounded by domains x letters and domains x domains.
MAX_DOMAINS = 64
TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}


def counts(text: Column) -> Column:
    """Letter counts of a text, as an array in the order of LETTERS."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # a letter of b bytes takes b bytes with each occurrence
    own = lambda t: F.array(*[((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit("")))) / len(c.encode())).cast("double") for c in LETTERS])
    return F.transform(F.array(low), lambda t: F.transform(F.array(own(t)), lambda n: F.array_append(n, F.length(t) - F.aggregate(n, F.lit(0.0), lambda a, x: a + x)))[0])[0]


def tokens(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(t, SPACE), lambda w: w != "")).cast("long")


def learn(rows: DataFrame, domains: list[str] | None = None) -> tuple[list[str], list[list[float]], list[float]]:
    """(domains, log P(letter | domain), log prior) from (domain, counts); one row for each domain reaches the driver."""
    features = range(len(LETTERS) + 1)
    sums = [F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in features]
    got = rows.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), *sums).orderBy("domain").limit(MAX_DOMAINS + 1).collect()
    if len(got) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    total = sum(r["n"] for r in got)
    logs = [[math.log((r[f"c{i}"] + 1) / (sum(r[f"c{j}"] for j in features) + len(features))) for i in features] for r in got]
    return [r["domain"] for r in got], logs, [math.log(r["n"] / total) for r in got]


def posteriors(model: tuple[list[str], list[list[float]], list[float]]) -> Column:
    """The posteriors of a row with counts, an array in the order of the domains."""
    _, logs, prior = model
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    scale = F.when(total > 0, F.least(F.lit(1.0), F.lit(TEMPER) / total)).otherwise(F.lit(0.0))
    weights = F.array(*[F.array(*map(F.lit, w)) for w in logs])
    raw = F.transform(weights, lambda w: F.aggregate(F.zip_with("counts", w, lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x))
    z = F.zip_with(raw, F.array(*map(F.lit, prior)), lambda r, p: r * scale + p)
    e = F.transform(F.array(z), lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))[0]
    return F.transform(F.array(e), lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))[0]


def rate(grads: list[list[float]], start: float, floor: float, ridge: float) -> Column:
    """The rate after steps of these K-vectors: r <- max(floor, r - (p . g + ridge (r - start)) / (1 + ridge))."""
    r = F.lit(start)
    if not grads:
        return r
    steps = F.array(*[F.array(*map(F.lit, g)) for g in grads])
    move = lambda r, g: F.greatest(F.lit(floor), r - (F.aggregate(F.zip_with("p", g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + ridge * (r - start)) / (1 + ridge))
    return F.aggregate(steps, r, move)


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """a^-1 b by elimination with pivots."""
    n = len(b)
    m = [[*row, x] for row, x in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(i + 1, n):
            f = m[r][i] / m[i][i]
            m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (m[i][n] - sum(m[i][j] * out[j] for j in range(i + 1, n))) / m[i][i]
    return out


def mixed(df: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str = "text", id_col: str = "doc_id", domain: str = "domain", floor: float = 0.0, budget: float = 1.0, steps: int = STEPS, ridge: float = RIDGE) -> DataFrame:
    """(doc_id, n_tokens, p, rate) of every row; labelled: (id, domain). budget: wanted tokens by tokens at hand; 0: the
    least budget with which no domain has to shrink."""
    base = df.select(F.col(id_col).alias("doc_id"), counts(F.col(text)).alias("counts"), tokens(F.col(text)).alias("n_tokens"))
    feats = stored(base, "letters")
    known = feats.join(labelled.select(F.col(id_col).alias("doc_id"), F.col(domain).cast("string").alias("domain")), "doc_id")
    model = learn(known)
    names = model[0]
    if not names:
        return feats.select("doc_id", "n_tokens", F.array().cast("array<double>").alias("p"), F.lit(float(max(1.0, floor))).alias("rate"))
    rows = stored(feats.select("doc_id", "n_tokens", posteriors(model).alias("p")), "posteriors")
    k = range(len(names))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0

    def masses(r: Column) -> list[float]:
        got = rows.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i] * r) for i in k]).first()
        return [(x or 0.0) / total for x in got]

    want = [max(0.0, targets.get(n, 0.0)) for n in names]
    if not total or not sum(want):
        return rows.withColumn("rate", F.lit(float(max(1.0, floor))))
    want = [w / sum(want) for w in want]
    natural = [max(m, 1e-12) for m in masses(F.lit(1.0))]
    second = rows.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]) for i in k for j in k]).first()
    metric = [[(second[i * len(names) + j] or 0.0) / total + (1e-9 if i == j else 0.0) for j in k] for i in k]
    if not budget:
        budget = max((m / w for m, w in zip(natural, want, strict=True) if w > 0), default=1.0)
    goal = [w * budget for w in want]
    start = max(floor, budget)
    grads: list[list[float]] = []
    for _ in range(steps):
        s = masses(rate(grads, start, floor, ridge))
        grads.append(solve(metric, [a - b for a, b in zip(s, goal, strict=True)]))
        if max(abs(a - b) for a, b in zip(s, goal, strict=True)) < 1e-4 * budget:
            break
    return rows.withColumn("rate", rate(grads, start, floor, ridge))


def labelled_by_lang(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Domains of labelled documents: their language where `labels` covers them."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    got = mixed(docs, labelled_by_lang(docs, read(spark, sf_dir, "labels")), TARGETS)
    return got.select("doc_id", "n_tokens", F.array_join(F.transform("p", lambda x: F.format_number(x, 6)), ",").alias("posteriors"), "rate")
