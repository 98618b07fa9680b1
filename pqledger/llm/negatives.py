"""Hard-negative mining by an exact, norm-bucketed search over integer inner products.

Candidates are sorted by norm and dealt to norm buckets, the longest vectors first; a bucket is cut into cells of bounded
size, and anchors meet the cells of a bucket only if the bucket can still matter to them: by Cauchy-Schwarz no inner product
exceeds |anchor| * (the bucket's greatest norm), so buckets under the lower limit of all of an anchor's windows, or under the
score of the k-th best so far, are left out. Two waves: the first bucket sets the running k-th scores, the others follow
where the bound lets them. Inside a cell the same bound ends the pass over candidates, which come by falling norm.

Positives are an anchor's best `positives` rows of its own label; each positive opens a window of scores relative to its
own, and the best `negatives` rows of other labels inside the window are returned. The search is exact.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part. Rows of null id may be
found but are no anchors; they come after all ids among equal scores. Anchors that repeat in id, label and vector count once;
an anchor's other rows are those of other ids, and candidates that repeat an id count each. Vectors are compared with those
of their own length only. Fewer positives or negatives than asked for give all there are; an anchor without positives and a
positive of negative score (an empty window) give no rows. An empty table gives an empty result. Columns but id, vector and
label aren't read. Scores beyond 64 bits are compared exactly within a cell and become the nearest long, and so do the
windows that they open.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import read

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A window in hundredths of the positive's score.
LOW, HIGH = 30, 90
BUCKETS = 16
#: Rows of a cell at least and at most, and anchors that meet a cell at once; bounds of memory, results don't depend on them.
CELL_LEAST, CELL_MOST, ANCHORS = 1024, 1 << 18, 1 << 14
#: Anchors and candidates of one product; the first product is small, so that running scores are there early.
BLOCK, CHUNK, FIRST = 256, 4096, 256
LONG = (1 << 63) - 1
#: Components beyond this are taken as this.
FAR = float(1 << 62)
#: For the rounding of norms.
SLACK = 1 + 1e-9


def matrix(lists: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1)


def exact(a: np.ndarray, b: np.ndarray, norm_a: float, norm_b: float):
    """A function that gives exact products of slices of a and b: sums of products never exceed the product of the norms."""
    most = norm_a * norm_b * SLACK
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    x, y = a.astype(kind), b.astype(kind)
    return lambda rows, cols: (x[rows] @ y[cols].T).astype(np.int64 if kind is not object else object)


def best(row: np.ndarray, score: np.ndarray, pick: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: highest score, then smallest id, then first."""
    if score.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[pick[i]], i)), np.int64)
    else:
        order = np.lexsort((ids[pick], -score, row))
    r = row[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[place < k]


def padded(lists: list[list[int]], empty: int) -> np.ndarray:
    """Rows of one length; anchors with fewer windows get empty ones."""
    n = max(map(len, lists))
    return np.array([x + [empty] * (n - len(x)) for x in lists], np.int64).reshape(len(lists), n)


def search(left: pa.Table, right: pa.Table, k: int, same: bool) -> pa.Table:
    """One cell: for each anchor of left and each of its windows (low, high, and least: the lowest score that can still
    matter) the k best rows of right, of the anchor's label (same) or of others."""
    names = pa.schema([("a", pa.int64()), ("w", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    na, nb = left.num_rows, right.num_rows
    if not na or not nb or not len(right["q"][0]):
        return names.empty_table() if not na or not nb else zeros(left, right, k, same, names)
    right = right.take(pa.array(np.argsort(-right["norm"].to_numpy(), kind="stable")))
    a, b = matrix(left["q"], na), matrix(right["q"], nb)
    norm_a, norm_b = left["norm"].to_numpy(), right["norm"].to_numpy()
    product = exact(a, b, norm_a.max(), norm_b[0])
    none = right["vec_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    ids = np.where(none, LONG, right["vec_id"].combine_chunks().fill_null(0).to_numpy())
    label_a, label_b, own = left["label"].to_numpy(), right["label"].to_numpy(), left["vec_id"].to_numpy()
    low, high, least = (padded(left[c].to_pylist(), x) for c, x in (("low", 1), ("high", 0), ("least", 1)))
    open_, least = low <= high, np.maximum(low, least)
    out = []
    for i in range(0, na, BLOCK):
        rows = np.arange(i, min(na, i + BLOCK))
        held = [(np.zeros(0, np.int64), least[:0, 0], np.zeros(0, np.int64)) for _ in range(low.shape[1])]  # rows, scores, picks
        floor = least[rows].copy()
        j = 0
        while j < nb:
            cols = np.arange(j, min(nb, j + (CHUNK if j else FIRST)))
            reach = norm_a[rows] * norm_b[j] * SLACK + 1
            live = np.flatnonzero((open_[rows] & (floor <= reach[:, None])).any(1))
            if not len(live):
                break  # all that follow are shorter
            s = product(rows[live], cols)
            alike = label_a[rows[live], None] == label_b[None, cols]
            fit = alike & (own[rows[live], None] != ids[None, cols]) | alike & none[None, cols] if same else ~alike
            for w in range(low.shape[1]):
                r, c = np.nonzero(fit & (s >= floor[live, w, None]) & (s <= high[rows[live], w, None]))
                if len(r):
                    before = held[w]
                    row, score, pick = (np.concatenate(x) for x in zip(before, (live[r], s[r, c], cols[c]), strict=True))
                    keep = best(row, score, pick, ids, k)
                    row, score, pick = row[keep], score[keep], pick[keep]
                    held[w] = row, score, pick
                    full = np.flatnonzero(np.bincount(row, minlength=len(rows)) == k)
                    last = np.searchsorted(row, full, "right") - 1
                    floor[full, w] = np.maximum(floor[full, w], score[last])
            j = int(cols[-1]) + 1
        out += [(rows[row], np.full(len(row), w), pick, score) for w, (row, score, pick) in enumerate(held)]
    return found(left, right, out, names)


def zeros(left: pa.Table, right: pa.Table, k: int, same: bool, names: pa.Schema) -> pa.Table:
    """search() for vectors without components: all scores are 0."""
    one = pa.array([[0]] * right.num_rows, pa.list_(pa.int16()))
    wide = lambda t, q: t.set_column(t.column_names.index("q"), "q", q)
    return search(wide(left, pa.array([[0]] * left.num_rows, pa.list_(pa.int16()))), wide(right, one), k, same)


def found(left: pa.Table, right: pa.Table, out: list, names: pa.Schema) -> pa.Table:
    row, w, pick, score = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4))
    if score.dtype == object:
        score = np.array([max(-LONG - 1, min(LONG, int(x))) for x in score], np.int64)
    take = lambda t, c, at: t[c].combine_chunks().take(pa.array(at.astype(np.int64)))
    return pa.Table.from_arrays([take(left, "a", row), pa.array(w.astype(np.int32)), take(right, "a", pick), take(right, "vec_id", pick), pa.array(score.astype(np.int64))], schema=names)


FOUND = "a long, w int, row long, vec_id long, score long"


def prepared(df: DataFrame, id_col: str, vector: str, label: Column, scale: int) -> DataFrame:
    """Rows that take part: vec_id, label, whole-numbered components q and their norm."""
    x = F.col(vector).cast("array<double>")
    sound = x.isNotNull() & label.isNotNull() & F.coalesce(F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False))  # NaN isn't less
    some = df.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-FAR)), F.lit(FAR)))).alias("q"))
    return some.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


def wave(candidates: DataFrame, anchors: DataFrame, stats: DataFrame, by: list[str], groups: int, k: int, same: bool) -> DataFrame:
    """Partial results of anchors (a, vec_id, label, d, q, norm, low, high, least) in the buckets of stats that they still
    need: each anchor goes to all cells of such a bucket, each candidate to one cell for each group of anchors."""
    bound = F.col("norm") * F.col("longest") * SLACK + 1
    need = F.exists(F.arrays_zip("low", "high", "least"), lambda x: (x.low <= x.high) & (F.greatest(x.low, x.least) <= bound))
    dealt = anchors.join(stats, by).where(need).withColumn("g", F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int"))
    used = dealt.select(*by, "bucket", "cells", "g").distinct()
    mine = dealt.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells", "longest")
    theirs = candidates.join(used, [*by, "bucket"]).withColumn("cell", F.pmod(F.xxhash64("a"), F.col("cells")).cast("int"))
    keys = list(dict.fromkeys([*by, "bucket", "cell", "g"]))
    # a cell's key columns by other names, as both sides hold label themselves
    named = lambda df, cols: df.select(*[F.col(c).alias(f"_{c}") for c in keys], *cols)
    left = named(mine, ["a", "vec_id", "label", "q", "norm", "low", "high", "least"])
    right = named(theirs, ["a", "vec_id", "label", "q", "norm"])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return search(x, y, k, same)

    cells = [f"_{c}" for c in keys]
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(run, FOUND)


def top(partial: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their place."""
    w = Window.partitionBy("a", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return partial.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def both_waves(candidates: DataFrame, anchors: DataFrame, stats: DataFrame, by: list[str], groups: int, k: int, same: bool, scratch: Scratch, name: str) -> DataFrame:
    head = stats.groupBy(*by).agg(F.min("bucket").alias("bucket"))
    first = scratch.store(top(wave(candidates, anchors, stats.join(head, [*by, "bucket"]), by, groups, k, same), k), f"{name}1")
    # least: the k-th score so far, where there are k
    kth = first.where(F.col("place") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))  # an entry for each window
    raised = anchors.join(kth, "a", "left").withColumn("least", F.transform("least", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w.cast("int")), x)))).drop("kth")
    rest = stats.join(head, [*by, "bucket"], "left_anti")
    second = wave(candidates, raised, rest, by, groups, k, same)
    out = scratch.store(top(first.drop("place").unionByName(second), k), name)
    scratch.drop(f"{name}1")
    return out


def mined(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. is_anchor reads vec_id and label."""
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = prepared(df, id_col, vector, F.col("label") if label is None else label, scale)
    size = F.greatest(F.abs(F.coalesce(F.array_max("q"), F.lit(0))), F.abs(F.coalesce(F.array_min("q"), F.lit(0))))
    cuts = [i / buckets for i in range(1, buckets)]
    about = rows.agg(F.count("*").alias("n"), F.max(size).alias("most"), F.count_if(is_anchor & F.col("vec_id").isNotNull()).alias("anchors"), F.percentile_approx("norm", cuts, 1000).alias("cuts")).first()
    kind = "smallint" if (about.most or 0) < 1 << 15 else "int" if about.most < 1 << 31 else "bigint"
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(about.cuts or []))]).cast("array<double>"), lambda c: c > F.col("norm")))
    whole = rows.withColumns({"q": F.col("q").cast(f"array<{kind}>"), "d": F.size("q"), "bucket": bucket, "a": F.monotonically_increasing_id()})
    table = scratch.store(whole, "rows")  # numbered once, in a table
    cell = max(CELL_LEAST, min(CELL_MOST, math.ceil(about.n / int(spark.conf.get("spark.sql.shuffle.partitions")))))
    groups = max(1, math.ceil(about.anchors / ANCHORS))
    once = table.where(is_anchor & F.col("vec_id").isNotNull()).groupBy("vec_id", "label", "d", "q", "norm").agg(F.min("a").alias("a"))
    anchors = scratch.store(once, "anchors")

    def stats(*by: str) -> DataFrame:
        return table.groupBy(*by, "bucket").agg(F.max("norm").alias("longest"), F.ceil(F.count("*") / cell).cast("int").alias("cells"))

    one = lambda x: F.array(F.lit(x).cast("long"))
    free = anchors.withColumns({"low": one(-LONG - 1), "high": one(LONG), "least": one(-LONG - 1)})
    alike = both_waves(table, free, stats("d", "label"), ["d", "label"], groups, positives, True, scratch, "positives")
    scores = alike.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # at most `positives` each
    decimal = lambda s, share: s.cast("decimal(19,0)") * share
    windows = {
        "low": F.transform("p", lambda x: F.ceil(decimal(x.score, low) / 100).cast("long")), "high": F.transform("p", lambda x: F.floor(decimal(x.score, high) / 100).cast("long")),
    }
    asked = scratch.store(anchors.join(scores, "a").withColumns(windows).withColumn("least", F.col("low")).drop("p"), "asked")
    other = both_waves(table, asked, stats("d"), ["d"], groups, negatives, False, scratch, "negatives")
    named = alike.select("a", (F.col("place") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = other.join(named, ["a", "w"]).join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


ORACLE = {
    "op13_hard_negatives": f"""
with e as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * x::double) as bigint)) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 r as materialized (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, q from e),
 a as (select min(r) as a, vec_id, label, q from r where vec_id % 100 = 0 group by all),
 s as materialized (select a.a, a.vec_id as anchor_id, r.r, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.q::double[], r.q::double[]) as bigint) as score from a, r
  where len(a.q) = len(r.q) and (a.label <> r.label or a.vec_id is distinct from r.vec_id)),
 p as (select *, row_number() over (partition by a order by score desc, vec_id nulls last, r) as w from s where same),
 n as (select p.a, p.w, p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
   row_number() over (partition by p.a, p.w order by s.score desc, s.vec_id nulls last, s.r) as rank from p join s on p.a = s.a and not s.same
   and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score where p.w <= {POSITIVES})
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
}
