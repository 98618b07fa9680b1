"""Links near-duplicates: candidates from shared bands, exact verification, classes as connected components.

Every pair of texts that share a band counts, but pairs within a band's group are neither listed nor all verified:

1. Each text is compared with one other, the least id of its groups. Links join classes.
2. Groups that still hold several classes compare their members with one member of another class, twice.
3. In groups that are still mixed, a few members, the hubs, meet the members of other classes, then more of them, and at
   last all members outside a group's largest class do. A pair is made only in the first group that both share, and only if
   sizes and sketches allow the threshold's similarity. In a group of many near copies few hubs join most members, so that
   the pairs of later rounds, which are of different classes, stay about as many as there are members.

A sketch is the parity of a text's shingles by bit: bits in which two sketches differ are never more than shingles in
which the texts differ, whatever they have in common. So steps 1 and 2 cost about as many pairs as there are members, and
step 3 makes only pairs near the threshold; none that reaches it is missing, as the last round leaves out no member. Similarities are exact, from whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, Scratch, hashed_words, map_arrow, mix, shingles, steps

#: 64-bit words of a sketch.
SKETCH = 16
MAPS = [f"m{i}" for i in range(SKETCH)]
#: Pairs of one salt when a text's shingles are joined to its many partners.
SALT = 200
#: Rounds in which mixed groups are compared with one of their members.
STARS = 2
#: One member in so many is a hub, by rounds of step 3. The last round takes all.
HUBS = (4096, 256, 16, 1)


def tune_bands(threshold: float, recall: float = 0.999, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands, at most `most` hashes in all, reach the recall at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        miss = 1 - threshold**rows
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(miss)))) if miss > 0 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: str, k: int = 5) -> Bag:
    """The multiset of a text's k-word shingles, lower-cased: sorted hashes and their counts."""
    return np.unique(shingles(hashed_words([text]).h, k), return_counts=True)


def jaccard(a: Bag, b: Bag, weighted: bool) -> float:
    (ha, na), (hb, nb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(ha):
        return 0.0 if len(hb) else 1.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[at] == ha
    if weighted:
        low = int(np.minimum(na[same], nb[at[same]]).sum())
        return low / (int(na.sum()) + int(nb.sum()) - low)
    low = int(same.sum())
    return low / (len(ha) + len(hb) - low)


def tokens(h: np.ndarray, weighted: bool) -> np.ndarray:
    """The set that stands for shingles h: different ones, or for multisets each repeat as an element of its own. The Jaccard
    similarity of these sets is that of the texts."""
    u, n = np.unique(h, return_counts=True)
    if not weighted or len(u) == len(h):
        return u
    nth = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(np.repeat(u, n) + nth.astype(np.uint64) * GOLD), np.repeat(u, n))


def sketch(t: np.ndarray) -> np.ndarray:
    """The parity of tokens by bit, as SKETCH words."""
    bit = np.bincount((t >> np.uint64(8)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bit.astype(np.uint8), bitorder="little").view("<u8")


def may_reach(sx: Column, sy: Column, differ: Column, threshold: float) -> Column:
    """Whether sets of these sizes, with so many differing sketch bits, can be as similar as the threshold."""
    slack = 1e-6
    apart = (sx + sy) * ((1 - threshold) / (1 + threshold)) + slack
    return (F.least(sx, sy) + slack >= F.greatest(sx, sy) * threshold) & (differ <= apart)


def differing(x: str, y: str) -> Column:
    out = F.lit(0)
    for m in MAPS:
        out = out + F.bit_count(F.col(f"{x}{m}").bitwiseXOR(F.col(f"{y}{m}")))
    return out


def verified(pairs: DataFrame, items: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that reach the threshold. A set that many pairs need is copied by salt."""
    side = lambda x: items.select(F.col("id").alias(x), F.col("size").alias(f"s{x}"), *[F.col(m).alias(f"{x}{m}") for m in MAPS])
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(may_reach(F.col("sa"), F.col("sb"), differing("a", "b"), threshold))
    near = scratch.store(met.select("a", "b", "sa", "sb"), "near")
    need = near.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("n"))
    sets = items.select("id", "tokens")
    left = sets.join(need, sets.id == need.a).select("a", F.col("tokens").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    right = near.join(need, "a").withColumn("s", F.pmod(F.xxhash64("b"), F.col("n")).cast("int")).drop("n")
    both = right.join(left, ["a", "s"]).join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    same = F.size(F.array_intersect("ta", "tb"))
    return both.where(same / (F.col("sa") + F.col("sb") - same) >= threshold).select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, class_id) of all ids in edges (a, b); class_id is the least id that can be reached."""
    both = scratch.store(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = scratch.store(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("l")).select("id", F.least("id", "l").alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("l")), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("l", "m").alias("m"), "l")
        jump = labels.select(F.col("id").alias("m"), F.col("l").alias("r"))
        new = scratch.store(step.join(jump, "m", "left").select("id", F.least("m", F.coalesce("r", "m")).alias("l"), (F.least("m", F.coalesce("r", "m")) != F.col("l")).alias("moved")), "labels")
        labels = new.select("id", "l")
        if new.where("moved").isEmpty():
            scratch.drop("edges")
            return labels.withColumnRenamed("l", "class_id")


def merged(classes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes (id, class_id) after more links (a, b): only classes that a link joins are labelled anew."""
    of = lambda x: classes.select(F.col("id").alias(x), F.col("class_id").alias(f"c{x}"))
    both = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joint = components(both, scratch).toDF("class_id", "least")
    new = scratch.store(classes.join(joint, "class_id", "left").select("id", F.coalesce("least", "class_id").alias("class_id")), "classes")
    scratch.drop("labels", "near")
    scratch.sweep()
    return new


def mixed_groups(member: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, id, class_id) of the groups that hold several classes."""
    placed = member.select("bucket", "id").join(classes, "id")
    several = placed.groupBy("bucket").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).where("x <> y").select("bucket")
    return scratch.store(placed.join(several, "bucket", "left_semi"), "open")


def is_hub(id_: str, one_in: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(one_in)) == 0


def left_over(open_: DataFrame, items: DataFrame, threshold: float, one_in: int = 1) -> DataFrame:
    """(a, b) of different classes that share a group and may reach the threshold, each pair once; only those with a hub if
    one_in is over 1."""
    if one_in > 1:  # all groups of a hub are kept, so the first group that it shares is
        open_ = open_.join(open_.where(is_hub("id", one_in)).select("bucket").distinct(), "bucket", "left_semi")
    most = open_.groupBy("bucket", "class_id").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "class_id")).alias("most"))
    own = open_.groupBy("id").agg(F.collect_list("bucket").alias("groups"))  # as many as there are bands
    rows = open_.join(most.select("bucket", F.col("most.class_id").alias("largest")), "bucket").join(items.drop("tokens"), "id").join(own, "id")
    side = lambda x: [F.col("id").alias(x), F.col("class_id").alias(f"c{x}"), F.col("size").alias(f"s{x}"), F.col("groups").alias(f"g{x}"), *[F.col(m).alias(f"{x}{m}") for m in MAPS]]
    first = is_hub("id", one_in) if one_in > 1 else F.col("class_id") != F.col("largest")  # whom a pair is made from
    x = rows.where(first).select("bucket", *side("x"))
    y = rows.select(F.col("bucket").alias("same"), first.alias("both"), *side("y"))
    apart = (F.col("cx") != F.col("cy")) & (~F.col("both") | (F.col("x") < F.col("y")))
    less = lambda g: F.filter(g, lambda v: v < F.col("bucket"))
    met = x.join(y, (F.col("bucket") == F.col("same")) & apart & may_reach(F.col("sx"), F.col("sy"), differing("x", "y"), threshold) & ~F.arrays_overlap(less("gx"), less("gy")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def token_sets(items: DataFrame, weighted: bool, k: int) -> DataFrame:
    """(id, tokens, size, sketch words) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, 256, 1):
                w = hashed_words(batch.column(1))
                yield token_batch(batch.column(0), [tokens(shingles(w.h[a:b], k), weighted) for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)])

    return map_arrow(items.select("id", "text"), run, SETS)


SETS = "id long, tokens array<long>, size long, " + ", ".join(f"{m} long" for m in MAPS)


def token_batch(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    size = np.array([len(t) for t in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
    maps = np.array([sketch(t) for t in sets], np.uint64).reshape(-1, SKETCH).view(np.int64)
    return pa.RecordBatch.from_arrays([ids, lists, pa.array(size), *(pa.array(np.ascontiguousarray(maps[:, i])) for i in range(SKETCH))], names=["id", "tokens", "size", *MAPS])


def linked(buckets: DataFrame, items: DataFrame | Callable[[DataFrame], DataFrame], threshold: float, weighted: bool, k: int = 5, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, classes) of buckets (id, bucket), different rows: verified links (a, b) that make up the classes, and (id,
    class_id) of the ids that have one. items: (id, text); or the result of token_sets; or a function that gets a table of
    ids and gives their texts (id, text)."""
    spark = buckets.sparkSession
    scratch = scratch or Scratch(spark, "linkage")
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("rep"), F.max("id").alias("other")).where("rep <> other").select("bucket", "rep")
    member = scratch.store(buckets.join(shared, "bucket").select("bucket", "id", "rep"), "members")
    first = scratch.store(member.groupBy("id").agg(F.min("rep").alias("rep")), "first")
    scratch.sweep()
    ids = first.select("id")
    if not isinstance(items, DataFrame) or "tokens" not in items.columns:
        items = scratch.store(token_sets(items.join(ids, "id", "left_semi") if isinstance(items, DataFrame) else items(ids), weighted, k), "sets")
    classes = scratch.store(first.select("id", F.col("id").alias("class_id")), "classes")
    links = []

    def compare(pairs: DataFrame) -> DataFrame:
        links.append(scratch.store(verified(pairs, items, threshold, scratch), f"links{len(links)}"))
        return merged(classes, links[-1], scratch)

    classes = compare(first.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    open_ = mixed_groups(member, classes, scratch)
    for head in (F.min, F.max)[:STARS]:
        if open_.isEmpty():
            break
        heads = open_.groupBy("bucket").agg(head(F.struct("class_id", "id")).alias("h")).select("bucket", F.col("h.id").alias("a"), F.col("h.class_id").alias("ca"))
        classes = compare(open_.join(heads, "bucket").where("class_id <> ca").select("a", F.col("id").alias("b")).distinct())
        open_ = mixed_groups(open_, classes, scratch)  # groups are only ever less mixed
    for one_in in HUBS:
        if open_.isEmpty():
            break
        if one_in > 1 and open_.where(is_hub("id", one_in)).isEmpty():
            continue
        classes = compare(left_over(open_, items, threshold, one_in))
        if one_in > 1:
            open_ = mixed_groups(open_, classes, scratch)
    scratch.drop("members", "first", "sets", "open")
    several = classes.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    return reduce(DataFrame.unionByName, links), classes.join(several, "class_id", "left_semi").select("id", "class_id")
