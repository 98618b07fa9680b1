"""Target-distribution importance resampling: documents drawn by how much likelier their n-grams are in a target's texts.

Words are runs of digits, letters a to z (A to Z lower-cased) and all code points from U+0080; features are single words and
pairs of neighbours, hashed to 10,000 buckets by crc32. A bucket's gain is the log ratio of its smoothed shares in target and
corpus. Scoring explodes nothing: higher-order functions make each document's array of buckets and add up the elements of one
literal array of gains. Only bucket totals and the order of the draw are shuffled; the driver holds the 10,000 totals.

Null and empty texts have no features and weight 0. A null id is hashed as the empty text and comes after all ids among
equal scores. Rows that repeat an id are judged one by one; equal rows get different ranks. An empty table gives an empty
result, an empty target gains from no features of its own, and columns but id and text are not read, whatever their names.
Texts are taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..scratch import Scratch
from .common import read

BUCKETS = 10_000
#: Documents of fewer words aren't drawn, and of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: What separates words; a Java pattern.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of the whole text. ASCII texts are lower-cased at once, others letter by letter, as only A to Z change."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def buckets(words: Column, n: int = BUCKETS) -> Column:
    """The bucket of each word and of each pair of neighbours, repeats counted."""
    of = lambda s: F.crc32(s.cast("binary")) % n
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: of(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(words, of), F.filter(pairs, lambda x: x.isNotNull()))


def totals(df: DataFrame, text: str, n: int = BUCKETS) -> list[int]:
    """Features in each bucket; each task sends at most n sums."""
    got = df.select(words(F.col(text)).alias("w")).select(F.explode(buckets(F.col("w"), n)).alias("b")).groupBy("b").agg(F.count("*").alias("c")).collect()  # at most n rows
    out = [0] * n
    for r in got:
        out[r.b] = r.c
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, all_s, all_t = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus, target, strict=True)]


def weighed(df: DataFrame, gain: list[int], text: str = "text", id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row, in one projection."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal when planned
    zero = F.lit(0).cast("long")
    one = df.select(F.col(id_col).alias("doc_id"), words(F.col(text)).alias("_w"))
    two = one.select("doc_id", F.size("_w").cast("long").alias("n_words"), buckets(F.col("_w"), len(gain)).alias("_b"))
    total = F.aggregate("_b", zero, lambda sum_, b: sum_ + F.element_at(table, (b + 1).cast("int")))
    n = F.size("_b").cast("long")
    three = two.select("doc_id", "n_words", n.alias("n_features"), F.when(n == 0, zero).otherwise(floored(total, n)).alias("weight"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    part = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return three.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln(part))).cast("long"))


def floored(a: Column, b: Column) -> Column:
    """a / b rounded down, in whole numbers; b is positive."""
    return F.call_function("div", a - F.pmod(a, b), b)


def resampled(df: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Each row's doc_id, n_features, weight, score and rank; rank is null where it isn't drawn."""
    scratch = Scratch(df.sparkSession, "importance")
    gain = gains(totals(df, text), totals(target, target_text))
    fit = F.col("n_words") >= least_words
    # scored once and written: dealing by ranges reads its input twice
    scored = scratch.store(weighed(df, gain, text, id_col, seed).withColumn("_fit", fit), "scored")
    # rows that can't be drawn come last, so positions of the others are their ranks
    at = numbered(scored, [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("doc_id")], scratch, "rank")
    scratch.drop("scored")
    quota = at.where("_fit").count() * percent // 100
    taken = F.col("_fit") & (F.col("rank") <= quota)
    return at.select("doc_id", "n_features", "weight", "score", F.when(taken, F.col("rank")).alias("rank"), "n_words")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    poly = 0xEDB88320
    # the table of crc32, from its rule: eight halvings, each with the polynomial where a one falls out
    halved = "n"
    for _ in range(8):
        halved = f"list_transform({halved}, lambda c: case when c & 1 = 1 then xor(c >> 1, {poly}) else c >> 1 end)"
    table = f"list_transform(list_transform([range(0, 256)], lambda n: {halved}), lambda x: x)[1]"
    return rf"""
with d as materialized (select row_number() over () as r, 0 as side, doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') as t from documents
  union all select row_number() over (), 1, null, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') from benchmark),
 w as materialized (select r, side, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from d),
 f as materialized (select r, side, unnest(ws) as f from w union all select r, side, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w where len(ws) > 1),
 tb as materialized (select {table} as tb),
 u as (select f, hex(encode(f)) as h from (select distinct f from f)),
 k as materialized (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint)),
   lambda c, b: xor(c >> 8, tb[xor(c, b) % 256 + 1])), 4294967295) % {BUCKETS} as b from u, tb),
 n as materialized (select f.r, f.side, k.b, count(*) as c from f join k on f.f = k.f group by all),
 s as (select b, sum(c) filter (side = 0) as s, sum(c) filter (side = 1) as t from n group by b),
 a as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from s),
 g as (select b, cast(floor(1000 * ln((coalesce(s.t, 0) + 1.0::double) * (a.s + {BUCKETS}) / ((coalesce(s.s, 0) + 1.0::double) * (a.t + {BUCKETS})))) as bigint) as gain from s, a),
 m as (select n.r, sum(n.c) as n, sum(n.c * g.gain) as total from n join g on n.b = g.b where n.side = 0 group by n.r),
 e as (select w.r, w.doc_id, len(ws) as words, cast(coalesce(m.n, 0) as bigint) as n_features,
   cast(case when m.n is null then 0 else (m.total - ((m.total % m.n) + m.n) % m.n) // m.n end as bigint) as weight,
   ('0x' || substr(sha256('{SEED}:' || coalesce(w.doc_id::varchar, '')), 1, 8))::bigint as h from w left join m on w.r = m.r where w.side = 0),
 x as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from e),
 y as (select *, row_number() over (partition by words >= {LEAST_WORDS} order by score desc, doc_id nulls last) as place, count(*) filter (words >= {LEAST_WORDS}) over () as fit from x)
select doc_id, n_features, weight, score, case when words >= {LEAST_WORDS} and place <= fit * {PERCENT} // 100 then place end as rank, words as n_words from y"""


ORACLE = {"op11_importance_resampling": _oracle()}
