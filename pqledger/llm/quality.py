"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Null, empty or blank text has no words: all counts are 0 and base_failed is true. Repeated rows are each judged, the
order of rows doesn't matter, an empty table gives an empty result, and further columns, whatever they are named, are
not read. Null ids pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, read

#: Frequent function words of the supported languages; fixed values.
STOP_WORDS = {
    "en": "the of and to in is that it for with as was on are be this have from or an at by not but they which you were her all she there would their we him been has when who will no more if out so".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "le la les de des du et en un une que qui est pour dans sur par pas au plus avec ne se ce il elle son sont mais ou aux nous vous cette ses".split(),
    "es": "el la los las de del y en un una que es por para con no se su al lo como más pero sus le ha o este sí porque esta entre cuando".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Up to so many repeated hashes are looked up one by one; beyond, all windows are sorted. The result is the same.
FEW = 24

#: The base rules of every verdict, then the method's own; thresholds are parameters.
BASE_RULES = (Rule("few_words", "n_words", low=50), Rule("repeated_windows", "repeat_percent", high=50))
RULES = (
    Rule("word_length", "mean_word_chars", low=1.5, high=20),
    Rule("symbols", "symbols_per_word", high=0.5),
    Rule("stop_words", "stop_word_ratio", low=0.01),
    Rule("copied_lines", "dup_line_ratio", high=0.5),
    Rule("short_lines", "short_line_ratio", high=0.95),
)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that the text has twice or more: sort windows, mark neighbours, add up spans."""

    def covered(spans: Column) -> Column:
        # spans: sorted starts of repeated windows; each adds the words that the one before doesn't cover
        return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.at)).alias("n"), p.alias("at"))).n

    def marked(s: Column) -> Column:
        same = lambda j: F.when((j > 0) & (F.get(s, j - 1).g == F.get(s, j).g), True).otherwise(F.coalesce(F.get(s, j + 1).g == F.get(s, j).g, F.lit(False)))
        return covered(F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(j), x.i)), lambda x: x.isNotNull())))

    def windows(w: Column) -> Column:
        # equal windows have equal hashes: without equal hashes nothing repeats, and with a few only their windows are compared
        window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))
        starts = F.sequence(F.lit(0), F.size(w) - 3)

        def found(hashes: Column) -> Column:
            equal = F.when(F.size(F.array_distinct(hashes)) == F.size(w), F.array().cast("array<bigint>")).otherwise(let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j + 1)))))
            some = lambda e: F.filter(F.transform(hashes, lambda x, i: F.when((i < F.size(w) - 2) & F.array_contains(e, x), i)), lambda i: i.isNotNull())
            return let(equal, lambda e: F.when(F.size(e) == 0, F.lit(0)).otherwise(let(F.sort_array(F.transform(F.when(F.size(e) <= FEW, some(e)).otherwise(starts), window)), marked)))

        return let(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), found)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, windows))


def compiled(rules: tuple[Rule, ...], metrics: dict[str, Column]) -> Column:
    """The names of the rules that a row fails."""
    fails = [F.when(F.coalesce((metrics[r.metric] < r.low) if r.low is not None else F.lit(False), F.lit(False)) | F.coalesce((metrics[r.metric] > r.high) if r.high is not None else F.lit(False), F.lit(False)), F.lit(r.name)) for r in rules]
    return F.array_compact(F.array(*fails))


def quality_rules(df: DataFrame, text: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each input row: id, the counts, base_failed, kept and failed_rules (names)."""
    t = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    one = df.select(F.col(id_col).alias("doc_id"), t.alias("_t"), words_of(t).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    two = one.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(stop))).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda x: F.length(x) < 30)).cast("long").alias("n_short_lines"),
    )
    c = F.col
    per = lambda a, b: F.when(c(b) > 0, c(a) / c(b))
    metrics = {
        "n_words": c("n_words"), "repeat_percent": F.when(c("n_words") > 0, 100 * c("n_repeat_words") / c("n_words")),
        "mean_word_chars": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"), "short_line_ratio": per("n_short_lines", "n_lines"),
    }
    base = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    return two.select("*", base.alias("base_failed"), compiled(rules, metrics).alias("failed_rules")).withColumn("kept", ~c("base_failed") & (F.size("failed_rules") == 0))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))


def _oracle() -> str:
    stop = ",".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
 w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
 g as (select r, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
 h as (select r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as g from g),
 m as (select r, i from (select r, i, count(*) over (partition by r, g) as n from h) where n > 1),
 p as (select r, count(distinct j) as n from (select r, unnest([i, i+1, i+2]) as j from m) group by r),
 s as (select w.r, doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
   cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
   cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(p.n, 0) as bigint) as n_repeat_words,
   cast(len(list_filter(ws, lambda x: list_contains([{stop}], rtrim(lower(x), '.,;:!?')))) as bigint) as n_stop_words,
   cast(len(ls) as bigint) as n_lines, cast(len(list_filter(ls, lambda x: length(x) < 30)) as bigint) as n_short_lines
  from w left join p on w.r = p.r),
 b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
   array_to_string(list_filter([
    case when n_words > 0 and (word_chars / n_words < 1.5 or word_chars / n_words > 20) then 'word_length' end,
    case when n_words > 0 and n_symbols / n_words > 0.5 then 'symbols' end,
    case when n_words > 0 and n_stop_words / n_words < 0.01 then 'stop_words' end,
    case when n_lines > 0 and n_dup_lines / n_lines > 0.5 then 'copied_lines' end,
    case when n_lines > 0 and n_short_lines / n_lines > 0.95 then 'short_lines' end], lambda x: x is not null), ',') as failed_rules from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, n_short_lines, base_failed, failed_rules,
 not base_failed and failed_rules = '' as kept from b"""


ORACLE = {"op1_quality_rules": _oracle()}
