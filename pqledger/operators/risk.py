"""Bill entries to scored findings: context, layers, attenuation, factors, score, band, recommendation, system score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from ..scratch import Scratch
from . import dims
from .cbom import any_in, attach_recommendations, keyed, lookup
from .numbering import numbered_within


def path_context(path: Column) -> dict[str, Column]:
    """What a path says of its finding."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return {"critical": any_in(low, dims.CRITICAL_HINTS), "internet": any_in(low, dims.INTERNET_HINTS)}


def scorable() -> Column:
    """The type of finding that an entry's category stands for; null where it can't be scored."""
    return lookup(dims.FINDING_TYPE, F.col("cbom_category"))


def context() -> dict[str, Column]:
    """Columns that scores read, from an entry's category and algorithm, `critical` and `internet`."""
    alg, cat, kind = F.upper(F.coalesce("algorithm", F.lit(""))), F.col("cbom_category"), scorable()
    purpose = F.when(cat.isin("Certificate", "Protocol"), "key_exchange").when(cat == "Hash Function", "integrity").when((cat == "Key") & alg.isin("ECDSA", "DSA", "ED25519"), "signing").otherwise("encryption")
    either = lambda a, b, c: F.when(F.col("critical"), a).when(F.col("internet"), b).otherwise(c)
    return {
        "finding_type": kind, "purpose": purpose, "key_is_long_lived": F.lit(False), "sensitivity": either("Critical", "High", "Moderate"), "device_class": F.lit("standard"),
        "internet_facing": F.col("internet"), "public_registry": F.lit(False), "third_party_api": F.lit(False), "data_lifetime_years": either(12.0, 6.0, 3.0),
        "migration_effort_years": lookup(dims.MIGRATION_YEARS, kind), "extra": F.lit(None).cast("map<string,string>"),
    }


def findings(occurrences: DataFrame) -> DataFrame:
    """One finding for each of cbom.occurrences() whose entry's category can be scored, with its context. Its id is the
    entry's with the occurrence's number in it: `i`, if numbered_occurrences() has given it, else counted where ids are read."""
    known = occurrences if "i" in occurrences.columns else occurrences.withColumn("i", F.row_number().over(Window.partitionBy("cbom_entry_id", "first_ord").orderBy("ord")) - 1)
    c = context()
    return known.where(scorable().isNotNull()).withColumns(path_context(F.col("file_path"))).select(
        F.concat_ws("_", "cbom_entry_id", F.col("i")).alias("finding_id"), c["finding_type"].alias("finding_type"), "algorithm", F.col("file_path").alias("location"), "key_size", "confidence",
        *[v.alias(k) for k, v in c.items() if k != "finding_type"], F.struct("first_ord", "ord").alias("ord"), "cbom_entry_id",
    )


def numbered_occurrences(occurrences: DataFrame, scratch: Scratch) -> DataFrame:
    """Occurrences with their number within their entry, from 0, by range partitions: an entry with most of the findings is
    numbered by many tasks."""
    return numbered_within(occurrences, ["cbom_entry_id", "first_ord"], [F.col("ord")], scratch, "i").withColumn("i", F.col("i") - 1)


def finding_groups(classified: DataFrame) -> DataFrame:
    """Findings that score alike, with their number n: what a score reads is the entry's category and algorithm and what the
    path says, so findings are counted by these in one pass, and only a few rows for each entry go on. ord is the first
    finding's; db_recommendation is the entry's."""
    by = ["_u", "_k", "_s"]
    lead = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "ord", "artifact_id", "algorithm", "key_size", "cbom_category")
    groups = keyed(classified).withColumns(path_context(F.col("file_path"))).groupBy(*by, "critical", "internet").agg(F.min(lead).alias("lead"), F.min("ord").alias("ord"), F.count("*").alias("n"))
    entry = Window.partitionBy(*by)  # four rows at most
    whole = groups.withColumns({"lead": F.min("lead").over(entry), "first_ord": F.min("ord").over(entry)})
    named = whole.select("critical", "internet", "n", F.struct("first_ord", "ord").alias("ord"), F.col("lead.artifact_id").alias("cbom_entry_id"), F.col("lead.algorithm").alias("algorithm"), F.when(~F.col("_u"), F.col("lead.key_size")).alias("key_size"), F.col("lead.cbom_category").alias("cbom_category"))
    advised = attach_recommendations(named.where(scorable().isNotNull())).withColumnRenamed("recommendation", "db_recommendation")
    return advised.withColumns(context()).drop("critical", "internet")


def conversion_counts(entries: DataFrame) -> DataFrame:
    ok = lookup(dims.FINDING_TYPE, F.col("cbom_category")).isNotNull()
    return entries.agg(F.coalesce(F.sum(F.when(ok, F.col("occurrence_count"))), F.lit(0)).cast("long").alias("converted"), F.coalesce(F.sum(F.when(~ok, F.col("occurrence_count"))), F.lit(0)).cast("long").alias("skipped"))


def tolerant(df: DataFrame) -> DataFrame:
    """Bad enum values become their defaults."""
    ok = {"purpose": (["encryption", "signing", "key_exchange", "integrity"], "encryption"), "sensitivity": (list(dims.SENSITIVITY), "Moderate"), "device_class": (["standard", "constrained"], "standard")}
    return df.withColumns({c: F.when(F.col(c).isin(v), F.col(c)).otherwise(d) for c, (v, d) in ok.items()})


def algorithm_class(alg: Column) -> Column:
    """pqc, shor or grover by substring, in this order; unknown and null count as shor."""
    low = F.lower(F.coalesce(alg, F.lit("")))
    return F.when(any_in(low, dims.PQC), "pqc").when(any_in(low, dims.SHOR), "shor").when(any_in(low, dims.GROVER), "grover").otherwise("shor")


def layer(kind: Column) -> Column:
    return F.coalesce(lookup(dims.LAYER, kind), F.lit("in_use"))


def band(score: Column) -> Column:
    out = F
    for top, name in dims.BANDS:
        out = out.when(score <= top, name)
    return out.otherwise("critical")


def time_factor(lifetime: Column, effort: Column, steepness: float = 2.0) -> Column:
    left = max(dims.QUANTUM_YEAR - dims.CURRENT_YEAR, 0.1)
    return 1 / (1 + F.exp(-steepness * ((lifetime + effort) / left - 1)))


def factors(df: DataFrame) -> DataFrame:
    """Adds f_time, f_migration, f_sensitivity, f_exposure, f_compliance, alpha and beta."""
    effort = F.coalesce("migration_effort_years", lookup(dims.MIGRATION_YEARS, F.col("finding_type")), F.lit(dims.DEFAULT_MIGRATION_YEARS))
    life = F.coalesce("data_lifetime_years", F.lit(dims.DEFAULT_LIFETIME_YEARS))
    on = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(False)), v).otherwise(0.0)
    cls = algorithm_class(F.col("algorithm"))
    return df.withColumns({
        "f_time": time_factor(life, effort), "f_migration": F.least(effort / 3.0, F.lit(1.0)), "f_sensitivity": lookup(dims.SENSITIVITY, F.col("sensitivity")),
        "f_exposure": F.least(on("internet_facing", 0.6) + on("public_registry", 0.3) + on("third_party_api", 0.3), F.lit(1.0)),
        "f_compliance": F.coalesce(F.try_element_at("extra", F.lit("compliance_score")).try_cast("double"), F.lit(0.0)),
        "algorithm_class": cls, "alpha": lookup({k: v[0] for k, v in dims.ATTENUATION.items()}, cls), "beta": lookup({k: v[1] for k, v in dims.ATTENUATION.items()}, cls),
    })


def weights_of(profile: str | None = None, weights: tuple[float, ...] | None = None) -> tuple[float, ...]:
    """A named profile or own weights, not both; own ones must add up to 1."""
    if profile and weights:
        raise ValueError("a profile or weights, not both")
    w = weights or dims.WEIGHTS[profile or "default"]
    if abs(sum(w) - 1) > 1e-6 or len(w) != 5:
        raise ValueError("five weights that add up to 1")
    return w


def score(df: DataFrame, profile: str | None = None, weights: tuple[float, ...] | None = None) -> DataFrame:
    """Adds the risk struct; the band is that of the unrounded score."""
    t, m, s, e, c = weights_of(profile, weights)
    f = factors(tolerant(df))
    raw = t * F.col("alpha") * F.col("f_time") + m * F.col("alpha") * F.col("f_migration") + s * F.col("beta") * F.col("f_sensitivity") + e * F.col("beta") * F.col("f_exposure") + c * F.col("f_compliance")
    f = f.withColumn("_raw", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    r4 = lambda n: exact_round(F.col(n), 4)
    risk = F.struct(layer(F.col("finding_type")).alias("layer"), (F.col("algorithm_class") == "shor").alias("shor_vulnerable"), F.struct("alpha", "beta").alias("attenuation"), F.struct(*[r4(f"f_{n}").alias(n) for n in ("time", "migration", "sensitivity", "exposure", "compliance")]).alias("factors"), r4("_raw").alias("layer_score"), band(F.col("_raw")).alias("band"))
    return f.withColumn("risk", risk).drop("_raw", "algorithm_class", "alpha", "beta", *[f"f_{n}" for n in ("time", "migration", "sensitivity", "exposure", "compliance")])


def recommend(df: DataFrame) -> DataFrame:
    """Adds the post-quantum recommendation of scored findings."""
    c = F.col
    safe = (c("risk.attenuation.alpha") == 0) & (c("risk.attenuation.beta") == 0)
    kem = c("purpose").isin("key_exchange", "encryption")
    long_ = (c("purpose") == "signing") & F.coalesce("key_is_long_lived", F.lit(False))
    tier = F.when(c("risk.band").isin("high", "critical"), "strong").when(c("device_class") == "constrained", "light").otherwise("standard")
    primary = F.when(kem, lookup(dims.KEM_LADDER, tier)).when(long_, F.format_string("SLH-DSA (SLH-DSA-128s equivalent tier: %s)", tier)).otherwise(lookup(dims.SIGNATURE_LADDER, tier))
    fallback = F.when(kem, "Hybrid X25519 + ML-KEM-1024 (classical+PQC diversification)").otherwise(F.concat(F.when(long_, "ML-DSA").otherwise("SLH-DSA"), F.lit(" (different mathematical family for diversification)")))
    reason = F.concat_ws(" + ", F.concat("risk.band", F.lit(" risk band")), F.when(c("internet_facing"), "internet-facing"), F.when(c("device_class") == "constrained", "constrained device"))
    years = c("migration_effort_years")
    effort = F.when(years.isNull(), "unknown").when(years <= 0.5, "low").when(years <= 1.5, "medium").otherwise("high")
    either = lambda a, b, n: F.when(safe, a).otherwise(b).alias(n)
    return df.withColumn("recommendation", F.struct(either(c("algorithm"), primary, "primary"), either(F.lit("none needed"), fallback, "fallback"), either(F.lit("already quantum-safe (PQC algorithm detected)"), reason, "reason"), either(F.lit("none"), effort, "est_migration_effort")))


def system_score(df: DataFrame) -> DataFrame:
    """One row: average over findings, the layer of the highest rounded average (first seen on ties) and all layers' averages.
    Rows are findings, or groups of n."""
    n = F.col("n") if "n" in df.columns else F.lit(1)
    by = df.groupBy(F.col("risk.layer").alias("layer")).agg(F.sum(F.col("risk.layer_score") * n).alias("s"), F.sum(n).alias("n"), F.min("ord").alias("first"))
    average = exact_round(F.col("s") / F.col("n"), 4)
    by = by.withColumn("avg", average)
    g = by.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min_by("layer", F.struct((-F.col("avg")).alias("a"), "first")).alias("priority_layer"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", "avg")))).alias("layer_scores"))
    return g.select(F.coalesce(average, F.lit(0.0)).alias("overall_score"), "priority_layer", "layer_scores", F.coalesce("n", F.lit(0)).alias("findings"))


def migration_phase() -> Column:
    return F.when(F.col("finding_type").isin(dims.HYBRID_TYPES) | F.coalesce(F.col("algorithm").isin(dims.HYBRID_ALGORITHMS), F.lit(False)), "Hybrid-ready").otherwise("Discover & Assess")


def recommendation_source() -> Column:
    """Where an entry's recommendation comes from."""
    return F.when(F.col("db_recommendation").isNull(), "none").when(F.col("algorithm") == "UNSPECIFIED", "category_fallback").otherwise("algorithm_map")


def phases(groups: DataFrame) -> DataFrame:
    """Phase and source of finding_groups()."""
    return groups.withColumns({"migration_phase": migration_phase(), "db_recommendation_source": recommendation_source()})


def merge_recommendations(scored: DataFrame, entries: DataFrame) -> DataFrame:
    """Left join to a finding's entry, with the source of its recommendation. Ids are short, so the entry's first finding
    names it as well."""
    e = entries.select(F.col("cbom_entry_id").alias("_e"), F.col("first_ord").alias("_o"), F.col("recommendation").alias("db_recommendation"), F.col("algorithm").alias("_a"))
    j = scored.join(e, (F.col("cbom_entry_id") == F.col("_e")) & (F.col("ord.first_ord") == F.col("_o")), "left")
    source = F.when(F.col("db_recommendation").isNull(), "none").when(F.col("_a") == "UNSPECIFIED", "category_fallback").otherwise("algorithm_map")
    return j.select(*scored.columns, migration_phase().alias("migration_phase"), "db_recommendation", source.alias("db_recommendation_source"))
