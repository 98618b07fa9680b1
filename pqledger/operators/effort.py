"""Migration effort: architecture class, weights, the three ratings, their weighted sum, and ratings of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from . import dims
from .cbom import lookup

HARDWARE = ["hsm", "embedded_iot", "firmware", "hardware"]


def flags(df: DataFrame) -> DataFrame:
    """One row of counts; everything else derives from it."""
    kind, method = F.col("artifact_type"), F.col("detection_method")
    hw, proto, db = kind.isin(HARDWARE), kind.isin("protocol", "packet_constraint"), kind == "database_crypto"
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    name = F.upper(F.coalesce("protocol", F.lit("")))
    return df.agg(
        F.count("*").alias("n"), yes(hw).alias("hardware"), yes(proto).alias("protocol"), yes(db).alias("database"), yes(~(hw | proto | db) | kind.isNull()).alias("software"), yes(kind == "packet_constraint").alias("packets"),
        yes(kind == "hsm").alias("hsm"), yes(kind.isin("embedded_iot", "firmware")).alias("iot"), yes(kind == "firmware").alias("firmware"), yes(method == "custom_crypto").alias("custom"),
        yes(F.upper("algorithm").isin(dims.LEGACY_ALGORITHMS)).alias("legacy"), yes(F.col("library").isin(dims.AGILE_LIBRARIES)).alias("agile"), yes(method.isin("ast_call", "semgrep", "treesitter_call", "c_ast_call")).alias("hardcoded"), yes(method.isin("config_directive", "api_pattern")).alias("configured"),
        yes(proto & name.isin(dims.LEGACY_PROTOCOLS)).alias("legacy_protocols"), yes(proto & name.isin(dims.MODERN_PROTOCOLS)).alias("modern_protocols"),
    )


def architecture() -> Column:
    c = F.col
    return F.when((c("hardware") > 0) & (c("software") > 0), "mixed").when(c("hardware") > 0, "hardware/IoT-centric").when((c("protocol") > 0) & (c("protocol") >= c("software")) & (c("packets") > 0), "network/protocol-centric").otherwise("software-centric")


def ratings(df: DataFrame) -> DataFrame:
    """One row: counts, architecture, weights, CA, DS, NP and m_tech. Empty input takes the fallbacks 3, 1 and 1."""
    c = F.col
    f = flags(df).withColumn("architecture", architecture())
    total = c("hardware") + c("protocol") + c("software")
    raw = [0.35 + 0.15 * c("software") / total, 0.20 + 0.35 * c("hardware") / total, 0.20 + 0.30 * c("protocol") / total]
    both = raw[0] + raw[1] + raw[2]
    fixed = lambda i: F.coalesce(*[F.when(c("architecture") == a, w[i]) for a, w in dims.EFFORT_WEIGHTS.items()])
    mixed = c("architecture") == "mixed"
    ca = F.when(c("n") == 0, 3).when((c("custom") > 0) | (c("firmware") > 0), 5).when(c("database") > 0, 5).when(c("legacy") > 0, 4).when(c("hardcoded") > 3, 3).when((c("agile") > 0) | (c("configured") > 0), F.when(c("hardcoded") > 0, 2).otherwise(1)).otherwise(2)
    ds = F.when(c("hardware") == 0, 1).when((c("hsm") > 1) | ((c("hsm") >= 1) & (c("iot") >= 1)), 5).otherwise(4)
    np_ = F.when(c("packets") > 0, F.when((c("iot") > 0) | (c("packets") > 1), 5).otherwise(4)).when(c("legacy_protocols") > 0, 3).when(c("modern_protocols") > 0, 2).otherwise(1)
    f = f.withColumns({"w_ca": F.when(mixed, exact_round(raw[0] / both, 2)).otherwise(fixed(0)), "w_ds": F.when(mixed, exact_round(raw[1] / both, 2)).otherwise(fixed(1)), "ca": ca, "ds": ds, "np": np_})
    f = f.withColumn("w_np", F.when(mixed, exact_round(1 - c("w_ca") - c("w_ds"), 2)).otherwise(fixed(2)))
    m = exact_round(c("w_ca") * c("ca") + c("w_ds") * c("ds") + c("w_np") * c("np"), 2)
    return f.withColumn("m_tech", F.when((m >= 1) & (m <= 5), m).otherwise(F.raise_error(F.lit("effort out of range")).cast("double")))


def components(df: DataFrame, rated: DataFrame) -> DataFrame:
    """Ratings of each file, with the weights of the whole system (a single row)."""
    kind = F.col("artifact_type")
    some = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    g = df.groupBy(F.coalesce(F.nullif(F.col("file_path"), F.lit("")), F.lit("general")).alias("path")).agg(
        F.count("*").alias("n"),
        F.when(some(F.col("detection_method") == "custom_crypto"), 5).when(some(F.upper("algorithm").isin(dims.LEGACY_ALGORITHMS)), 4).otherwise(2).alias("ca"),
        F.when(some(kind.isin("hsm", "embedded_iot", "firmware")), 4).otherwise(1).alias("ds"),
        F.when(some(kind == "packet_constraint"), 4).otherwise(1).alias("np"))
    w = F.broadcast(rated.select("w_ca", "w_ds", "w_np"))  # one row
    m = exact_round(F.col("w_ca") * F.col("ca") + F.col("w_ds") * F.col("ds") + F.col("w_np") * F.col("np"), 2)
    return g.join(w).select(F.regexp_extract("path", "([^/]*)$", 1).alias("component"), "path", "n", "ca", "ds", "np", m.alias("m_tech"))


def affected_files(df: DataFrame) -> DataFrame:
    return df.where("file_path is not null and file_path <> ''").select("file_path").distinct().orderBy("file_path")


#: Hardcoded calls are shown up to so many; all other evidence is whole.
SHOWN = 5
# fixed values: what ratings say of themselves
REASONS = {
    "CA": {
        "none": "No cryptographic findings were available to assess crypto-agility.",
        "custom": "Very low agility: custom cryptographic algorithm implementation or firmware-level cryptography detected.",
        "database": "Very low agility: database-level cryptographic logic detected.",
        "legacy": "Low agility: hardcoded legacy/insecure cryptographic algorithms (e.g. DES, MD5, SHA-1) detected.",
        "hardcoded": "Moderate agility: cryptography is used via standard libraries but multiple hardcoded algorithm calls are scattered across source files.",
        "agile": "Good agility: standard modern crypto libraries used with localized algorithm selections.",
        "central": "Highly agile: cryptography managed via centralized modern APIs and configuration-driven selection with minimal hardcoded logic.",
        "standard": "Moderate-to-good agility: standard software crypto findings with no legacy or custom crypto detected.",
    },
    "DS": {
        "software": "Low dependency: software-only enterprise with standard software cryptography and no HSM, embedded, IoT, or hardware dependencies.",
        "many": "High dependency: multiple HSMs, IoT devices, or physical hardware replacement dependencies detected.",
        "some": "Significant dependency: HSM or embedded/IoT device dependency detected requiring hardware/firmware integration.",
    },
    "NP": {
        "tight": "High impact: strict packet MTU limits, tight packet buffers, or legacy banking protocol constraints detected.",
        "fixed": "Significant impact: fixed frame/packet size or buffer limits detected that may affect larger PQC keys/signatures.",
        "old": "Moderate impact: legacy TLS/SSL versions (TLS 1.0/1.1/SSLv3) detected in protocol configuration.",
        "new": "Low-to-moderate impact: standard TLS 1.2+ / SSH protocol APIs detected with configurable cipher suites.",
        "flexible": "Low impact: standard flexible software protocols detected with no restrictive packet MTU or buffer limits.",
    },
}
# fixed values: evidence where no single finding is the reason
GENERAL = {
    "central": "Centralized modern crypto library APIs and configuration-driven selection detected.",
    "standard": "Standard crypto findings with no legacy or custom routines.",
    "software": "Software-only environment confirmed; 0 HSM, IoT, embedded, or specialized hardware artifacts detected.",
    "flexible": "Standard flexible software protocols; no restrictive MTU or packet buffer limits discovered.",
}


def verdicts(rated: DataFrame) -> DataFrame:
    """One row: which rule each rating of ratings() comes from, as ca_rule, ds_rule and np_rule."""
    c = F.col
    ca = (
        F.when(c("n") == 0, "none").when((c("custom") > 0) | (c("firmware") > 0), "custom").when(c("database") > 0, "database").when(c("legacy") > 0, "legacy").when(c("hardcoded") > 3, "hardcoded")
        .when((c("agile") > 0) | (c("configured") > 0), F.when(c("hardcoded") > 0, "agile").otherwise("central")).otherwise("standard")
    )
    ds = F.when(c("hardware") == 0, "software").when(c("ds") == 5, "many").otherwise("some")
    np_ = F.when(c("packets") > 0, F.when(c("np") == 5, "tight").otherwise("fixed")).when(c("legacy_protocols") > 0, "old").when(c("modern_protocols") > 0, "new").otherwise("flexible")
    return rated.withColumns({"ca_rule": ca, "ds_rule": ds, "np_rule": np_})


def evidence(df: DataFrame, rated: DataFrame) -> DataFrame:
    """(rating, place, ord, evidence, file_path): a row for each finding that a rating rests on, and for a rating that rests on
    none its general statement. One pass; the ratings are one broadcast row, and only the few hardcoded calls that are shown are
    put in order."""
    rule = verdicts(rated).select("ca_rule", "ds_rule", "np_rule")
    kind, method, name = F.col("artifact_type"), F.col("detection_method"), F.upper(F.coalesce("protocol", F.lit("")))
    said = lambda c: F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("None"))
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    why, protocol = said(either("evidence", "code_snippet")), kind.isin("protocol", "packet_constraint")
    agile, configured = F.col("library").isin(dims.AGILE_LIBRARIES), method.isin("config_directive", "api_pattern")
    standard = F.format_string("Standard library/config '%s' in %s", said(either("library", "protocol")), said("file_path"))
    rows = [
        ("CA", 0, (F.col("ca_rule") == "custom") & ((method == "custom_crypto") | (kind == "firmware")), F.format_string("Custom/firmware crypto in %s: %s", said("file_path"), why)),
        ("CA", 0, (F.col("ca_rule") == "database") & (kind == "database_crypto"), F.format_string("Database crypto in %s: %s", said("file_path"), why)),
        ("CA", 0, (F.col("ca_rule") == "legacy") & F.upper("algorithm").isin(dims.LEGACY_ALGORITHMS), F.format_string("Legacy cipher '%s' in %s", said("algorithm"), said("file_path"))),
        ("CA", 0, (F.col("ca_rule") == "agile") & agile, standard),
        ("CA", 1, (F.col("ca_rule") == "agile") & configured, standard),
        ("DS", 0, (F.col("ds_rule") == "many") & kind.isin(HARDWARE), F.format_string("Hardware dependency '%s' in %s: %s", kind, said("file_path"), said("evidence"))),
        ("DS", 0, (F.col("ds_rule") == "some") & kind.isin(HARDWARE), F.format_string("Hardware/IoT dependency in %s: %s", said("file_path"), said("evidence"))),
        ("NP", 0, F.col("np_rule").isin("tight", "fixed") & (kind == "packet_constraint"), F.format_string("Packet/MTU constraint in %s: %s", said("file_path"), why)),
        ("NP", 0, (F.col("np_rule") == "old") & protocol & name.isin(dims.LEGACY_PROTOCOLS), F.format_string("Legacy protocol '%s' in %s", said("protocol"), said("file_path"))),
        ("NP", 0, (F.col("np_rule") == "new") & protocol & name.isin(dims.MODERN_PROTOCOLS), F.format_string("Standard protocol '%s' in %s", said("protocol"), said("file_path"))),
    ]
    struct = lambda r, p, text: F.struct(F.lit(r).alias("rating"), F.lit(p).alias("place"), text.alias("evidence"))
    held = F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), struct(r, p, text)) for r, p, ok, text in rows]), lambda x: x.isNotNull())
    both = df.join(F.broadcast(rule))  # one row
    each = both.select(F.explode(held).alias("h"), "ord", "file_path").select("h.rating", "h.place", "ord", "h.evidence", "file_path")
    calls = both.where((F.col("ca_rule") == "hardcoded") & method.isin("ast_call", "semgrep", "treesitter_call", "c_ast_call")).orderBy("ord").limit(SHOWN)
    shown = F.format_string("Hardcoded algorithm '%s' at %s:%s", said("algorithm"), said("file_path"), said("line_number"))
    few = calls.select(F.lit("CA").alias("rating"), F.lit(0).alias("place"), "ord", shown.alias("evidence"), "file_path")
    general = lookup(GENERAL, F.col("rule"))
    alone = rule.select(F.explode(F.create_map(F.lit("CA"), "ca_rule", F.lit("DS"), "ds_rule", F.lit("NP"), "np_rule")).alias("rating", "rule")).select("rating", F.lit(0).alias("place"), F.lit(None).cast(df.schema["ord"].dataType).alias("ord"), general.alias("evidence"), F.lit(None).cast("string").alias("file_path"))
    return each.unionByName(few).unionByName(alone.where("evidence is not null"))


def result(rated: DataFrame) -> DataFrame:
    """One row of the effort report: class, ratings with their reasons, weights, the effort, and what was missing."""
    one = verdicts(rated)
    rating = lambda r: F.struct(F.col(r.lower()).alias("score"), lookup(REASONS[r], F.col(f"{r.lower()}_rule")).alias("reason")).alias(r)
    none = F.col("n") == 0
    texts = lambda t: F.when(none, F.array(F.lit(t))).otherwise(F.array().cast("array<string>"))
    return one.select(
        F.col("architecture").alias("architecture_classification"), F.struct(*[rating(r) for r in REASONS]).alias("ratings"), F.struct(F.col("w_ca").alias("CA"), F.col("w_ds").alias("DS"), F.col("w_np").alias("NP")).alias("weights"),
        F.col("m_tech").alias("M_tech"), texts("Applied CA=3 fallback score.").alias("uncertainty"), texts("No crypto findings detected to evaluate Crypto-Agility.").alias("missing_evidence"),
    )
