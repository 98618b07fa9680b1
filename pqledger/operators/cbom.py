"""Findings to a bill of materials: normalise, deduplicate, classify, merge, patterns, recommendations, export.

Findings carry ``ord``, a struct or number that gives their input order; "first" always means least ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dims

_S, _I, _D, _A = T.StringType(), T.IntegerType(), T.DoubleType(), T.ArrayType(T.StringType())
ARTIFACT = T.StructType(
    [T.StructField(n, _S) for n in ("artifact_id", "artifact_type", "algorithm")]
    + [T.StructField("key_size", _I), T.StructField("file_path", _S), T.StructField("detection_method", _S), T.StructField("confidence", _D), T.StructField("library", _S), T.StructField("line_number", _I)]
    + [T.StructField(n, _S) for n in ("code_snippet", "language", "mode", "protocol", "protocol_version", "evidence", "dependency_version", "curve")]
    + [T.StructField(f"certificate_{n}", _S) for n in ("subject", "issuer", "expiry", "serial_number", "not_before")]
    + [T.StructField("certificate_version", _I), T.StructField("certificate_signature_algorithm", _S), T.StructField("certificate_ec_curve", _S)]
    + [T.StructField(f"certificate_{n}", _A) for n in ("subject_alternative_names", "key_usage", "extended_key_usage")]
    + [T.StructField("certificate_source_format", _S), T.StructField("certificate_password_protected", T.BooleanType()), T.StructField("certificate_note", _S)]
    + [T.StructField(n, _S) for n in ("source_type", "warning_type", "message", "docker_instruction", "evidence_type")]
)


def lookup(table: dict, key: Column) -> Column:
    """A literal map's value; null without an entry."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(key.isNotNull(), F.try_element_at(m, F.coalesce(key, F.lit(""))))


def any_in(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def conform(df: DataFrame) -> DataFrame:
    """Any finding rows to the fixed schema; what is missing is null. ord stays."""
    have = set(df.columns)
    cols = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in ARTIFACT]
    return df.select(*cols, *([F.col("ord")] if "ord" in have else []))


def with_ids(df: DataFrame) -> DataFrame:
    """Deterministic ids from what makes a finding: 64 bits, as an entry's id must be unique in its document."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("file_path", "line_number", "artifact_type", "algorithm", "evidence", "detection_method", "code_snippet", "library")]
    return df.withColumn("artifact_id", F.coalesce("artifact_id", F.substring(F.sha2(F.concat_ws("\x01", *key), 256), 1, 16)))


def normal_path(path: Column) -> Column:
    """POSIX normpath, then backslashes to slashes. Paths that are normal already are taken as they are."""
    return F.when(path.rlike(r"^$|//|./$|\\|(^|/)\.{1,2}(/|$)"), _normalised(path)).otherwise(path)


def _normalised(path: Column) -> Column:
    absolute = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        up = (p == "..") & (F.size(acc) > 0) & (last != "..")
        return F.when(F.coalesce(up, F.lit(False)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "..") & absolute & (F.size(acc) == 0), acc).otherwise(F.concat(acc, F.array(p)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    body = F.array_join(kept, "/")
    # exactly two leading slashes stay two
    lead = F.when(path.rlike("^//(?!/)"), "//").when(absolute, "/").otherwise("")
    out = F.concat(lead, body)
    return F.when(path.isNotNull(), F.replace(F.when(out == "", ".").otherwise(out), F.lit("\\"), F.lit("/")))


def exact_dedup(df: DataFrame) -> DataFrame:
    """First finding of each (path, line, type, algorithm, evidence, method); nulls are equal. One shuffle; each task sends at
    most one row of a key, so a hot key stays small. A row is sorted and sent with each value once: the path as it is written
    goes along only where it differs from the normal one."""
    keys = ["_p", "line_number", "artifact_type", "algorithm", "evidence", "detection_method"]
    named = df.withColumn("_p", normal_path(F.col("file_path")))
    narrow = named.select(*[c for c in df.columns if c != "file_path"], "_p", F.nullif("file_path", "_p").alias("_w"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    kept = narrow.withColumn("_n", first).where("_n = 1").withColumn("file_path", F.coalesce("_w", "_p"))
    return kept.select(*df.columns)


def multiset_difference(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ("artifact_id", "ord")) -> DataFrame:
    """Rows of either side that the other lacks, with their side."""
    x, y = a.drop(*ignore), b.drop(*ignore)
    # one count of both sides: what is left over of a row is on the left if positive, on the right if negative
    both = x.withColumn("_v", F.lit(1).cast("long")).union(y.withColumn("_v", F.lit(-1).cast("long")))
    n = both.groupBy(*x.columns).agg(F.sum("_v").alias("_v")).where("_v <> 0")
    side = F.when(F.col("_v") > 0, "left").otherwise("right")
    return n.select(*x.columns, side.alias("side"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_v"))).alias("_i")).drop("_i")


def category() -> Column:
    """The category of a finding, first rule that holds."""
    alg, kind, path = F.col("algorithm"), F.col("artifact_type"), F.lower(F.coalesce("file_path", F.lit("")))
    protocol = (alg != "UNSPECIFIED") & F.exists(F.array(*map(F.lit, ["TLS", "SSL", "SSH", "IPSEC"])), lambda k: F.contains(F.upper(alg), k))
    ends = lambda exts: F.exists(F.array(*map(F.lit, exts)), lambda e: F.endswith(path, e))
    return (
        F.when(alg.isin(dims.PROTOCOL_NAMES), "Protocol")
        .when(kind.isin(list(dims.TYPE_CATEGORY)), lookup(dims.TYPE_CATEGORY, kind))
        .when(ends([dims.KEY_EXTENSION]), "Key")
        .when(ends(dims.CERTIFICATE_EXTENSIONS), "Certificate")
        .when(F.coalesce(protocol, F.lit(False)), "Protocol")
        .when(kind == "hash", "Hash Function")
        .when((kind == "algorithm") & F.col("key_size").isNotNull() & alg.isin(dims.KEY_ALGORITHMS), "Key")
        .when(kind == "algorithm", "Algorithm")
        .otherwise("Uncategorized")
    )


def classify(df: DataFrame) -> DataFrame:
    return df.withColumn("cbom_category", category())


def category_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("cbom_category").agg(F.count("*").alias("n"))


#: What merge() adds for later steps and ordered() leaves out of the bill.
HELPERS = ("first_path", "first_file", "n_files", "languages")


def keyed(df: DataFrame) -> DataFrame:
    """Classified findings with the key of their entry, _u, _k and _s: UNSPECIFIED findings go by library, others by
    algorithm and key size; a null algorithm is an ordinary key, and so is a null library."""
    none = F.coalesce(F.col("algorithm") == "UNSPECIFIED", F.lit(False))
    return df.withColumns({"_u": none, "_k": F.when(none, F.col("library")).otherwise(F.col("algorithm")), "_s": F.when(~none, F.col("key_size"))})


def lead() -> Column:
    """The most confident, then first finding, which describes the entry."""
    return F.min_by(F.struct("artifact_id", "algorithm", "key_size", "cbom_category", "library"), F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "ord"))


def merge(df: DataFrame) -> DataFrame:
    """Classified findings to entries. files_affected and occurrences hold all of an entry's findings in one value, as the
    bill's format asks; steps that need no more than counts, the first path or the languages read the columns of HELPERS, and
    the lists are then left out of the plan. What works on each occurrence takes the rows of occurrences()."""
    occurrence = F.struct("ord", F.struct("file_path", "line_number", "code_snippet", "detection_method", "confidence").alias("o"))
    all_ = keyed(df)
    lists = all_.groupBy("_u", "_k", "_s").agg(
        lead().alias("r"), F.sort_array(F.collect_list(occurrence)).alias("all"), F.count("*").alias("occurrence_count"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("max_confidence"), F.sort_array(F.collect_set("file_path")).alias("files_affected"), F.min("ord").alias("first_ord"),
        F.min_by("file_path", "ord").alias("first_path"), F.min("file_path").alias("first_file"), F.sort_array(F.collect_set(F.when(F.col("file_path").isNotNull(), language_bucket(F.col("file_path"))))).alias("languages"),
    )
    # different paths are counted apart: beside the rest, each of them would be sent with all of an entry's values
    paths = all_.select(*[F.col(c).alias(f"{c}p") for c in ("_u", "_k", "_s")], "file_path").distinct().groupBy("_up", "_kp", "_sp").agg(F.count("file_path").alias("n_files"))
    same = (F.col("_u") == F.col("_up")) & F.col("_k").eqNullSafe(F.col("_kp")) & F.col("_s").eqNullSafe(F.col("_sp"))
    g = lists.join(paths, same)
    return g.select(F.col("r.artifact_id").alias("cbom_entry_id"), F.col("r.algorithm").alias("algorithm"), F.when(~F.col("_u"), F.col("r.key_size")).alias("key_size"), F.col("r.cbom_category").alias("cbom_category"), F.col("r.library").alias("library"), "occurrence_count", "max_confidence", "files_affected", F.col("all.o").alias("occurrences"), "first_ord", *HELPERS)


def occurrences(df: DataFrame) -> DataFrame:
    """One row for each classified finding, with what its entry says of it: cbom_entry_id, algorithm, key_size, cbom_category
    and first_ord. Entries are found by partial aggregation and joined back by their key, so an entry with most of the
    findings never meets in one value; the join's large side is split by AQE where entries are too many to broadcast."""
    rows = keyed(df).select("_u", "_k", "_s", "file_path", "confidence", "ord")
    g = keyed(df).groupBy("_u", "_k", "_s").agg(lead().alias("r"), F.min("ord").alias("first_ord"))
    e = g.select(*[F.col(c).alias(f"{c}e") for c in ("_u", "_k", "_s")], F.col("r.artifact_id").alias("cbom_entry_id"), F.col("r.algorithm").alias("algorithm"), F.when(~F.col("_u"), F.col("r.key_size")).alias("key_size"), F.col("r.cbom_category").alias("cbom_category"), "first_ord")
    same = (F.col("_u") == F.col("_ue")) & F.col("_k").eqNullSafe(F.col("_ke")) & F.col("_s").eqNullSafe(F.col("_se"))
    return rows.join(e, same).select("cbom_entry_id", "algorithm", "key_size", "cbom_category", "first_ord", "file_path", "confidence", "ord")


def ordered(entries: DataFrame) -> DataFrame:
    """Most occurrences first, then by first finding."""
    return entries.orderBy(F.desc("occurrence_count"), "first_ord").drop(*HELPERS)


def language(path: Column) -> Column:
    """Language of a path for fixes, case-sensitive; null if none."""
    return F.when(F.endswith(path, F.lit(".py")), "python").when(F.endswith(path, F.lit(".java")), "java").when(F.endswith(path, F.lit(".js")), "javascript").when(F.endswith(path, F.lit(".c")), "c")


def language_bucket(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".py")), "Python").when(F.endswith(path, F.lit(".java")), "Java").when(F.endswith(path, F.lit(".c")), "C").otherwise("Other")


def cross_file_patterns(entries: DataFrame, min_files: int = 2) -> DataFrame:
    n = F.col("n_files")
    named = F.col("algorithm").isNull() | (F.col("algorithm") != "UNSPECIFIED")
    return entries.where((n >= min_files) & named).select("algorithm", "key_size", F.lit("cross_file_repetition").alias("pattern_type"), "files_affected", "n_files", F.col("occurrence_count").alias("total_occurrences"), F.when(n >= 3, "high").otherwise("medium").alias("severity_signal"), "first_ord")


def cross_language_patterns(entries: DataFrame) -> DataFrame:
    named = F.col("algorithm").isNull() | (F.col("algorithm") != "UNSPECIFIED")
    return entries.where(named).where(F.size("languages") >= 2).select("algorithm", "key_size", F.lit("cross_language_spread").alias("pattern_type"), "languages", "files_affected", "first_ord")


def _dim(spark, rows, schema):
    return F.broadcast(spark.createDataFrame(rows, schema))  # lookup tables of fixed size


def attach_recommendations(entries: DataFrame) -> DataFrame:
    """Left joins with the recommendation and guidance tables: UNSPECIFIED entries take their category's guidance or none."""
    spark = entries.sparkSession
    rec = _dim(spark, [(a, *r) for a, r in dims.RECOMMENDATIONS.items()], "ra string, r1 string, r2 string, r3 boolean")
    cat = _dim(spark, [(c, *g) for c, g in dims.CATEGORY_GUIDANCE.items()], "gc string, g1 string, g2 string, g3 boolean")
    none = F.coalesce(F.col("algorithm") == "UNSPECIFIED", F.lit(False))
    both = entries.withColumn("_n", none).join(rec, F.col("algorithm") == F.col("ra"), "left").join(cat, (F.col("cbom_category") == F.col("gc")) & F.col("_n"), "left")
    pick = lambda i: F.when(F.col("_n"), F.col(f"g{i}")).otherwise(F.coalesce(F.col(f"r{i}"), F.lit(dims.UNKNOWN_RECOMMENDATION[i - 1])))
    value = F.struct(pick(1).alias("recommended_alternative"), pick(2).alias("rationale"), pick(3).alias("already_quantum_safe"))
    return both.withColumn("recommendation", F.when(pick(1).isNotNull(), value)).select(*entries.columns, "recommendation")


def attach_fixes(entries: DataFrame) -> DataFrame:
    """Left join on (algorithm, language of the first occurrence)."""
    fixes = _dim(entries.sparkSession, [(a, g, t) for (a, g), t in dims.FIXES.items()], "fa string, fl string, fix_suggestion string")
    first = language(F.col("first_path"))
    return entries.withColumn("_l", first).join(fixes, (F.col("algorithm") == F.col("fa")) & (F.col("_l") == F.col("fl")), "left").select(*entries.columns, "fix_suggestion")


def summary(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: entries, raw findings, entries that aren't quantum safe, files of the findings."""
    zero = F.lit(0).cast("long")
    of = entries.agg(F.count("*").alias("unique_entries"), F.coalesce(F.sum("occurrence_count"), zero).alias("raw_findings"), F.count_if(~F.col("recommendation.already_quantum_safe")).alias("quantum_vulnerable"))
    files = findings.agg(F.count_distinct("file_path").alias("files"))
    both = of.withColumn("files", zero).unionByName(files.select(*[zero.alias(c) for c in of.columns], "files"))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def normal_order() -> list[Column]:
    """The order of entries in the bill: most findings first, then by first finding."""
    return [(-F.col("occurrence_count")).alias("_n"), F.col("first_ord").alias("_first")]


def cyclonedx_properties(entries: DataFrame) -> DataFrame:
    """Entries with the name, props and advice of their components."""
    kind = F.coalesce(lookup(dims.ASSET_TYPES, F.col("cbom_category")), F.lit("algorithm"))
    is_ = lambda k: F.col("_kind") == k
    props = F.struct(
        F.col("_kind").alias("assetType"),
        F.when(is_("algorithm"), F.struct(F.when(F.col("cbom_category") == "Hash Function", "hash").otherwise("unknown").alias("primitive"), F.coalesce(F.nullif(F.col("key_size"), F.lit(0)).cast("string"), F.lit("")).alias("parameterSetIdentifier"))).alias("algorithmProperties"),
        F.when(is_("certificate"), F.struct(F.col("algorithm").alias("signatureAlgorithmRef"))).alias("certificateProperties"),
        F.when(is_("protocol"), F.struct(F.lit("tls").alias("protocolType"), F.col("algorithm").alias("version"))).alias("protocolProperties"),
        F.when(is_("related-crypto-material"), F.struct(F.when(F.col("cbom_category") == "Key", "private-key").otherwise("unknown").alias("type"), F.col("key_size").alias("size"))).alias("relatedCryptoMaterialProperties"),
    )
    name = F.when(F.col("algorithm").isNull() | (F.col("algorithm") != "UNSPECIFIED"), F.col("algorithm")).otherwise(F.coalesce("library", F.lit("unknown")))
    advice = F.when(F.col("recommendation").isNotNull(), F.array(F.struct(F.lit("inventory:recommendedAlternative").alias("name"), F.col("recommendation.recommended_alternative").alias("value"))))
    return entries.withColumn("_kind", kind).withColumns({"name": name, "props": props, "advice": advice})


def cyclonedx_components(entries: DataFrame) -> DataFrame:
    """(first_ord, component): the entries as cryptographic-asset components."""
    where = F.struct(F.transform("occurrences", lambda o: F.struct(o.file_path.alias("location"))).alias("occurrences"))
    component = F.struct(F.lit("cryptographic-asset").alias("type"), F.col("cbom_entry_id").alias("bom-ref"), "name", F.col("props").alias("cryptoProperties"), where.alias("evidence"), F.col("advice").alias("properties"))
    return cyclonedx_properties(entries).select("first_ord", "occurrence_count", component.alias("component"))


def cyclonedx(entries: DataFrame, version: str = "1.0") -> DataFrame:
    """One row with the whole document as JSON. The bill's size is that of its entries, as the format asks."""
    parts = cyclonedx_components(entries).agg(F.sort_array(F.collect_list(F.struct((-F.col("occurrence_count")).alias("n"), "first_ord", "component"))).alias("c"))
    tool = F.struct(F.array(F.struct(F.lit("application").alias("type"), F.lit("pqledger").alias("name"), F.lit(version).alias("version"))).alias("components"))
    doc = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.concat(F.lit("urn:uuid:"), F.uuid()).alias("serialNumber"), F.lit(1).alias("version"), F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), tool.alias("tools")).alias("metadata"), F.col("c.component").alias("components"))
    return parts.select(F.to_json(doc).alias("json"))


def bill(findings: DataFrame) -> DataFrame:
    """Findings to entries with recommendations and fixes."""
    return attach_fixes(attach_recommendations(merge(classify(findings))))
