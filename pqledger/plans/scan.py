"""A whole scan: files to routed detectors to one deduplicated table of findings, and on to bill, scores and effort.

Each file's content is read once. Rules on lines and statements are column expressions; what needs a parser is one Arrow
column over the files that are routed to one; a file's findings meet in one array, which one explode opens.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cbom, code, commands, document, effort, risk, rules
from ..scratch import Scratch
from ..sources import files as src

#: Routes of files that parsers read, and of files whose text the rules read.
PARSED = ["manifest", "binary", "source", "certificate"]
READ = ["source", "infrastructure"]
#: Files of an image that are configuration, by name; fixed values.
CONFIGS = ["openssl.cnf", "openssl.conf", "ssh_config", "sshd_config", "nginx.conf", "httpd.conf", "apache2.conf"]


def findings(spark: SparkSession, root: str, password: str | None = None) -> DataFrame:
    return detect(src.tree(spark, root), password)


def routed(*names: str) -> Column:
    return F.arrays_overlap("routes", F.array(*map(F.lit, names)))


def when(condition: Column, hits: Column) -> Column:
    return F.when(condition, hits).otherwise(rules.no_hits())


@lru_cache(maxsize=8)
def file_hits(app: str) -> Column:
    """All that the rules find in a file (path, routes, _t: its text, _u: whether it is UTF-8). The expression is built once for
    each application: it takes thousands of calls to the JVM."""
    text, path = F.col("_t"), F.col("path")
    firmware = F.lower("path").rlike(r"\.(fw|hex|bin)$")

    def source(line: Column, number: Column) -> Column:
        return F.concat(rules.code_hits(line, number, 4), when(~rules.is_doc(path), rules.protocol_hits(line, number, 5)), rules.hardware_hits(line, number, 6))

    bad = rules.hit(rank=0, artifact_type="warning", confidence=0.0, detection_method="pattern", warning_type="unreadable_dockerfile", message="not UTF-8", source_type="dockerfile")
    image = rules.hit(rank=6, artifact_type="firmware", detection_method="firmware_file_extension", confidence=0.9)
    return F.concat(
        when(routed("dockerfile") & F.col("_u"), commands.docker_hits(text, 0)),
        when(routed("dockerfile") & ~F.col("_u"), F.array(bad)),
        when(routed("source"), rules.each_line(text, source)),
        when(routed("infrastructure") & ~firmware, rules.each_line(text, lambda line, n: rules.hardware_hits(line, n, 6))),
        when(routed("infrastructure") & firmware, F.array(image)),
        when(routed("java"), rules.java_hits(text, 7)),
        when(routed("c"), rules.c_hits(text, 7)),
    )


def opened(files: DataFrame, found: Column) -> DataFrame:
    """One row for each finding of a file's array, in the order of path, detector and place."""
    rows = files.select(F.col("path").alias("file_path"), F.posexplode(found).alias("_m", "_f")).select("file_path", "_m", "_f.*")
    order = F.struct(F.col("file_path").alias("p"), F.coalesce("rank", F.lit(9)).alias("d"), F.col("_m").alias("m"))
    return cbom.conform(rows.withColumn("ord", order))


def detect(tree: DataFrame, password: str | None = None) -> DataFrame:
    """Findings of files (path, length, content), first ones first by (path, detector, place). The password opens PKCS#12
    files; it goes to workers and, by environment, to the tool, never into a row."""
    files = src.with_routes(tree.where(src.is_routed()))
    text = files.withColumns({"_u": F.is_valid_utf8(F.col("content").cast("string")), "_t": F.when(routed("dockerfile", *READ), src.as_text())})
    both = text.withColumn("_p", code.parsed(F.col("path"), F.col("routes"), F.when(routed(*PARSED), F.col("content")), password))
    return cbom.with_ids(cbom.exact_dedup(opened(both, F.concat(code.widened(file_hits(tree.sparkSession.sparkContext.applicationId)), F.col("_p")))))


def container(tree: DataFrame, cap: int = 5000, config_bytes: int = 1_000_000) -> DataFrame:
    """Findings of an image's file system (path, length, content): at most `cap` classified files, in path order, and the
    package databases."""
    low, base = F.lower("path"), F.regexp_extract(F.lower("path"), "([^/]*)$", 1)
    config = low.rlike(r"\.(conf|cnf|cfg|ini)$") | base.isin(CONFIGS)
    kind = (
        F.when(low.rlike(r"(^|/)(var/lib/dpkg/status|lib/apk/db/installed)$"), "packages")
        .when(low.rlike(r"(^|/)(var/lib|usr/lib/sysimage)/rpm/rpmdb\.sqlite$"), "rpm")
        .when(low.rlike(r"\.(pem|crt|cer|der|p12|pfx)$"), "certificate")
        .when(low.rlike(r"\.(key|pub)$") | base.rlike(r"^id_(rsa|dsa|ecdsa|ed25519)(\.pub)?$"), "key")
        .when(config & (F.col("length") <= config_bytes), "config")
    )
    some = tree.withColumn("kind", kind).where("kind is not null")
    keep = some.where("kind not in ('packages', 'rpm')").select("path", F.lit(1).alias("_k")).orderBy("path").limit(cap)
    near = some.join(F.broadcast(keep), "path", "left").where("_k = 1 or kind in ('packages', 'rpm')")  # at most cap paths
    is_ = lambda k: F.col("kind") == k
    text = near.withColumn("_t", F.when(is_("key"), src.as_text(F.substring("content", 1, 4096))).when(is_("config") | is_("packages"), src.as_text()))
    both = text.withColumn("_p", code.parsed(F.col("path"), F.array("kind"), F.when(is_("certificate") | is_("rpm"), F.col("content"))))
    hits = F.concat(
        when(is_("key"), commands.key_hits(F.col("_t"), F.col("path"), 1)),
        when(is_("config"), commands.config_hits(F.col("_t"), 0.65, 1)),
        when(is_("packages"), commands.database_hits(F.col("_t"), low.endswith("installed"), 3)),
    )
    rows = opened(both, F.concat(code.widened(hits), in_container(F.col("_p"))))
    return cbom.with_ids(rows.withColumn("source_type", F.lit("container_image")).withColumn("line_number", F.coalesce("line_number", F.lit(0))))


def in_container(found: Column) -> Column:
    """Certificate rows as an image's: another method, and a broken certificate is unsure instead of a warning."""

    def of(f: Column) -> Column:
        package, locked = (f.detection_method == "package_metadata") | (f.detection_method == "database"), f.artifact_type == "pkcs12"
        broken = (f.artifact_type == "warning") & ~package
        fields = {
            "artifact_type": F.when(broken, "certificate").otherwise(f.artifact_type),
            "detection_method": F.when(broken, "filesystem_pattern").when(package, "package_metadata").otherwise("certificate_detector"),
            "confidence": F.when(broken, 0.3).otherwise(f.confidence),
            "evidence": F.when(broken, F.concat(F.lit("certificate-like extension but could not be parsed: "), f.message)).when(locked, f.certificate_note).when(package, f.evidence),
            "warning_type": F.when(package, f.warning_type), "message": F.when(package, f.message), "rank": F.when(package, 4).otherwise(1),
        }
        return F.struct(*[(fields[n] if n in fields else f[n]).cast(t).alias(n) for n, t in code.FINDING.items()])

    return F.transform(found, of)


def metadata(images: DataFrame, name: str = "image", inspect: str = "inspect") -> DataFrame:
    """Findings of images' metadata, one JSON text for each image, without a parser of our own."""
    files = images.select(F.concat(F.lit("docker-inspect:"), F.col(name)).alias("path"), F.col(inspect).alias("_j"))
    return cbom.with_ids(opened(files, code.widened(commands.metadata_hits(F.col("_j"), 0))))


def documents(found: DataFrame) -> dict[str, DataFrame]:
    """The bill and its CycloneDX document as rows of text in order."""
    classified = cbom.classify(found)
    return {"cbom": document.bill(classified), "cyclonedx": document.cyclonedx(classified)}


def inventory(found: DataFrame, profile: str = "enterprise_default") -> dict[str, DataFrame]:
    """All results of a table of findings."""
    entries = cbom.bill(found)
    occurrences = risk.numbered_occurrences(cbom.occurrences(cbom.classify(found)), Scratch(found.sparkSession, "inventory"))
    scored = risk.recommend(risk.score(risk.findings(occurrences), profile))
    rated = effort.ratings(found)
    return {"evidence": effort.evidence(found, rated), "effort_report": effort.result(rated), "entries": cbom.ordered(entries), "cross_file": cbom.cross_file_patterns(entries).drop("n_files"), "cross_language": cbom.cross_language_patterns(entries), "summary": cbom.summary(entries, found), "scored": risk.merge_recommendations(scored, entries).drop("cbom_entry_id"), "system": risk.system_score(scored), "cyclonedx": cbom.cyclonedx(entries), "effort": rated, "components": effort.components(found, rated)}
