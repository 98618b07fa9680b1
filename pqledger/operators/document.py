"""The bill and its CycloneDX document as sorted rows of text, so that no entry's findings ever meet in one value.

An entry is a few rows of its own (what stands before, between and after its lists) and one row for each item of its lists.
All rows are dealt by ranges of (entry, part, item), so an entry with most of the findings spans many tasks; written in that
order, the rows are one JSON document, white space aside. ``ord`` of findings must be unique, as it is in a scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cbom import attach_fixes, attach_recommendations, cyclonedx_properties, keyed, lead, normal_order

KEY = ["_u", "_k", "_s"]
#: Places of rows of the whole document and of an entry.
BEFORE, HEAD, FILES, MIDDLE, ITEMS, TAIL, AFTER = range(7)


def entries_of(classified: DataFrame) -> DataFrame:
    """Entries without their lists: what describes them, counts, the first of each list, recommendation and fix."""
    g = keyed(classified).groupBy(*KEY).agg(
        lead().alias("r"), F.count("*").alias("occurrence_count"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("max_confidence"),
        F.min("ord").alias("first_ord"), F.min("file_path").alias("first_file"), F.min_by("file_path", "ord").alias("first_path"),
    )
    named = g.select(
        *KEY, F.col("r.artifact_id").alias("cbom_entry_id"), F.col("r.algorithm").alias("algorithm"), F.when(~F.col("_u"), F.col("r.key_size")).alias("key_size"),
        F.col("r.cbom_category").alias("cbom_category"), F.col("r.library").alias("library"), "occurrence_count", "max_confidence", "first_ord", "first_file", "first_path",
    )
    return attach_fixes(attach_recommendations(named))


def part(entries: DataFrame, place: int, text: Column) -> DataFrame:
    """A row of each entry."""
    return entries.select(*normal_order(), F.lit(place).alias("_p"), F.lit(None).cast("string").alias("_f"), F.lit(None).alias("_o"), text.alias("text"))


def joined(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of findings with their entry's place in the order, the first of its lists, and their own columns."""
    e = entries.select(*[F.col(c).alias(f"{c}e") for c in KEY], "occurrence_count", "first_ord", "first_file")
    same = (F.col("_u") == F.col("_ue")) & F.col("_k").eqNullSafe(F.col("_ke")) & F.col("_s").eqNullSafe(F.col("_se"))
    return rows.join(e, same)


def listed(first: Column, json: Column) -> Column:
    """An item of a list: all but the first have a comma before them."""
    return F.when(first, json).otherwise(F.concat(F.lit(","), json))


def document(parts: list[DataFrame], entries: DataFrame, before: Column | str, after: Column | str) -> DataFrame:
    """The rows of a document in order, as one column `text`."""
    rows = reduce(DataFrame.unionByName, parts)
    spark, ord_type = entries.sparkSession, entries.schema["first_ord"].dataType
    frame = spark.range(2).select(
        F.when(F.col("id") == 0, F.lit(-(1 << 62))).otherwise(F.lit(1 << 62)).alias("_n"), F.lit(None).cast(ord_type).alias("_first"),
        F.when(F.col("id") == 0, BEFORE).otherwise(AFTER).alias("_p"), F.lit(None).cast("string").alias("_f"), F.lit(None).cast(ord_type).alias("_o"),
        F.when(F.col("id") == 0, before if isinstance(before, Column) else F.lit(before)).otherwise(after if isinstance(after, Column) else F.lit(after)).alias("text"),
    )
    order = ["_n", "_first", "_p", "_f", "_o"]
    whole = rows.withColumn("_o", F.col("_o").cast(ord_type)).unionByName(frame)
    return whole.repartitionByRange(*order).sortWithinPartitions(*order).select("text")


def comma(entries: DataFrame) -> Column:
    """A comma before each entry but the first of all."""
    first = entries.orderBy(F.desc("occurrence_count"), "first_ord").select(F.to_json(F.struct("first_ord")).alias("j"), "occurrence_count").first()
    if first is None:
        return F.lit("")
    return F.when((F.to_json(F.struct("first_ord")) == first.j) & (F.col("occurrence_count") == first.occurrence_count), "").otherwise(",")


def bill(classified: DataFrame) -> DataFrame:
    """The bill as one JSON array: entries by falling number of findings, each with its files and its findings."""
    entries = entries_of(classified)
    head = F.struct("cbom_entry_id", "algorithm", "key_size", "cbom_category", "library", "occurrence_count", "max_confidence")
    tail = F.to_json(F.struct("recommendation", "fix_suggestion"))
    files = joined(keyed(classified).where("file_path is not null").select(*KEY, "file_path").distinct(), entries)
    items = joined(keyed(classified).select(*KEY, "ord", F.struct("file_path", "line_number", "code_snippet", "detection_method", "confidence").alias("o")), entries)
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("file_path").alias("p"))), r'(?s)^\{"p":(.*)\}$', 1)
    row = lambda df, place, file, ord_, text: df.select(*normal_order(), F.lit(place).alias("_p"), file.cast("string").alias("_f"), ord_.alias("_o"), text.alias("text"))
    none = F.lit(None)
    parts = [
        part(entries, HEAD, F.concat(comma(entries), F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"files_affected":['))),
        row(files, FILES, F.col("file_path"), none, listed(F.col("file_path") == F.col("first_file"), quoted)),
        part(entries, MIDDLE, F.lit('],"occurrences":[')),
        row(items, ITEMS, none, F.col("ord"), listed(F.col("ord") == F.col("first_ord"), F.to_json("o"))),
        part(entries, TAIL, F.concat(F.lit("]"), F.when(tail == "{}", "}").otherwise(F.regexp_replace(tail, r"^\{", ",")))),
    ]
    return document([p.withColumn("_o", F.col("_o").cast(entries.schema["first_ord"].dataType)) for p in parts], entries, "[", "]")


def cyclonedx(classified: DataFrame, version: str = "1.0") -> DataFrame:
    """The CycloneDX document: a component for each entry, with the places of its findings."""
    entries = entries_of(classified)
    c = cyclonedx_properties(entries)
    head = F.to_json(F.struct(F.lit("cryptographic-asset").alias("type"), F.col("cbom_entry_id").alias("bom-ref"), "name", F.col("props").alias("cryptoProperties")))
    tail = F.to_json(F.struct(F.col("advice").alias("properties")))
    items = joined(keyed(classified).select(*KEY, "ord", F.struct(F.col("file_path").alias("location")).alias("o")), entries)
    none = F.lit(None)
    parts = [
        part(c, HEAD, F.concat(comma(entries), F.regexp_replace(head, r"\}$", ""), F.lit(',"evidence":{"occurrences":['))),
        items.select(*normal_order(), F.lit(ITEMS).alias("_p"), none.cast("string").alias("_f"), F.col("ord").alias("_o"), listed(F.col("ord") == F.col("first_ord"), F.to_json("o")).alias("text")),
        part(c, TAIL, F.concat(F.lit("]}"), F.when(tail == "{}", "}").otherwise(F.regexp_replace(tail, r"^\{", ",")))),
    ]
    tool = F.struct(F.array(F.struct(F.lit("application").alias("type"), F.lit("pqledger").alias("name"), F.lit(version).alias("version"))).alias("components"))
    top = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.concat(F.lit("urn:uuid:"), F.uuid()).alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), tool.alias("tools")).alias("metadata"),
    )
    before = F.concat(F.regexp_replace(F.to_json(top), r"\}$", ""), F.lit(',"components":['))
    return document([p.withColumn("_o", F.col("_o").cast(entries.schema["first_ord"].dataType)) for p in parts], entries, before, "]}")
