"""A deterministic view that turns the driver's lineitem table into findings; the same SQL runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = """
select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string)) as artifact_id,
 case k % 14 when 0 then 'RSA' when 1 then 'AES' when 2 then 'MD5' when 3 then 'SHA-1' when 4 then 'SHA-256' when 5 then 'DES' when 6 then '3DES'
  when 7 then 'ECC' when 8 then 'ECDSA' when 9 then 'TLS-1.2' when 10 then 'ML-KEM' when 11 then 'UNSPECIFIED' when 12 then null else 'TLS 1.0' end as algorithm,
 cast(case when k % 14 = 0 then 1024 * (1 + u % 4) when k % 14 = 1 then 128 * (1 + u % 2) end as int) as key_size,
 case when k % 14 in (2, 3, 4) then 'hash' when k % 14 = 9 then 'protocol' when k % 14 = 11 then (case u % 3 when 0 then 'import_signal' when 1 then 'certificate' else 'library' end)
  when k % 14 = 12 then (case u % 4 when 0 then 'hsm' when 1 then 'packet_constraint' when 2 then 'embedded_iot' else 'protocol' end) else 'algorithm' end as artifact_type,
 concat(case u % 3 when 0 then 'src/auth/m' when 1 then 'src/payment/m' else 'src/core/m' end, cast(u as string), case ln % 6 when 0 then '.py' when 1 then '.java' when 2 then '.c' when 3 then '.js' when 4 then '.key' else '.pem' end) as file_path,
 case q % 4 when 0 then 'ast_call' when 1 then 'tree_sitter' when 2 then 'config_directive' else 'pattern_match' end as detection_method,
 case when k % 14 = 11 then concat('lib', cast(u % 5 as string)) when k % 3 = 0 then 'OpenSSL' end as library,
 case when k % 14 = 12 then (case q % 3 when 0 then 'TLS 1.0' when 1 then 'TLS 1.2' else 'SSH' end) end as protocol,
 ln as line_number, cast(20 + q as double) / 100 as confidence, ord
from (select l_partkey as k, l_suppkey as u, l_linenumber as ln, cast(floor(l_quantity) as int) as q, {ord} as ord, * from lineitem) b"""
ORDER = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.cbom import conform

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return conform(spark.sql(FINDINGS.format(ord=f"struct{ORDER}").replace("from lineitem)", "from {t})"), t=df))


def oracle_findings() -> str:
    return FINDINGS.format(ord=f"row{ORDER}")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic source line for each line item: (path, line_number, line)."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(LINES.replace("from lineitem", "from {t}"), t=df)


LINES = """
select concat('src/m', cast(l_suppkey as string), case l_linenumber % 4 when 0 then '.py' when 1 then '.java' when 2 then '.c' else '.js' end) as path, l_linenumber as line_number,
 l_orderkey, l_partkey,
 case l_partkey % 10 when 0 then concat('key = RSA.generate(', cast(1024 * (1 + l_suppkey % 4) as string), ')') when 1 then 'c = AES.new(key, AES.MODE_GCM)' when 2 then 'hashlib.sha1(data)'
  when 3 then '// DES.new(key)' when 4 then 'x = EVP_sha256()' when 5 then 'ssl.create_default_context()' when 6 then 'ssl_protocols TLSv1.2 TLSv1.3;' when 7 then 'MTU_SIZE = 1500'
  when 8 then concat('RSA_generate_key(', cast(512 * (1 + l_suppkey % 3) as string), ', 3)') else 'return total + 1' end as line
from lineitem"""
