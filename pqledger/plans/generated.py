"""Files of source code and configuration that Spark derives from the driver's lineitem table, one for each order, and the
queries that run the detectors over them. The SQL beside each query reads the same lines and computes what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code, commands, rules
from ..operators.structure import structural
from ..session import ship
from . import scan

SIZE = "cast(1024 * (1 + u % 4) as string)"
BITS = "cast(128 * (1 + u % 2) as string)"
#: For each kind of file, what its lines say; u is a number that differs from row to row.
SNIPPETS = {
    "java": [
        """'MessageDigest a = MessageDigest.getInstance("MD5");'""",
        f"""concat('KeyPairGenerator g = KeyPairGenerator.getInstance("RSA");', chr(10), 'g.initialize(', {SIZE}, ');')""",
        """concat('Cipher c = Cipher.getInstance("AES/', case u % 2 when 0 then 'GCM' else 'CBC' end, '/NoPadding");')""",
        f"""concat('wrap(', chr(10), '  Signature.getInstance("DSA"), ', {SIZE}, ');')""",
        "'import javax.crypto.Cipher;'",
        """concat('/* Cipher.getInstance("DES") */ int x = ', cast(u as string), ';')""",
        """'byte[] b = MessageDigest.getInstance("SHA-256").digest(d);'""",
        "concat('int y = foo(', cast(u as string), ');')",
    ],
    "c": [
        "'MD5(data, len, out);'",
        f"concat('RSA *r = RSA_generate_key(', {SIZE}, ', 3, NULL, NULL);')",
        "concat('init(ctx,', chr(10), '  EVP_sha256());')",
        f"concat('AES_set_encrypt_key(key, ', {BITS}, ', &k);')",
        "'#include <openssl/evp.h>'",
        "'// DES_set_key(k);'",
        "'unsigned char *MD5(const unsigned char *d);'",
        "concat('int x = ', cast(u as string), ';')",
    ],
    "js": [
        """'const h = crypto.createHash("sha256").update(d).digest("hex");'""",
        f"""concat('crypto.generateKeyPairSync("rsa", {{ modulusLength: ', {SIZE}, ' }});')""",
        f"""concat('const c = crypto.createCipheriv(', chr(10), '  "aes-', {BITS}, '-gcm", k, iv);')""",
        """'run(() => crypto.createHmac("md5", k));'""",
        """'const crypto = require("crypto");'""",
        """'// crypto.createHash("sha1")'""",
        """'let s = "crypto.createHash(sha-512)";'""",
        "concat('let y = add(', cast(u as string), ');')",
    ],
    "py": [
        "'h = hashlib.md5(data).hexdigest()'",
        f"concat('k = RSA.generate(', {SIZE}, ')')",
        "concat('c = AES.new(key, AES.MODE_', case u % 2 when 0 then 'GCM' else 'EAX' end, ')')",
        "concat('e = ec.generate_private_key(', chr(10), '    ec.SECP', case u % 2 when 0 then '256' else '384' end, 'R1())')",
        "'import hashlib'",
        "'# DES.new(key)'",
        "'s = \"hashlib.sha1(x)\"'",
        "concat('x = total(', cast(u as string), ')')",
    ],
    "docker": [
        "concat('RUN apt-get update && ', chr(92), chr(10), '  apt-get install -y openssl=', cast(u as string), ' curl libssl-dev')",
        f"concat('RUN openssl genrsa -out server.key ', {SIZE})",
        "concat('ENV TLS_VERSION=TLSv1.', cast(u % 4 as string))",
        "concat('COPY certs/ca-', cast(u as string), '.pem /etc/ssl/')",
        f"concat('# RSA-', {SIZE})",
        f"concat('RUN echo AES-', {BITS}, '-GCM and RSA-', {SIZE}, ' by TLSv1.2')",
        "concat('RUN openssl dgst -', case u % 2 when 0 then 'sha256' else 'md5' end, ' file')",
        "concat('ENV DB_PASSWORD=hunter', cast(u as string))",
        f"concat('ARG RSA_KEY_SIZE=', {SIZE})",
        "'EXPOSE 443'",
    ],
    "config": [
        "concat('ssl_protocols TLSv1.', cast(u % 4 as string), ';')",
        f"concat('; cipher AES-', {BITS}, '-CBC')",
        f"concat('kex RSA-', {SIZE}, ' SHA-256 ChaCha20-Poly1305')",
        "'PermitRootLogin no'",
        "concat('exec openssl ', case u % 2 when 0 then 'genrsa' else 'x509' end, ' -out f')",
        "concat('worker ', cast(u as string))",
    ],
    "requirements": ["concat('cryptography==', cast(u as string), '.1')", "'pynacl'", "concat('flask==', cast(u as string))", "'# bcrypt'"],
    "gradle": ["concat('implementation ''org.bouncycastle:bcprov-jdk18on:1.', cast(u as string), '''')", "'compile tink'", "concat('version ', cast(u as string))"],
    "cmake": ["concat('find_package(OpenSSL ', cast(u % 9 as string), '.', cast(u as string), ' REQUIRED)')", "'target_link_libraries(app mbedtls)'", "'set(x openssl)'"],
    "dpkg": ["concat('Package: openssl', chr(10), 'Version: ', cast(u as string), chr(10))", "concat('Package: bash', chr(10), 'Version: 5', chr(10))", "concat('Package: libssl3', chr(10), 'Status: ok', chr(10))"],
}
PATHS = {"java": "src/F{}.java", "c": "src/f{}.c", "js": "src/f{}.js", "py": "src/f{}.py", "docker": "d{}/Dockerfile", "config": "etc/f{}.conf", "requirements": "r{}/requirements.txt", "gradle": "g{}/build.gradle", "cmake": "m{}/CMakeLists.txt", "dpkg": "i{}/var/lib/dpkg/status"}
PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
IN_ORDER = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


def lines_sql(kind: str) -> str:
    """Orders o, row numbers n and lines of a kind of file, in SQL that Spark and DuckDB both read."""
    some = SNIPPETS[kind]
    cases = " ".join(f"when {i} then {x}" for i, x in enumerate(some))
    return f"select o, n, u, case k {cases} end as line from (select l_orderkey as o, l_suppkey as u, l_partkey % {len(some)} as k, row_number() over ({IN_ORDER}) as n from lineitem) b"


def lines_at(kind: str) -> str:
    """The same, with the line number at which each row begins."""
    return f"select *, cast(coalesce(sum(1 + length(line) - length(replace(line, chr(10), ''))) over (partition by o order by n rows between unbounded preceding and 1 preceding), 0) as bigint) + 1 as pos from ({lines_sql(kind)}) a"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, rows): an order's rows, sorted by what lines_sql numbers them by. One shuffle: they are sorted where they meet, and lines
    are made after it, as what they say is a function of what rows are sorted by; rows equal in it are equal lines."""
    rows = ship(spark).read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), *PLACE)
    return rows.groupBy("o").agg(F.sort_array(F.collect_list(F.struct(*PLACE))).alias("rows"))


def path_of(kind: str) -> Column:
    before, after = PATHS[kind].split("{}")
    return F.concat(F.lit(before), F.col("o").cast("string"), F.lit(after))


def text_of(kind: str) -> Column:
    """The text that an order's rows make."""
    some = SNIPPETS[kind]
    cases = " ".join(f"when {i} then {x}" for i, x in enumerate(some))
    return F.array_join(F.expr(f"zip_with(rows.l_suppkey, rows.l_partkey, (u, k) -> case k % {len(some)} {cases} end)"), "\n")


def files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(path, text) of a kind, one file for each order; an order has a few lines."""
    return orders(spark, sf_dir).select(path_of(kind).alias("path"), text_of(kind).alias("text"))


def texts(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(path, text) of several kinds. An order's rows are read, sent and sorted once for all of them."""
    some = F.array(*[F.struct(path_of(k).alias("path"), text_of(k).alias("text")) for k in kinds])
    return orders(spark, sf_dir).select(F.explode(some).alias("f")).select("f.path", "f.text")


def tree(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(path, length, content) as a scan reads it."""
    return texts(spark, sf_dir, *kinds).select("path", F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.coalesce("line_number", F.lit(0))).cast("long").alias("lines"))


STRUCTURE = ("language", "artifact_type", "algorithm", "library", "key_size", "mode", "curve")


def structural_rows(spark, sf):
    """Calls with their enclosing and chained calls, and imports, in four languages."""
    some = texts(spark, sf, "java", "c", "js", "py")
    return counted(code.found(some, structural, only=(*STRUCTURE, "line_number")), *STRUCTURE)


def java_factories(spark, sf):
    return counted(rules.java_code(files(spark, sf, "java")), "artifact_type", "algorithm", "library", "key_size", "mode", "detection_method", "confidence")


def c_signals(spark, sf):
    return counted(rules.c_code(files(spark, sf, "c")), "artifact_type", "algorithm", "library", "key_size", "detection_method", "confidence")


def javascript_calls(spark, sf):
    return counted(code.found(files(spark, sf, "js"), code.javascript_code), "artifact_type", "algorithm", "library", "key_size", "mode", "detection_method")


def python_calls(spark, sf):
    return counted(code.found(files(spark, sf, "py"), code.python_code), "artifact_type", "algorithm", "library", "key_size", "mode", "curve", "detection_method")


def dockerfile_rules(spark, sf):
    found = rules.opened(files(spark, sf, "docker").select("path", "text"), commands.docker_hits(F.col("text")))
    return counted(found, "docker_instruction", "artifact_type", "algorithm", "key_size", "library", "protocol", "protocol_version", "evidence_type", "detection_method", "confidence")


def config_rules(spark, sf):
    found = rules.opened(files(spark, sf, "config").select("path", "text"), commands.config_hits(F.col("text")))
    return counted(found, "artifact_type", "algorithm", "key_size", "protocol", "evidence", "confidence")


def manifest_versions(spark, sf):
    some = texts(spark, sf, "requirements", "gradle", "cmake")
    return counted(code.found(some, code.manifest), "library", "dependency_version")


def package_databases(spark, sf):
    found = rules.opened(files(spark, sf, "dpkg").select("path", "text"), commands.database_hits(F.col("text"), F.lit(False)))
    return found.groupBy("library", "dependency_version", "evidence", "confidence").agg(F.count("*").alias("n"))


def image_metadata(spark, sf):
    """Metadata of one image for each order: its lines are the labels."""
    some = files(spark, sf, "config")
    labels = F.map_from_entries(F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.concat(F.lit("l"), i.cast("string")).alias("key"), x.alias("value"))))
    config = F.struct(F.array(F.lit("SSL_VERSION=TLSv1.1"), F.lit("API_TOKEN=RSA")).alias("Env"), labels.alias("Labels"))
    images = some.select(F.col("path").alias("image"), F.to_json(F.array(F.struct(config.alias("Config")))).alias("inspect"))
    return scan.metadata(images).groupBy("artifact_type", "algorithm", "key_size", "protocol", "detection_method", "confidence").agg(F.count("*").alias("n"))


def scan_methods(spark, sf):
    """A whole scan, in one pass over the files, by detector."""
    found = scan.detect(tree(spark, sf, "docker", "requirements"))
    return found.groupBy("detection_method", "artifact_type").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


_NULL, _INT = "null::varchar", "null::int"
_J, _JS = f"j as materialized ({lines_at('java')})", f"js as materialized ({lines_at('js')})"
_C, _PY = f"c as materialized ({lines_at('c')})", f"p as materialized ({lines_at('py')})"
_OF = lambda pattern, kind="int": f"cast(nullif(regexp_extract(line, '{pattern}', 1), '') as {kind})"
_KIND = "case when name in ('MD5', 'SHA-256') then 'hash' else 'algorithm' end"
_JAVA_CALLS = f"""jc as (select *, regexp_extract(line, '(\\w+)\\.getInstance', 1) as factory, regexp_extract(line, 'getInstance\\("([^"/]+)', 1) as name, nullif(regexp_extract(line, 'getInstance\\("[^/"]+/(\\w+)', 1), '') as mode from j where line like '%getInstance%' and line not like '/*%')"""
_STRUCTURAL = f"""with {_J}, {_C}, {_JS}, {_PY}, {_JAVA_CALLS},
 r as (select 'Java' as language, {_KIND} as artifact_type, name as algorithm, 'java.security.' || factory as library, {_INT} as key_size, mode, {_NULL} as curve, case when line like 'wrap%' then pos + 1 else pos end as pos from jc
  union all select 'Java', {_KIND}, name, 'java.security.' || factory, null, mode, null, pos from jc where line like '%).digest(%'
  union all select 'Java', {_KIND}, name, 'java.security.' || factory, {_OF('(1024|2048|3072|4096)')}, mode, null, pos from jc where line like 'wrap%'
  union all select 'Java', 'import_signal', 'UNSPECIFIED', regexp_extract(line, 'import (.*);', 1), null, null, null, pos from j where line like 'import%'
  union all select 'C/C++', case when line like 'MD5(%' then 'hash' else 'algorithm' end, regexp_extract(line, '(MD5|RSA|AES)_?\\w*\\(', 1),
    case when line like 'MD5(%' then 'openssl/md5.h' when line like 'AES%' then 'openssl/aes.h' else 'openssl/rsa.h' end, {_OF('\\b(512|1024|2048|3072|4096|128|192|256)\\b')}, null, null, pos from c where line like 'MD5(%' or line like 'RSA%' or line like 'AES%'
  union all select 'C/C++', 'hash', 'SHA-256', 'openssl/evp.h', null, null, null, pos + 1 from c where line like 'init(%'
  union all select 'C/C++', 'import_signal', 'UNSPECIFIED', regexp_extract(line, '<(.*)>', 1), null, null, null, pos from c where line like '#include%'
  union all select 'JavaScript', 'hash', 'SHA-256', 'Node.js crypto', null, null, null, pos from js, range(0, 3) where line like 'const h = crypto.createHash%'
  union all select 'JavaScript', 'hash', 'MD5', 'Node.js crypto', null, null, null, pos from js, range(0, 2) where line like 'run(%createHmac%'
  union all select 'JavaScript', 'algorithm', 'RSA', 'Node.js crypto', {_OF('modulusLength: (\\d+)')}, null, null, pos from js where line like 'crypto.generateKeyPair%'
  union all select 'JavaScript', 'algorithm', 'AES', 'Node.js crypto', {_OF('aes-(\\d+)')}, upper(regexp_extract(line, 'aes-\\d+-(\\w+)', 1)), null, pos from js where line like '%createCipheriv%'
  union all select 'JavaScript', 'import_signal', 'UNSPECIFIED', 'Node.js crypto', null, null, null, pos from js where line like 'const%require("crypto")%'
  union all select 'Python', 'hash', 'MD5', 'hashlib', null, null, null, pos from p where line like 'h = hashlib.md5%'
  union all select 'Python', 'algorithm', 'RSA', 'Crypto.PublicKey', {_OF('generate\\((\\d+)')}, null, null, pos from p where line like 'k = RSA%'
  union all select 'Python', 'algorithm', 'AES', 'Crypto.Cipher', null, regexp_extract(line, 'MODE_(\\w+)', 1), null, pos from p where line like 'c = AES%'
  union all select 'Python', 'algorithm', 'ECC', 'cryptography', null, null, 'P-' || regexp_extract(line, 'SECP(\\d+)', 1), pos from p where line like 'e = ec.%'
  union all select 'Python', 'import_signal', 'UNSPECIFIED', 'hashlib', null, null, null, pos from p where line = 'import hashlib')
 select language, artifact_type, algorithm, library, key_size, mode, curve, count(*) as n, cast(sum(pos) as bigint) as lines from r group by all"""
_D = f"with d as materialized ({lines_at('docker')})"
_DOCKER_ROWS = f"""r as (select 'RUN' as docker_instruction, 'library' as artifact_type, {_NULL} as algorithm, {_INT} as key_size, x.lib as library, {_NULL} as protocol, {_NULL} as protocol_version, 'package_install' as evidence_type, 'pattern' as detection_method, x.sure as confidence, pos, o
   from d, (values ('OpenSSL', 0.9::double, ' openssl='), ('OpenSSL (dev headers)', 0.85::double, ' libssl-dev')) x(lib, sure, word) where line like '%apt-get install%' and contains(line, x.word)
  union all select 'RUN', 'algorithm', 'RSA', {_OF('server.key (\\d+)')}, 'OpenSSL', null, null, 'openssl_command', 'regex/pattern', 0.95, pos, o from d where line like 'RUN openssl genrsa%'
  union all select 'RUN', 'key_reference', null, null, null, null, null, 'key_file_reference', 'pattern', 0.8, pos, o from d where line like '%server.key%'
  union all select 'RUN', 'algorithm', case regexp_extract(line, 'dgst -(\\w+)', 1) when 'md5' then 'MD5' else 'SHA-256' end, null, 'OpenSSL', null, null, 'openssl_command', 'regex/pattern', 0.9, pos, o from d where line like 'RUN openssl dgst%'
  union all select 'ENV', 'protocol', null, null, null, 'TLS', regexp_extract(line, '(TLSv1[.0-9]*)', 1), 'env_config', 'pattern', 0.9, pos, o from d where line like 'ENV TLS%'
  union all select 'COPY', 'certificate_reference', null, null, null, null, null, 'certificate_file_reference', 'pattern', 0.8, pos, o from d where line like 'COPY%'
  union all select 'RUN', 'algorithm', regexp_extract(line, '(AES-\\d+-GCM)', 1), null, null, null, null, 'algorithm_reference', 'regex/pattern', 0.75, pos, o from d where line like 'RUN echo%'
  union all select 'RUN', 'algorithm', 'RSA', {_OF('RSA-(\\d+)')}, null, null, null, 'algorithm_reference', 'regex/pattern', 0.75, pos, o from d where line like 'RUN echo%'
  union all select 'RUN', 'protocol', null, null, null, 'TLS', regexp_extract(line, '(TLSv1[.0-9]*)', 1), 'protocol_version', 'pattern', 0.9, pos, o from d where line like 'RUN echo%'
  union all select 'ARG', 'algorithm', 'RSA', {_OF('=(\\d+)')}, null, null, null, 'env_config', 'pattern', 0.85, pos, o from d where line like 'ARG RSA%')"""
_F = f"f as materialized ({lines_at('config')})"
_CONFIG = """select 'protocol' as artifact_type, null::varchar as algorithm, null::int as key_size, 'TLSv1.' || regexp_extract(line, 'TLSv1[.]([0-3])', 1) as protocol, null::varchar as evidence, least(0.9::double, {sure} + 0.2) as confidence, pos from f where line like 'ssl%'
 union all select 'algorithm', regexp_extract(line, '(AES-\\d+-CBC)', 1), null, null, null, {comment}, pos from f where line like ';%'
 union all select 'algorithm', 'RSA', cast(regexp_extract(line, 'RSA-(\\d+)', 1) as int), null, null, {sure}, pos from f where line like 'kex%'
 union all select 'algorithm', x.name, null, null, null, {sure}, pos from f, (values ('SHA-256'), ('ChaCha20-Poly1305')) x(name) where line like 'kex%' and contains(line, x.name)
 union all select 'protocol', null, null, 'SSH', null, least(0.85::double, {sure} + 0.1), pos from f where line like '%PermitRootLogin%'
 union all select case when line like '%x509%' then 'certificate' else 'algorithm' end, null, null, null, 'openssl ' || regexp_extract(line, 'openssl (\\w+)', 1), least(0.95::double, {sure} + 0.3), pos from f where line like 'exec%'"""

ORACLES = {
    "structural_rows": _STRUCTURAL,
    "java_factories": f"""with {_J}, {_JAVA_CALLS}, s as (select o, pos + 1 as pos, {_OF('initialize\\((\\d+)')} as size from j where line like '%initialize%'),
 c as (select *, case when line like 'wrap%' then pos + 1 else pos end as b from jc),
 z as (select c.o, c.n, max_by(s.size, s.pos) as key_size from c join s on c.o = s.o and s.pos between c.b and c.b + 3 group by 1, 2)
 select {_KIND} as artifact_type, name as algorithm, case factory when 'Cipher' then 'javax.crypto' else 'java.security' end as library, z.key_size, mode, 'ast_call' as detection_method, 0.95::double as confidence, count(*) as n, cast(sum(b) as bigint) as lines
  from c left join z on c.o = z.o and c.n = z.n group by all
 union all select 'import_signal', 'UNSPECIFIED', regexp_extract(line, 'import (.*);', 1), null, null, 'ast_import', 0.3, count(*), 0 from j where line like 'import%' group by 3""",
    "c_signals": f"""with {_C}, r as (select 'hash' as artifact_type, 'MD5' as algorithm, 'openssl/md5.h' as library, {_INT} as key_size, 0.7::double as confidence, pos from c where contains(line, 'MD5(')
  union all select 'algorithm', 'RSA', 'openssl/rsa.h', {_OF('key\\((\\d+)')}, 0.7, pos from c where line like '%RSA_generate_key(%'
  union all select 'hash', 'SHA-256', 'openssl/evp.h', null, 0.7, pos + 1 from c where line like '%EVP_sha256(%'
  union all select 'algorithm', 'AES', 'openssl/aes.h', {_OF('key, (\\d+)')}, 0.7, pos from c where line like 'AES_set%'
  union all select 'import_signal', 'UNSPECIFIED', regexp_extract(line, '<(.*)>', 1), null, 0.25, pos from c where line like '#include%')
 select artifact_type, algorithm, library, key_size, 'pattern_match' as detection_method, confidence, count(*) as n, cast(sum(pos) as bigint) as lines from r group by all""",
    "javascript_calls": f"""with {_JS}, m as (select *, regexp_extract(line, 'crypto[.](\\w+)\\(', 1) as api, lower(regexp_extract(line, 'crypto[.]\\w+\\(\\s*"?([\\w-]+)', 1)) as arg from js where contains(line, 'crypto.') and line not like '//%'),
 r as (select case when api in ('createHash', 'createHmac') then 'hash' else 'algorithm' end as artifact_type, case when arg like 'aes%' then 'AES' when arg = 'rsa' then 'RSA' when arg = 'md5' then 'MD5' else 'SHA-' || regexp_extract(arg, '(\\d+)', 1) end as algorithm,
   {_OF('modulusLength: (\\d+)')} as key_size, nullif(upper(regexp_extract(arg, 'aes-\\d+-(\\w+)', 1)), '') as mode, 'pattern_match' as detection_method, pos from m
  union all select 'import_signal', 'UNSPECIFIED', null, null, 'import_signal', pos from js where line like '%require("crypto")%')
 select artifact_type, algorithm, 'Node.js crypto' as library, key_size, mode, detection_method, count(*) as n, cast(sum(pos) as bigint) as lines from r group by all""",
    "python_calls": f"""with {_PY}, r as (select 'hash' as artifact_type, 'MD5' as algorithm, 'hashlib' as library, {_INT} as key_size, {_NULL} as mode, {_NULL} as curve, 'ast_call' as detection_method, pos from p where line like 'h = hashlib.md5%'
  union all select 'algorithm', 'RSA', 'Crypto.PublicKey', {_OF('generate\\((\\d+)')}, null, null, 'ast_call', pos from p where line like 'k = RSA%'
  union all select 'algorithm', 'AES', 'Crypto.Cipher', null, regexp_extract(line, 'MODE_(\\w+)', 1), null, 'ast_call', pos from p where line like 'c = AES%'
  union all select 'algorithm', 'ECC', 'cryptography', null, null, 'P-' || regexp_extract(line, 'SECP(\\d+)', 1), 'ast_call', pos from p where line like 'e = ec.%'
  union all select 'import_signal', 'UNSPECIFIED', 'hashlib', null, null, null, 'ast_import', pos from p where line = 'import hashlib')
 select artifact_type, algorithm, library, key_size, mode, curve, detection_method, count(*) as n, cast(sum(pos) as bigint) as lines from r group by all""",
    "dockerfile_rules": f"{_D}, {_DOCKER_ROWS} select docker_instruction, artifact_type, algorithm, key_size, library, protocol, protocol_version, evidence_type, detection_method, confidence, count(*) as n, cast(sum(pos) as bigint) as lines from r group by all",
    "scan_methods": f"""{_D}, {_DOCKER_ROWS}, a as ({lines_at('requirements')}),
 x as (select distinct detection_method, artifact_type, algorithm, pos, 'd' || o as file from r
  union all select 'dependency_manifest', 'library', null, pos, 'r' || o from a where line like 'cryptography%' or line like 'pynacl%')
 select detection_method, artifact_type, count(*) as n, count(distinct file) as files from x group by all""",
    "config_rules": f"with {_F}, r as ({_CONFIG.format(sure='0.65::double', comment='round(0.65::double * 0.5, 2)')}) select artifact_type, algorithm, key_size, protocol, evidence, round(confidence, 2) as confidence, count(*) as n, cast(sum(pos) as bigint) as lines from r group by all",
    "manifest_versions": f"""with a as ({lines_at('requirements')}), b as ({lines_at('gradle')}), c as ({lines_at('cmake')}),
 r as (select case when line like 'cryptography%' then 'cryptography (Python)' else 'PyNaCl (libsodium)' end as library, coalesce(nullif(regexp_extract(line, '==([\\w.]+)', 1), ''), 'unknown') as dependency_version, pos from a where line like 'cryptography%' or line like 'pynacl%'
  union all select x.lib, coalesce(nullif(regexp_extract(line, ':([\\w.]+)''', 1), ''), 'unknown'), pos from b, (values ('bouncycastle', 'Bouncy Castle'), ('bcprov-jdk18on', 'Bouncy Castle Provider'), ('tink', 'Google Tink')) x(word, lib) where contains(line, x.word)
  union all select case when line like '%OpenSSL%' then 'OpenSSL' else 'mbed TLS' end, coalesce(nullif(regexp_extract(line, '(\\d+\\.\\d+)', 1), ''), 'unknown'), pos from c where line like 'find_package%' or line like 'target_link%')
 select library, dependency_version, count(*) as n, cast(sum(pos) as bigint) as lines from r group by all""",
    "package_databases": f"""with a as ({lines_sql('dpkg')}) select case when line like '%openssl%' then 'OpenSSL' else 'OpenSSL' end as library, nullif(regexp_extract(line, 'Version: (\\w+)', 1), '') as dependency_version, 'dpkg package: ' || regexp_extract(line, 'Package: (\\S+)', 1) as evidence,
 case when line like '%libssl3%' then 0.85::double else 0.9::double end as confidence, count(*) as n from a where line not like '%bash%' group by all""",
    "image_metadata": f"""with {_F}, l as (select *, 'l' || (row_number() over (partition by o order by n) - 1) || '=' || line as label from f),
 g as (select o, n, pos, label as line from l), h as (select count(distinct o) as orders from f),
 r as (select 'protocol' as artifact_type, {_NULL} as algorithm, {_INT} as key_size, 'TLSv1.' || regexp_extract(line, 'TLSv1[.]([0-3])', 1) as protocol, 0.9::double as confidence from g where line like '%ssl_protocols%'
  union all select 'algorithm', regexp_extract(line, '(AES-\\d+-CBC)', 1), null, null, 0.7 from g where line like '%=; cipher%'
  union all select 'algorithm', 'RSA', cast(regexp_extract(line, 'RSA-(\\d+)', 1) as int), null, 0.7 from g where line like '%=kex%'
  union all select 'algorithm', x.name, null, null, 0.7 from g, (values ('SHA-256'), ('ChaCha20-Poly1305')) x(name) where line like '%=kex%' and contains(line, x.name)
  union all select 'protocol', null, null, 'SSH', 0.8 from g where line like '%PermitRootLogin%'
  union all select case when line like '%x509%' then 'certificate' else 'algorithm' end, null, null, null, 0.95 from g where line like '%=exec%'
  union all select 'protocol', null, null, 'TLSv1.1', 0.9 from f where n = 1)
 select artifact_type, algorithm, key_size, protocol, 'docker_inspect' as detection_method, confidence, count(*) as n from r group by all""",
}


#: Lines of code and configuration that between them match every line rule.
RULE_LINES = [
    "RSA.generate(2048)", "rsa.generate_private_key(x)", 'KeyPairGenerator.getInstance("RSA"x', "ec.generate_private_key(x)", 'createSign("ECDSA"x', "ECDH.new(x)", "createECDH(x)", "AES.new(k, MODE_CBC)", 'createCipheriv("aes',
    'Cipher.getInstance("AES', "DES.new(k)", 'Cipher.getInstance("DES"x', "DES3.new(k)", "TripleDES", 'Cipher.getInstance("DESede"x', "hashlib.sha1(x)", 'createHash("sha1"x', 'MessageDigest.getInstance("SHA-1"x', "hashlib.sha256(x) bits = 256",
    'createHash("sha256"x', 'MessageDigest.getInstance("SHA256"x', "hashlib.sha3_256(x)", 'createHash("sha3-256"x', "hmac.new(k)", "crypto.createHmac(x)", "Mac.getInstance(x)", "ssl.wrap_socket(s)", "ssl.create_default_context()", "SSL_CTX_new(m)", "tls.connect(o)",
    "https.request(o)", "use TLSv1.3", "PROTOCOL_TLSv1_2", "TLS1_1_VERSION", "TLSv1_0", "SSLv3", "SSLContext(x)", "SSL_CTX_set_min_proto_version(c)", "TLS_server_method()", "https.createServer(o)", "SSLSocketFactory f", "ECDHE-RSA-AES128-GCM-SHA256",
    "ECDHE-ECDSA-AES256-GCM-SHA384", "TLS_AES_256_GCM_SHA384", "TLS_CHACHA20_POLY1305_SHA256", "DHE-RSA-AES256-SHA", "ssh-keygen -t rsa", "paramiko.SSHClient()", "JSch(x)", "ssh-rsa AAAA", "ecdsa-sha2-nistp256", "ssh-ed25519", "diffie-hellman-group14-sha1",
    "  ssl_protocols TLSv1.2 TLSv1.3;", "ssl_ciphers HIGH;", "SSLCipherSuite ALL", "SSLProtocol all -SSLv3", "Protocol 2", "KexAlgorithms curve25519", "Ciphers aes256-ctr", "HostKeyAlgorithms ssh-rsa", "C_Initialize(x)", "new SunPKCS11()", "yubihsm", "TPM2_Init()",
    "KMIP", "FreeRTOS", "#include avr/io.h", "include stm32f4xx.h", "firmware_update()", "MTU_SIZE = 1500", "SO_SNDBUF", "fixed_frame_size", "ISO8583", "pgp_sym_encrypt(x)", "DBMS_CRYPTO", "UNHEX(SHA2(x))", "ENCRYPTBYPASSPHRASE(x)", "// DES.new(k)", "# ssh-rsa",
    "* FreeRTOS", "return total + 1", "",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_lines_sql() -> str:
    cases = " ".join(f"when {i} then {_quoted(x)}" for i, x in enumerate(RULE_LINES))
    return f"select concat('src/m', cast(l_suppkey as string), '.py') as path, l_linenumber as line_number, case l_partkey % {len(RULE_LINES)} {cases} end as line from lineitem"


def rule_findings(spark, sf):
    """All line rules over lines that between them match every rule."""
    query = rule_lines_sql().replace("{", "{{").replace("}", "}}").replace("from lineitem", "from {t}")
    lines = spark.sql(query, t=spark.read.parquet(f"{sf}/lineitem.parquet"))
    found = rules.code_rules(lines).unionByName(rules.protocols(lines)).unionByName(rules.hardware(lines))
    return counted(found, "detection_method", "artifact_type", "algorithm", "library", "confidence", "evidence", "protocol", "warning_type", "key_size", "mode")


def _rules_sql() -> str:
    """Each rule's pattern over each line, by DuckDB's own engine and without the sieves of the plan."""
    text = lambda x: "null::varchar" if x is None else _quoted(str(x))
    code_ = lambda c: f"not regexp_matches(line, '^\\s*({c})')"
    named, bare = r"\b(?:key_size|bits|modulusLength)\s*[:=]\s*(\d+)", r"\b(512|1024|2048|3072|4096|8192|128|192|256)\b"
    size = f"cast(coalesce(nullif(regexp_extract(line, '{named}', 1), ''), nullif(regexp_extract(line, '{bare}', 1), '')) as int)"
    mode = r"nullif(upper(regexp_extract(line, '(?i)\b(?:MODE_)?(GCM|CBC|EAX|ECB|CTR|CFB|OFB)\b', 1)), '')"
    out = []
    families = [([(rules.CODE_RULES, "semgrep")], "#|//|/\\*|\\*", size, mode), (rules.PROTOCOL_FAMILIES, "#|//|/\\*|\\*", "null::int", "null::varchar"), ([(rules.HARDWARE, rules.HARDWARE_METHOD)], "#|//|\\*", "null::int", "null::varchar")]
    for some, comments, size_, mode_ in families:
        for table, method in some:
            for r in table:
                pattern = _quoted(r.pattern.replace("(?iu)", "(?i)"))
                evidence = f"{text(r.evidence + ': ')} || trim(regexp_extract(line, {pattern}, 1))" if table is rules.DIRECTIVES else text(r.evidence)
                how = method[r.artifact_type] if isinstance(method, dict) else method
                out.append(f"select {text(how)} as detection_method, {text(r.artifact_type)} as artifact_type, {text(r.algorithm)} as algorithm, {text(r.library)} as library, {r.confidence}::double as confidence, {evidence} as evidence, {text(r.protocol)} as protocol, {text(r.warning)} as warning_type, {size_} as key_size, {mode_} as mode, line_number from l where regexp_matches(line, {pattern}) and {code_(comments)}")
    return f"with l as materialized ({rule_lines_sql()}), r as (" + " union all ".join(out) + ") select detection_method, artifact_type, algorithm, library, confidence, evidence, protocol, warning_type, key_size, mode, count(*) as n, cast(sum(line_number) as bigint) as lines from r group by all"


ORACLES["rule_findings"] = _rules_sql()

QUERIES = {f.__name__: f for f in (structural_rows, java_factories, c_signals, javascript_calls, python_calls, dockerfile_rules, config_rules, manifest_versions, package_databases, image_metadata, scan_methods, rule_findings)}
