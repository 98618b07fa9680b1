"""Rules on lines: tables of patterns compiled into one projection each; findings of a line come out of one explode.

Patterns are Java regular expressions and, as plan-time literals, compiled once. The pattern strings are fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line ends, as text files have them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@dataclass(frozen=True)
class Rule:
    """What a line that matches gives. size: number of the group that holds the key size."""

    pattern: str
    algorithm: str | None = None
    artifact_type: str = "algorithm"
    library: str | None = None
    confidence: float = 0.7
    evidence: str | None = None
    protocol: str | None = None
    warning: str | None = None
    size: int = 0


# fixed values: C and C++
C_CALLS = [
    Rule(r"\bRSA_generate_key\s*\(\s*(\d+)", "RSA", "algorithm", "openssl/rsa.h", size=1),
    Rule(r"\bMD5\s*\(", "MD5", "hash", "openssl/md5.h"),
    Rule(r"\bEVP_md5\s*\(", "MD5", "hash", "openssl/evp.h"),
    Rule(r"\bEVP_sha1\s*\(", "SHA-1", "hash", "openssl/evp.h"),
    Rule(r"\bEVP_sha256\s*\(", "SHA-256", "hash", "openssl/evp.h"),
    Rule(r"\bDES_ecb_encrypt\s*\(", "DES", "algorithm", "openssl/des.h"),
    Rule(r"\bDES_set_key\s*\(", "DES", "algorithm", "openssl/des.h"),
    Rule(r"\bAES_encrypt\s*\(", "AES", "algorithm", "openssl/aes.h"),
    Rule(r"\bAES_set_encrypt_key\s*\(\s*\w+\s*,\s*(\d+)", "AES", "algorithm", "openssl/aes.h", size=1),
]
C_INCLUDE = r"#include\s*[<\"]([^>\"]+)[>\"]"
C_HEADERS = ["openssl/rsa.h", "openssl/des.h", "openssl/md5.h", "openssl/aes.h", "openssl/evp.h"]
#: A line that a rule of C matches holds one of these.
C_PARTS = r"RSA_|MD5|EVP_|DES_|AES_|#include"
# fixed values: cross-language rules, word boundaries as they are
CODE_RULES = [
    Rule(r"\b(RSA\.generate|rsa\.generate_private_key|RSA_generate_key|KeyPairGenerator\.getInstance\s*\(\s*[\"']RSA[\"'])\b", "RSA", "algorithm", "Cryptographic Library", 0.95, "crypto-rsa-keygen"),
    Rule(r"\b(ec\.generate_private_key|SHA256withECDSA|ECDSA\.new|createSign\s*\(\s*[\"']ECDSA[\"'])\b", "ECDSA", "algorithm", "Cryptographic Library", 0.95, "crypto-ecdsa-usage"),
    Rule(r"\b(ECDH\.new|createECDH|ecdh)\b", "ECDH", "algorithm", "Cryptographic Library", 0.90, "crypto-ecdh-usage"),
    Rule(r"\b(AES\.new|createCipheriv\s*\(\s*[\"']aes|AES_encrypt|AES_set_encrypt_key|Cipher\.getInstance\s*\(\s*[\"']AES)\b", "AES", "algorithm", "Cryptographic Library", 0.95, "crypto-aes-cipher"),
    Rule(r"\b(DES\.new|DES_ecb_encrypt|Cipher\.getInstance\s*\(\s*[\"']DES[\"'])\b", "DES", "algorithm", "Cryptographic Library", 0.90, "crypto-des-weak", warning="deprecated_algorithm"),
    Rule(r"\b(DES3\.new|TripleDES|Cipher\.getInstance\s*\(\s*[\"']DESede[\"'])\b", "3DES", "algorithm", "Cryptographic Library", 0.90, "crypto-3des-weak", warning="deprecated_algorithm"),
    Rule(r"\b(hashlib\.sha1|EVP_sha1|createHash\s*\(\s*[\"']sha1[\"']|MessageDigest\.getInstance\s*\(\s*[\"']SHA-?1[\"'])\b", "SHA-1", "hash", "Hash Library", 0.90, "crypto-sha1-hash", warning="weak_hash"),
    Rule(r"\b(hashlib\.sha256|hashlib\.sha384|hashlib\.sha512|EVP_sha256|createHash\s*\(\s*[\"']sha256[\"']|MessageDigest\.getInstance\s*\(\s*[\"']SHA-?256[\"'])\b", "SHA-256", "hash", "Hash Library", 0.95, "crypto-sha2-hash"),
    Rule(r"\b(hashlib\.sha3_256|hashlib\.sha3_512|createHash\s*\(\s*[\"']sha3-256[\"'])\b", "SHA-3", "hash", "Hash Library", 0.95, "crypto-sha3-hash"),
    Rule(r"\b(hmac\.new|crypto\.createHmac|Mac\.getInstance)\b", "HMAC", "hash", "HMAC Library", 0.90, "crypto-hmac-usage"),
    Rule(r"\b(ssl\.wrap_socket|ssl\.create_default_context|SSL_CTX_new|tls\.connect|https\.request)\b", "TLS", "protocol", "TLS Library", 0.85, "crypto-tls-api"),
]
# fixed values: protocols
TLS_VERSIONS = [Rule(p, n, "protocol", None, 0.95, v, n) for p, n, v in [(r"\b(TLSv1\.3|TLSv1_3|PROTOCOL_TLSv1_3|TLS1_3_VERSION)\b", "TLS 1.3", "1.3"), (r"\b(TLSv1\.2|TLSv1_2|PROTOCOL_TLSv1_2|TLS1_2_VERSION)\b", "TLS 1.2", "1.2"), (r"\b(TLSv1\.1|TLSv1_1|PROTOCOL_TLSv1_1|TLS1_1_VERSION)\b", "TLS 1.1", "1.1"), (r"\b(TLSv1\.0|TLSv1_0|PROTOCOL_TLSv1|TLS1_VERSION)\b", "TLS 1.0", "1.0"), (r"\b(SSLv3|SSLv2)\b", "SSL", "3.0")]]
TLS_APIS = [Rule(p, None, "protocol", lib, 0.95, lib, v or "TLS") for p, lib, v in [(r"\bssl\.create_default_context\s*\(", "Python ssl", "TLS 1.2+"), (r"\bSSLContext\s*\(", "Standard SSLContext", None), (r"\bSSL_CTX_new\s*\(", "OpenSSL SSL_CTX", None), (r"\bSSL_CTX_set_min_proto_version\s*\(", "OpenSSL Min Version", None), (r"\bTLS_server_method\s*\(", "OpenSSL TLS Server", None), (r"\btls\.connect\s*\(", "Node.js TLS", None), (r"\bhttps\.createServer\s*\(", "Node.js HTTPS", None), (r"\bSSLSocketFactory\b", "Java SSLSocketFactory", None)]]
CIPHER_SUITES = [Rule(rf"\b{s}\b", s, "protocol", None, 0.5, s, v) for s, v in [("ECDHE-RSA-AES128-GCM-SHA256", "TLS 1.2"), ("ECDHE-ECDSA-AES256-GCM-SHA384", "TLS 1.2"), ("TLS_AES_256_GCM_SHA384", "TLS 1.3"), ("TLS_CHACHA20_POLY1305_SHA256", "TLS 1.3"), ("DHE-RSA-AES256-SHA", "TLS 1.0-1.2")]]
SSH = [Rule(p, None, "protocol", lib, 0.5, lib, v or "SSH") for p, lib, v in [(r"\bssh-keygen\b", "SSH Key Generator", None), (r"\bParamiko\b|\bparamiko\.SSHClient\s*\(", "Paramiko SSH", "SSHv2"), (r"\bJSch\s*\(", "JSch Java SSH", "SSHv2"), (r"\bssh-rsa\b", "SSH RSA Algorithm", "SSHv2"), (r"\becdsa-sha2-nistp256\b", "SSH ECDSA Algorithm", "SSHv2"), (r"\bssh-ed25519\b", "SSH Ed25519 Algorithm", "SSHv2"), (r"\bdiffie-hellman-group14-sha1\b", "SSH DH Group 14", "SSHv2")]]
DIRECTIVES = [Rule("(?iu)" + p, None, "protocol", None, 0.5, n, "TLS" if "ssl" in n else "SSH") for p, n in [(r"^\s*ssl_protocols\s+([^;]+);", "nginx_ssl_protocols"), (r"^\s*ssl_ciphers\s+([^;]+);", "nginx_ssl_ciphers"), (r"^\s*SSLCipherSuite\s+(\S+)", "apache_ssl_ciphers"), (r"^\s*SSLProtocol\s+(.+)", "apache_ssl_protocols"), (r"^\s*Protocol\s+(2|1,2|2,1)\b", "sshd_protocol"), (r"^\s*KexAlgorithms\s+(.+)", "sshd_kex"), (r"^\s*Ciphers\s+(.+)", "sshd_ciphers"), (r"^\s*HostKeyAlgorithms\s+(.+)", "sshd_hostkeys")]]
# fixed values: hardware and infrastructure
HARDWARE = [
    *[Rule("(?iu)" + p, None, "hsm", None, 0.95, e) for p, e in [(r"\b(pkcs11|libpkcs11\.so|cryptoki\.h|C_Initialize|C_OpenSession)\b", "PKCS#11 HSM Interface"), (r"\b(SunPKCS11|SoftHSM|CloudHSM|YubiHSM|nCipher|SafeNet)\b", "Hardware Security Module (HSM) Library"), (r"\b(TPM2_Init|tpm2_tss|tpm2\.h|tpm2_createkey)\b", "TPM 2.0 Hardware Interface"), (r"\bKMIP\b|\bkmip_client\b", "KMIP Hardware Key Management Protocol")]],
    *[Rule("(?iu)" + p, None, "embedded_iot", None, 0.5, e) for p, e in [(r"\b(FreeRTOS|esp_idf|zephyr|CMSIS|MBED_TLS)\b", "Embedded/IoT Operating System"), (r"\b(avr/io\.h|stm32[f|l|g|h]\d+xx\.h|pico/stdlib\.h)\b", "Microcontroller Hardware Abstraction Layer"), (r"\b(microcode|firmware_update|flash_write_sector)\b", "Firmware / Microcode Logic")]],
    *[Rule("(?iu)" + p, None, "packet_constraint", None, 0.5, e) for p, e in [(r"\b(MTU_SIZE|MAX_PACKET_SIZE|SO_SNDBUF|SO_RCVBUF)\b\s*=?\s*(\d+)", "Packet / Buffer Constraint"), (r"\b(MTU\s*=\s*\d+|packet_buffer_overflow|fixed_frame_size)\b", "Fixed Frame / MTU Constraint"), (r"\b(ISO8583|SWIFT_FIN|FIX_PROTOCOL)\b", "Legacy Banking / Financial Protocol")]],
    *[Rule("(?iu)" + p, None, "database_crypto", None, 0.95, e) for p, e in [(r"\b(pgp_sym_encrypt|pgp_sym_decrypt|AES_ENCRYPT|AES_DECRYPT|DBMS_CRYPTO)\b", "Database-Level Cryptography"), (r"\b(UNHEX\(SHA2\(|ENCRYPTBYPASSPHRASE)\b", "SQL Column Encryption")]],
]
HARDWARE_METHOD = {"hsm": "hsm_pattern", "embedded_iot": "embedded_iot_pattern", "packet_constraint": "packet_mtu_pattern", "database_crypto": "db_crypto_pattern"}


#: What a rule gives; detectors that aren't line rules fill the same fields.
HIT = {
    "rank": "int", "family": "int", "rule_index": "int", "line_number": "int", "artifact_type": "string", "algorithm": "string",
    "key_size": "int", "detection_method": "string", "confidence": "double", "library": "string", "code_snippet": "string",
    "language": "string", "mode": "string", "protocol": "string", "protocol_version": "string", "evidence": "string",
    "dependency_version": "string", "source_type": "string", "warning_type": "string", "message": "string",
    "docker_instruction": "string", "evidence_type": "string",
}
HITS = "array<struct<" + ",".join(f"{n}:{t}" for n, t in HIT.items()) + ">>"


@lru_cache(maxsize=4096)
def constant(name: str, value: str | float | None, app: str) -> Column:
    """A field of fixed value. Most fields of most rules are, and a column costs several calls to the JVM: it is made once
    for each application."""
    return F.lit(value).cast(HIT[name]).alias(name)


def hit(**values) -> Column:
    """One finding as a struct; what isn't given is null."""
    app = SparkSession.active().sparkContext.applicationId
    field = lambda n, v: v.cast(HIT[n]).alias(n) if isinstance(v, Column) else constant(n, v, app)
    return F.struct(*[field(n, values.get(n)) for n in HIT])


def no_hits() -> Column:
    return F.array().cast(HITS)


def present(found: Column) -> Column:
    return F.filter(found, lambda h: h.isNotNull())


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row. A fold over nothing, whose type is the body's: an element of a
    transformed array asks the body for its type twice at each level, so that planning takes time exponential in the depth."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def line_array(text: Column) -> Column:
    """A text's lines. An end of line at the end begins no line."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(F.coalesce(text, F.lit("")), LINE_END), whole)


def fed_array(text: Column) -> Column:
    """A text's lines by line feeds alone, other ends stay in them. One feed at the end begins no line, an empty text is one
    line, a null has none."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def lines(df: DataFrame, text: str = "text", split: Callable[[Column], Column] = line_array) -> DataFrame:
    """Numbered lines of texts, from 1, as split has them; further columns stay."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(split(F.col(text))).alias("_p", "line")).withColumn("line_number", F.col("_p") + 1).drop("_p")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_doc(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"\.(md|txt|rst|doc|docx|pdf|html)$") | F.substring_index(low, "/", -1).isin("readme", "license", "changelog")


def starts_comment(line: Column, marks: tuple[str, ...] = ("#", "//", "/*", "*")) -> Column:
    return line.rlike(r"(?U)^\s*(?:" + "|".join(map(re.escape, marks)) + ")")


def mask_comments(text: Column) -> Column:
    """C comments blanked, block comments first, then to the end of lines; lines and offsets stay."""
    blank = lambda c, pattern: F.array_join(F.transform(F.arrays_zip(F.split(c, pattern).alias("t"), F.regexp_extract_all(c, F.lit(f"({pattern})")).alias("m")), lambda x: F.concat(F.coalesce(x["t"], F.lit("")), F.coalesce(F.regexp_replace(x["m"], r"[^\n]", " "), F.lit("")))), "")
    masked = lambda c: F.when(c.contains("//"), blank(c, r"//[^\n]*")).otherwise(c)
    return let(F.when(text.contains("/*"), blank(text, r"(?s:/\*.*?\*/)")).otherwise(text), masked)


def matched(df: DataFrame, rules: list[Rule], method: str | dict, line: str = "line") -> DataFrame:
    """One row for each rule that a line matches, with the rule's fields; a line's rules in order, as rule_index."""
    return matched_families(df, [(rules, method)], line).drop("family")


def rule_hits(line: Column, families: list[tuple[list[Rule], str | dict]], number: Column | None = None, snippet: Column | None = None, rank: int | None = None, **more: Column) -> Column:
    """The hits of a line, in the order of the families and their rules. more: fields that all hits share."""
    shown = strip(line) if snippet is None else snippet

    def one(family: int, i: int, r: Rule, method: str | dict) -> Column:
        fields = {
            "rank": rank, "family": family, "rule_index": i, "line_number": number, "algorithm": r.algorithm, "artifact_type": r.artifact_type, "library": r.library,
            "confidence": r.confidence, "evidence": r.evidence, "protocol": r.protocol, "warning_type": r.warning, "code_snippet": shown,
            "key_size": F.regexp_extract(line, r.pattern, r.size).try_cast("int") if r.size else None, "detection_method": method[r.artifact_type] if isinstance(method, dict) else method,
        }
        return F.when(line.rlike(r.pattern), hit(**fields | more))

    return present(F.array(*[one(f, i, r, method) for f, (rules, method) in enumerate(families) for i, r in enumerate(rules)]))


def opened(df: DataFrame, hits: Column) -> DataFrame:
    """One row for each hit of a row, with the fields that df doesn't have itself."""
    return df.withColumn("_h", F.explode(hits)).select(*df.columns, *[f"_h.{n}" for n in HIT if n not in df.columns])


def matched_families(df: DataFrame, families: list[tuple[list[Rule], str | dict]], line: str = "line") -> DataFrame:
    """matched() for several lists of rules in one pass; family numbers the lists, rule_index a list's rules."""
    return opened(df, rule_hits(F.col(line), families))


def snippet_key_size(line: Column) -> Column:
    named, bare = F.regexp_extract(line, r"\b(key_size|bits|modulusLength)\s*[:=]\s*(\d+)", 2), F.regexp_extract(line, r"\b(512|1024|2048|3072|4096|8192|128|192|256)\b", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(bare, F.lit(""))).try_cast("int")


def snippet_mode(line: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(line, r"(?i)\b(MODE_)?(GCM|CBC|EAX|ECB|CTR|CFB|OFB)\b", 2), F.lit("")))


#: Every line that a rule of the families matches holds one of the parts, or starts as a directive does: most lines are
#: put aside by these before any rule's pattern is tried.
CODE_PARTS = ["RSA", "rsa.", "ec.generate", "ECD", "ecdh", "AES", "aes", "DES", "hashlib.", "EVP_sha", "createHash", "MessageDigest", "hmac.new", "createHmac", "Mac.getInstance", "ssl.", "SSL_CTX", "tls.", "https."]
PROTOCOL_PARTS = ["TLS", "SSL", "ssl.", "tls.", "https.", "ssh", "aramiko", "JSch", "DHE-", "ecdsa-sha2", "diffie-hellman"]
DIRECTIVE_START = r"(?iu:^\s*(?:ssl|Protocol|KexAlgorithms|Ciphers|HostKeyAlgorithms))"


def holds(line: Column, parts: list[str], *patterns: str) -> Column:
    """One joint pattern, so that a line that is computed is computed once."""
    return line.rlike("|".join([*map(re.escape, parts), *patterns]))


def code_hits(line: Column, number: Column | None = None, rank: int | None = None) -> Column:
    """Cross-language rules on a line that isn't a comment, with key size and mode of the line."""
    found = rule_hits(line, [(CODE_RULES, "semgrep")], number, rank=rank, key_size=snippet_key_size(line), mode=snippet_mode(line))
    return F.when(holds(line, CODE_PARTS) & ~starts_comment(line), found).otherwise(no_hits())


def code_rules(df: DataFrame) -> DataFrame:
    """Cross-language rules on lines that aren't comments, with key size and mode of the line."""
    return opened(df, code_hits(F.col("line")))


PROTOCOL_FAMILIES = [(DIRECTIVES, "config_directive"), (TLS_VERSIONS, "api_pattern"), (TLS_APIS, "api_pattern"), (CIPHER_SUITES, "cipher_suite"), (SSH, "ssh_evidence")]


def protocol_hits(line: Column, number: Column | None = None, rank: int | None = None) -> Column:
    """Protocol rules on a line that isn't a comment; a directive's evidence holds its value."""
    families = [(DIRECTIVES, "config_directive")], PROTOCOL_FAMILIES[1:]
    directives = []
    for i, r in enumerate(DIRECTIVES):
        named = F.concat(F.lit(f"{r.evidence}: "), strip(F.regexp_extract(line, r.pattern, 1)))
        fields = {"rank": rank, "family": 0, "rule_index": i, "line_number": number, "artifact_type": r.artifact_type, "confidence": r.confidence, "protocol": r.protocol, "code_snippet": strip(line), "detection_method": families[0][0][1]}
        directives.append(F.when(line.rlike(r.pattern), hit(evidence=named, **fields)))
    others = F.transform(rule_hits(line, families[1], number, rank=rank), lambda h: h.withField("family", h.family + 1))
    found = F.concat(F.when(line.rlike(DIRECTIVE_START), present(F.array(*directives))).otherwise(no_hits()), others)
    return F.when(holds(line, PROTOCOL_PARTS, DIRECTIVE_START) & ~starts_comment(line), found).otherwise(no_hits())


def protocols(df: DataFrame, path: str = "path") -> DataFrame:
    return opened(df.where(~is_doc(F.col(path))), protocol_hits(F.col("line")))


#: A line that a rule of hardware matches holds one of these.
HARDWARE_PARTS = r"(?iu)pkcs11|cryptoki|C_Initialize|C_OpenSession|HSM|nCipher|SafeNet|TPM|KMIP|FreeRTOS|esp_idf|zephyr|CMSIS|MBED_TLS|avr/io|stm32|pico/stdlib|microcode|firmware_update|flash_write|MTU|MAX_PACKET|SO_SNDBUF|SO_RCVBUF|packet_buffer|fixed_frame|ISO8583|SWIFT_FIN|FIX_PROTOCOL|pgp_sym|AES_ENCRYPT|AES_DECRYPT|DBMS_CRYPTO|UNHEX|ENCRYPTBY"


def hardware_hits(line: Column, number: Column | None = None, rank: int | None = None) -> Column:
    return F.when(line.rlike(HARDWARE_PARTS) & ~starts_comment(line, ("#", "//", "*")), rule_hits(line, [(HARDWARE, HARDWARE_METHOD)], number, rank=rank)).otherwise(no_hits())


def hardware(df: DataFrame) -> DataFrame:
    return opened(df, hardware_hits(F.col("line")))


def each_line(text: Column, hits) -> Column:
    """The hits of all lines of a text: hits(line, number)."""
    return F.flatten(F.transform(line_array(text), lambda line, i: hits(line, i + 1)))


def c_hits(text: Column, rank: int | None = None) -> Column:
    """Includes and calls of C text. Comments are blanked first, snippets are lines as they were written."""

    def found(raw: Column) -> Column:
        def of(line: Column, number: Column) -> Column:
            shown, header = strip(F.get(raw, number - 1)), F.regexp_extract(line, C_INCLUDE, 1)
            include = F.when(header.isin(C_HEADERS), hit(rank=rank, family=0, rule_index=0, line_number=number, algorithm="UNSPECIFIED", artifact_type="import_signal", library=header, confidence=0.25, code_snippet=shown, detection_method="pattern_match"))
            calls = rule_hits(line, [(C_CALLS, "pattern_match")], number, shown, rank)
            return F.when(line.rlike(C_PARTS), F.concat(present(F.array(include)), calls)).otherwise(no_hits())

        return each_line(mask_comments(text), of)

    return let(line_array(text), found)


def c_code(df: DataFrame) -> DataFrame:
    """Files (path, text): calls on lines without comments, and includes."""
    return opened(df.select("path", "text"), c_hits(F.col("text"))).drop("text")


# fixed values: Java
JAVA = {"MD5": ("MD5", "hash"), "SHA-1": ("SHA-1", "hash"), "SHA1": ("SHA-1", "hash"), "SHA-256": ("SHA-256", "hash"), "SHA256": ("SHA-256", "hash"), "RSA": ("RSA", "algorithm"), "DES": ("DES", "algorithm"), "DESede": ("3DES", "algorithm"), "AES": ("AES", "algorithm"), "AES/GCM/NoPadding": ("AES", "algorithm"), "AES/CBC/PKCS5Padding": ("AES", "algorithm"), "EC": ("ECC", "algorithm"), "DSA": ("DSA", "algorithm"), "SHA256withECDSA": ("ECDSA", "algorithm"), "SHA256withRSA": ("RSA", "algorithm"), "SHA1withDSA": ("DSA", "algorithm")}
JAVA_LIBRARIES = {"MessageDigest": "java.security", "Cipher": "javax.crypto", "KeyPairGenerator": "java.security", "Signature": "java.security", "KeyGenerator": "javax.crypto"}


JAVA_CALL = r"\b(?:MessageDigest|Cipher|KeyPairGenerator|Signature|KeyGenerator)\s*\.\s*getInstance\s*\(\s*\"[^\"]*\""
JAVA_SIZE = r"\.\s*initialize\s*\(\s*(\d+)\s*[,)]"
JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?((?:javax\.crypto|java\.security)[\w.]*?)(?:\.\*)?\s*;"
#: An initialize() so many lines below a call gives its key size.
REACH = 3


def java_hits(text: Column, rank: int | None = None) -> Column:
    """Factory calls with the key size of the last initialize() within REACH lines below, then imports (line 0)."""
    from .cbom import lookup

    names, kinds = {k: v[0] for k, v in JAVA.items()}, {k: v[1] for k, v in JAVA.items()}

    def call(c: Column, number: Column, line: Column, sizes: Column) -> Column:
        name, factory = F.regexp_extract(c, "\"([^\"]*)\"", 1), F.regexp_extract(c, r"^(\w+)", 1)
        head = F.substring_index(name, "/", 1)
        near = F.filter(sizes, lambda s: s.at.between(number, number + REACH))
        algorithm = F.coalesce(lookup(names, name), lookup(names, head))
        fields = {"rank": rank, "family": 0, "line_number": number, "library": lookup(JAVA_LIBRARIES, factory), "mode": F.get(F.split(name, "/"), F.lit(1)), "code_snippet": strip(line), "detection_method": "ast_call", "confidence": 0.95}
        return F.when(algorithm.isNotNull(), hit(algorithm=algorithm, artifact_type=F.coalesce(lookup(kinds, name), lookup(kinds, head)), key_size=F.try_element_at(near, F.lit(-1)).n, **fields))

    def found(raw: Column) -> Column:
        def rest(masked: Column) -> Column:
            size = lambda line, i: F.transform(F.when(line.contains("initialize"), F.regexp_extract_all(line, F.lit(JAVA_SIZE), F.lit(1))).otherwise(F.array().cast("array<string>")), lambda n: F.struct((i + 1).alias("at"), n.try_cast("int").alias("n")))
            sizes = F.flatten(F.transform(masked, size))
            calls = let(sizes, lambda known: F.flatten(F.transform(masked, lambda line, i: F.when(line.contains("getInstance"), present(F.transform(F.regexp_extract_all(line, F.lit(JAVA_CALL), F.lit(0)), lambda c: call(c, i + 1, F.get(raw, i), known)))).otherwise(no_hits()))))
            imports = F.filter(F.transform(F.filter(masked, lambda line: line.contains("import")), lambda line: F.regexp_extract(line, JAVA_IMPORT, 1)), lambda x: x != "")
            row = lambda x: hit(rank=rank, family=1, line_number=0, algorithm="UNSPECIFIED", artifact_type="import_signal", library=x, code_snippet=F.concat(F.lit("import "), x, F.lit(";")), detection_method="ast_import", confidence=0.3)
            return F.concat(calls, F.transform(imports, row))

        return let(line_array(mask_comments(text)), rest)

    return let(line_array(text), found)


def java_code(df: DataFrame) -> DataFrame:
    """Files (path, text): factory calls and imports."""
    return opened(df.select("path", "text"), java_hits(F.col("text"))).drop("text")


def key_size_band(calls: DataFrame, sizes: DataFrame, reach: int = 3) -> DataFrame:
    """Band join: of sizes (_p, _l, _s) at most `reach` lines below a call, the last. Each size is sent to the reach + 1
    lines it can belong to, so it's an equi-join on (path, line)."""
    near = sizes.select(F.col("_p").alias("path"), F.explode(F.sequence(F.col("_l") - reach, F.col("_l"))).alias("line_number"), "_l", "_s").groupBy("path", "line_number").agg(F.max_by("_s", "_l").try_cast("int").alias("key_size"))
    return calls.join(near, ["path", "line_number"], "left")
