"""Rows of detectors on files of known content: methods, confidences, evidence and places, as surveyed."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from pqledger.operators import code, commands, rules, structure
from pqledger.plans import scan


def column(spark, hits, text):
    return [r.asDict() for r in spark.createDataFrame([(text,)], "t string").select(F.explode(hits(F.col("t"))).alias("h")).select("h.*").collect()]


def shown(rows, *fields):
    return [tuple(r.get(f) for f in fields) for r in rows]


FILES = {
    "src/Service.java": 'import javax.crypto.Cipher;\nimport java.security.*;\nclass Service {\n  // Cipher.getInstance("DES")\n  Object a = MessageDigest.getInstance("MD5");\n  Object g = KeyPairGenerator.getInstance("RSA");\n  void f() { g.initialize(1024); }\n  Object c = Cipher.getInstance("AES/GCM/NoPadding");\n}\n',
    "src/old.c": '#include <openssl/md5.h>\n#include <stdio.h>\nint main(void) {\n  MD5(data, len, out); /* DES_set_key(k) */\n  init(ctx, EVP_sha1());\n}\n',
    "src/web.js": 'const crypto = require("crypto");\nconst c = crypto.createCipheriv(\n  "aes-256-gcm", key, iv);\ncrypto.subtle.digest("SHA-384", d);\n',
    "src/auth.py": "import hashlib\nfrom Crypto.Cipher import AES\nhashlib.sha1(x)\nAES.new(k, AES.MODE_EAX)\n",
    "Dockerfile": 'FROM alpine\nRUN apk add --no-cache openssl\nRUN openssl req -x509 -newkey rsa:4096 \\\n    -keyout key.pem -out site.crt\nCOPY ca.pem /etc/ssl/\nENV TLS_VERSION=TLSv1.2 SSL_KEY=/k\n# RSA-2048\n',
    "requirements.txt": "cryptography==42.0.1\nflask\nPyNaCl >= 1.5\n",
}
GOLDEN = {
    ("src/Service.java", 5, "hash", "MD5", 1024, "ast_call", 0.95, "java.security"),  # any initialize() within three lines counts
    ("src/Service.java", 6, "algorithm", "RSA", 1024, "ast_call", 0.95, "java.security"),
    ("src/Service.java", 8, "algorithm", "AES", None, "ast_call", 0.95, "javax.crypto"),
    ("src/Service.java", 0, "import_signal", "UNSPECIFIED", None, "ast_import", 0.3, "javax.crypto.Cipher"),
    ("src/Service.java", 5, "hash", "MD5", None, "tree_sitter", 0.95, "java.security.MessageDigest"),
    ("src/Service.java", 6, "algorithm", "RSA", None, "tree_sitter", 0.95, "java.security.KeyPairGenerator"),
    ("src/old.c", 1, "import_signal", "UNSPECIFIED", None, "pattern_match", 0.25, "openssl/md5.h"),
    ("src/old.c", 4, "hash", "MD5", None, "pattern_match", 0.7, "openssl/md5.h"),
    ("src/old.c", 5, "hash", "SHA-1", None, "pattern_match", 0.7, "openssl/evp.h"),
    ("src/old.c", 5, "hash", "SHA-1", None, "tree_sitter", 0.95, "openssl/evp.h"),
    ("src/web.js", 1, "import_signal", "UNSPECIFIED", None, "import_signal", 0.3, "Node.js crypto"),
    ("src/web.js", 2, "algorithm", "AES", None, "pattern_match", 0.7, "Node.js crypto"),
    ("src/web.js", 2, "algorithm", "AES", 256, "tree_sitter", 0.95, "Node.js crypto"),
    ("src/web.js", 4, "hash", "SHA-384", None, "pattern_match", 0.7, "Web Crypto API"),
    ("src/auth.py", 1, "import_signal", "UNSPECIFIED", None, "ast_import", 0.3, "hashlib"),
    ("src/auth.py", 2, "import_signal", "UNSPECIFIED", None, "ast_import", 0.3, "Crypto.Cipher"),
    ("src/auth.py", 3, "hash", "SHA-1", None, "ast_call", 0.95, "hashlib"),
    ("src/auth.py", 4, "algorithm", "AES", None, "ast_call", 0.95, "Crypto.Cipher"),
    ("Dockerfile", 2, "library", None, None, "pattern", 0.9, "OpenSSL"),
    ("Dockerfile", 3, "algorithm", "RSA", 4096, "regex/pattern", 0.95, "OpenSSL"),
    ("Dockerfile", 3, "certificate_generation", None, None, "regex/pattern", 0.95, "OpenSSL"),
    ("Dockerfile", 3, "certificate_reference", None, None, "pattern", 0.8, None),
    ("Dockerfile", 3, "key_reference", None, None, "pattern", 0.8, None),
    ("Dockerfile", 5, "certificate_reference", None, None, "pattern", 0.8, None),
    ("Dockerfile", 6, "key_reference", None, None, "pattern", 0.85, None),
    ("Dockerfile", 6, "protocol", None, None, "pattern", 0.9, None),
    ("requirements.txt", 1, "library", None, None, "dependency_manifest", 0.2, "cryptography (Python)"),
    ("requirements.txt", 3, "library", None, None, "dependency_manifest", 0.2, "PyNaCl (libsodium)"),
}


def test_scan_of_known_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "Dockerfile.bad").write_bytes(b"RUN apt-get install openssl \xff\xfe")
    found = scan.findings(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("binaryFile") == 1  # each file is read once
    got = [r.asDict() for r in found.collect()]
    rows = {(r["file_path"].removeprefix(f"{tmp_path}/"), r["line_number"], r["artifact_type"], r["algorithm"], r["key_size"], r["detection_method"], r["confidence"], r["library"]) for r in got}
    assert rows >= GOLDEN
    extra = {r for r in rows - GOLDEN if r[5] not in ("semgrep", "tree_sitter", "api_pattern")}
    assert extra == {("Dockerfile.bad", None, "warning", None, None, "pattern", 0.0, None)}
    by = {(r["file_path"].rpartition("/")[2], r["line_number"], r["detection_method"], r["artifact_type"]): r for r in got}
    assert by["Service.java", 0, "ast_import", "import_signal"]["code_snippet"] == "import javax.crypto.Cipher;"
    assert by["Dockerfile", 6, "pattern", "protocol"]["protocol_version"] == "TLSv1.2" and by["Dockerfile", 6, "pattern", "protocol"]["evidence_type"] == "env_config"


def test_order_within_a_file(spark):
    """First findings are those of the first detector, then of the first place."""
    text = 'import hashlib\nhashlib.sha1(b)\nRSA.generate(1024)\n'
    df = spark.createDataFrame([("a.py", 10, text.encode())], "path string, length long, content binary")
    got = [(r.detection_method, r.line_number) for r in scan.detect(df).orderBy("ord").collect()]
    assert got == [("tree_sitter", 1), ("tree_sitter", 2), ("tree_sitter", 3), ("semgrep", 2), ("semgrep", 3), ("ast_import", 1), ("ast_call", 2), ("ast_call", 3)]


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a.java", 'wrap(\n  Signature.getInstance("DSA"), 2048).x();', [(1, "DSA", 2048), (1, "DSA", 2048), (2, "DSA", None)]),
        ("a.java", 'if (Cipher.getInstance("AES/CBC/P") != null) new Foo(Cipher.getInstance("DES"));', [(1, "AES", None), (1, "DES", None)]),
        ("a.java", 'String s = "Cipher.getInstance(\\"AES\\")"; // Cipher.getInstance("AES")\n/* MessageDigest.getInstance("MD5") */', []),
        ("a.c", "#define H(x) MD5(x)\nunsigned char *MD5(const char *d);\nint MD5(int x) { return x; }\n", []),
        ("a.c", "int f() { if (MD5 (a)) return EVP_sha1(); x.MD5(b); y = (T*)AES_set_encrypt_key(k, 192, &s); }", [(1, "MD5", None), (1, "SHA-1", None), (1, "AES", 192)]),
        ("a.js", "describe('x', () => {\n  crypto.createHash('md5').update(`${d}`)\n})", [(1, "MD5", None), (2, "MD5", None), (2, "MD5", None)]),
        ("a.js", "x = /crypto.createHash('md5')/; // crypto.createHash('md5')\ny = `crypto.createHash('md5')`", []),
        ("a.ts", "crypto.generateKeyPairSync('rsa', {\n modulusLength: 3072 })", [(1, "RSA", 3072)]),
        ("a.py", "d = wrap(hashlib.md5(a).hexdigest())\ns = '''hashlib.sha1(x)'''\nbroken( = AES.new(k, AES.MODE_CBC)", [(1, "MD5", None), (3, "AES", None)]),
        ("a.py", "k = rsa.generate_private_key(\n  public_exponent=65537,\n  key_size=2048)", [(1, "RSA", 2048)]),
        ("a.py", "", []),
        ("a.c", "MD5(((((", []),
    ],
)
def test_structure(path, text, want):
    assert shown(structure.structural(path, text), "line_number", "algorithm", "key_size") == want


def test_structural_signals():
    rows = lambda p, t: [(r["line_number"], r["library"]) for r in structure.structural(p, t) if r["artifact_type"] == "import_signal"]
    assert rows("a.java", "import static java.security.X.*;\nimport java.util.List;") == [(1, "static java.security.X.*")]
    assert rows("a.js", "import crypto from 'crypto';\nvar c = require('crypto');\nlet d = require('crypto')\nfoo()") == [(1, "Node.js crypto"), (3, "Node.js crypto")]
    assert rows("a.c", "  # include <openssl/evp.h>\n#include \"x.h\"") == [(1, "openssl/evp.h")]
    assert rows("a.py", "from Crypto.PublicKey import (RSA,\n  DSA)\nimport os, hashlib\n") == [(1, "Crypto.PublicKey"), (3, "hashlib")]


def test_structure_is_linear_enough():
    """Deep nesting and long lines end."""
    assert len(list(structure.structural("a.c", "MD5(" * 3000 + ")" * 3000))) == 3000
    assert list(structure.structural("a.js", "crypto " + "'" * 100_000)) == []


MANIFESTS = {
    "requirements.txt": ("cryptography==42.0\nbcrypt[x]>=1\n# pynacl\nPyCrypto\n", [("cryptography (Python)", "42.0", 1), ("bcrypt", "unknown", 2), ("PyCrypto", "unknown", 4)]),
    "pyproject.toml": ('[tool]\n"cryptography" = "^42.0"\n"pynacl": "~1.5"\n', [("cryptography (Python)", "^42.0", 2), ("PyNaCl (libsodium)", "~1.5", 3)]),
    "build.gradle": ("implementation 'org.bouncycastle:bcprov-jdk18on:1.70'\ncompile tink\n", [("Bouncy Castle", "1.70", 1), ("Bouncy Castle Provider", "1.70", 1), ("Google Tink", "unknown", 2)]),
    "CMakeLists.txt": ("find_package(OpenSSL 1.1.1 REQUIRED)\nset(x openssl)\n", [("OpenSSL", "1.1.1", 1)]),
    "conanfile.txt": ("[requires]\nopenssl/3.0.1\n", []),
    "vcpkg.json": ('{"dependencies": ["openssl"]}', []),
}


@pytest.mark.parametrize("name", list(MANIFESTS))
def test_manifest_versions(name):
    text, want = MANIFESTS[name]
    assert shown(code.manifest(name, text), "library", "dependency_version", "line_number") == want


def test_dockerfile_commands(spark):
    text = "RUN openssl genpkey -out k\nRUN openssl genpkey -algorithm ed25519\nCMD openssl enc -aes-256-cbc x && openssl enc x\nRUN openssl ecparam -name secp384r1\nRUN openssl s_client -tls1_3 h\nRUN openssl x509 -in c\nONBUILD RUN openssl genrsa 2048\nLABEL x=RSA\nENV A RSA-4096\nRUN ssh-keygen -f id_rsa"
    got = shown(column(spark, commands.docker_hits, text), "line_number", "artifact_type", "algorithm", "protocol_version", "confidence")
    assert got == [
        (1, "algorithm", "RSA", None, 0.95), (2, "algorithm", "ED25519", None, 0.95), (3, "algorithm", "AES-256-CBC", None, 0.9), (3, "algorithm", "AES-256-CBC", None, 0.9), (4, "algorithm", "EC (secp384r1)", None, 0.9),
        (5, "protocol", None, "TLSv1.3", 0.85), (9, "algorithm", "RSA", None, 0.75), (10, "key_reference", None, None, 0.8), (10, "protocol", None, None, 0.75),
    ]


def test_dockerfile_statements(spark):
    text = "# c\n\n  run a \\\n# inside\nb\nENV X=1 \\"
    got = spark.createDataFrame([(text,)], "t string").select(commands.statements(F.col("t")).alias("s")).first().s
    assert [(r.at, r.flat) for r in got] == [(3, "run a # inside"), (5, "b"), (6, "ENV X=1")]


def test_dockerfile_secrets(spark):
    text = 'ENV DB_SECRET=my-private-thing\nENV KEYS="-----BEGIN PRIVATE KEY----- abc"\nARG API_TOKEN=/x/cert.pem'
    got = column(spark, commands.docker_hits, text)
    assert "my-private-thing" not in str(got) and "abc" not in str(got)
    assert shown(got, "line_number", "artifact_type", "code_snippet") == [(1, "key_reference", "ENV DB_SECRET=<redacted>"), (2, "key_reference", commands.REDACTED), (2, "key_reference", commands.REDACTED), (3, "certificate_reference", "ARG API_TOKEN=<redacted>")]


def test_configuration_lines(spark):
    text = "ssl_protocols TLSv1.2 TLSv1.3;\n# AES-128\n\nexec openssl s_client -tls1_2\nPermitRootLogin no RSA\nx AES256-CBC triple-des"
    got = shown(column(spark, commands.config_hits, text), "line_number", "artifact_type", "algorithm", "protocol", "evidence", "confidence")
    assert got == [
        (1, "protocol", None, "TLSv1.2", None, 0.85), (1, "protocol", None, "TLSv1.3", None, 0.85), (2, "algorithm", "AES-128", None, None, 0.33),
        (4, "algorithm", None, None, "openssl s_client", 0.95), (5, "algorithm", "RSA", None, None, 0.65), (5, "protocol", None, "SSH", None, 0.75), (6, "algorithm", "AES-256-CBC", None, None, 0.65), (6, "algorithm", "3DES", None, None, 0.65),
    ]


def test_key_files(spark):
    cases = {"a.pub": ("rubbish", "public_key", 0.85, None), "b.key": ("-----BEGIN EC PRIVATE KEY-----", "private_key", 0.9, "EC"), "c.key": ("-----BEGIN PRIVATE KEY-----", "private_key", 0.9, None), "d.key": ("ssh-rsa AAAA", "public_key", 0.85, None), "e.key": ("", "key", 0.4, None)}
    df = spark.createDataFrame([(p, t) for p, (t, *_) in cases.items()], "p string, t string").select("p", F.explode(commands.key_hits(F.col("t"), F.col("p"))).alias("h")).select("p", "h.*")
    assert {r.p: (cases[r.p][0], r.artifact_type, r.confidence, r.algorithm) for r in df.collect()} == cases


def test_container_rows(spark):
    files = {"etc/ssl/broken.pem": b"rubbish", "etc/nginx.conf": b"TLSv1.2", "root/.ssh/id_rsa": b"-----BEGIN RSA PRIVATE KEY-----", "var/lib/dpkg/status": b"Package: openssl\nVersion: 3\n", "usr/bin/x": b"RSA"}
    df = spark.createDataFrame([(f"/{p}", len(c), bytearray(c)) for p, c in files.items()], "path string, length long, content binary")
    got = {(r.file_path, r.artifact_type, r.detection_method, r.confidence) for r in scan.container(df).collect()}
    assert got == {
        ("/etc/ssl/broken.pem", "certificate", "filesystem_pattern", 0.3), ("/etc/nginx.conf", "protocol", "filesystem_pattern", 0.85),
        ("/root/.ssh/id_rsa", "private_key", "filesystem_pattern", 0.9), ("/var/lib/dpkg/status", "library", "package_metadata", 0.9),
    }
    capped = scan.container(df, cap=1).collect()
    assert {r.file_path for r in capped} == {"/etc/nginx.conf", "/var/lib/dpkg/status"}


def test_hardware_parts_put_no_match_aside(spark):
    some = "C_Initialize SunPKCS11 YubiHSM TPM2_Init tpm2.h KMIP kmip_client freertos MBED_TLS avr/io.h stm32f4xx.h microcode flash_write_sector MTU_SIZE SO_RCVBUF=1 packet_buffer_overflow ISO8583 pgp_sym_encrypt DBMS_CRYPTO UNHEX(SHA2( ENCRYPTBYPASSPHRASE"
    lines = [*some.split(), "MTU = 5", "mtu_size = 1500", "nothing"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_number int, line string")
    want = {(r.line_number, r.rule_index) for r in rules.matched(df, rules.HARDWARE, rules.HARDWARE_METHOD).collect()}
    assert want and {(r.line_number, r.rule_index) for r in rules.hardware(df).collect()} == want


def elf(names: bytes, wide: bool = True, end: str = "<") -> bytes:
    labels = b"\0.dynstr\0.shstrtab\0.rodata\0"
    head = 64 if wide else 52
    data = names + labels + names
    at = head + len(data)
    word = "Q" if wide else "I"
    row = lambda label, kind, off, n: struct.pack(end + "II" + (word * 2), label, kind, 0, 0) + struct.pack(end + word * 2, off, n) + b"\0" * (64 - 40 if wide else 40 - 24)
    table = row(0, 0, 0, 0) + row(1, 3, head, len(names)) + row(9, 3, head + len(names), len(labels)) + row(19, 1, head + len(names) + len(labels), len(names))
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if end == "<" else 2, 1]) + b"\0" * 9
    rest = struct.pack(end + "HHI" + word * 3 + "I" + "HHHHHH", 3, 62, 1, 0, 0, at, 0, head, 0, 0, 64 if wide else 40, 4, 2)
    return ident + rest + data + table


@pytest.mark.parametrize("wide, end", [(True, "<"), (False, "<"), (True, ">")])
def test_elf(wide, end):
    raw = elf(b"\0EVP_sha256\0AES_encrypt_x\0libssl.so.3\0", wide, end)
    got = shown(code.binary("lib.so", raw), "artifact_type", "algorithm", "library", "detection_method", "confidence", "evidence")
    assert got == [
        ("hash", "SHA-256", "OpenSSL", "binary_elf_symbol", 0.85, "ELF binary contains symbol EVP_sha256"), ("algorithm", "AES", "OpenSSL", "binary_elf_symbol", 0.85, "ELF binary contains symbol AES_encrypt"),
        ("library", None, "OpenSSL libssl", "binary_elf_needed", 0.85, "ELF references libssl.so"),
    ]
    assert list(code.binary("lib.so", raw[: len(raw) - 30])) is not None


def pe(wide: bool) -> bytes:
    """One section at file offset 512 and address 4096, with an import of two names and an export of one."""
    base, at = 4096, 512
    body = bytearray(600)
    put = lambda off, data: body.__setitem__(slice(off, off + len(data)), data)
    step = 8 if wide else 4
    put(0, struct.pack("<IIIII", base + 100, 0, 0, base + 200, base + 100) + b"\0" * 20)  # import directory
    put(100, b"".join(struct.pack("<Q" if wide else "<I", x) for x in (base + 220, base + 250, 0)))
    put(200, b"BCRYPT.dll\0")
    put(220, b"\0\0BCryptEncrypt\0")
    put(250, b"\0\0Other\0")
    put(300, struct.pack("<IIIIIIIIIII"[:12], 0, 0, 0, 0, 1, 1, 1, 0, base + 400, 0, 0)[:44])  # export directory: one name
    put(400, struct.pack("<I", base + 420))
    put(420, b"EVP_md5\0")
    assert step
    opt = 240 if wide else 224
    optional = bytearray(opt)
    optional[0:2] = struct.pack("<H", 0x20B if wide else 0x10B)
    where = 112 if wide else 96
    optional[where : where + 16] = struct.pack("<IIII", base + 300, 40, base, 40)
    section = b".data\0\0\0" + struct.pack("<IIII", 600, base, 600, at) + b"\0" * 16
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, opt, 0) + bytes(optional) + section
    return head + b"\0" * (at - len(head)) + bytes(body)


@pytest.mark.parametrize("wide", [True, False])
def test_pe(wide):
    got = shown(code.binary("x.DLL", pe(wide)), "artifact_type", "algorithm", "library", "detection_method", "confidence", "code_snippet")
    assert got == [
        ("library", None, "Windows CNG", "binary_pe_import", 0.85, "Imported DLL: bcrypt.dll"), ("algorithm", "AES", "Windows CNG", "binary_pe_symbol", 0.9, "Imported symbol: BCryptEncrypt"),
        ("hash", "MD5", "OpenSSL", "binary_pe_symbol", 0.9, "Exported symbol: EVP_md5"),
    ]
    assert list(code.binary("x.exe", b"MZ")) == [] and list(code.binary("x.exe", pe(wide)[:300])) == []


def test_bad_files_end_no_scan(spark):
    bad = [("package.json", b"{"), ("pom.xml", b"<a"), ("a.so", b"\x7fELF"), ("b.exe", b"MZ\0"), ("c.py", b"\xff\xfe\0"), ("d.js", b"crypto.createHash("), ("e.pem", b"")]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in bad], "path string, length long, content binary")
    got = scan.detect(df).collect()
    assert {r.file_path for r in got if r.artifact_type == "warning"} == {"package.json", "pom.xml", "e.pem"}
    assert scan.detect(df.limit(0)).count() == 0
    assert json.dumps([r.file_path for r in got])
