"""Detectors on files of known content, and the whole way to scores."""

import json
import subprocess
import tarfile

import pytest
from pyspark.sql import functions as F

from pqledger.operators import cbom, code, commands, effort, risk, rules
from pqledger.plans import scan
from pqledger.sources import sinks, tar


def rows(body, path, text):
    return list(body(path, text))


def hits(spark, column, text):
    """The hits that a column of rules finds in a text."""
    return [r.asDict() for r in spark.createDataFrame([(text,)], "t string").select(F.explode(column(F.col("t"))).alias("h")).select("h.*").collect()]


def test_python_calls():
    text = "import hashlib\nfrom Crypto.PublicKey import RSA\nk = RSA.generate(1024)\nhashlib.md5(b'')\nk2 = ec.generate_private_key(ec.SECP256R1(), b())\nc = AES.new(k, AES.MODE_GCM)\nrsa.generate_private_key(public_exponent=3, key_size=2048)\n# DES.new(k)\n"
    got = {(r["line_number"], r["algorithm"], r.get("key_size"), r.get("curve"), r.get("mode")) for r in rows(code.python_code, "a.py", text)}
    assert {(3, "RSA", 1024, None, None), (4, "MD5", None, None, None), (5, "ECC", None, "P-256", None), (6, "AES", None, None, "GCM"), (7, "RSA", 2048, None, None)} <= got
    assert not any(a == "DES" for _, a, *_ in got)
    assert rows(code.python_code, "b.py", "def broken(:") == []


def test_javascript_arguments_and_comments():
    text = "const c = require('crypto');\n// crypto.createHash('md5')\ncrypto.createHash('sha256').update('x)');\ncrypto.createCipheriv(\n 'aes-256-gcm', k, iv);\ncrypto.generateKeyPairSync('rsa', { modulusLength: 2048 });\ncrypto.subtle.digest('SHA-384', d);\n"
    got = [(r["line_number"], r["algorithm"], r.get("key_size")) for r in rows(code.javascript_code, "a.js", text)]
    assert got == [(3, "SHA-256", None), (4, "AES", None), (6, "RSA", 2048), (7, "SHA-384", None), (1, "UNSPECIFIED", None)]


def test_manifests():
    assert [(r["library"], r["dependency_version"]) for r in rows(code.manifest, "x/requirements.txt", "cryptography==42.0\nflask\n")] == [("cryptography (Python)", "42.0")]
    assert [(r["library"], r["dependency_version"]) for r in rows(code.manifest, "package.json", json.dumps({"dependencies": {"node-forge": "^1.3.0"}, "devDependencies": {"jest": "1"}}))] == [("node-forge", "1.3.0")]
    pom = "<project xmlns='http://x'><dependencies><dependency><artifactId>bcprov-jdk18on</artifactId><version>1.7</version></dependency></dependencies></project>"
    assert [(r["library"], r["dependency_version"]) for r in rows(code.manifest, "pom.xml", pom)] == [("Bouncy Castle Provider", "1.7")]


def test_dockerfile(spark):
    text = "FROM x\n# RSA-2048 in a comment\nRUN apt-get update && \\\n apt-get install -y openssl curl\nRUN openssl req -x509 -newkey rsa:4096 -keyout /k/server.key -out /k/server.crt\nENV TLS_VERSION=TLSv1.3\nENV DB_PASSWORD=hunter2\n"
    got = hits(spark, commands.docker_hits, text)
    kinds = {(r["line_number"], r["artifact_type"], r.get("algorithm"), r.get("key_size")) for r in got}
    assert {(3, "library", None, None), (5, "algorithm", "RSA", 4096), (5, "certificate_generation", None, None), (6, "protocol", None, None)} <= kinds
    assert "hunter2" not in str(got) and not any(n == 2 for n, *_ in kinds)
    key = 'ENV K="-----BEGIN RSA PRIVATE KEY----- secret"\nRUN apt-get install openssl -----BEGIN PRIVATE KEY----- secret'
    assert "secret" not in str(hits(spark, commands.docker_hits, key))


def test_overlapping_names(spark):
    """Names come by priority; what one has taken no later one reads."""
    text = "AES-256-GCM and RSA-2048, ChaCha20-Poly1305, 3DES, SHA-256, dsa"
    want = [("ChaCha20-Poly1305", None), ("RSA", 2048), ("AES-256-GCM", None), ("3DES", None), ("SHA-256", None)]
    assert [(r["algorithm"], r["key_size"]) for r in hits(spark, commands.config_hits, text)] == want
    assert [(r["algorithm"], r["key_size"]) for r in hits(spark, commands.docker_hits, "RUN " + text)] == want


def test_package_databases(spark):
    dpkg = "Package: openssl\nStatus: ok\nVersion: 3.0.13\n\nPackage: bash\nVersion: 5\n\nPackage: libssl-dev\nVersion: 3.0.13-0ubuntu1\n"
    base = lambda apk: lambda t: commands.database_hits(t, F.lit(apk))
    assert [(r["evidence"], r["dependency_version"]) for r in hits(spark, base(False), dpkg)] == [("dpkg package: openssl", "3.0.13"), ("dpkg package: libssl-dev", "3.0.13-0ubuntu1")]
    apk = "P:openssl\nV:3.1.4-r5\n\nP:libsodium\nV:1"
    assert [r["evidence"] for r in hits(spark, base(True), apk)] == ["apk package: openssl"]


def test_image_metadata_keeps_no_secrets(spark):
    inspect = json.dumps([{"Config": {"Env": ["API_TOKEN=abc", "SSL_VERSION=TLSv1.2"], "Cmd": ["run"], "Entrypoint": None, "Labels": {"a": "RSA-4096"}}}])
    got = [r.asDict() for r in scan.metadata(spark.createDataFrame([("nginx:1", inspect), ("none", "{}"), ("bad", "[")], "image string, inspect string")).collect()]
    assert "abc" not in str(got)
    assert {(r["file_path"], r["detection_method"], r["protocol"], r["algorithm"], r["key_size"], r["confidence"]) for r in got} == {("docker-inspect:nginx:1", "docker_inspect", "TLSv1.2", None, None, 0.9), ("docker-inspect:nginx:1", "docker_inspect", None, "RSA", 4096, 0.7)}


def openssl(*args):
    subprocess.run(["openssl", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def certs(tmp_path_factory):
    d = tmp_path_factory.mktemp("certs")
    openssl("req", "-x509", "-newkey", "rsa:2048", "-nodes", "-keyout", f"{d}/k.key", "-out", f"{d}/rsa.pem", "-subj", "/CN=localhost", "-days", "30", "-addext", "subjectAltName=DNS:localhost")
    openssl("x509", "-in", f"{d}/rsa.pem", "-outform", "DER", "-out", f"{d}/rsa.der")
    openssl("req", "-x509", "-newkey", "ec", "-pkeyopt", "ec_paramgen_curve:prime256v1", "-nodes", "-keyout", f"{d}/e.key", "-out", f"{d}/ec.pem", "-subj", "/CN=e", "-days", "30")
    openssl("pkcs12", "-export", "-inkey", f"{d}/k.key", "-in", f"{d}/rsa.pem", "-out", f"{d}/locked.p12", "-passout", "pass:secret")
    return d


def test_certificates(certs):
    read = lambda n, **k: list(code.certificate(n, (certs / n).read_bytes(), **k))
    pem = read("rsa.pem")[0]
    assert (pem["algorithm"], pem["key_size"], pem["certificate_version"], pem["certificate_signature_algorithm"]) == ("RSA", 2048, 3, "sha256WithRSAEncryption")
    assert pem["certificate_subject_alternative_names"] == ["DNS:localhost"] and pem["certificate_source_format"] == "PEM"
    assert read("rsa.der")[0]["certificate_source_format"] == "DER"
    assert (read("ec.pem")[0]["key_size"], read("ec.pem")[0]["certificate_ec_curve"]) == (None, "prime256v1")
    assert read("locked.p12")[0]["artifact_type"] == "pkcs12"
    assert read("locked.p12", password="secret")[0]["key_size"] == 2048
    assert list(code.certificate("k.pem", (certs / "k.key").read_bytes())) == []
    assert list(code.certificate("x.crt", b"rubbish"))[0]["artifact_type"] == "warning"


def test_whole_scan(spark, tmp_path, certs):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("hashlib.md5()")
    (tmp_path / "src" / "a.py").write_text("import hashlib\nhashlib.sha1(b'')\nssl.create_default_context()\n")
    (tmp_path / "src" / "A.java").write_text('import javax.crypto.Cipher;\nclass A {\n KeyPairGenerator g = KeyPairGenerator.getInstance("RSA");\n /* MessageDigest.getInstance("MD5") */\n void f() { g.initialize(1024); }\n}\n')
    (tmp_path / "src" / "c.c").write_text('#include <openssl/rsa.h>\n// MD5(x)\nRSA_generate_key(1024, 3);\n')
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00\x01")
    (tmp_path / "Dockerfile").write_text("FROM x\nRUN apk add openssl\n")
    (tmp_path / "ok.pem").write_bytes((certs / "rsa.pem").read_bytes())
    (tmp_path / "boot.fw").write_bytes(b"\0")
    found = scan.findings(spark, str(tmp_path)).cache()
    got = {(r.file_path.rsplit("/", 1)[1], r.line_number, r.algorithm, r.key_size, r.detection_method) for r in found.collect()}
    assert {("a.py", 2, "SHA-1", None, "ast_call"), ("A.java", 3, "RSA", 1024, "ast_call"), ("c.c", 3, "RSA", 1024, "pattern_match"), ("ok.pem", None, "RSA", 2048, "openssl")} <= got
    assert not any(f == "x.py" or a == "MD5" for f, _, a, *_ in got)
    assert found.where("artifact_type = 'firmware'").count() == 1
    out = scan.inventory(found)
    assert out["summary"].first().raw_findings == found.count() and out["system"].first().findings > 0
    doc = json.loads(out["cyclonedx"].first()[0])
    assert doc["specVersion"] == "1.6" and len(doc["components"]) == out["entries"].count()
    n = sinks.write_json_array(found.drop("ord"), str(tmp_path / "o.json"))
    assert len(json.loads((tmp_path / "o.json").read_text())) == n == found.count()


def test_container(spark, tmp_path):
    root = tmp_path / "r"
    (root / "etc").mkdir(parents=True)
    (root / "etc" / "nginx.conf").write_text("ssl_protocols TLSv1.2;\n# TLSv1.0\n")
    (root / "etc" / "id_rsa").write_text("-----BEGIN RSA PRIVATE KEY-----\nsecret")
    with tarfile.open(tmp_path / "i.tar", "w") as t:
        t.add(root, "")
        evil = tarfile.TarInfo("../evil.conf")
        t.addfile(evil)
    got = scan.container(tar.image_files(tar.read_tar(spark, str(tmp_path / "i.tar")))).collect()
    conf = {r.line_number: r.confidence for r in got if r.artifact_type == "protocol"}
    assert conf[2] < conf[1]
    assert any(r.artifact_type == "private_key" and r.algorithm == "RSA" for r in got)
    assert "secret" not in str(got) and not any("evil" in r.file_path for r in got)


def test_paths_and_dedup(spark):
    df = spark.createDataFrame([("a/./b", 1), ("a//b", 2), ("a/x/../b", 3), ("../a", 4), ("", 5), (None, 6)], "file_path string, ord int")
    got = {r.ord: r.p for r in df.select("ord", cbom.normal_path(F.col("file_path")).alias("p")).collect()}
    assert got == {1: "a/b", 2: "a/b", 3: "a/b", 4: "../a", 5: ".", 6: None}
    assert sorted(r.ord for r in cbom.exact_dedup(cbom.conform(df)).collect()) == [1, 4, 5, 6]


def test_score_cases(spark):
    """Hand-computed scores by profile."""
    cols = "algorithm string, finding_type string, data_lifetime_years double, migration_effort_years double, sensitivity string, internet_facing boolean, public_registry boolean, third_party_api boolean, purpose string, device_class string, extra map<string,string>, want double, band string, profile string"
    base = [("RSA", "code_call", 6.0, 1.5, "High", True), ("AES", "code_call", 6.0, 1.5, "High", True), ("RSA", "tls_config", 12.0, 1.0, "Critical", True), ("ML-KEM", "code_call", 3.0, 1.5, "Moderate", False), (None, "code_call", 3.0, 1.5, "Moderate", False)]
    want = {"default": [(0.5077, "medium"), (0.1223, "low"), (0.6326, "high"), (0.0, "low"), (0.2807, "low")], "finance": [(0.5535, "medium"), (0.1460, "low"), (0.6951, "high"), (0.0, "low"), (0.3038, "medium")]}
    for profile, w in want.items():
        df = spark.createDataFrame([(*b, False, False, "encryption", "standard", None, *x, profile) for b, x in zip(base, w, strict=True)], cols)
        for r in risk.score(df, profile).collect():
            assert (r.risk.layer_score, r.risk.band) == (r.want, r.band)
    with pytest.raises(ValueError):
        risk.weights_of("iot", (1, 0, 0, 0, 0))


@pytest.mark.parametrize(
    "findings, want",
    [
        ([("algorithm", "AES"), ("hash", "SHA-256")], ("software-centric", 2, 1, 1)),
        ([("hsm", None), ("firmware", None)], ("hardware/IoT-centric", 5, 5, 1)),
        ([("packet_constraint", None)] * 2, ("network/protocol-centric", 2, 1, 5)),
        ([("hsm", None), ("algorithm", "AES")], ("mixed", 2, 4, 1)),
        ([], ("software-centric", 3, 1, 1)),
    ],
)
def test_effort(spark, findings, want):
    df = cbom.conform(spark.createDataFrame(findings, "artifact_type string, algorithm string"))
    r = effort.ratings(df).first()
    assert (r.architecture, r.ca, r.ds, r.np) == want and abs(r.w_ca + r.w_ds + r.w_np - 1) < 1e-9


def test_lines_and_comments(spark):
    df = spark.createDataFrame([("a", "x\r\ny\n\nz\n"), ("b", ""), ("c", None)], "path string, text string")
    assert [(r.path, r.line_number, r.line) for r in rules.lines(df).collect()] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, ""), ("a", 4, "z")]
    t = spark.createDataFrame([("a /* b\nc */ d // e\nf",)], "t string").select(rules.mask_comments(F.col("t"))).first()[0]
    assert t == "a     \n     d     \nf"


def test_streaming(spark, tmp_path):
    from pqledger.streaming.incremental import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("hashlib.md5(b'')\n")
    q = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("algorithm = 'MD5'").count() > 0


def test_rules_put_no_matching_line_aside(spark):
    from pqledger.operators import rules

    code = """RSA.generate(2048) rsa.generate_private_key(x) RSA_generate_key(1) KeyPairGenerator.getInstance("RSA"x ec.generate_private_key(x)
SHA256withECDSA ECDSA.new(x) createSign("ECDSA"x ECDH.new(x) createECDH(x) ecdh AES.new(k) createCipheriv("aes AES_encrypt(x) AES_set_encrypt_key(x)
Cipher.getInstance("AES DES.new(k) DES_ecb_encrypt(x) Cipher.getInstance("DES"x DES3.new(k) TripleDES Cipher.getInstance("DESede"x hashlib.sha1(x)
EVP_sha1() createHash("sha1"x MessageDigest.getInstance("SHA-1"x hashlib.sha256(x) hashlib.sha512(x) EVP_sha256() createHash("sha256"x
MessageDigest.getInstance("SHA256"x hashlib.sha3_256(x) createHash("sha3-256"x hmac.new(k) crypto.createHmac(x) Mac.getInstance(x)
ssl.wrap_socket(s) ssl.create_default_context() SSL_CTX_new(m) tls.connect(o) https.request(o)""".split()
    protocols = """TLSv1.3 PROTOCOL_TLSv1_2 TLS1_1_VERSION TLSv1_0 SSLv3 SSLv2 ssl.create_default_context() SSLContext( SSL_CTX_new( SSL_CTX_set_min_proto_version(
TLS_server_method( tls.connect( https.createServer( SSLSocketFactory ECDHE-RSA-AES128-GCM-SHA256 ECDHE-ECDSA-AES256-GCM-SHA384 TLS_AES_256_GCM_SHA384
TLS_CHACHA20_POLY1305_SHA256 DHE-RSA-AES256-SHA ssh-keygen Paramiko paramiko.SSHClient() JSch() ssh-rsa ecdsa-sha2-nistp256 ssh-ed25519
diffie-hellman-group14-sha1""".split()
    directives = [" ſsl_protocols TLS;", "SSL_CIPHERS x;", "sslciphersuite x", "SSLProtocol all", "\tprotocol 2", "KexAlgorithms x", "Ciphers x", "HostKeyAlgorithms x"]
    families = [rules.DIRECTIVES, rules.TLS_VERSIONS, rules.TLS_APIS, rules.CIPHER_SUITES, rules.SSH]
    for lines, plain, got in (
        (code, [(rules.CODE_RULES, "m")], rules.code_rules),
        (protocols + directives, [(f, "m") for f in families], rules.protocols),
    ):
        df = spark.createDataFrame([("a.py", i, x) for i, x in enumerate(lines)], "path string, line_number int, line string")
        want = {(r.line_number, r.family, r.rule_index) for r in rules.matched_families(df, plain).collect()}
        rows = [r.asDict() for r in got(df).collect()]
        assert {(r["line_number"], r.get("family", 0), r["rule_index"]) for r in rows} == want and len(rows) == len(want)
        assert {n for n, _, _ in want} == set(range(len(lines))), sorted(set(range(len(lines))) - {n for n, _, _ in want})


def test_comment_starts_and_normal_paths(spark):
    import posixpath

    from pyspark.sql import functions as F

    from pqledger.operators import cbom, rules

    lines = {"# a": True, " \t// a": True, " * a": True, "/* a": True, "a # b": False, "": False, "/ a": False}
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.c for r in df.select("line", rules.starts_comment(F.col("line")).alias("c")).collect()} == lines
    paths = ["", "/", "//", "//a", "///a", "a/", "a", "./a", "../a", "a/../b", "a//b", "a\\b", ".", "..", "/..", "/../a", "a/.", "a/..", "a.b/c..d/.e"]
    df = spark.createDataFrame([(x,) for x in paths], "path string")
    for r in df.select("path", cbom.normal_path(F.col("path")).alias("n")).collect():
        assert r.n == posixpath.normpath(r.path).replace("\\", "/")


def test_dependencies_and_binaries_name_no_algorithm():
    from pqledger.operators import code

    assert [(r["algorithm"], r["library"]) for r in code.manifest("requirements.txt", "pycrypto==2.6\nflask\n")] == [(None, "PyCrypto")]
    pem = b"-----BEGIN CERTIFICATE-----\nMIIB\n-----END CERTIFICATE-----"
    assert [r["algorithm"] for r in code.binary("a.bin", pem)] == [None]


def test_occurrences_are_the_entries_rows(spark):
    rows = [("a1", "algorithm", "RSA", 2048, "b.py", 0.5, None, 3), ("a2", "algorithm", "RSA", 2048, "a.py", 0.9, None, 7), ("a3", "algorithm", None, None, None, None, None, 2), ("a2", "hash", "MD5", None, "c.c", 0.4, None, 5), ("a5", "algorithm", "UNSPECIFIED", 1, "a.py", 0.3, "x", 9), ("a6", "algorithm", "UNSPECIFIED", 2, "d.py", 0.3, "x", 1)]
    df = spark.createDataFrame(rows, "artifact_id string, artifact_type string, algorithm string, key_size int, file_path string, confidence double, library string, ord long")
    found = cbom.classify(cbom.conform(df))
    entries = cbom.merge(found)
    nested = entries.selectExpr("cbom_entry_id", "algorithm", "key_size", "first_ord", "explode(occurrences) as o").selectExpr("cbom_entry_id", "algorithm", "key_size", "first_ord", "o.file_path", "o.confidence")
    flat = cbom.occurrences(found)
    assert sorted(map(str, flat.select(*nested.columns).collect())) == sorted(map(str, nested.collect())) and flat.count() == len(rows)
    scored = risk.score(risk.findings(flat))
    assert {(r.finding_id, r.location) for r in scored.collect() if r.algorithm == "RSA"} == {("a2_0", "b.py"), ("a2_1", "a.py")}
    # two entries share the id a2; no row is repeated for it
    merged = risk.merge_recommendations(scored, cbom.attach_recommendations(entries))
    assert merged.count() == scored.count() == len(rows)
    plan = scored.groupBy("risk.band").count()._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    empty = cbom.merge(found.limit(0))
    assert empty.count() == 0 and cbom.summary(cbom.attach_recommendations(empty), found.limit(0)).first().asDict() == {"unique_entries": 0, "raw_findings": 0, "quantum_vulnerable": 0, "files": 0}


def test_numbers_of_a_hot_entry(spark):
    """Ids count an entry's findings in order, also where one entry has half the rows; no window spans an entry."""
    from pqledger.scratch import Scratch

    rows = [(f"a{i}", "algorithm", "RSA" if i % 2 else f"X{i % 9}", f"f{i % 5}.py", i) for i in range(400)]
    df = spark.createDataFrame(rows, "artifact_id string, artifact_type string, algorithm string, file_path string, ord int")
    occurrences = cbom.occurrences(cbom.classify(cbom.conform(df)))
    numbered = risk.findings(risk.numbered_occurrences(occurrences, Scratch(spark, "test")))
    assert "cbom_entry_id" not in [w for w in numbered._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in w]
    by = lambda df: {(r.finding_id, r.location, r.ord.ord) for r in df.collect()}
    assert by(numbered) == by(risk.findings(occurrences)) and len(by(numbered)) == 400


def test_groups_score_like_their_findings(spark):
    paths = ["src/auth/a.py", "src/payment/b.py", "src/core/c.key", None]
    rows = [(f"a{i}", ["algorithm", "hash", "protocol", "hsm"][i % 4], ["RSA", "MD5", "TLS 1.0", None, "UNSPECIFIED"][i % 5], paths[i % 3 if i % 7 else 3], i / 90, f"l{i % 2}", i) for i in range(90)]
    df = spark.createDataFrame(rows, "artifact_id string, artifact_type string, algorithm string, file_path string, confidence double, library string, ord int")
    found = cbom.classify(cbom.conform(df))
    one, many = risk.score(risk.findings(cbom.occurrences(found))), risk.score(risk.finding_groups(found))
    keys = ["cbom_entry_id", "algorithm", "key_size", "purpose", "sensitivity", "risk.layer_score", "risk.band"]
    assert sorted(map(str, one.groupBy(*keys).count().collect())) == sorted(map(str, many.groupBy(*keys).agg(F.sum("n").alias("count")).collect()))
    a, b = risk.system_score(one).first(), risk.system_score(many).first()
    assert a == b and a.findings == one.count()
    merged = risk.merge_recommendations(one, cbom.attach_recommendations(cbom.merge(found)))
    phase = ["migration_phase", "db_recommendation_source"]
    assert sorted(map(str, merged.groupBy(*phase).count().collect())) == sorted(map(str, risk.phases(many).groupBy(*phase).agg(F.sum("n").alias("count")).collect()))


def test_passwords_open_containers(spark, certs):
    raw = (certs / "locked.p12").read_bytes()
    df = spark.createDataFrame([("a.p12", len(raw), bytearray(raw))], "path string, length long, content binary")
    assert [(r.artifact_type, r.key_size) for r in scan.detect(df).collect()] == [("pkcs12", None)]
    opened = scan.detect(df, "secret").collect()
    assert [(r.artifact_type, r.key_size, r.certificate_source_format) for r in opened] == [("certificate", 2048, "PKCS12")] and "secret" not in str(opened)


def evidence_of(spark, rows):
    df = cbom.conform(spark.createDataFrame(rows, "artifact_type string, algorithm string, detection_method string, file_path string, line_number int, library string, protocol string, evidence string, code_snippet string, ord int"))
    rated = effort.ratings(df)
    got = [(r.rating, r.evidence) for r in effort.evidence(df, rated).orderBy("rating", "place", "ord").collect()]
    report = effort.result(rated).first()
    return got, report


def test_effort_evidence(spark):
    soft = lambda i, method="ast_call", alg="AES", lib=None: ("algorithm", alg, method, f"f{i}.py", i, lib, None, None, "x", i)
    none = ("DS", "Software-only environment confirmed; 0 HSM, IoT, embedded, or specialized hardware artifacts detected.")
    flat = ("NP", "Standard flexible software protocols; no restrictive MTU or packet buffer limits discovered.")
    got, report = evidence_of(spark, [soft(i) for i in range(9, 0, -1)])
    assert got == [*(("CA", f"Hardcoded algorithm 'AES' at f{i}.py:{i}") for i in range(1, 6)), none, flat] and report.ratings.CA.score == 3
    got, report = evidence_of(spark, [soft(1, alg="MD5"), soft(2, "pattern_match", "des")])
    assert got[:2] == [("CA", "Legacy cipher 'MD5' in f1.py"), ("CA", "Legacy cipher 'des' in f2.py")] and report.ratings.CA.score == 4
    hard = [("hsm", None, "hsm_pattern", "h.c", 1, None, None, "PKCS#11", None, 1), ("firmware", None, "f", "b.fw", None, None, None, None, None, 2), ("packet_constraint", None, "p", "n.c", 3, None, None, None, "MTU = 5", 3)]
    got, report = evidence_of(spark, hard)
    assert got == [("CA", "Custom/firmware crypto in b.fw: None"), ("DS", "Hardware dependency 'hsm' in h.c: PKCS#11"), ("DS", "Hardware dependency 'firmware' in b.fw: None"), ("NP", "Packet/MTU constraint in n.c: MTU = 5")]
    assert (report.ratings.CA.score, report.ratings.DS.score, report.ratings.NP.score) == (5, 5, 5)
    got, _ = evidence_of(spark, [("protocol", None, "config_directive", "a.conf", 1, None, "TLS 1.0", "x", None, 1), ("protocol", None, "api_pattern", "b.py", 1, None, "TLS 1.2", "x", None, 2)])
    assert got == [("CA", "Centralized modern crypto library APIs and configuration-driven selection detected."), none, ("NP", "Legacy protocol 'TLS 1.0' in a.conf")]
    got, report = evidence_of(spark, [])
    assert got == [none, flat] and report.missing_evidence == ["No crypto findings detected to evaluate Crypto-Agility."] and report.ratings.CA.score == 3


def test_command_line(spark, tmp_path, capsys):
    from pqledger import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("import hashlib\nhashlib.md5(b'')\nRSA.generate(1024)\n")
    assert cli.main([str(tmp_path / "in"), "-o", str(tmp_path / "out.json"), "--results", str(tmp_path / "r")]) == 0
    said = capsys.readouterr().out
    found = json.loads((tmp_path / "out.json").read_text())
    assert f"{len(found)} artifacts detected" in said and "RSA (1024-bit)  <- RSA.generate(1024)" in said
    report = json.loads((tmp_path / "mtech_result.json").read_text())
    assert report["M_tech"] and report["evidence"][0]["evidence"].startswith("Legacy cipher 'MD5'") and report["component_ratings"][0]["component"] == "a.py"
    assert f"score: {report['M_tech']}" in said
    bom = json.loads((tmp_path / "r" / "cyclonedx.json").read_text())
    bill = json.loads((tmp_path / "r" / "cbom.json").read_text())
    assert len(bom["components"]) == len(bill) > 0 and sum(e["occurrence_count"] for e in bill) == len(found)
    with pytest.raises(SystemExit):
        cli.main([])
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path / "missing")])
