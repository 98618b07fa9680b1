"""Certificates read in process, against the tool's own words."""

import re
import subprocess

import pytest

from pqledger.operators import code, x509


def tool(*args, data=None):
    return subprocess.run(["openssl", *args], check=True, capture_output=True, input=data).stdout


KINDS = {
    "rsa2048": ["-newkey", "rsa:2048", "-sha256"],
    "rsa3072": ["-newkey", "rsa:3072", "-sha512"],
    "rsa1024": ["-newkey", "rsa:1024", "-sha1"],
    "p256": ["-newkey", "ec", "-pkeyopt", "ec_paramgen_curve:prime256v1"],
    "p384": ["-newkey", "ec", "-pkeyopt", "ec_paramgen_curve:secp384r1", "-sha384"],
    "k1": ["-newkey", "ec", "-pkeyopt", "ec_paramgen_curve:secp256k1"],
    "ed25519": ["-newkey", "ed25519"],
    "ed448": ["-newkey", "ed448"],
}
SUBJECTS = ["/CN=localhost", "/C=DE/O=Some Org/OU=a/CN=b.example/emailAddress=x@y.z", "/O=Foo, Inc./CN=quote\\\"d", "/CN=Müller é"]
MORE = ["-addext", "subjectAltName=DNS:localhost,DNS:*.example.com,IP:127.0.0.1,IP:::1,email:a@b.c,URI:http://x/y", "-addext", "keyUsage=critical,digitalSignature,keyCertSign", "-addext", "extendedKeyUsage=serverAuth,clientAuth,1.2.3.4"]


def said(pem):
    """The tool's own words on the same fields."""
    text = tool("x509", "-noout", "-text", "-certopt", "ext_dump", data=pem).decode()
    meta = dict(x.split("=", 1) for x in tool("x509", "-noout", "-subject", "-issuer", "-serial", "-startdate", "-enddate", data=pem).decode().splitlines())
    one = lambda p: (m[1].strip() if (m := re.search(p, text)) else None)
    many = lambda p: ([x.strip() for x in m[1].split(",")] if (m := re.search(p, text)) else None)
    close = lambda s: re.sub(r" = ", "=", s.strip())  # noqa: E731  older versions put blanks there
    bits = one(r"Public-Key:\s*\((\d+) bit")
    alg = {"rsaEncryption": "RSA", "id-ecPublicKey": "EC", "ED25519": "Ed25519", "ED448": "Ed448"}[one(r"Public Key Algorithm:\s*(\S+)")]
    return {
        "algorithm": alg, "key_size": int(bits) if bits and alg == "RSA" else None, "certificate_ec_curve": one(r"ASN1 OID:\s*(\S+)"), "certificate_version": int(one(r"Version:\s*(\d+)")),
        "certificate_signature_algorithm": one(r"Signature Algorithm:\s*(\S+)"), "certificate_subject": close(meta["subject"]), "certificate_issuer": close(meta["issuer"]),
        "certificate_serial_number": meta["serial"], "certificate_not_before": meta["notBefore"], "certificate_expiry": meta["notAfter"],
        "certificate_subject_alternative_names": many(r"Subject Alternative Name:[^\n]*\n\s*(.+)"), "certificate_key_usage": many(r"X509v3 Key Usage:[^\n]*\n\s*(.+)"), "certificate_extended_key_usage": many(r"Extended Key Usage:[^\n]*\n\s*(.+)"),
    }


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    d, out = tmp_path_factory.mktemp("x509"), {}
    for i, (kind, args) in enumerate(KINDS.items()):
        extra = MORE if i % 2 else []
        tool("req", "-x509", *args, "-nodes", "-keyout", f"{d}/{kind}.key", "-out", f"{d}/{kind}.pem", "-subj", SUBJECTS[i % 4], "-utf8", "-days", str(30 + 9000 * i), "-set_serial", ["1", "0x80ff", "12345678901234567890", "255"][i % 4], *extra)
        out[kind] = (d / f"{kind}.pem").read_bytes()
    return out


@pytest.mark.parametrize("kind", list(KINDS))
def test_same_as_the_tool(made, kind, monkeypatch):
    monkeypatch.setattr(code, "openssl", None)  # no process is started
    pem = made[kind]
    want = said(pem)
    got, form = x509.first_certificate(pem)
    assert form == "PEM" and {k: got.get(k) for k in want} == want
    der = tool("x509", "-outform", "DER", data=pem)
    assert x509.first_certificate(der) == (got, "DER")
    row = next(code.certificate("a.crt", b"some text\n" + pem))
    assert (row["artifact_type"], row["confidence"], row["certificate_source_format"], row["algorithm"]) == ("certificate", 1.0, "PEM", want["algorithm"])


def test_damaged_certificates(made):
    der = tool("x509", "-outform", "DER", data=made["rsa2048"])
    for cut in range(0, len(der), 7):
        with pytest.raises(x509.Malformed):
            x509.certificate_fields(der[:cut])
    for at in range(0, len(der), 3):  # never another error than Malformed
        try:
            x509.certificate_fields(der[:at] + bytes([der[at] ^ 0xFF]) + der[at + 1 :])
        except x509.Malformed:
            pass
    for raw in (b"", b"0", b"\x30\x80\0\0", b"-----BEGIN CERTIFICATE-----\n!!!\n-----END CERTIFICATE-----"):
        with pytest.raises(x509.Malformed):
            x509.first_certificate(raw)
