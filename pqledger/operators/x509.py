"""X.509 certificates read in process: the fields of a DER certificate, in the words that the usual tool prints them in."""

from __future__ import annotations

import base64
import binascii
import ipaddress
import re
from dataclasses import dataclass

# fixed values: object ids and their names
SIGNATURES = {
    "1.2.840.113549.1.1.4": "md5WithRSAEncryption",
    "1.2.840.113549.1.1.5": "sha1WithRSAEncryption",
    "1.2.840.113549.1.1.10": "rsassaPss",
    "1.2.840.113549.1.1.11": "sha256WithRSAEncryption",
    "1.2.840.113549.1.1.12": "sha384WithRSAEncryption",
    "1.2.840.113549.1.1.13": "sha512WithRSAEncryption",
    "1.2.840.113549.1.1.14": "sha224WithRSAEncryption",
    "1.2.840.10040.4.3": "dsaWithSHA1",
    "2.16.840.1.101.3.4.3.2": "dsa_with_SHA256",
    "1.2.840.10045.4.1": "ecdsa-with-SHA1",
    "1.2.840.10045.4.3.1": "ecdsa-with-SHA224",
    "1.2.840.10045.4.3.2": "ecdsa-with-SHA256",
    "1.2.840.10045.4.3.3": "ecdsa-with-SHA384",
    "1.2.840.10045.4.3.4": "ecdsa-with-SHA512",
    "1.3.101.112": "ED25519",
    "1.3.101.113": "ED448",
}
KEYS = {
    "1.2.840.113549.1.1.1": "RSA",
    "1.2.840.113549.1.1.10": "RSA",
    "1.2.840.10045.2.1": "EC",
    "1.2.840.10040.4.1": "DSA",
    "1.2.840.113549.1.3.1": "DH",
    "1.3.101.110": "X25519",
    "1.3.101.111": "X448",
    "1.3.101.112": "Ed25519",
    "1.3.101.113": "Ed448",
}
CURVES = {
    "1.2.840.10045.3.1.1": "prime192v1",
    "1.2.840.10045.3.1.7": "prime256v1",
    "1.3.132.0.10": "secp256k1",
    "1.3.132.0.33": "secp224r1",
    "1.3.132.0.34": "secp384r1",
    "1.3.132.0.35": "secp521r1",
    "1.3.36.3.3.2.8.1.1.7": "brainpoolP256r1",
    "1.3.36.3.3.2.8.1.1.11": "brainpoolP384r1",
    "1.3.36.3.3.2.8.1.1.13": "brainpoolP512r1",
}
ATTRIBUTES = {
    "2.5.4.3": "CN",
    "2.5.4.4": "SN",
    "2.5.4.5": "serialNumber",
    "2.5.4.6": "C",
    "2.5.4.7": "L",
    "2.5.4.8": "ST",
    "2.5.4.9": "street",
    "2.5.4.10": "O",
    "2.5.4.11": "OU",
    "2.5.4.12": "title",
    "2.5.4.42": "GN",
    "2.5.4.97": "organizationIdentifier",
    "0.9.2342.19200300.100.1.1": "UID",
    "0.9.2342.19200300.100.1.25": "DC",
    "1.2.840.113549.1.9.1": "emailAddress",
}
USAGES = ["Digital Signature", "Non Repudiation", "Key Encipherment", "Data Encipherment", "Key Agreement", "Certificate Sign", "CRL Sign", "Encipher Only", "Decipher Only"]
PURPOSES = {
    "1.3.6.1.5.5.7.3.1": "TLS Web Server Authentication",
    "1.3.6.1.5.5.7.3.2": "TLS Web Client Authentication",
    "1.3.6.1.5.5.7.3.3": "Code Signing",
    "1.3.6.1.5.5.7.3.4": "E-mail Protection",
    "1.3.6.1.5.5.7.3.8": "Time Stamping",
    "1.3.6.1.5.5.7.3.9": "OCSP Signing",
    "2.5.29.37.0": "Any Extended Key Usage",
}
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
PEM = re.compile(rb"-----BEGIN (?:TRUSTED |X509 )?CERTIFICATE-----(.*?)-----END (?:TRUSTED |X509 )?CERTIFICATE-----", re.S)


class Malformed(ValueError):
    """Not a whole certificate."""


@dataclass
class Item:
    """A DER value: its tag (with class and form bits) and its bytes."""

    tag: int
    body: bytes

    def items(self) -> list[Item]:
        out, at = [], 0
        while at < len(self.body):
            item, at = read(self.body, at)
            out.append(item)
        return out


def read(raw: bytes, at: int = 0) -> tuple[Item, int]:
    """The value that begins at a place, and where the next one does. Lengths must be definite and within the bytes."""
    try:
        tag, n = raw[at], raw[at + 1]
    except IndexError:
        raise Malformed("ends early") from None
    if tag & 0x1F == 0x1F:
        raise Malformed("a long tag")
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(raw):
            raise Malformed("a length")
        n, at = int.from_bytes(raw[at : at + k], "big"), at + k
    if at + n > len(raw):
        raise Malformed("ends early")
    return Item(tag, raw[at : at + n]), at + n


def object_id(body: bytes) -> str:
    parts, n = [], 0
    for b in body:
        n = n << 7 | b & 0x7F
        if not b & 0x80:
            parts.append(n)
            n = 0
    if not parts:
        raise Malformed("an object id")
    first = min(parts[0] // 40, 2)
    return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))


def text_of(item: Item) -> str:
    if item.tag == 0x1E:
        return item.body.decode("utf-16-be", "replace")
    if item.tag == 0x1C:
        return item.body.decode("utf-32-be", "replace")
    return item.body.decode("utf-8" if item.tag == 0x0C else "latin-1", "replace")


def shown(value: str) -> str:
    """An attribute's value as it is, control signs as hexadecimal."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\{ord(m[0]):02X}", value)


def name(item: Item, equals: str = "=") -> str:
    parts = []
    for group in item.items():
        pairs = [pair.items() for pair in group.items()]
        parts.append(" + ".join(f"{ATTRIBUTES.get(oid := object_id(k.body), oid)}{equals}{shown(text_of(v))}" for k, v in pairs))
    return ", ".join(parts)


def time_of(item: Item) -> str:
    t = item.body.decode("ascii", "replace")
    if item.tag == 0x17:  # two digits of the year
        t = ("19" if t[:2] >= "50" else "20") + t
    if not re.fullmatch(r"\d{14}Z", t) or not 1 <= int(t[4:6]) <= 12:
        raise Malformed("a time")
    return f"{MONTHS[int(t[4:6]) - 1]} {int(t[6:8]):2d} {t[8:10]}:{t[10:12]}:{t[12:14]} {t[:4]} GMT"


def alternative(item: Item) -> str:
    kind, body = item.tag & 0x1F, item.body
    if kind in (1, 2, 6):
        return {1: "email", 2: "DNS", 6: "URI"}[kind] + ":" + body.decode("latin-1")
    if kind == 7:
        if len(body) == 4:
            return "IP Address:" + str(ipaddress.ip_address(body))
        if len(body) == 16:
            return "IP Address:" + ":".join(f"{int.from_bytes(body[i : i + 2], 'big'):X}" for i in range(0, 16, 2))
        return "IP Address:<invalid>"
    if kind == 4:
        return "DirName:" + name(read(body)[0])
    return "Registered ID:" + object_id(body) if kind == 8 else "othername:<unsupported>"


def bits(item: Item) -> bytes:
    if item.tag != 3 or not item.body:
        raise Malformed("a bit string")
    return item.body[1:]


def key_fields(info: Item) -> dict:
    """Algorithm, size and curve of a public key."""
    kind, key = info.items()
    parts = kind.items()
    oid = object_id(parts[0].body)
    algorithm = KEYS.get(oid, oid)
    size = curve = None
    if algorithm == "RSA":
        size = int.from_bytes(read(bits(key))[0].items()[0].body, "big").bit_length()
    elif algorithm == "EC" and parts[1].tag == 6:
        curve = CURVES.get(oid := object_id(parts[1].body), oid)
    elif algorithm in ("DSA", "DH") and len(parts) > 1 and parts[1].tag == 0x30:
        size = int.from_bytes(parts[1].items()[0].body, "big").bit_length()
    return {"algorithm": algorithm, "key_size": size, "certificate_ec_curve": curve}


def extension_fields(wrapped: Item) -> dict:
    out: dict = {}
    for ext in read(wrapped.body)[0].items():
        parts = ext.items()
        oid, value = object_id(parts[0].body), read(parts[-1].body)[0]
        if oid == "2.5.29.17":
            out["certificate_subject_alternative_names"] = [alternative(x) for x in value.items()] or None
        elif oid == "2.5.29.15":
            flags = "".join(f"{b:08b}" for b in bits(value))
            out["certificate_key_usage"] = [u for u, f in zip(USAGES, flags, strict=False) if f == "1"] or None
        elif oid == "2.5.29.37":
            out["certificate_extended_key_usage"] = [PURPOSES.get(p := object_id(x.body), p) for x in value.items()] or None
    return out


def certificate_fields(der: bytes) -> dict:
    """The columns of a DER certificate; Malformed if it isn't one."""
    try:
        whole, _ = read(der)
        body, signature, _ = whole.items()[:3]
        if whole.tag != 0x30 or body.tag != 0x30:
            raise Malformed("not a sequence")
        parts = body.items()
        version = 1
        if parts[0].tag == 0xA0:
            version = int.from_bytes(read(parts.pop(0).body)[0].body, "big") + 1
        serial, _, issuer, validity, subject, key = parts[:6]
        if serial.tag != 2 or not serial.body:
            raise Malformed("a serial number")
        begins, ends = validity.items()
        number = int.from_bytes(serial.body, "big", signed=True)
        digits = f"{abs(number):X}"
        out = {
            "certificate_version": version, "certificate_serial_number": ("-" if number < 0 else "") + digits.zfill(len(digits) + len(digits) % 2),
            "certificate_signature_algorithm": SIGNATURES.get(oid := object_id(signature.items()[0].body), oid), "certificate_subject": name(subject), "certificate_issuer": name(issuer),
            "certificate_not_before": time_of(begins), "certificate_expiry": time_of(ends), **key_fields(key),
        }
        for item in parts[6:]:
            if item.tag == 0xA3:
                out |= extension_fields(item)
        return out
    except (IndexError, ValueError, UnicodeDecodeError) as e:
        raise e if isinstance(e, Malformed) else Malformed(type(e).__name__) from None


def first_certificate(raw: bytes) -> tuple[dict, str]:
    """The fields of a file's first certificate and the form that it has, PEM or DER."""
    m = PEM.search(raw)
    if m:
        try:
            der = base64.b64decode(b"".join(m[1].split()), validate=True)
        except (binascii.Error, ValueError):
            raise Malformed("not base 64") from None
        return certificate_fields(der), "PEM"
    return certificate_fields(raw), "DER"
