"""Dockerfiles, configuration text, image metadata and package databases, as column expressions without user functions.

Names of algorithms are taken by a fold over patterns in order of priority: what one pattern has matched is replaced by a
sign that keeps the word's ends, so that no later pattern reads the same place again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cbom import lookup
from .rules import hit, let, line_array, no_hits, present, strip

# fixed values: instructions of Dockerfiles that are read, and others that are known
TARGETS = ["FROM", "RUN", "CMD", "ENTRYPOINT", "ENV", "ARG", "COPY", "ADD"]
OTHERS = ["WORKDIR", "EXPOSE", "USER", "VOLUME", "SHELL", "HEALTHCHECK", "ONBUILD", "STOPSIGNAL", "MAINTAINER", "LABEL"]
# fixed values: package names, what they are called, and how sure that is
PACKAGES = {
    "openssl": ("OpenSSL", 0.90),
    "libssl-dev": ("OpenSSL (dev headers)", 0.85),
    "libssl1.1": ("OpenSSL", 0.85),
    "libssl3": ("OpenSSL", 0.85),
    "libssl": ("OpenSSL", 0.85),
    "cryptography": ("cryptography (Python)", 0.90),
    "pycryptodome": ("PyCryptodome", 0.90),
    "pycrypto": ("PyCrypto", 0.85),
    "pyopenssl": ("pyOpenSSL", 0.90),
    "crypto": ("crypto (npm)", 0.55),
    "node-forge": ("node-forge", 0.90),
    "forge": ("node-forge", 0.60),
    "bcrypt": ("bcrypt", 0.80),
    "libsodium": ("libsodium", 0.90),
    "sodium-native": ("libsodium (Node bindings)", 0.85),
    "gnutls": ("GnuTLS", 0.85),
    "gnutls-bin": ("GnuTLS", 0.85),
    "mbedtls": ("mbed TLS", 0.85),
    "libmbedtls-dev": ("mbed TLS", 0.85),
    "wolfssl": ("wolfSSL", 0.85),
    "tweetnacl": ("TweetNaCl", 0.80),
}
PACKAGE_NAMES, PACKAGE_CONFIDENCE = {k: v[0] for k, v in PACKAGES.items()}, {k: v[1] for k, v in PACKAGES.items()}
# fixed values: how package managers are called; group 1 holds the packages
INSTALLS = [
    r"(?iu)\bapt-get\s+(?:-\S+\s+)*install\s+(?:-\S+\s+)*([^\n|;&]+)",
    r"(?iu)(?<!-get)\bapt\s+(?:-\S+\s+)*install\s+(?:-\S+\s+)*([^\n|;&]+)",
    r"(?iu)\bapk\s+(?:--\S+\s+)*add\s+([^\n|;&]+)",
    r"(?iu)\byum\s+(?:-\S+\s+)*install\s+(?:-\S+\s+)*([^\n|;&]+)",
    r"(?iu)\bdnf\s+(?:-\S+\s+)*install\s+(?:-\S+\s+)*([^\n|;&]+)",
    r"(?iu)\bpip3?\s+install\s+(?:-\S+\s+)*([^\n|;&]+)",
    r"(?iu)\bnpm\s+install\s+(?:-\S+\s+)*([^\n|;&]+)",
    r"(?iu)\byarn\s+add\s+(?:-\S+\s+)*([^\n|;&]+)",
]
#: A text in capitals that such a call is in holds its word, as for PART_PLACES.
INSTALL_WORDS = ["APT-", "APT", "AP", "YUM", "DNF", "P", "NPM", "YARN"]
# fixed values: commands of the certificate tool and their options
OPENSSL = r"(?iu)\bopenssl\s+(genrsa|genpkey|req|x509|ecparam|ec|dgst|enc|s_client|verify|rsa|pkey|pkcs12|ca)\b"
KEY_SIZE = r"\b(512|1024|2048|3072|4096|8192|16384)\b"
KEY_BITS = r"(?iu)rsa_keygen_bits\s*:\s*(\d+)"
KEY_ALGORITHM = r"(?iu)-algorithm\s+(\S+)"
CURVE = r"(?iu)-(?:name|pkeyopt\s+ec_paramgen_curve)\s*[: ]\s*(\S+)"
DIGEST = r"(?iu)-(md5|sha1|sha224|sha256|sha384|sha512)\b"
DIGESTS = {"md5": "MD5", "sha1": "SHA-1", "sha224": "SHA-224", "sha256": "SHA-256", "sha384": "SHA-384", "sha512": "SHA-512"}
CIPHER = r"(?iu)-((?:aes|des|chacha20)[-\w]*)"
TLS_FLAG = r"(?iu)-(tls1_3|tls1_2|tls1_1|tls1|ssl3|ssl2)\b"
TLS_FLAGS = {"tls1_3": "TLSv1.3", "tls1_2": "TLSv1.2", "tls1_1": "TLSv1.1", "tls1": "TLSv1", "ssl3": "SSLv3", "ssl2": "SSLv2"}
NEW_KEY = r"(?iu)-newkey\s+(rsa|ec|dsa)\s*:\s*(\S+)"
# fixed values: names of algorithms, in order of priority; group 1 is a key size, group 2 a mode
AES_DOCKER = r"(?iu)\bAES(?:[-_](128|192|256))?(?:[-_](GCM|CBC|CTR|CFB|OFB|ECB))?\b"
AES_CONFIG = r"(?iu)\bAES[-_]?(128|192|256)?(?:[-_](GCM|CBC|CTR|CFB|OFB|ECB))?\b"
NAMES = [
    (r"(?iu)\bChaCha20-Poly1305\b", "ChaCha20-Poly1305"),
    (r"(?iu)\bChaCha20\b", "ChaCha20"),
    (r"(?iu)\bRSA[-_]?(1024|2048|3072|4096|8192)\b", "RSA"),
    (r"(?iu)\bRSA\b", "RSA"),
    (r"(?iu)\bECDSA\b", "ECDSA"),
    (r"(?iu)\bECDH\b", "ECDH"),
    (r"(?iu)\bECC\b", "ECC"),
    (r"(?iu)\bEd25519\b", "Ed25519"),
    (r"(?iu)\bEd448\b", "Ed448"),
    (r"\bDSA\b", "DSA"),
    (AES_DOCKER, "AES"),
    (r"(?iu)\bTriple[-_ ]?DES\b", "3DES"),
    (r"(?iu)\b3DES\b", "3DES"),
    (r"\bDES\b", "DES"),
    (r"(?iu)\bSHA[-_]?224\b", "SHA-224"),
    (r"(?iu)\bSHA[-_]?256\b", "SHA-256"),
    (r"(?iu)\bSHA[-_]?384\b", "SHA-384"),
    (r"(?iu)\bSHA[-_]?512\b", "SHA-512"),
    (r"(?iu)\bSHA[-_]?1\b", "SHA-1"),
    (r"(?iu)\bMD5\b", "MD5"),
]
#: A text that holds a name holds its part: the parts, with the places of their patterns in NAMES. They are looked for in the
#: text in capitals, which holds whatever folds to them: their letters are none that other letters only fold down to (I, K).
PART_PLACES = {
    part.upper(): [i for i, (_, name) in enumerate(NAMES) if name in of]
    for part, of in {
        "ChaCha": ["ChaCha20-Poly1305", "ChaCha20"], "RSA": ["RSA"], "ECD": ["ECDSA", "ECDH"], "ECC": ["ECC"], "Ed25519": ["Ed25519"], "Ed448": ["Ed448"], "DSA": ["DSA"],
        "AES": ["AES"], "DES": ["3DES", "DES"], "SHA": ["SHA-224", "SHA-256", "SHA-384", "SHA-512", "SHA-1"], "MD5": ["MD5"],
    }.items()
}
# fixed values: protocols
PROTOCOL = r"(?iu)\b(TLS|SSL)[\s_-]*v?(1\.3|1\.2|1\.1|1\.0|1|2|3)\b"
PROTOCOL_CONFIG = r"(?iu)\b(TLS|SSL)[\s_-]?v?[\s_-]?(1\.3|1\.2|1\.1|1\.0|1|2|3)\b"
SSH = r"(?iu)\bssh-keygen\b|\bauthorized_keys\b|\bid_rsa\b"
SSH_CONFIG = r"(?iu)\bssh-keygen\b|\bauthorized_keys\b|\bAllowUsers\b|\bPermitRootLogin\b"
#: A line of configuration that gives a finding holds one of these.
CONFIG_PARTS = "(?iu)openssl|TLS|SSL|ssh-keygen|authorized_keys|AllowUsers|PermitRootLogin|" + "|".join(PART_PLACES)
# fixed values: files and variables
KEY_FILE = r"(?iu)([\w./\\*:-]+\.(?:crt|cer|pem|der|p12|pfx|key)|[\w./\\*:-]*id_rsa|[\w./\\*:-]*id_dsa|[\w./\\*:-]*id_ecdsa|[\w./\\*:-]*id_ed25519)\b"
KEY_WORDS = r"(key|priv|private|id_rsa|id_dsa|id_ecdsa|id_ed25519|secret)"
CERTIFICATE_WORDS = r"(cert|crt|cer|ca|chain|fullchain)"
VARIABLES = [
    "SSL_CERTIFICATE", "SSL_CERTIFICATE_KEY", "TLS_CERT", "TLS_KEY", "CERT_FILE", "CERTIFICATE_FILE", "KEY_FILE", "PRIVATE_KEY", "SSL_CERT", "SSL_KEY",
    "TLS_VERSION", "SSL_VERSION", "RSA_KEY_SIZE", "PRIVATE_KEY_PATH", "PUBLIC_KEY_PATH", "CA_CERT", "CA_CERTIFICATE",
]
ASSIGNMENT = r"""([A-Za-z_][A-Za-z0-9_]*)\s*=\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\S+)"""
PEM_KEY = r"(?iu)-----BEGIN\s+(?:(?:RSA|EC|DSA|ED25519|ENCRYPTED|OPENSSH)\s+)?PRIVATE KEY-----"
SECRET = r"(?iu)(SECRET|PASSWORD|PASSWD|PASS\b|PWD|TOKEN|API[_-]?KEY|PRIVATE[_-]?KEY|CREDENTIAL)"
REDACTED = "<redacted: embedded private key material>"


def found_in(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def holds_key(text: Column) -> Column:
    return text.contains("-----") & text.rlike(PEM_KEY)


def safe(text: Column) -> Column:
    """Text that holds a private key isn't shown."""
    return F.when(holds_key(text), REDACTED).otherwise(text)


def where(condition: Column, hits: Column) -> Column:
    return F.when(condition, hits).otherwise(no_hits())


def taking(one, name: str, pattern: str):
    return lambda m: one(m, name, pattern)


def names(text: Column, one, aes: str = AES_DOCKER) -> Column:
    """one(match, name) for each algorithm that a text names, by priority and without overlaps. A fold over the patterns
    whose part the text holds keeps what is left of the text: each reads it once, and replaces in it only if it was found."""
    patterns = [aes if name == "AES" else pattern for pattern, name in NAMES]
    numbers = lambda xs: F.array(*map(F.lit, xs))
    held = lambda up: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(up.contains(part), numbers(i)).otherwise(numbers([]).cast("array<int>")) for part, i in PART_PLACES.items()]))))
    tried = let(F.upper(text), held)

    def at(i: Column, of, low: int = 0, high: int = len(NAMES)) -> Column:
        if high - low == 1:
            return of(low)
        middle = (low + high) // 2
        return F.when(i < middle, at(i, of, low, middle)).otherwise(at(i, of, middle, high))

    def step(s: Column, i: Column) -> Column:
        def taken(found: Column) -> Column:
            more = at(i, lambda k: F.transform(found, taking(one, NAMES[k][1], patterns[k])))
            # a word's sign, so the neighbours' word ends stay
            left = at(i, lambda k: F.regexp_replace(s.left, patterns[k], "0"))
            return F.when(F.size(found) > 0, F.struct(left.alias("left"), F.concat(s.hits, more).alias("hits"))).otherwise(s)

        return let(at(i, lambda k: every(s.left, patterns[k])), taken)

    return F.aggregate(tried, F.struct(text.alias("left"), no_hits().alias("hits")), step, lambda s: s.hits)


def is_command(text: Column) -> Column:
    return text.rlike(OPENSSL)


def command_hits(flat: Column, **base) -> Column:
    """What calls of the certificate tool generate, hash, encrypt or connect with."""
    base |= {"library": "OpenSSL", "evidence_type": "openssl_command", "detection_method": "regex/pattern"}
    size = F.coalesce(found_in(flat, KEY_BITS), found_in(flat, KEY_SIZE)).try_cast("int")
    curve, digest, cipher = found_in(flat, CURVE), found_in(flat, DIGEST), found_in(flat, CIPHER)
    kind, parameter = F.lower(found_in(flat, NEW_KEY)), found_in(flat, NEW_KEY, 2)
    ec = lambda c: F.concat(F.lit("EC ("), c, F.lit(")"))
    new_key = F.when(kind == "ec", hit(artifact_type="algorithm", algorithm=ec(parameter), confidence=0.9, **base)).when(
        kind.isNotNull(), hit(artifact_type="algorithm", algorithm=F.upper(kind), key_size=F.when(parameter.rlike(r"^\d+$"), parameter.try_cast("int")), confidence=0.95, **base)
    )
    sure = lambda c: F.when(c.isNotNull(), 0.9).otherwise(0.6)

    def of(sub: Column) -> Column:
        return (
            F.when(sub.isin("genrsa", "genpkey"), F.array(hit(artifact_type="algorithm", algorithm=F.coalesce(F.upper(found_in(flat, KEY_ALGORITHM)), F.lit("RSA")), key_size=size, confidence=0.95, **base)))
            .when(sub.isin("ec", "ecparam"), F.array(hit(artifact_type="algorithm", algorithm=F.coalesce(ec(curve), F.lit("EC")), confidence=0.9, **base)))
            .when(sub == "dgst", F.array(hit(artifact_type="algorithm", algorithm=lookup(DIGESTS, F.lower(digest)), confidence=sure(digest), **base)))
            .when(sub == "enc", F.array(hit(artifact_type="algorithm", algorithm=F.upper(cipher), confidence=sure(cipher), **base)))
            .when(sub == "s_client", F.array(hit(artifact_type="protocol", protocol="TLS", protocol_version=lookup(TLS_FLAGS, F.lower(found_in(flat, TLS_FLAG))), confidence=0.85, **base)))
            .when((sub == "req") & flat.rlike(r"(?iu)-x509\b"), present(F.array(hit(artifact_type="certificate_generation", confidence=0.95, **base), new_key)))
            .otherwise(no_hits())
        )

    return F.flatten(F.transform(every(flat, OPENSSL, 1), lambda sub: of(F.lower(sub))))


def package_hits(flat: Column, **base) -> Column:
    """Known packages that a package manager installs, by manager."""
    found, up = [], F.upper(flat)
    for word, pattern in zip(INSTALL_WORDS, INSTALLS, strict=True):
        tokens = F.filter(F.flatten(F.transform(every(flat, pattern, 1), lambda blob: F.split(strip(blob), r"\s+"))), lambda t: (t != "") & ~t.startswith("-"))
        keys = F.filter(F.transform(tokens, lambda t: F.lower(F.trim(F.substring_index(F.substring_index(t, "=", 1), ":", 1)))), lambda k: k.isin(list(PACKAGES)))
        found.append(where(up.contains(word), F.transform(keys, lambda k: hit(artifact_type="library", library=lookup(PACKAGE_NAMES, k), confidence=lookup(PACKAGE_CONFIDENCE, k), evidence_type="package_install", detection_method="pattern", **base))))
    return F.when(flat.rlike(r"(?iu)install|add"), F.concat(*found)).otherwise(no_hits())


def file_hits(flat: Column, **base) -> Column:
    """Key and certificate files that a statement names, each path once."""

    def of(path: Column) -> Column:
        low = F.lower(path)
        ends = lambda *xs: low.rlike(r"[^/.][^/]*(" + "|".join(re.escape(x) for x in xs) + ")$")
        row = lambda kind, why, sure: hit(artifact_type=kind, evidence_type=why, confidence=sure, detection_method="pattern", **base)
        return (
            F.when(low.rlike(KEY_WORDS) | ends(".key"), row("key_reference", "key_file_reference", 0.8))
            .when(low.rlike(CERTIFICATE_WORDS) | ends(".crt", ".cer", ".p12", ".pfx"), row("certificate_reference", "certificate_file_reference", 0.8))
            .when(ends(".pem", ".der"), row("certificate_reference", "ambiguous_pem_reference", 0.5))
        )

    return F.when(flat.rlike(r"(?iu)\.(?:crt|cer|pem|der|p12|pfx|key)|id_(?:rsa|dsa|ecdsa|ed25519)"), present(F.transform(F.array_distinct(every(flat, KEY_FILE, 1)), of))).otherwise(no_hits())


def variable_hits(flat: Column, rest: Column, **base) -> Column:
    """Variables of ENV and ARG that configure keys, certificates or protocols. Values of other variables with a secret's
    name are not shown."""
    base = {"detection_method": "pattern"} | base
    shown = base.pop("code_snippet")
    first = F.regexp_extract(rest, r"^(\S+)", 1)
    # what is read of a variable several times is computed once
    variable = lambda n, v: F.struct(n.alias("n"), F.upper(n).alias("name"), F.regexp_replace(v, "^[\"']+|[\"']+$", "").alias("value"))
    named = lambda pairs: F.transform(pairs, lambda p: variable(F.regexp_extract(p, ASSIGNMENT, 1), F.regexp_extract(p, ASSIGNMENT, 2)))
    alone = F.array(variable(first, strip(F.substring(rest, F.length(first) + 1, F.length(rest)))))

    def of(p: Column) -> Column:
        name, value = p["name"], p["value"]
        low = F.lower(value)
        hidden = F.when(p.n.rlike(SECRET) & ~holds_key(flat), F.concat(base["docker_instruction"], F.lit(" "), p.n, F.lit("=<redacted>"))).otherwise(shown)
        row = lambda kind, sure, why="env_config", snippet=shown, **more: hit(artifact_type=kind, confidence=sure, evidence_type=why, code_snippet=snippet, **more, **base)
        at = F.when(value.rlike(PROTOCOL), value).otherwise(flat)
        version = F.when(at.rlike(PROTOCOL), F.concat(F.upper(F.regexp_extract(at, PROTOCOL, 1)), F.lit("v"), F.regexp_extract(at, PROTOCOL, 2))).otherwise(F.nullif(value, F.lit("")))
        return (
            F.when(~name.isin(VARIABLES) & low.rlike(r"(key|priv|private|secret)"), row("key_reference", 0.7, "key_file_reference", hidden))
            .when(~name.isin(VARIABLES) & low.rlike(r"(cert|crt|cer|ca)|\.(crt|cer|p12|pfx|pem)$"), row("certificate_reference", 0.7, "certificate_file_reference", hidden))
            .when(~name.isin(VARIABLES), F.lit(None))
            .when(name.isin("TLS_VERSION", "SSL_VERSION"), row("protocol", 0.9, protocol=F.substring(name, 1, 3), protocol_version=version))
            .when(name == "RSA_KEY_SIZE", row("algorithm", 0.85, algorithm="RSA", key_size=F.when(value.rlike(r"^\d+$"), value.try_cast("int"))))
            .when(name.contains("KEY"), row("key_reference", 0.85))
            .otherwise(row("certificate_reference", 0.85))
        )

    some = let(every(rest, ASSIGNMENT), lambda pairs: F.when(F.size(pairs) > 0, named(pairs)).when(rest == "", F.slice(alone, 1, 0)).otherwise(alone))
    found = present(F.transform(some, of))
    key = hit(artifact_type="key_reference", confidence=0.99, evidence_type="embedded_private_key", code_snippet=REDACTED, **base)
    return let(found, lambda f: F.when(holds_key(flat) & ~F.exists(f, lambda h: h.evidence_type == "env_config"), F.concat(f, F.array(key))).otherwise(f))


def statements(text: Column) -> Column:
    """(at, flat) of a Dockerfile's statements: continued lines are joined, white space becomes one space, and comments and
    blank lines between statements are left out. at: the first line."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("held"), F.array().cast("array<struct<at:int,flat:string>>").alias("done"))
    # what the fold reads of a line is computed once
    ends = F.transform(line_array(text), lambda line: F.regexp_replace(line, r"(?U)\s+$", ""))
    parts = F.transform(ends, lambda r, i: F.struct((i + 1).alias("n"), r.endswith("\\").alias("more"), (r == "").alias("blank"), strip(F.when(r.endswith("\\"), F.regexp_replace(r, r"\\$", "")).otherwise(r)).alias("part")))

    def step(s: Column, x: Column) -> Column:
        idle = (s.at == 0) & (x.blank | x.part.startswith("#"))
        at, held = F.when(s.at == 0, x.n).otherwise(s.at), F.concat(s.held, F.lit(" "), x.part)
        done = F.concat(s.done, F.array(F.struct(at.alias("at"), held.alias("flat"))))
        state = lambda at, held, done: F.struct(at.alias("at"), held.alias("held"), done.alias("done"))
        return F.when(idle, s).when(x.more, state(at, held, s.done)).otherwise(state(F.lit(0), F.lit(""), done))

    ended = F.aggregate(parts, start, step, lambda s: F.when(s.at > 0, F.concat(s.done, F.array(F.struct(s.at.alias("at"), s.held.alias("flat"))))).otherwise(s.done))
    return F.transform(ended, lambda s: F.struct(s.at.alias("at"), strip(F.regexp_replace(s.flat, r"(?U)\s+", " ")).alias("flat")))


def docker_hits(text: Column, rank: int | None = None) -> Column:
    """All findings of a Dockerfile, by line and type. Snippets that hold a private key are always redacted."""

    def of(s: Column) -> Column:
        def with_word(word: Column) -> Column:
            return let(F.upper(s.flat), lambda up: let(up.contains("OPENSSL") & is_command(s.flat), lambda command: found(word, up, command)))

        def found(word: Column, up: Column, command: Column) -> Column:
            """up: the statement in capitals. No pattern is tried where words that it needs aren't in it."""
            flat, rest = s.flat, strip(F.regexp_replace(s.flat, r"^[A-Za-z]+\s*", ""))
            base = {"rank": rank, "line_number": s.at, "docker_instruction": word, "code_snippet": safe(flat), "source_type": "dockerfile"}
            variable = word.isin("ENV", "ARG")

            def named(m: Column, name: str, pattern: str) -> Column:
                size = found_in(m, pattern, 1) if "(" in pattern.removeprefix("(?iu)") else F.lit(None)
                mode = F.upper(found_in(m, pattern, 2)) if name == "AES" else None
                label = F.concat(F.lit("AES"), F.coalesce(F.concat(F.lit("-"), size), F.lit("")), F.coalesce(F.concat(F.lit("-"), mode), F.lit(""))) if name == "AES" else F.lit(name)
                return hit(artifact_type="algorithm", algorithm=label, key_size=size.try_cast("int") if name == "RSA" else None, evidence_type="algorithm_reference", detection_method="regex/pattern", confidence=0.75, **base)

            version = lambda m: hit(artifact_type="protocol", protocol=F.upper(F.regexp_extract(m, PROTOCOL, 1)), protocol_version=F.concat(F.upper(F.regexp_extract(m, PROTOCOL, 1)), F.lit("v"), F.regexp_extract(m, PROTOCOL, 2)), evidence_type="protocol_version", detection_method="pattern", confidence=0.9, **base)
            ssh = F.when((up.contains("SSH-") | flat.contains("_")) & flat.rlike(SSH), hit(artifact_type="protocol", protocol="SSH", evidence_type="ssh_evidence", detection_method="pattern", confidence=0.75, **base))
            return F.concat(
                where(word == "RUN", package_hits(flat, **base)),
                where(command & word.isin("RUN", "CMD", "ENTRYPOINT"), command_hits(flat, **base)),
                where(~command, names(flat, named)),
                where(~command & ~variable & (up.contains("TLS") | up.contains("SSL")), F.transform(every(flat, PROTOCOL), version)),
                where(~command & ~variable, present(F.array(ssh))),
                where(word.isin("COPY", "ADD", "RUN") & (flat.contains(".") | flat.contains("_")), file_hits(flat, **base)),
                where(variable, let(rest, lambda after: variable_hits(flat, after, **base))),
            )

        return let(F.upper(F.regexp_extract(s.flat, r"^([A-Za-z]+)", 1)), lambda word: F.when(word.isin(TARGETS), with_word(word)).otherwise(no_hits()))

    # by line and type, else in the order found
    ranked = lambda found: F.transform(F.sort_array(F.transform(found, lambda h, i: F.struct(h.line_number.alias("l"), h.artifact_type.alias("t"), i.alias("i")))), lambda k: F.get(found, k.i))
    return let(F.flatten(F.transform(statements(text), of)), ranked)


def config_hits(text: Column, sure: float = 0.65, rank: int | None = None, method: str = "filesystem_pattern") -> Column:
    """Findings of configuration text, line by line: commands, names, protocols. Lines that are comments count half."""

    def of(line: Column, number: Column) -> Column:
        return let(strip(line), lambda bare: F.when(line.rlike(CONFIG_PARTS), read(line, number, bare)).otherwise(no_hits()))

    def read(line: Column, number: Column, bare: Column) -> Column:
        comment = bare.rlike(r"^(#|//|;)")
        # Python rounds half to even by the exact binary value as well
        up_to = lambda most, more: F.when(comment, round(min(most, sure * 0.5 + more), 2)).otherwise(round(min(most, sure + more), 2))
        base = {"rank": rank, "line_number": number, "code_snippet": F.substring(F.regexp_replace(bare, "-----BEGIN.*", REDACTED), 1, 200), "detection_method": method, "source_type": "container_image"}

        def command(sub: Column) -> Column:
            kind = F.when(F.lower(sub).isin("req", "x509", "verify", "pkcs12", "ca"), "certificate").otherwise("algorithm")
            unrounded = F.when(comment, min(0.95, sure * 0.5 + 0.3)).otherwise(min(0.95, sure + 0.3))
            return hit(artifact_type=kind, confidence=unrounded, evidence=F.concat(F.lit("openssl "), sub), **base)

        def named(m: Column, name: str, pattern: str) -> Column:
            size = found_in(m, pattern, 1) if "(" in pattern.removeprefix("(?iu)") else F.lit(None)
            label = F.lit(name)
            if name == "AES":
                label = F.when(size.isNull(), "AES").otherwise(F.concat(F.lit("AES-"), size, F.coalesce(F.concat(F.lit("-"), F.upper(found_in(m, pattern, 2))), F.lit(""))))
            return hit(artifact_type="algorithm", algorithm=label, key_size=size.try_cast("int") if name == "RSA" else None, confidence=up_to(0.9, 0.0), **base)

        version = lambda m: hit(artifact_type="protocol", protocol=F.concat(F.upper(F.regexp_extract(m, PROTOCOL_CONFIG, 1)), F.lit("v"), F.regexp_extract(m, PROTOCOL_CONFIG, 2)), confidence=up_to(0.9, 0.2), **base)
        ssh = F.when(line.rlike(SSH_CONFIG), hit(artifact_type="protocol", protocol="SSH", confidence=up_to(0.85, 0.1), **base))
        commands = F.transform(F.slice(every(line, OPENSSL, 1), 1, 1), command)
        return F.concat(commands, names(line, named, AES_CONFIG), F.transform(every(line, PROTOCOL_CONFIG), version), present(F.array(ssh)))

    return F.flatten(F.transform(line_array(text), lambda line, i: of(line, i + 1)))


#: What is read of an image's metadata.
METADATA = "array<struct<Config:struct<Entrypoint:array<string>,Cmd:array<string>,Env:array<string>,Labels:map<string,string>>>>"


def metadata_text(inspect: Column) -> Column:
    """An image's metadata (one JSON object or an array) as text, without secret variables."""
    config = F.get(F.from_json(F.when(inspect.rlike(r"^\s*\["), inspect).otherwise(F.concat(F.lit("["), inspect, F.lit("]"))), METADATA), F.lit(0)).Config
    line = lambda words: F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    name = lambda e: F.substring_index(e, "=", 1)
    env = F.filter(config.Env, lambda e: e.contains("=") & ~name(e).rlike(SECRET) & ~e.rlike(PEM_KEY))
    labels = F.transform(F.map_entries(config.Labels), lambda kv: F.concat(kv.key, F.lit("="), F.coalesce(kv.value, F.lit(""))))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(line(config.Entrypoint), line(config.Cmd), F.coalesce(env, none), F.coalesce(labels, none)), "\n")


def metadata_hits(inspect: Column, rank: int | None = None) -> Column:
    return config_hits(metadata_text(inspect), 0.7, rank, "docker_inspect")


def database_hits(text: Column, apk: Column, rank: int | None = None) -> Column:
    """Known packages of a dpkg status file, by blocks, or of an apk database, where a record counts with its blank line."""
    blocks = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n\n")
    whole = F.when(apk, F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))).otherwise(blocks)
    # the last of repeated fields counts
    last = lambda b, dpkg, short: strip(F.try_element_at(F.when(apk, every(b, short, 1)).otherwise(every(b, dpkg, 1)), F.lit(-1)))

    def of(b: Column) -> Column:
        name = last(b, r"(?m)^Package:(.*)$", r"(?m)^P:(.*)$")
        key = F.lower(name)
        evidence = F.concat(F.when(apk, "apk package: ").otherwise("dpkg package: "), name)
        return F.when(key.isin(list(PACKAGES)), hit(rank=rank, artifact_type="library", library=lookup(PACKAGE_NAMES, key), dependency_version=last(b, r"(?m)^Version:(.*)$", r"(?m)^V:(.*)$"), confidence=lookup(PACKAGE_CONFIDENCE, key), evidence=evidence, source_type="container_image", detection_method="package_metadata"))

    return present(F.transform(whole, of))


# fixed values: what a private key's header says
KEY_HEADER = r"(?iu)-----BEGIN\s+((?:RSA|EC|DSA|ED25519|ENCRYPTED|OPENSSH)?\s*PRIVATE KEY)-----"
KEY_TYPES = {"rsa private key": "RSA", "ec private key": "EC", "dsa private key": "DSA", "ed25519 private key": "Ed25519"}


def key_hits(head: Column, path: Column, rank: int | None = None) -> Column:
    """What key an image's key file holds, by the text of its first 4096 bytes; never the key itself."""
    base = {"rank": rank, "line_number": 0, "source_type": "container_image", "detection_method": "filesystem_pattern"}
    private = found_in(head, KEY_HEADER)
    public = F.upper(head).contains("PUBLIC KEY") | strip(head).rlike(r"^(ssh-rsa|ssh-ed25519|ssh-dss|ecdsa-sha2-\S+)\s") | (F.lower(path).endswith(".pub") & private.isNull())
    row = lambda kind, sure, **more: hit(artifact_type=kind, confidence=sure, **more, **base)
    return F.array(
        F.when(public, row("public_key", 0.85))
        .when(private.isNotNull(), row("private_key", 0.9, algorithm=lookup(KEY_TYPES, F.lower(strip(private)))))
        .otherwise(row("key", 0.4, evidence="key-like filename, format not confirmed"))
    )
