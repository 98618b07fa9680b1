"""Lookup tables. All of them are fixed values: results depend on them."""

from __future__ import annotations

PROTOCOL_NAMES = ["TLS-1.0", "TLS-1.1", "TLS-1.2", "TLS-1.3", "SSLv2", "SSLv3", "SSHv1", "SSHv2", "IPsec"]
TYPE_CATEGORY = {"import_signal": "Library", "certificate": "Certificate", "protocol": "Protocol", "cert": "Certificate"}
CERTIFICATE_EXTENSIONS = [".crt", ".pem", ".cer", ".p12", ".pfx", ".der"]
KEY_EXTENSION = ".key"
KEY_ALGORITHMS = ["RSA", "ECC", "DSA", "3DES"]

#: algorithm -> (alternative, rationale, already quantum safe)
RECOMMENDATIONS = {
    "RSA": ("ML-KEM (Kyber) for key exchange, ML-DSA (Dilithium) for signatures", "RSA is broken by Shor's algorithm on a cryptographically-relevant quantum computer.", False),
    "ECC": ("ML-DSA (Dilithium) or FN-DSA (Falcon)", "ECC/ECDSA relies on the elliptic-curve discrete log problem, broken by Shor's algorithm.", False),
    "ECDSA": ("ML-DSA (Dilithium) or FN-DSA (Falcon)", "Same vulnerability as ECC — discrete log problem broken by Shor's algorithm.", False),
    "EC": ("ML-DSA (Dilithium) or FN-DSA (Falcon)", "ECC/ECDSA relies on the elliptic-curve discrete log problem, broken by Shor's algorithm.", False),
    "Ed25519": ("ML-DSA (Dilithium) or FN-DSA (Falcon)", "EdDSA (Ed25519) relies on the elliptic-curve discrete log problem, broken by Shor's algorithm.", False),
    "DSA": ("ML-DSA (Dilithium)", "DSA relies on the discrete log problem, broken by Shor's algorithm.", False),
    "DH": ("ML-KEM (Kyber)", "Diffie-Hellman key exchange is broken by Shor's algorithm.", False),
    "MD5": ("SHA-256 or SHA-3", "MD5 is already broken classically (practical collision attacks exist) — not just a quantum concern.", False),
    "SHA-1": ("SHA-256 or SHA-3", "SHA-1 is already broken classically (practical collision attacks demonstrated).", False),
    "DES": ("AES-256", "DES's 56-bit key is far too small even without quantum computers.", False),
    "3DES": ("AES-256", "3DES is deprecated; its effective 112-bit security is weak and it's being phased out industry-wide.", False),
    "AES": ("AES-256 (if not already)", "AES is only weakened (not broken) by Grover's algorithm; AES-256 remains considered safe.", True),
    "SHA-256": ("No change needed (SHA-384+ optional for extra long-term margin)", "SHA-256 is weakened but not broken by Grover's algorithm; generally still acceptable.", True),
    "ChaCha20": ("No change needed", "Modern symmetric stream cipher with a 256-bit key; same Grover's-only weakening as AES-256.", True),
}
UNKNOWN_RECOMMENDATION = ("Unknown — not in recommendation database", "This algorithm was detected but has no mapped alternative yet. Flag for manual review.", False)
CATEGORY_GUIDANCE = {
    "Certificate": ("Inspect certificate's signature algorithm and key size directly; reissue with a quantum-safe algorithm (ML-DSA/Dilithium) if signed with RSA/ECDSA", "Certificates signed with RSA or ECDSA are only as quantum-safe as their underlying signature algorithm — the certificate itself must be re-issued during PQC migration.", False),
    "Protocol": ("Upgrade to TLS 1.3 with a PQC or hybrid (e.g. X25519+Kyber) key exchange", "Older TLS/SSL versions may negotiate quantum-vulnerable key exchange by default; protocol-level configuration must be updated independently of any single algorithm swap.", False),
}

_SHA_PYTHON = "import hashlib\nhashlib.sha256(data.encode()).hexdigest()"
_SHA_JAVA = 'MessageDigest md = MessageDigest.getInstance("SHA-256");\nbyte[] hash = md.digest(data.getBytes());'
_AES_PYTHON = "from Crypto.Cipher import AES\nfrom Crypto.Random import get_random_bytes\nkey = get_random_bytes(32)  # 256-bit key\ncipher = AES.new(key, AES.MODE_GCM)\nciphertext, tag = cipher.encrypt_and_digest(data)"
_AES_JAVA = 'KeyGenerator kg = KeyGenerator.getInstance("AES");\nkg.init(256);\nSecretKey key = kg.generateKey();\nCipher cipher = Cipher.getInstance("AES/GCM/NoPadding");\ncipher.init(Cipher.ENCRYPT_MODE, key);'
#: (algorithm, language) -> example of the fix
FIXES = {
    ("RSA", "python"): "Use ML-KEM (Kyber) instead of RSA.generate(). Example:\nfrom pqcrypto.kem.ml_kem_512 import generate_keypair\npublic_key, secret_key = generate_keypair()",
    ("RSA", "java"): 'Use a PQC library like liboqs-java for ML-KEM instead of RSA. Example:\nKeyPairGenerator kpg = KeyPairGenerator.getInstance("ML-KEM", "liboqs");\nKeyPair kp = kpg.generateKeyPair();',
    ("MD5", "python"): "Use SHA-256 instead of MD5. Example:\n" + _SHA_PYTHON,
    ("MD5", "java"): "Use SHA-256 instead of MD5. Example:\n" + _SHA_JAVA,
    ("SHA-1", "python"): "Use SHA-256 instead of SHA-1. Example:\n" + _SHA_PYTHON,
    ("SHA-1", "java"): "Use SHA-256 instead of SHA-1. Example:\n" + _SHA_JAVA,
    ("DES", "python"): "Use AES-256 instead of DES. Example:\n" + _AES_PYTHON,
    ("DES", "java"): "Use AES-256 instead of DES. Example:\n" + _AES_JAVA,
    ("3DES", "python"): "Use AES-256 instead of 3DES (Triple DES). Example:\n" + _AES_PYTHON,
    ("3DES", "java"): "Use AES-256 instead of 3DES (Triple DES). Example:\n" + _AES_JAVA,
}

FINDING_TYPE = {"Certificate": "certificate", "Protocol": "tls_config", "Algorithm": "code_call", "Hash Function": "code_call", "Key": "code_call"}
INTERNET_HINTS = ["tls", "gateway", "public", "auth", "login", "api", "payment"]
CRITICAL_HINTS = ["payment", "financial", "kms", "vault"]
HYBRID_TYPES = ["certificate", "tls_config"]
HYBRID_ALGORITHMS = ["RSA", "ECC", "EC", "ECDSA", "Ed25519", "DSA", "DH"]
ASSET_TYPES = {"Algorithm": "algorithm", "Hash Function": "algorithm", "Key": "related-crypto-material", "Certificate": "certificate", "Protocol": "protocol", "Library": "related-crypto-material"}

LAYER = {"certificate": "in_transit", "tls_config": "in_transit", "protocol_handshake": "in_transit", "vpn_config": "in_transit", "code_call": "in_use", "in_memory_key": "in_use", "service_config": "in_use", "container_secret": "at_rest", "disk_encryption": "at_rest", "stored_key": "at_rest", "database_encryption": "at_rest"}
SHOR = ["rsa", "ecc", "ecdsa", "ecdh", "dh", "dsa", "elgamal"]
PQC = ["ml-kem", "kyber", "ml-dsa", "dilithium", "slh-dsa", "sphincs"]
GROVER = ["aes", "chacha20", "sha", "hmac", "camellia", "3des", "des"]
QUANTUM_YEAR, CURRENT_YEAR = 2035, 2026
SENSITIVITY = {"Low": 0.25, "Moderate": 0.5, "High": 0.75, "Critical": 1.0}
MIGRATION_YEARS = {"certificate": 0.5, "tls_config": 1.0, "code_call": 1.5, "container_secret": 0.5, "protocol_handshake": 2.0}
DEFAULT_MIGRATION_YEARS, DEFAULT_LIFETIME_YEARS = 1.0, 5.0
BANDS = [(0.30, "low"), (0.60, "medium"), (0.85, "high")]
KEM_LADDER = {"light": "ML-KEM-512", "standard": "ML-KEM-768", "strong": "ML-KEM-1024"}
SIGNATURE_LADDER = {"light": "ML-DSA-44", "standard": "ML-DSA-65", "strong": "ML-DSA-87"}
#: time, migration, sensitivity, exposure, compliance
WEIGHTS = {"default": (0.30, 0.15, 0.25, 0.20, 0.10), "iot": (0.50, 0.10, 0.20, 0.20, 0.00), "enterprise_default": (0.25, 0.15, 0.30, 0.20, 0.10), "finance": (0.20, 0.10, 0.40, 0.20, 0.10)}
ATTENUATION = {"shor": (1.0, 1.0), "grover": (0.15, 0.30), "pqc": (0.0, 0.0)}

LEGACY_ALGORITHMS = ["DES", "3DES", "RC4", "MD5", "SHA-1", "SHA1", "BLOWFISH"]
AGILE_LIBRARIES = ["OpenSSL", "Windows CNG", "cryptography", "PyCryptodome", "libsodium", "bouncycastle", "Node.js TLS", "Java SSLSocketFactory"]
LEGACY_PROTOCOLS = ["TLS 1.0", "TLS 1.1", "SSL", "SSLV3", "SSLV2"]
MODERN_PROTOCOLS = ["TLS 1.2", "TLS 1.3", "SSH", "TLS"]
#: architecture -> weights of crypto agility, device support, network and protocol
EFFORT_WEIGHTS = {"software-centric": (0.50, 0.20, 0.30), "hardware/IoT-centric": (0.25, 0.55, 0.20), "network/protocol-centric": (0.30, 0.20, 0.50)}
