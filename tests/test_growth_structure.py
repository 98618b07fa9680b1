"""Structural rows: what the parser remembers of lines changes no row, and an order's rows are read and sent once."""

import itertools
import random

import pytest

from pqledger.operators import structure
from pqledger.plans import generated

LINES = {
    "a.java": ['a = MessageDigest.getInstance("MD5");', "class A {", "}", "wrap(", '  Signature.getInstance("DSA"), 1024);', "/* x", "*/", 's = """', '""";', "import javax.crypto.Cipher;", "import java.security", "  .x;", "@A", "int f(int x)", "return new", 'B(Cipher.getInstance("AES/GCM/X"))', ".digest(d);", '"\\', "", ")", "foo(1);", "{"],
    "a.c": ["MD5(d);", "#include <openssl/evp.h>", "#define X \\", "  RSA_generate_key(2048, 3)", "init(ctx,", "  EVP_sha256());", "/* x", "*/", "unsigned char *MD5(x);", "int", "{", "}", "*", '"a\\', "// DES_set_key(k);", "", ")", "x->MD5(1)", "AES_encrypt"],
    "a.js": ["const c = crypto.createCipheriv(", '  "aes-128-gcm", k);', 'const h = crypto.createHash("md5")', ".update(d)", "import", "(x)", 'import a from "crypto"', "let x = /ab\\", "c/;", "`", "run(() => {", "});", 'crypto.createHmac("sha1", k);', "", "{", "}", '  const crypto = require("crypto");', "// a", "/*", "*/", "=", "function f"],
    "a.py": ["h = hashlib.md5(d)", "from Crypto.Cipher \\", "import AES", "import hashlib", "e = ec.generate_private_key(", "    ec.SECP256R1())", "'" * 3, '"' * 3, "@x", "def", "MD5(x)", "c = [AES.new(k, AES.MODE_GCM)", "]", "", ")", "(", "f'{x}'", "'a\\", "x = RSA.generate(2048); import hashlib"],
}


def plain(path, text):
    """The rows of the whole text, read token by token."""
    language, rows = structure.LANGUAGES["." + path.rpartition(".")[2]], text.splitlines()
    for n in structure.nodes(text, language) if structure.WORTH.search(text) else ():
        line = text.count("\n", 0, n.start) + 1
        for r in structure.rows_of(n, text, language):
            yield r | {"line_number": line, "code_snippet": rows[line - 1].strip() if line <= len(rows) else ""}


@pytest.mark.parametrize("path", list(LINES))
def test_remembered_lines_change_no_row(path):
    some, dice = LINES[path], random.Random(7)
    texts = [*itertools.product(some, repeat=2), *([dice.choice(some) for _ in range(dice.randint(1, 9))] for _ in range(3_000))]
    for lines in texts:
        text = "\n".join(lines) + dice.choice(["", "\n"])
        assert list(structure.structural(path, text)) == list(plain(path, text)), text


def test_known_lines_are_read_once(monkeypatch):
    text = "\n".join(["class A {", *['a = MessageDigest.getInstance("MD5");', "wrap(", '  Signature.getInstance("DSA"), 1024);'] * 50, "}"])
    want = list(structure.structural("a.java", text))
    read = []
    monkeypatch.setitem(structure.ROWS, "Java", lambda n, t: read.append(t) or iter(()))
    assert list(structure.structural("a.java", text)) == want and len(want) == 150 and not read


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(structure, "STRETCHES", 8)
    for i in range(100):
        assert [r["key_size"] for r in structure.structural("a.py", f"k{i} = RSA.generate(2048)\nx = {i}\n")] == [2048]
    assert len(structure._KNOWN["Python"]) <= 8
    long = "x = RSA.generate(" + " " * 1000 + "2048)\n"
    assert len(list(structure.structural("a.py", long * 3))) == 3 and all(len(k) <= structure.WIDTH for _, k in structure._KNOWN["Python"])


def test_kinds_share_one_scan_and_one_shuffle(spark):
    df = generated.tree(spark, "/root/testdata/sf0.001", "java", "c", "js", "py")
    made = df._jdf.queryExecution().executedPlan().toString()
    assert made.count("FileScan") == 1 and made.count("Exchange") == 1
    one = [generated.files(spark, "/root/testdata/sf0.001", k) for k in ("java", "py")]
    both = generated.texts(spark, "/root/testdata/sf0.001", "java", "py")
    assert both.exceptAll(one[0].unionByName(one[1])).isEmpty() and one[0].unionByName(one[1]).exceptAll(both).isEmpty()
