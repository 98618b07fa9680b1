"""Structural findings: calls with their whole text, also of enclosing and chained calls, from an island grammar.

One pass over a file's tokens keeps a stack of open brackets and the start of the postfix expression at hand (a name, string
or bracket followed by members, indices and calls). A bracket that closes behind such an expression is a call; its text
reaches from the expression's start to the bracket, so a chain's outer calls hold the inner ones. Strings, comments and
preprocessor lines are single tokens. Everything else is skipped, so broken files give the calls that are whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from .code import CURVES

_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"
_REST = r"[A-Za-z_$][\w$]*|\d[\w.]*|\?\.|->|=>|::|[\n]|[^\s\w]"
GRAMMARS = {
    "Python": rf"#[^\n]*|(?:[rbfuRBFU]{{0,2}})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|{_STRING})|\\\n|{_REST}",
    "Java": rf"{_COMMENT}|\"\"\".*?\"\"\"|{_STRING}|{_REST}",
    "JavaScript": rf"{_COMMENT}|(?<=[=(,:;!&|?\[])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*|{_STRING}|`(?:[^`\\]|\\.)*`?|{_REST}",
    "C/C++": rf"{_COMMENT}|(?m:^[ \t]*\#(?:[^\n\\]|\\.|\\\n)*)|{_STRING}|{_REST}",
}
TOKENS = {k: re.compile(v, re.S) for k, v in GRAMMARS.items()}
LANGUAGES = {
    ".py": "Python", ".java": "Java", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "JavaScript", ".tsx": "JavaScript",
    ".c": "C/C++", ".h": "C/C++", ".cpp": "C/C++", ".hpp": "C/C++", ".cc": "C/C++", ".cxx": "C/C++",
}
# fixed values: words before a bracket that is no call, and words after which a name is declared
KEYWORDS = {
    "Python": "if elif while for in is not and or return yield lambda assert del raise await else except with from import global pass".split(),
    "Java": "if while for switch catch synchronized return try throw assert case do else instanceof yield".split(),
    "JavaScript": "if while for switch catch return throw case do else typeof instanceof in of void delete await yield function async const let var with".split(),
    "C/C++": "if while for switch return case do else sizeof goto catch throw delete".split(),
}
DECLARERS = {"Python": {"def", "class"}, "JavaScript": {"function", "class"}, "Java": {"class", "interface", "enum", "record"}, "C/C++": {"struct", "union", "enum", "class"}}
OPENING, CLOSING = "([{", ")]}"
_KEYWORDS = {k: frozenset(v) for k, v in KEYWORDS.items()}
_END = re.compile("\n")


@dataclass(slots=True)
class Node:
    """A call or a statement: text[start:end]; name_end: where a call's name ends."""

    kind: str
    start: int
    end: int
    name_end: int = 0
    rows: list[dict] | None = None


#: Bounds of what a worker remembers of a language: stretches, the lines and characters of one.
STRETCHES, LINES, WIDTH = 1 << 15, 4, 400
#: A stretch of lines that doesn't end where it could be remembered, but may with the next line.
MORE = object()


def nodes(text: str, language: str, known: dict | None = None) -> list[Node]:
    """Calls, imports and (JavaScript) const and let statements, an outer one before those inside it.

    known: what is remembered of stretches of whole lines, between ends of line at which no expression or statement is open and
    the same brackets are. What such a stretch holds depends on it, the last two tokens and a few flags alone, so its nodes are
    taken from there. Those that give no rows are left out, the others have theirs. Stretches whose tokens depend on what
    follows (a backslash at a line's end, quotes of three, statements that go on by the next line) are read anew."""
    keywords, declarers = _KEYWORDS[language], DECLARERS[language]
    typed = language in ("Java", "C/C++")  # a name after a name is declared
    out: list[Node] = []
    stack: list[tuple[str, int, str, int]] = []  # bracket, start of its expression, kind, place
    open_: list[tuple[str, int, int]] = []  # statements: kind, start, depth
    chain = new = None  # starts of the postfix expression, and of a `new` before it
    link = declared = marked = False  # after a member sign; the name at hand is declared; an annotation
    before, earlier = "", ""  # kinds of the last two tokens: name, a bracket, a sign
    ended = 0  # where the last token that isn't a line's end ends

    def close(depth: int, at: int) -> None:
        while open_ and open_[-1][2] >= depth:
            kind, start, _ = open_.pop()
            out.append(Node(kind, start, at))

    python, base, low = language == "Python", 0, False  # base: open brackets at the stretch's start, low: one of them closed
    start, count, state = (-1 if known is None else 0), len(out), None  # the stretch: its place (-1: none), nodes before it, state
    tokens = TOKENS[language].finditer(text) if known is None else None
    while True:
        if tokens is None:  # at the start of a line, where a stretch can begin
            state = (not stack, link, declared, marked, before, earlier)
            end = start - 1
            while True:
                end = text.find("\n", end + 1)
                stretch = text[start:] if end < 0 else text[start:end]
                found = known.get((state, stretch))
                if found is not MORE or end < 0:
                    break
            if found is not None and found is not MORE:
                link, declared, marked, before, earlier, last, made = found
                for kind, begin, to, rows in made:
                    out.append(Node(kind, start + begin, start + to, 0, rows))
                if last is not None:
                    ended = start + last
                if end < 0:
                    break
                start = end + 1
                continue
            tokens, base, low, count = TOKENS[language].finditer(text, start), len(stack), False, len(out)
        m = next(tokens, None)
        if m is None:
            break
        t, at = m[0], m.start()
        first = t[0]
        if t == "\n":
            depth = len(stack)
            if open_ and open_[-1][2] == depth and not (python and not depth):
                start = -1  # whether the statement ends here depends on the next line
            if python and not depth:
                close(0, ended)
                chain, link, before = None, False, ""
            elif open_ and open_[-1][2] == depth and before not in ("", ",", "=", "+", "-", "*", "/", "?", ":", "&", "|", "=>", ".", "(", "[", "{") and not re.match(r"\s*[.,=+*/?:&|(\[`;]", text[m.end() : m.end() + 200]):
                close(depth, ended)  # no sign of a statement's end, but none that it goes on
            if known is not None:
                clean = chain is None and new is None and not open_
                if start >= 0:
                    stretch = text[start:at]
                    fits = not low and len(stretch) <= WIDTH and stretch.count("\n") < LINES and not odd(stretch)
                    if clean and depth > base and stack[-1][0] == "{":
                        start = -1  # a body begins: its lines are stretches of their own
                    elif fits:
                        if len(known) >= STRETCHES:
                            known.clear()
                        at_end = (link, declared, marked, before, earlier, ended - start if ended > start else None)
                        known[state, stretch] = (*at_end, remembered(out[count:], text, language, start)) if clean and depth == base else MORE
                    else:
                        start = -1
                if clean and (start < 0 or depth == base):
                    start, tokens = m.end(), None
            continue
        if t.startswith(("//", "/*")) and language != "Python" or first == "#" and (language == "Python" or len(t) > 1) or t == "\\\n":
            if first == "#" and language == "C/C++" and re.match(r"\s*#\s*include\b", t):
                out.append(Node("include", at + len(t) - len(t.lstrip()), m.end()))
            continue
        if language == "C/C++" and t.lstrip().startswith("#") and len(t) > 1:
            if re.match(r"\s*#\s*include\b", t):
                out.append(Node("include", at + len(t) - len(t.lstrip()), m.end()))
            continue
        if first in "\"'`" or first in "rbfuRBFU" and t[-1] in "\"'":
            if not link:
                chain, new = at, None
            kind, link = "name", False
        elif first.isalpha() or first in "_$":
            kind = "name"
            if link and chain is not None:
                link = False
            elif t == "new" and language != "Python":
                chain, new, kind = None, at, "new"
            elif t in keywords:
                chain, new, kind = None, None, "keyword" if t not in declarers else "declarer"
                if language == "JavaScript" and t in ("const", "let") and earlier_ok(before):
                    open_.append(("declaration", at, len(stack)))
            elif t == "import" and language != "Python" and earlier_ok(before) and not (language == "JavaScript" and re.match(r"\s*[(.]", text[m.end() : m.end() + 50])):
                open_.append(("import", at, len(stack)))
                chain, kind = None, "keyword"
            else:
                declared = before == "declarer" or typed and new is None and (before == "name" or before in ("*", "&") and earlier == "name")
                chain = at
            if t in declarers:
                chain, kind = None, "declarer"
            if language == "Python" and t in ("import", "from") and before == "" and not open_:
                open_.append(("import", at, len(stack)))
        elif t in (".", "?.", "->", "::"):
            kind, link = ".", chain is not None
        elif first in OPENING:
            begin = chain if new is None else new
            if chain is not None and not link and first != "{":
                what = "index" if first == "[" else "new" if new is not None else "other" if declared or marked else "call"
                if what == "call" and language == "Java" and text[chain:at].strip() in ("super", "this"):
                    what = "other"
                stack.append((first, begin, what, at))
            else:
                stack.append((first, at, "keyword" if before == "keyword" else "block" if first == "{" else "group", at))
            chain, new, link, declared, marked, kind = None, None, False, False, False, first
        elif first in CLOSING:
            close(len(stack), at)
            kind, chain, link, new = first, None, False, None
            if stack:
                _, begin, what, opened = stack.pop()
                low = low or len(stack) < base
                if what == "call":
                    out.append(Node("call", begin, m.end(), opened))
                if what in ("call", "index", "new", "group") and first != "}":
                    chain = begin
        else:
            if first == ";":
                close(len(stack), m.end())
            chain, new, link, kind, marked = None, None, False, "" if first in ";" else t, first == "@"
        earlier, before, ended = before, kind, m.end()
    close(0, ended)
    out.sort(key=lambda n: (n.start, -n.end))
    return out


def odd(stretch: str) -> bool:
    """Whether tokens of these lines may depend on the lines that follow."""
    return stretch.endswith("\\") or '"""' in stretch or "'''" in stretch


def remembered(made: list[Node], text: str, language: str, start: int) -> list[tuple[str, int, int, list[dict]]]:
    """The nodes that give rows, with them, by their place in a stretch."""
    some = [(n, rows_of(n, text, language)) for n in made]
    return [(n.kind, n.start - start, n.end - start, rows) for n, rows in some if rows]


def rows_of(n: Node, text: str, language: str) -> list[dict]:
    """A node's rows, but for their place."""
    signal = {"algorithm": "UNSPECIFIED", "artifact_type": "import_signal", "confidence": 0.3} if n.kind != "call" else {"confidence": 0.95}
    return [signal | r | {"detection_method": "tree_sitter", "language": language} for r in ROWS[language](n, text[n.start : n.end])]


def earlier_ok(before: str) -> bool:
    """Whether a statement can begin after such a token."""
    return before in ("", "{", "}", ")", "name", "(")


# fixed values: calls by their whole name
CALLS = {
    "RSA.generate": ("RSA", "algorithm", "Crypto.PublicKey"),
    "rsa.generate_private_key": ("RSA", "algorithm", "cryptography"),
    "ec.generate_private_key": ("ECC", "algorithm", "cryptography"),
    "DSA.generate": ("DSA", "algorithm", "Crypto.PublicKey"),
    "AES.new": ("AES", "algorithm", "Crypto.Cipher"),
    "DES.new": ("DES", "algorithm", "Crypto.Cipher"),
    "DES3.new": ("3DES", "algorithm", "Crypto.Cipher"),
    "ChaCha20.new": ("ChaCha20", "algorithm", "Crypto.Cipher"),
    "hashlib.md5": ("MD5", "hash", "hashlib"),
    "hashlib.sha1": ("SHA-1", "hash", "hashlib"),
    "hashlib.sha256": ("SHA-256", "hash", "hashlib"),
    "hashlib.sha384": ("SHA-384", "hash", "hashlib"),
    "hashlib.sha512": ("SHA-512", "hash", "hashlib"),
    "hashes.SHA256": ("SHA-256", "hash", "cryptography"),
    "hashes.SHA1": ("SHA-1", "hash", "cryptography"),
    "hashes.MD5": ("MD5", "hash", "cryptography"),
    "hashes.SHA384": ("SHA-384", "hash", "cryptography"),
    "hashes.SHA512": ("SHA-512", "hash", "cryptography"),
    "RSA_generate_key": ("RSA", "algorithm", "openssl/rsa.h"),
    "RSA_generate_key_ex": ("RSA", "algorithm", "openssl/rsa.h"),
    "AES_encrypt": ("AES", "algorithm", "openssl/aes.h"),
    "AES_set_encrypt_key": ("AES", "algorithm", "openssl/aes.h"),
    "DES_ecb_encrypt": ("DES", "algorithm", "openssl/des.h"),
    "DES_set_key": ("DES", "algorithm", "openssl/des.h"),
    "MD5": ("MD5", "hash", "openssl/md5.h"),
    "EVP_md5": ("MD5", "hash", "openssl/evp.h"),
    "EVP_sha1": ("SHA-1", "hash", "openssl/evp.h"),
    "EVP_sha256": ("SHA-256", "hash", "openssl/evp.h"),
    "EVP_sha384": ("SHA-384", "hash", "openssl/evp.h"),
    "EVP_sha512": ("SHA-512", "hash", "openssl/evp.h"),
}
# fixed values: Java
FACTORIES = ["MessageDigest", "Cipher", "KeyPairGenerator", "Signature", "KeyGenerator"]
JAVA_NAMES = {
    "MD5": ("MD5", "hash"),
    "SHA-1": ("SHA-1", "hash"),
    "SHA1": ("SHA-1", "hash"),
    "SHA-256": ("SHA-256", "hash"),
    "SHA256": ("SHA-256", "hash"),
    "SHA-384": ("SHA-384", "hash"),
    "SHA-512": ("SHA-512", "hash"),
    "RSA": ("RSA", "algorithm"),
    "DES": ("DES", "algorithm"),
    "DESede": ("3DES", "algorithm"),
    "AES": ("AES", "algorithm"),
    "EC": ("ECC", "algorithm"),
    "ECDSA": ("ECDSA", "algorithm"),
    "ECDH": ("ECDH", "algorithm"),
    "DSA": ("DSA", "algorithm"),
}
JAVA_MODES = ["GCM", "CBC", "ECB", "CTR", "CFB", "OFB"]
# fixed values: modules of Python, in order of trial, and digests of JavaScript
MODULES = ["Crypto.PublicKey", "Crypto.Cipher", "Crypto.Hash", "cryptography", "hashlib"]
DIGESTS = {"md5": "MD5", "sha1": "SHA-1", "sha224": "SHA-224", "sha256": "SHA-256", "sha384": "SHA-384", "sha512": "SHA-512"}
NAMED_SIZE = re.compile(r"\b(key_size|bits|modulusLength)\s*[:=]\s*(\d+)")
BARE_SIZE = re.compile(r"\b(512|1024|2048|3072|4096|8192)\b")
C_SIZE = re.compile(r"\b(512|1024|2048|3072|4096|128|192|256)\b")
MODE = re.compile(r"\b(MODE_)?(GCM|CBC|EAX|ECB|CTR|CFB|OFB)\b", re.I)


def size_in(text: str) -> int | None:
    if m := NAMED_SIZE.search(text):
        return int(m[2])
    m = BARE_SIZE.search(text)
    return int(m[1]) if m else None


def python_rows(n: Node, text: str) -> Iterator[dict]:
    if n.kind == "import":
        lib = next((x for x in MODULES if x in text), None)
        if lib:
            yield {"library": lib}
    elif name := CALLS.get(text[: n.name_end - n.start].strip()):
        curve = next((v for k, v in CURVES.items() if k in text), None) if text.startswith("ec.generate_private_key") else None
        mode = MODE.search(text) if name[1] == "algorithm" else None
        yield {"algorithm": name[0], "artifact_type": name[1], "library": name[2], "key_size": size_in(text), "curve": curve, "mode": mode and mode[2].upper()}


def java_rows(n: Node, text: str) -> Iterator[dict]:
    if n.kind == "import":
        if "javax.crypto" in text or "java.security" in text:
            yield {"library": text.replace("import", "").replace(";", "").strip()}
        return
    for factory in FACTORIES:
        m = re.search(r"getInstance\s*\(\s*[\"']([^\"']+)[\"']", text) if f"{factory}.getInstance(" in text else None
        if m:
            parts = m[1].split("/")
            known = JAVA_NAMES.get(m[1]) or JAVA_NAMES.get(parts[0])
            if known:
                mode = parts[1].upper() if len(parts) > 1 and parts[1].upper() in JAVA_MODES else None
                yield {"algorithm": known[0], "artifact_type": known[1], "library": f"java.security.{factory}", "key_size": size_in(text), "mode": mode}


def javascript_rows(n: Node, text: str) -> Iterator[dict]:
    if n.kind != "call":
        if any(x in text for x in ("require(\"crypto\")", "require('crypto')", "from \"crypto\"", "from 'crypto'")):
            yield {"library": "Node.js crypto"}
        return
    one = lambda names: re.search(rf"{names}\s*\(\s*[\"']([^\"']+)[\"']", text, re.I)
    if "crypto.createHash" in text or "crypto.createHmac" in text:
        m = one("create(?:Hash|Hmac)")
        alg = m and DIGESTS.get(m[1].lower().replace("-", "").replace("_", ""))
        if alg:
            yield {"algorithm": alg, "artifact_type": "hash", "library": "Node.js crypto"}
    elif "crypto.createCipheriv" in text or "crypto.createDecipheriv" in text:
        if m := one("create(?:Cipheriv|Decipheriv)"):
            name = m[1].upper()
            alg = "AES" if "AES" in name else "DES" if "DES" in name else "3DES" if "TRIPLE" in name else "UNSPECIFIED"
            mode, size = re.search(r"GCM|CBC|CTR|ECB|OFB|CFB", name), re.search(r"128|192|256", name)
            yield {"algorithm": alg, "artifact_type": "algorithm", "library": "Node.js crypto", "mode": mode and mode[0], "key_size": int(size[0]) if size else None}
    elif "crypto.generateKeyPair" in text and (m := one("generateKeyPair(?:Sync)?")):
        size = re.search(r"modulusLength\s*:\s*(\d+)", text)
        yield {"algorithm": m[1].upper(), "artifact_type": "algorithm", "library": "Node.js crypto", "key_size": int(size[1]) if size else None}


def c_rows(n: Node, text: str) -> Iterator[dict]:
    if n.kind == "include":
        if "openssl/" in text:
            header = re.search(r"openssl/\w+\.h", text)
            yield {"library": header[0] if header else "openssl"}
    elif n.kind == "call" and (name := CALLS.get(text[: n.name_end - n.start].strip())):
        size = C_SIZE.search(text)
        yield {"algorithm": name[0], "artifact_type": name[1], "library": name[2], "key_size": int(size[1]) if size else None}


ROWS = {"Python": python_rows, "Java": java_rows, "JavaScript": javascript_rows, "C/C++": c_rows}
#: What this process remembers of each language.
_KNOWN: dict[str, dict] = {k: {} for k in GRAMMARS}
#: Texts that hold none of these give no rows.
WORTH = re.compile("|".join(sorted({re.escape(re.split(r"[.(]", c)[0]) for c in CALLS} | {"getInstance", "crypto", "openssl/", "hashlib", "Crypto", "java.security"})))


def structural(path: str, text: str) -> Iterator[dict]:
    """The structural rows of a source file, in order of place, outer calls first."""
    language = LANGUAGES.get("." + path.lower().rpartition(".")[2])
    if language is None or not WORTH.search(text):
        return
    some = nodes(text, language, _KNOWN[language])
    ends, rows = [m.start() for m in _END.finditer(text)], text.splitlines()
    for n in some:
        line = bisect_right(ends, n.start - 1) + 1
        shown = None
        for r in rows_of(n, text, language) if n.rows is None else n.rows:
            if shown is None:
                shown = rows[line - 1].strip() if line <= len(rows) else ""
            yield {**r, "line_number": line, "code_snippet": shown}
