"""Token-ID output: shards of separately compressed documents under one shared zstandard dictionary.

File format of a shard (little-endian):
    magic "PQTOK1\\n\\0" | u32 dictionary id hash length and bytes (sha256) | documents, each one zstandard frame of its
    u16 or u32 ids | index: one record of INDEX dtype for each document, in order | u64 index offset | u64 documents | magic
The dictionary is stored once beside the shards as dictionary-<sha256>.zdict. A reader opens the index at the end and
decompresses only the documents it wants.

Rows go to shards by ranges of doc_id and are in ascending order within and across shards (rows that repeat an id stay
next to each other, ordered by text; null ids come first). Null text is empty text: it has only the end id. Empty tables
give no shards and no rows; further columns are not read. A task that runs again writes files of new names, and only
those named by the manifest count.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE, read, release, sampled_texts, shared_dir

MAGIC = b"PQTOK1\n\0"
INDEX = np.dtype([("key", "<i8"), ("null", "u1"), ("at", "<u8"), ("size", "<u4"), ("start", "<u8"), ("tokens", "<u8")])
END_ID = 2
#: The dictionary learns from at most so many documents, whole ones.
DICT_DOCS, DICT_BYTES = 1000, 64 * 1024


#: Signs that are not plain in a word: blanks and controls, soft hyphens, the capital I with a dot, all from U+0250.
ODD = re.compile("[^\\x21-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u024f]")
#: The same in a text, where ASCII white space is plain; in the syntax of Arrow's patterns.
ODD_TEXT = r"[^\x09-\x0d\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}]"
#: The part of the tokenizer's pattern that takes runs of letters.
LETTERS = r"[\p{L}]+|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Whole texts to ids, the same as Tokenizer.encode(text, add_special_tokens=False).ids, by different pieces.

    Of plain texts, up to U+024F, the tokenizer's NFC changes nothing, lower-casing goes letter by letter and white space only
    separates. So Arrow lower-cases a batch, cuts it into the pieces of the tokenizer's pattern and numbers them; each
    different piece is encoded once and ids are gathered by number. Other texts are cut at spaces, and the library encodes
    the words that aren't plain; texts that hold a special token's string are given to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, spec = Tokenizer.from_file(path), json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        # ids of pieces and of words, met in this and in the last generation
        self.pieces: list[dict[str, bytes]] = [{}, {}]
        self.words: list[dict[str, bytes]] = [{}, {}]
        split = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pattern = split[0]["pattern"].get("Regex", "") if len(split) == 1 and split[0].get("invert") is True else ""
        # the pattern's parts besides runs of letters: set off by spaces, they leave the runs
        self.by_piece = kinds == ["NFC", "Replace", "Lowercase"] and pattern.count(LETTERS) == 1
        self.pattern = regex.compile(pattern) if self.by_piece else None
        self.others = f"({pattern.replace(LETTERS, '')})" if self.by_piece else ""
        # the printable stand-ins of bytes in byte-level models: printable Latin-1 stands for itself, others follow 255
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.stand = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.stand.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def word(self, word: str) -> bytes:
        return self.whole(word) if ODD.search(word) else b"".join(map(self.piece, self.pattern.findall(word.lower())))

    def gathered(self, lists: pa.ListArray, cache: list[dict[str, bytes]], encode) -> list[np.ndarray]:
        """The ids of each list of pieces or words."""
        coded = lists.flatten().dictionary_encode()
        if len(cache[0]) > 2 * CACHE:
            cache[:] = {}, cache[0]
        known, older = cache
        ids = []
        for w in coded.dictionary.to_pylist():
            x = known.get(w)
            if x is None:
                x = known[w] = (older.get(w) or encode(w)) if w else b""
            ids.append(x)
        table, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        flat = table[np.repeat((np.cumsum(size) - size)[at] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        last = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        return np.split(flat, last[:-1])

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow array; null is empty."""
        if not len(texts):
            return []
        texts = texts.fill_null("") if texts.null_count else texts
        out: list[np.ndarray | None] = [None] * len(texts)
        flags = lambda x: x.to_numpy(zero_copy_only=False)
        alone = np.full(len(texts), not self.by_piece)
        for s in self.special if self.by_piece else []:
            alone |= flags(pc.match_substring(texts, s))
        for i in np.flatnonzero(alone).tolist():
            out[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
        odd = flags(pc.match_substring_regex(texts, ODD_TEXT)) if self.by_piece else alone
        plain, rest = np.flatnonzero(~alone & ~odd), np.flatnonzero(~alone & odd)
        if len(plain):
            cut = pc.replace_substring_regex(pc.utf8_lower(texts.take(pa.array(plain))), self.others, r" \1 ")
            for i, x in zip(plain.tolist(), self.gathered(pc.ascii_split_whitespace(cut), self.pieces, self.piece), strict=True):
                out[i] = x
        if len(rest):
            lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rest)), "\n", " "), " ")
            for i, x in zip(rest.tolist(), self.gathered(lists, self.words, self.word), strict=True):
                out[i] = x
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.large_string()))[0]


def packed(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def train_dictionary(df: DataFrame, path: str, text: str, id_col: str, width: int) -> bytes:
    """From a bounded sample; empty where there is too little to learn from."""
    rows = sampled_texts(df.select(F.col(id_col).alias("_i"), F.col(text).alias("_t")).where("_t is not null"), DICT_DOCS).toArrow()
    samples = sorted(packed(ids, width) for ids in Encoder(path).batch(rows["_t"].combine_chunks()))
    del rows
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s for s in samples if len(s) >= 8]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""
    finally:
        del samples
        release()  # the driver goes on without the sample


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


MANIFEST = "file string, shard int, docs long, tokens long, bytes long, dictionary string"


def write_tokens(df: DataFrame, out_uri: str, tokenizer: str | None = None, text: str = "text", id_col: str = "doc_id", end_id: int = END_ID, shards: int | None = None) -> list[dict]:
    """Writes the shards and returns the manifest, one entry for each shard in order, with the ids before it."""
    path = tokenizer or default_tokenizer()
    width = 2 if max(json.load(open(path, encoding="utf-8"))["model"]["vocab"].values(), default=0) < 65536 and end_id < 65536 else 4
    if width == 2 and any(t["id"] >= 65536 for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])):
        width = 4
    dictionary = train_dictionary(df, path, text, id_col, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, root = filesystem(out_uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary-{digest}.zdict") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = encoders(path), compressor(dictionary)
        out_fs, out_root = filesystem(out_uri)
        out = None
        index, at, start = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column(2)[0].as_py()
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.pqtok"
                out = out_fs.open_output_stream(f"{out_root}/{name}")
                head = MAGIC + len(digest).to_bytes(4, "little") + digest.encode() + bytes([width])
                out.write(head)
                at = len(head)
            for key, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                frame = press.compress(packed(ids, width))
                out.write(frame)
                index.append((key or 0, key is None, at, len(frame), start, len(ids)))
                at, start = at + len(frame), start + len(ids)
        if out is not None:
            table = np.array(index, INDEX).tobytes()
            out.write(table + at.to_bytes(8, "little") + len(index).to_bytes(8, "little") + MAGIC)
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "shard": shard, "docs": len(index), "tokens": start, "bytes": at, "dictionary": digest}], pa.schema([("file", pa.string()), ("shard", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("dictionary", pa.string())]))

    rows = df.select(F.col(id_col).cast("long").alias("_k"), F.col(text).alias("_t"))
    ranged = rows.repartitionByRange(shards, "_k", "_t") if shards else rows.repartitionByRange("_k", "_t")
    ordered = ranged.sortWithinPartitions(F.asc_nulls_first("_k"), F.asc_nulls_first("_t")).withColumn("_p", F.spark_partition_id())
    manifest = sorted((r.asDict() for r in ordered.mapInArrow(write, MANIFEST).collect()), key=lambda r: r["shard"])  # one row for each shard
    total = 0
    for m in manifest:
        m["start"] = total
        total += m["tokens"]
    with fs.open_output_stream(f"{root}/manifest-{digest[:16]}.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


_ENCODERS: dict[str, Encoder] = {}


def encoders(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Shard:
    """Random access to a shard's documents through its index."""

    def __init__(self, fs: pafs.FileSystem, root: str, name: str):
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        if tail[16:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{name} is no whole shard")
        at, n = (int.from_bytes(tail[i : i + 8], "little") for i in (0, 8))
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        length = int.from_bytes(self.file.read_at(4, 8), "little")
        self.digest, self.width = self.file.read_at(length, 12).decode(), self.file.read_at(1, 12 + length)[0]
        with fs.open_input_stream(f"{root}/dictionary-{self.digest}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != self.digest:
            raise ValueError(f"{name}: its dictionary has changed")
        self.press = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))

    def ids(self, i: int) -> np.ndarray:
        r = self.index[i]
        return np.frombuffer(self.press.decompress(self.file.read_at(int(r["size"]), int(r["at"]))), "<u2" if self.width == 2 else "<u4").astype("<u4")


def read_tokens(spark, out_uri: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document of the shards; one shard is a task's unit of work."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not manifest:
        return spark.createDataFrame([], schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        fs, root = filesystem(out_uri)
        names = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for m in batch.to_pylist():
                shard, rows = Shard(fs, root, m["file"]), []
                for i, r in enumerate(shard.index):
                    ids = shard.ids(i)
                    if len(ids) != r["tokens"]:
                        raise ValueError(f"{m['file']}: document {i} is damaged")
                    raw = ids.tobytes()
                    rows.append({"doc_id": None if r["null"] else int(r["key"]), "start": m["start"] + int(r["start"]), "n_tokens": len(ids), "ids_crc32": zlib.crc32(raw), "ids": raw})
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist(rows, names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, names)

    small = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long").repartition(len(manifest))
    return small.mapInArrow(load, schema)


def op2_token_binary(spark, sf_dir: str) -> DataFrame:
    return token_digest(read(spark, sf_dir, "documents"))


def token_digest(docs: DataFrame) -> DataFrame:
    """Writes docs to shards in the shared folder, reads these back and returns what the files hold of each document."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(spark, out, write_tokens(docs, out)).drop("ids")
