"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of adjacent symbol pairs ordered by score.

A text's white space becomes U+2581, one is put in front, and symbols, at first single characters, are merged: the agenda
gives the pair of the highest score, the leftmost of equal ones, and a merge puts the pairs with both neighbours on it.
Characters that are no piece become the pieces of their UTF-8 bytes. No piece of the vocabulary holds U+2581 behind another
sign (that is verified when it is loaded), so no merge crosses the beginning of a run of spaces: texts are cut there, and each
different segment of an Arrow batch goes through the agenda once.

Segments new to a worker are given to the sentencepiece library too, and of each batch a whole document, there and back;
where they differ the library's answer is returned and counted in n_differ (none is known to).

Null text is the empty text: it has the begin and end ids only. Repeated rows and null ids pass through one by one, an empty
table gives an empty result, texts are taken whole, and columns but id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE, flat, map_arrow, read, steps

SPACE = "▁"
REPLACED = "�"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary with its agenda encoder and its decoder. Vocabularies of other kinds raise ValueError."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback or not plain or kinds & {kind.USER_DEFINED, kind.UNUSED}:
            raise ValueError("only merge-type vocabularies with byte pieces, white space kept and no other normalisation")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())  # puts no white space in front
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        # a merge's rank: the highest score first
        self.rank = {p.piece: -p.score for p in spec.pieces if p.type == kind.NORMAL and len(p.piece) > 1}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.is_byte = set(byte_of)
        self.surface = [
            bytes([byte_of[i]]) if i in byte_of else b"" if p.type == kind.CONTROL else spec.trainer_spec.unk_surface.encode() if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ").encode()
            for i, p in enumerate(spec.pieces)
        ]
        self.lead = {i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL and p.piece.startswith(SPACE)}
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == kind.CONTROL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses white space")
        self.known: list[dict[str, bytes]] = [{}, {}]  # ids of segments, of this and the last generation

    def merged(self, text: str) -> list[str]:
        """The symbols that remain of a text whose white space is U+2581 already."""
        symbols, n = list(text), len(text)
        if n < 2:
            return symbols
        rank, after, before = self.rank, list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, i + 1, p) for i in range(n - 1) if (r := rank.get(p := symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, piece = heappop(agenda)
            # an older entry: one of its symbols has been merged since
            if not symbols[i] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(p := piece + symbols[k])) is not None:
                    heappush(agenda, (r, i, k, p))
            h = before[i]
            if h >= 0 and (r := rank.get(p := symbols[h] + piece)) is not None:
                heappush(agenda, (r, h, i, p))
        return [s for s in symbols if s]

    def segment(self, text: str) -> list[int]:
        """The ids of a segment, its spaces not yet replaced."""
        out: list[int] = []
        for s in self.merged(text.replace(" ", SPACE)):
            i = self.ids.get(s)
            if i is None:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text, with begin and end ids, and how many of its segments the library reads otherwise."""
        texts = texts.cast(pa.large_string()).fill_null("")
        spaced = pc.replace_substring(texts, SPACE, " ")
        spaced = pc.if_else(pc.equal(pc.binary_length(spaced), 0), spaced, pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (" ", spaced, "")]))
        data, offsets = flat(spaced)
        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        cut = np.append(starts, len(data)).astype("<i8")
        segments = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data)))
        coded = segments.dictionary_encode()
        ids, odd = self.looked_up(coded.dictionary.to_pylist())
        table, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        every = table[np.repeat((np.cumsum(size) - size)[at] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.searchsorted(starts, offsets)  # of each text among the segments
        last = np.concatenate([[0], ends])[bounds]
        head, tail = np.array([self.begin], "<u4"), np.array([self.end], "<u4")
        differ = np.concatenate([[0], np.cumsum(odd[at])])[bounds]
        return [np.concatenate([head, every[a:b], tail]) for a, b in zip(last[:-1], last[1:], strict=True)], np.diff(differ)

    def looked_up(self, segments: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The ids of different segments, and which of those that are new the library reads otherwise."""
        if len(self.known[0]) > 2 * CACHE:
            self.known = [{}, self.known[0]]
        known, older = self.known
        out = [known.get(s) or older.get(s) for s in segments]
        new = [k for k, x in enumerate(out) if x is None]
        odd = np.zeros(len(segments), np.int64)
        for k, theirs in zip(new, self.bare.encode([segments[k] for k in new], num_threads=1) if new else [], strict=True):
            own = self.segment(segments[k])
            odd[k] = own != theirs
            out[k] = np.array(theirs if odd[k] else own, "<u4").tobytes()
        for s, x in zip(segments, out, strict=True):
            known[s] = x
        return out, odd

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids say nothing, the white space put in front goes, byte pieces are read as UTF-8."""
        a, b = 0, len(ids)
        while a < b and ids[a] in self.control:
            a += 1
        while a < b and ids[b - 1] in self.control:
            b -= 1
        if not self.control.isdisjoint(ids[a:b]):
            return self.decode_bytewise(ids)
        raw = b"".join(map(self.surface.__getitem__, ids[a:b]))
        if a < b and ids[a] in self.lead:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.decode_bytewise(ids)

    def decode_bytewise(self, ids: list[int]) -> str:
        """decode() where runs of byte pieces aren't UTF-8: each byte that begins no character becomes U+FFFD."""
        out, run, fresh = [], b"", True

        def flush(run: bytes) -> str:
            text = ""
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        text, run = text + run[:n].decode(), run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text, run = text + REPLACED, run[1:]
            return text

        for i in ids:
            if i in self.is_byte:
                run += self.surface[i]
                continue
            out.append(flush(run))
            run, s = b"", self.surface[i].decode()
            fresh = fresh and not any(out)
            if fresh and i in self.lead:
                s, fresh = s[1:], False
            out.append(s)
        return "".join([*out, flush(run)])


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """A worker's vocabulary, loaded once."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encoded(df: DataFrame, model: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids, decoded and n_differ of each row."""
    path = model or default_model()
    names = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.large_string()), ("n_differ", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, decoded, differ in rows(batches, path):
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([keys, lists, pa.array(decoded, pa.large_string()), pa.array(differ, pa.int64())], schema=names)

    return map_arrow(df.select(F.col(id_col).cast("long"), F.col(text)), run, "doc_id long, ids array<int>, decoded string, n_differ long")


def rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[np.ndarray], list[str], np.ndarray]]:
    """(keys, ids, decoded texts, differences) of batches of (key, text), some at a time."""
    p = pieces(path)
    for batch in batches:
        for part in steps(batch, text=1):
            ids, differ = p.encode(part.column(1))
            decoded = [p.decode(x.tolist()) for x in ids]
            whole = part.column(1)[0].as_py() or ""
            theirs = p.library.encode(whole, add_bos=True, add_eos=True)
            if theirs != ids[0].tolist() or p.library.decode(theirs) != decoded[0]:
                every = [x or "" for x in part.column(1).to_pylist()]
                ids = [np.array(x, "<u4") for x in p.library.encode(every, add_bos=True, add_eos=True, num_threads=1)]
                decoded, differ = [p.library.decode(x.tolist()) for x in ids], differ + 1
            yield part.column(0), ids, decoded, differ


def piece_digest(df: DataFrame, model: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_differ of each row: encoded() without what is long."""
    path = model or default_model()
    names = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_differ", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, decoded, differ in rows(batches, path):
            digests = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) for x in ids], pa.int64()), pa.array(digests), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]), pa.array(differ, pa.int64())], schema=names)

    return map_arrow(df.select(F.col(id_col).cast("long"), F.col(text)), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differ long")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_digest(read(spark, sf_dir, "documents"))
