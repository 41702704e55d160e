"""SentencePiece encoding and decoding that keeps the source alignment.

Normalisation follows the compiled character map: at each place the longest prefix found in its double-array trie is
replaced, else one character is copied; every normalised byte records the source byte that it came from. Each piece is
a range of normalised bytes, so it projects to a range of source bytes.

The segmentation itself is the library's, over whole texts. Where a model's map is the identity, the projection is
vectorised: only blanks change their width (one byte to the three of the word-begin mark).

Defined results: null and empty texts encode to the begin and end ids alone, with empty spans, and decode to the
empty text; repeated rows agree; an empty table gives an empty table; extra columns pass through (an input
column with an output's name is replaced). Texts are worked off whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import set_batches, text_udf
from glosspark.llm.rows import fresh

MARK = "▁"


@dataclass
class CharsMap:
    """A compiled character map: uint32 size, double-array trie, then the zero-ended replacements."""

    units: np.ndarray
    texts: bytes

    @classmethod
    def parse(cls, blob: bytes) -> CharsMap | None:
        if not blob:
            return None
        (size,) = struct.unpack_from("<I", blob)
        return cls(np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :])

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of ``raw[at:]`` in the map, and the prefix's length."""
        units, node, found = self.units, 0, None
        unit = int(units[0])
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != raw[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (int(units[node]) & 0x7FFFFFFF, k + 1 - at)
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


@dataclass
class Rules:
    """What a model's normaliser does."""

    charsmap: CharsMap | None = None
    dummy_prefix: bool = True
    remove_extra: bool = False
    escape: bool = True
    suffix: bool = False


def normalise(text: str, rules: Rules) -> tuple[bytes, np.ndarray]:
    """Normalised UTF-8 bytes, and for each of them (and the end) the offset of its source byte."""
    raw = text.encode()
    space = MARK.encode() if rules.escape else b" "

    def prefix(at: int) -> tuple[bytes, int, bool]:
        if rules.charsmap is not None and (hit := rules.charsmap.longest(raw, at)):
            return *hit, False
        size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return raw[at : at + size], size, True

    at, out, source = 0, bytearray(), []
    if rules.remove_extra:
        while at < len(raw):
            piece, size, _ = prefix(at)
            if piece != b" ":
                break
            at += size
    if at == len(raw):
        return b"", np.array([len(raw)])

    def put(piece: bytes, where: int) -> None:
        out.extend(piece)
        source.extend([where] * len(piece))

    if rules.dummy_prefix and not rules.suffix:
        put(space, at)
    blank = rules.remove_extra
    while at < len(raw):
        piece, size, copied = prefix(at)
        while blank and piece.startswith(b" "):
            piece = piece[1:]
        for k, byte in enumerate(piece):  # a copied byte is its own source, a replacement's source is the whole prefix
            put(space if byte == 32 else bytes([byte]), at + k * copied)
        if piece:
            blank = rules.remove_extra and piece.endswith(b" ")
        at += size
    if rules.remove_extra:
        while out.endswith(space):
            del out[-len(space) :], source[-len(space) :]
    if rules.dummy_prefix and rules.suffix:
        put(space, len(raw))
    return bytes(out), np.array([*source, len(raw)])


@dataclass
class Model:
    path: str
    library: object
    rules: Rules
    widths: np.ndarray  # normalised bytes of each piece
    identity: bool  # normalisation only adds the prefix and marks blanks


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    n, t = proto.normalizer_spec, proto.trainer_spec
    rules = Rules(CharsMap.parse(n.precompiled_charsmap), n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces, t.treat_whitespace_as_suffix)
    normal, user, byte = 1, 4, 6  # piece types of the model format
    identity = rules == Rules() and not any(p.type == user for p in proto.pieces) and t.byte_fallback
    widths = np.array([1 if p.type == byte else len(p.piece.encode()) if p.type in (normal, user) else 0 for p in proto.pieces])
    return Model(path, SentencePieceProcessor(model_file=path), rules, widths, identity)


def piece_ends(model: Model, text: str, ids: np.ndarray) -> np.ndarray:
    """Source byte offset at which each piece ends; a piece starts where the one before ends."""
    if model.identity:
        raw = np.frombuffer(text.encode(), np.uint8)
        normal = np.cumsum(np.where(raw == 32, 3, 1))
        return np.searchsorted(normal, np.cumsum(model.widths[ids]) - len(MARK.encode()), side="right")
    normal, source = normalise(text, model.rules)
    width, end, ends = model.widths, 0, []
    for piece in model.library.encode(text, out_type="immutable_proto").pieces:  # an unknown piece is as wide as its text
        end += int(width[piece.id]) or len(piece.piece.encode())
        ends.append(int(source[min(end, len(normal))]))
    return np.array(ends, np.int64)


def encode_slice(path: str, offsets: np.ndarray, data: np.ndarray) -> dict:
    """All ids (begin and end too), each piece's source span end, and the decoded text, for every row."""
    model = load(path)
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    begin, end = model.library.bos_id(), model.library.eos_id()
    inner = model.library.encode(texts, num_threads=1)
    ids = [[begin, *x, end] for x in inner]
    decoded = model.library.decode(ids, num_threads=1)
    ends = [piece_ends(model, t, np.array(x, np.int64)) for t, x in zip(texts, inner)]
    return {"ids": ids, "ends": ends, "decoded": decoded}


FULL = "ids array<int>, ends array<int>, decoded string"
DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_spans bigint, aligned_bytes bigint"


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``ends`` (source byte offset where each inner piece ends) and ``decoded``."""
    set_batches(docs.sparkSession)
    work = text_udf(lambda o, d: encode_slice(path, o, d), FULL, 1 << 20)
    own = fresh(docs, "_e")
    out = docs.withColumn(own, work(F.col(text)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "ends", "decoded")), f"{own}.*")


def digest_slice(path: str, offsets: np.ndarray, data: np.ndarray) -> dict:
    x = encode_slice(path, offsets, data)
    return {
        "n_tokens": pa.array(list(map(len, x["ids"])), pa.int64()),
        "ids_sha256": [hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in x["ids"]],
        "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in x["decoded"]],
        "n_spans": pa.array([int((np.diff(e, prepend=0) > 0).sum()) for e in x["ends"]], pa.int64()),
        "aligned_bytes": pa.array([int(e[-1]) if len(e) else 0 for e in x["ends"]], pa.int64()),
    }


def encode_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the digests of what ``encode_documents`` gives, taken before anything leaves the worker."""
    set_batches(docs.sparkSession)
    work = text_udf(lambda o, d: digest_slice(path, o, d), DIGEST, 1 << 20)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_spans", "aligned_bytes"]
    own = fresh(docs, "_e")
    out = docs.withColumn(own, work(F.col(text)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names), *(F.col(f"{own}.{c}") for c in names))
