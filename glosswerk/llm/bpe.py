"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library does the merges.  Its byte alphabet (one printable
character for each byte) is reversed into a table of each id's bytes, which
serves decoding, byte offsets and character offsets.

Null and empty texts encode to no ids; a long text is cut only before a space
between two visible characters, where the pattern always starts a new match, so
its pieces can be encoded one by one.  A text without such a place is encoded in one
piece, in memory that grows with it.  Rows that repeat a doc_id are coded each; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswerk.llm.shared import slices

#: Texts are cut into pieces of about this many characters.
PIECE_CHARS = 1 << 15
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_paths() -> tuple[str, str]:
    """Tokenizer file and rank file of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet to byte: visible Latin-1 bytes stand
    for themselves, the others take the code points from U+0100 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and byte table of one vocabulary, checked against its rank file."""

    def __init__(self, tokenizer_path: str, ranks_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        alphabet = byte_alphabet()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        table = {i: bytes(alphabet[c] for c in token) for token, i in self.tokenizer.get_vocab().items() if token not in special}
        with open(ranks_path, "rb") as f:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
        if table != ranks:
            raise ValueError(f"{tokenizer_path} and {ranks_path} hold different vocabularies")
        self.table = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        self.lengths = np.array([len(b) for b in self.table], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces, owner = [], []
        for k, text in enumerate(texts):
            for piece in cut(text):
                pieces.append(piece)
                owner.append(k)
        out: list[list] = [[] for _ in texts]
        start = size = 0
        for end, piece in enumerate([*pieces, None]):
            if piece is None or size + len(piece) > 4 * PIECE_CHARS:  # few Encoding objects at a time
                for k, e in zip(owner[start:end], self.tokenizer.encode_batch_fast(pieces[start:end], add_special_tokens=False), strict=True):
                    out[k].append(np.array(e.ids, dtype=np.uint32))
                start, size = end, 0
            size += len(piece or "")
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.uint32) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character span of each id; ids that share a split character share its span."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return (char[starts], char[ends - 1] + 1) if len(ids) else (starts, ends)


def cut(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE_CHARS and (m := _CUT.search(text, at + PIECE_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:]


@lru_cache(maxsize=2)
def codec(tokenizer_path: str, ranks_path: str) -> Codec:
    return Codec(tokenizer_path, ranks_path)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *(len(a) for a in arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", paths: tuple[str, str] | None = None, packed: bool = False, spans: bool = False, decoded: str | None = None) -> DataFrame:
    """``docs`` with a column of token ids; it replaces a column of that name.

    ``ids``: array<int>, or with ``packed`` the ids as little-endian unsigned
    32-bit integers in a binary.  With ``spans`` also ``<ids>_starts`` and
    ``<ids>_ends``, the character offsets (end exclusive) of each id.  ``decoded``
    names a binary column for the bytes that the ids decode to, in the same pass.
    """
    names = [ids, *([f"{ids}_starts", f"{ids}_ends"] if spans else []), *([decoded] if decoded else [])]
    docs, paths = docs.drop(*names), paths or default_paths()
    schema = T.StructType([*docs.schema, T.StructField(ids, T.BinaryType() if packed else T.ArrayType(T.IntegerType())), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names[1:] if n != decoded), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*paths)
        for whole in batches:
            for batch in slices(whole, text):
                texts = [x or "" for x in batch.column(text).to_pylist()]
                found = c.encode(texts)
                added = [pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()) if packed else _lists(found, pa.int32())]
                if spans:
                    pairs = [c.offsets(t, x) for t, x in zip(texts, found, strict=True)]
                    added += [_lists([p[k] for p in pairs], pa.int32()) for k in (0, 1)]
                if decoded:
                    added.append(pa.array([c.decode(x) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", paths: tuple[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``encoded`` with the bytes of its ids (array or packed) as binary ``out``.

    Bytes, not text: a character split between two ids is whole again once all
    ids are joined, and a list cut within a character still decodes.  Ids outside
    the vocabulary raise.  ``keep`` names the columns that stay (default: all); a column
    called ``out`` is replaced.
    """
    paths = paths or default_paths()
    keep = [c for c in encoded.columns if c != out and (keep is None or c in keep)]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*paths)
        for batch in batches:
            column = batch.column(ids)
            binary = pa.types.is_binary(column.type)
            found = [c.decode(np.frombuffer(x or b"", dtype="<u4") if binary else np.array(x or [], np.int64)) for x in (column.to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(found, pa.binary())], names=[*keep, out])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Both digests are of what the two operators return; other columns of ``docs``
    are not read.  Repeated rows give repeated results.
    """
    coded = encode(docs.select("doc_id", "text"), packed=True, paths=paths).drop("text")
    both = decode(coded, paths=paths)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
