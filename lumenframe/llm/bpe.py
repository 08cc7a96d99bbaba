"""Byte-level BPE on a sentencepiece model that is serialised from the vocabulary.

No tokenizer is trained: the ranks of a public vocabulary become a sentencepiece
BPE model, written field by field in protobuf's wire format. Every byte is mapped
to one character, so each vocabulary entry is a piece of such characters; its score
is its negative rank; the normalizer is the identity without white-space rules.
sentencepiece then merges the adjacent pair of highest score, the left one first,
which is the merge order of a rank file. A text is first split by the pattern into
pre-tokens; merges never cross them. Decoding maps pieces back to bytes.

Defined results: a null or empty text gives no ids and decodes to no bytes. Every
row is worked on by itself (no exchange, nothing hot); repeated rows repeat, extra
columns pass through, computed names replace columns of the same name. An unpaired
surrogate cannot reach this module: Spark's strings are UTF-8.

The path of the vocabulary is a parameter; the file has to be at that path on
every executor, as an installed package is. Its 50,256 entries are read there.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import hex_sha256, table

#: Byte b is the character FIRST_CHAR + b; all of these take two bytes in UTF-8.
FIRST_CHAR = 0x100
#: Pre-tokens that a worker remembers, and rows that it emits at once: memory only, not results.
CACHE_ENTRIES = 600_000
ROWS_OUT = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file, by rank."""
    ranked = []
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranked.append((int(rank), base64.b64decode(token)))
    ranked.sort()
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [t for _, t in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown one, piece r + 1 has rank r."""
    to_char = [chr(FIRST_CHAR + b) for b in range(256)]
    model = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, entry in enumerate(entries):
        piece = "".join(map(to_char.__getitem__, entry)).encode()
        model.append(_field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(40, 0) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(model) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        import sentencepiece

        entries = read_ranks(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(entries))
        back = {FIRST_CHAR + b: b for b in range(256)}
        #: By rank, from the model's own pieces.
        self.bytes = [bytes(back[ord(c)] for c in self.model.id_to_piece(i + 1)) for i in range(len(entries))]
        self.split = regex.compile(pattern).findall
        self.chars = {b: FIRST_CHAR + b for b in range(256)}
        self.known: dict[str, bytes] = {}

    def learn(self, missing: list[str]) -> None:
        mapped = [t.encode().decode("latin-1").translate(self.chars) for t in missing]
        for t, ids in zip(missing, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
            self.known[t] = struct.pack(f"<{len(ids)}i", *[i - 1 for i in ids])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. What several texts lack is
        looked up at once: a call of the model costs far more than a token."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        split = [self.split(t) if t else [] for t in texts]
        known = self.known
        if missing := [t for t in set().union(*split) if t not in known]:
            self.learn(missing)
        return [b"".join(map(known.__getitem__, tokens)) for tokens in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode(df: DataFrame, *, text_col: str = "text", ids_col: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``ids_col``, array<int>: each pre-token of the whole text encoded by itself."""
    path, pat = vocabulary or default_vocabulary(), pattern or default_pattern()
    rest = df.drop(ids_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pat)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(first, ROWS_OUT)
                done = codec.encode(batch.column(at).to_pylist())
                yield _with_list(batch, done, ids_col)

    return rest.mapInArrow(run, schema)


def _with_list(batch: pa.RecordBatch, done: list[bytes], name: str) -> pa.RecordBatch:
    import numpy as np

    ends = np.cumsum([0, *(len(x) // 4 for x in done)]).astype("int32")
    values = pa.array(np.frombuffer(b"".join(done), dtype="<i4"), pa.int32())
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])


def decode(df: DataFrame, *, ids_col: str = "ids", bytes_col: str = "decoded", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``bytes_col``, binary: the bytes of the ids; null ids give no bytes."""
    path, pat = vocabulary or default_vocabulary(), pattern or default_pattern()
    rest = df.drop(bytes_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    at = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pat)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(first, ROWS_OUT)
                done = [codec.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], [*batch.schema.names, bytes_col])

    return rest.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of ``ids`` and ``decoded``."""
    return df.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": hex_sha256(F.array_join(F.col("ids").cast("array<string>"), " ")),
            "decoded_sha256": hex_sha256(F.col("decoded")),
        }
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs).drop("text"))
    return digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
