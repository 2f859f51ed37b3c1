"""Byte-level BPE: encoding with character offsets, and decoding, over Arrow batches.

A file of ranks (base64 token, rank) becomes a tokenizers model on the driver: bytes map
to printable characters, and each token's merge is the split of it that the lower ranks
give. The workers get the model as text. Offsets count each id's bytes and map them to
characters, an id that ends inside a character ending at the next one's start. Decoding
reverses the byte table; ids that split a character are joined as bytes first, so
nothing is lost.

Defined cases: null and empty texts have no ids and decode to no bytes; unknown ids
raise; repeated rows stay; columns besides the key and the text aren't read.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship
from .tokens import PieceEncoder, single_threaded

BATCH = 256
_WORKER: dict[tuple, PieceEncoder] = {}


def byte_characters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return out


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _split(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by ranks below the token's own leaves; None if it leaves more."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], own)) < own]
        if not found:
            return None
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def model_json(ranks: dict[bytes, int], pattern: str) -> str:
    chars = byte_characters()
    name = lambda t: "".join(map(chars.__getitem__, t))
    ordered = sorted(ranks, key=ranks.get)
    merges = [[name(x) for x in s] for t in ordered if len(t) > 1 and (s := _split(t, ranks))]
    return json.dumps(
        {
            "version": "1.0",
            "added_tokens": [],
            "pre_tokenizer": {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
                ],
            },
            "model": {"type": "BPE", "vocab": {name(t): ranks[t] for t in ordered}, "merges": merges, "ignore_merges": True},
        }
    )


class ByteBpe:
    """An encoder and decoder made of ranks; build it on the driver once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.ranks = read_ranks(spark, path)
        self.key = (path, pattern)
        self.model = model_json(self.ranks, pattern)
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
        """(key, token_ids), and with offsets (starts, ends): each id's characters in the text."""
        ship(docs.sparkSession)
        fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
        if offsets:
            fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")]
        sizes = np.array([len(t or b"") for t in self.tokens], dtype=np.int64) if offsets else None
        return docs.select(key, text).mapInArrow(_encode(self.key, self.model, sizes), T.StructType([docs.schema[key], *fields]))

    def decode(self, encoded: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, token_ids, decoded binary)."""
        ship(encoded.sparkSession)
        rows = encoded.select(key, "token_ids")
        return rows.mapInArrow(_decode(self.tokens), T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def worker_encoder(key: tuple, model: str) -> PieceEncoder:
    if key not in _WORKER:
        single_threaded()
        from tokenizers import Tokenizer

        _WORKER[key] = PieceEncoder(Tokenizer.from_str(model))
    return _WORKER[key]


def character_offsets(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character that ids of so many bytes touch."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before byte i
    ends = np.cumsum(sizes)
    inside = np.concatenate(((raw & 0xC0) == 0x80, [False]))
    starts = ends - sizes
    return before[starts] - inside[starts], before[ends]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32, copy=False) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _encode(key: tuple, model: str, sizes: np.ndarray | None):
    def run(batches):
        encoder = worker_encoder(key, model)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [np.frombuffer(x, dtype=np.int32) for x in encoder.encode_many(texts)]
                columns, names = [part.column(0), _lists(ids)], [batch.schema.names[0], "token_ids"]
                if sizes is not None:
                    spans = [character_offsets(t, sizes[x]) for t, x in zip(texts, ids, strict=True)]
                    columns += [_lists([s[k] for s in spans]) for k in (0, 1)]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decode(tokens: list[bytes | None]):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                decoded = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def digest(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    ids = F.col("token_ids")
    return bpe.decode(bpe.encode(docs)).select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    from .common import table

    bpe = ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return digest(table(spark, sf_dir, "documents"), bpe)
