"""Packing token sequences into windows by minimum bin slack.

A document's ids are cut into pieces of the window's size and one remainder. Only the
histogram of piece lengths reaches the driver (at most `window` numbers, whatever the
input). There, for the longest length left, a subset-sum dynamic programme over bitsets
(bit s: a multiset of remaining lengths sums to s) finds the fill closest to the window;
the bitsets are traced back to how many pieces of each length it takes, and the pattern
is used as often as the counts allow. Pieces then look up their place by rank among the
pieces of their length, ranks being counted per written block, so neither a hot length
nor a hot document meets in one task.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each;
an empty table gives no pieces; columns besides the id and the text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, ship
from .tokens import text_encoder, tokenizer_text

WINDOW = 2048
END = 1
#: Texts per Arrow batch that a worker hands back.
BATCH = 256


def best_fill(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """[(length, times)] of the multiset within counts whose sum is closest to room from below.

    lengths descend; each is added in binary parts (1, 2, 4 ... copies), every part's
    bitset of reachable sums is kept, and the walk back takes a part wherever the sum
    wasn't reachable without it.
    """
    mask = (1 << (room + 1)) - 1
    reach, parts = 1, []
    for length, count in zip(lengths, counts, strict=True):
        left, size = min(count, room // length), 1
        while left > 0:
            take = min(size, left)
            parts.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(parts):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def plan_patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(sequences, [(length, pieces in each)])] that uses every piece once."""
    left = {k: v for k, v in sorted(counts.items(), reverse=True) if v > 0}
    plan = []
    while left:
        first = next(iter(left))
        room, rest = window - first, {k: v - (k == first) for k, v in left.items()}
        fit = [k for k, v in rest.items() if v > 0 and k <= room]
        used = dict(best_fill(fit, [rest[k] for k in fit], room)) if fit else {}
        used[first] = used.get(first, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        plan.append((times, sorted(used.items(), reverse=True)))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def plan_table(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces in each sequence, first sequence id, offset in it)."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, used in plan:
        offset = 0
        for length, n in used:
            table.setdefault(length, []).append((ranks.get(length, 0), n, sequence, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in table.items()}


def _cut(model: str, window: int, end: int):
    def run(batches):
        encoder = text_encoder(model, words=True)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out: list[list] = [[], [], [], [], []]
                encoded = encoder.encode_many([t or "" for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    ids += end.to_bytes(4, "little")
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        for column, value in zip(out, (doc, start, length, n, ids[4 * start : 4 * (start + length)]), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], batch.schema.field(0).type), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4], pa.binary())],
                    ["id", "start", "length", "doc_tokens", "ids"],
                )

    return run


def _place(table: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for k in np.unique(length):
                rows, own = table[int(k)], np.flatnonzero(length == k)
                hit = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                within = rank[own] - hit[:, 0]
                sequence[own] = hit[:, 2] + within // hit[:, 1]
                offset[own] = hit[:, 3] + within % hit[:, 1] * k
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [n for n in batch.schema.names if n != "rank"] + ["sequence_id", "offset"])

    return run


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, doc_tokens, ids binary, uid): the pieces, written; uid's upper bits are the block that wrote it."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")), T.StructField("ids", T.BinaryType())])
    pieces = docs.select(doc_id, text).mapInArrow(_cut(tokenizer_text(path), window, end), schema)
    return saved(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def pack(pieces: DataFrame, window: int = WINDOW, payload: Column | None = None) -> DataFrame:
    """pieces with sequence_id and offset; `ids` replaced by `payload`, if given."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    block = F.shiftright("uid", 33)
    blocks = pieces.groupBy("length", block.alias("block")).agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY length ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    blocks = blocks.select(F.col("length").alias("b_length"), F.col("block").alias("b_block"), before.alias("before"))
    rows = pieces.withColumn("block", block).withColumn("ids", F.col("ids") if payload is None else payload)
    rows = rows.withColumn("rank", F.expr("cast(row_number() OVER (PARTITION BY block, length ORDER BY uid) - 1 AS bigint)"))
    rows = rows.join(blocks, (F.col("block") == F.col("b_block")) & (F.col("length") == F.col("b_length")))
    rows = rows.select("id", "start", "length", "doc_tokens", "ids", (F.col("rank") + F.col("before")).alias("rank"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(_place(plan_table(plan_patterns(counts, window))), schema)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, payload: Column | None = None) -> DataFrame:
    return pack(cut_pieces(docs, path, window), window, payload)


def digest(docs: DataFrame, path: str) -> DataFrame:
    packed = pack_documents(docs, path, payload=F.crc32("ids"))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.col("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark, sf_dir) -> DataFrame:
    from .common import table

    return digest(table(spark, sf_dir, "documents"), word_file())
