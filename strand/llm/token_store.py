"""Token ids as Parquet lists in ascending document order, with selective reads.

Texts are dealt by ranges of the document id and sorted, encoded per partition, and
written by Spark's own committing writer, one file per range: token ids as a list
column with delta-packed (or dictionary) pages, row groups and pages of set sizes, and
the column and offset indexes that let readers skip pages. Next to the ids lie the
file's number, the ids before the document in its file, the count and the id.

Defined cases: a null or empty text holds the end id alone; a null id sorts first, and
repeated ids sort by text; an empty table writes no ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_checked, scratch_path, ship
from .tokens import text_encoder, tokenizer_text

END = 2
BATCH = 256
#: Documents of a file, about; a count that Parquet's footers answer.
FILE_ROWS = 100_000
ROW_GROUP = 16 << 20
PAGE = 256 << 10
#: Packed ids hardly compress further at higher levels.
ZSTD_LEVEL = 1


def _encode(model: str, end: int):
    last = end.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        encoder, part, before = text_encoder(model), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                piece = batch.slice(at, BATCH)
                ids = encoder.encode_many([t or "" for t in piece.column(1).to_pylist()])
                sizes = np.array([len(x) // 4 + 1 for x in ids], dtype=np.int64)
                ends = np.cumsum(sizes)
                flat = np.frombuffer(b"".join([y for x in ids for y in (x, last)]), dtype=np.int32)
                starts = before + ends - sizes
                before += int(ends[-1]) if len(ends) else 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(ids), part, dtype=np.int64)), pa.array(starts), pa.array(sizes), lists], ["doc_id", "part", "part_start", "n_tokens", "token_ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end: int = END, encoding: str = "delta", row_group: int = ROW_GROUP, page: int = PAGE, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the token files to `out`; encoding: "delta" or "dictionary" for the token ids."""
    ship(docs.sparkSession)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // FILE_ROWS))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in ("part", "part_start", "n_tokens")), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    (
        rows.mapInArrow(_encode(tokenizer_text(tokenizer), end), schema)
        .write.option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", ZSTD_LEVEL)
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.enable.dictionary#token_ids.list.element", str(encoding == "dictionary").lower())
        .option("parquet.enable.dictionary#n_tokens", "true")
        .parquet(out)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, token_ids: only the columns asked for are read."""
    rows = spark.read.parquet(path)
    sums = rows.groupBy(F.col("part").alias("p")).agg(F.sum("n_tokens").alias("n"))
    # one row per file; its running total needs an order over files, never over documents
    firsts = sums.select("p", F.expr("coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("first"))
    joined = rows.join(broadcast_checked(firsts), F.col("part") == F.col("p"))
    return joined.select("doc_id", (F.col("first") + F.col("part_start")).alias("start"), "n_tokens", "token_ids")


def _crc(batches):
    for batch in batches:
        lists = batch.column("token_ids")
        flat, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        raw = memoryview(flat).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    ship(tokens.sparkSession)
    return tokens.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(_crc, T.StructType([*tokens.select("doc_id", "start", "n_tokens").schema.fields, T.StructField("ids_crc32", T.LongType())]))


def byte_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark, sf_dir) -> DataFrame:
    from .common import table

    out = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), byte_file(), out)
    return checksums(read_tokens(spark, out))
