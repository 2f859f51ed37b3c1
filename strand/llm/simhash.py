"""SimHash near-duplicates found by pigeonring filtering.

Fingerprints of 64 bits are cut into five segments on a ring. If two fingerprints differ
in at most four bits, then from some segment on, the differences summed over 1, 2, ... 5
consecutive segments never exceed 4/5 of the segments so far: 0, 1, 2, 3, 4. So pairs are
looked for only among distinct fingerprints with an equal segment, and the chain of
budgets drops most of them before the full Hamming check. Fingerprints are dealt by
(segment, its value) and sorted, and each task streams through its groups. A large group
is searched outward from one fingerprint after another, what has been reached leaving the
search, so copies that lie close to each other give a number of links linear in their
number; very large groups are first split by the halves of the next segment, of which one
must be equal. Groups of linked fingerprints are found by alternating star contractions
over written tables.

Defined cases: null and empty texts have fingerprint zero, linked like any other; copies
meet as one fingerprint before any search; ids may repeat or be null (ignored in a
group's smallest id unless it has no other); an empty table gives an empty result;
texts are read whole, however long; columns besides the id and the text aren't read by the
search and may have any name that doesn't begin with __strand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, ship

BITS = 64
DISTANCE = 4
SEGMENTS = 5
SHINGLE = 4
SEED = 42
#: Groups up to this size compare all pairs at once, larger ones search outward.
SMALL = 32
#: Groups beyond this size are split by the next segment's halves.
LARGE = 4096
#: Shingles whose bits are summed at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return bytes(BITS // 8)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: -shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    counts, n = np.zeros(BITS, dtype=np.int64), len(starts)
    for at in range(0, n, BLOCK):
        digests = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)])
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, BITS // 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > n).tobytes()


def _prints(text: str, keep: list[str], shingle: int, seed: int, name: str):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            prints = [int.from_bytes(fingerprint(t, shingle, seed), "big", signed=True) for t in batch.column(at(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in keep), pa.array(prints, pa.int64())], [*keep, name])

    return run


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE, seed: int = SEED, name: str = "fp") -> DataFrame:
    """The columns in keep, and `name`: the fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)
    rows = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(name, T.LongType())])
    return rows.mapInArrow(_prints(text, keep, shingle, seed, name), schema)


def segment_masks(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _chains(segments: int, distance: int) -> list[list[tuple[np.uint64, int]]]:
    """For each first segment, (mask of the segments so far, budget) for every chain length."""
    masks = [((1 << w) - 1) << a for a, w in segment_masks(segments)]
    out = []
    for i in range(segments):
        so_far, chain = 0, []
        for k in range(segments):
            so_far |= masks[(i + k) % segments]
            chain.append((np.uint64(so_far), (k + 1) * distance // segments))
        out.append(chain)
    return out


def _near(x: np.ndarray, chain) -> np.ndarray:
    """Indices of the differences that keep every budget of the chain; the last is the full Hamming check."""
    at = np.arange(len(x))
    for mask, budget in chain[1:]:
        ok = np.bitwise_count(x & mask) <= budget
        at, x = at[ok], x[ok]
    return at


def _outward(fps: np.ndarray, chain) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever the chain joins in one group, each fingerprint being reached once."""
    links, rest = [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            own = front.pop()
            hit = _near(rest ^ own, chain)
            if len(hit):
                links.append((np.full(len(hit), own), rest[hit]))
                front.extend(rest[hit])
                rest = np.delete(rest, hit)
    return links


def _large(fps: np.ndarray, chain, next_segment: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    low, width = next_segment
    half = width // 2
    links = []
    for a, w in ((low, half), (low + half, width - half)):
        key = (fps >> np.uint64(a)) & np.uint64((1 << w) - 1)
        order = np.argsort(key, kind="stable")
        for part in np.split(fps[order], np.flatnonzero(np.diff(key[order])) + 1):
            links += _outward(part, chain)
    return links


def group_links(bucket: np.ndarray, fps: np.ndarray, segments: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole groups of equal bucket; bucket: (first segment << 32 | its value), sorted."""
    chains, places = _chains(segments, distance), segment_masks(segments)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    begin, size = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(bucket)])))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    big = size > SMALL
    for b, n in zip(begin[big], size[big], strict=True):
        i, own = int(bucket[b] >> 32), fps[b : b + n]
        links += _outward(own, chains[i]) if n <= LARGE else _large(own, chains[i], places[(i + 1) % segments])
    small = np.repeat(~big, size)
    bucket, fps = bucket[small], fps[small]
    first = bucket >> 32
    for d in range(1, SMALL):
        at = np.flatnonzero(bucket[d:] == bucket[:-d])
        if not len(at):
            break
        for i in range(segments):
            own = at[first[at] == i]
            hit = own[_near(fps[own] ^ fps[own + d], chains[i])]
            links.append((fps[hit], fps[hit + d]))
    if not links:
        return fps[:0], fps[:0]
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def _stream(segments: int, distance: int):
    def run(batches):
        bucket, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        send = lambda a, b: pa.RecordBatch.from_arrays([pa.array(np.maximum(a.view(np.int64), b.view(np.int64))), pa.array(np.minimum(a.view(np.int64), b.view(np.int64)))], ["u", "v"])
        for batch in batches:
            bucket = np.concatenate((bucket, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if whole:
                yield send(*group_links(bucket[:whole], fps[:whole], segments, distance))
                bucket, fps = bucket[whole:], fps[whole:]
        if len(bucket):
            yield send(*group_links(bucket, fps, segments, distance))

    return run


def links(distinct: DataFrame, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """(u, v), u > v: links that connect all fingerprints (column fp, distinct) at most `distance` bits apart."""
    if distance >= segments:
        raise ValueError("one segment must be equal: more segments than differing bits are needed")
    ship(distinct.sparkSession)
    keys = [F.expr(f"{i}L << 32 | (shiftrightunsigned(fp, {a}) & {(1 << w) - 1}L)") for i, (a, w) in enumerate(segment_masks(segments))]
    rows = distinct.select(F.explode(F.array(*keys)).alias("bucket"), "fp")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInArrow(_stream(segments, distance), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u > v): large-star and small-star steps until nothing changes."""
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    edges = saved(edges, "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "stars")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def rooted_prints(prints: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(fp, first, root) of each different fingerprint, and (root, group): the smallest key of each root's rows."""
    distinct = prints.groupBy("fp").agg(F.min(key).alias("first"))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rooted, rooted.groupBy("root").agg(F.min("first").alias("group"))


def near_duplicate_groups(prints: DataFrame, key: str) -> DataFrame:
    """prints (a written table with fp) and `group`: the smallest key that links lead to, itself included."""
    rooted, smallest = rooted_prints(prints, key)
    return prints.join(rooted.join(smallest, "root").select("fp", "group"), "fp")


def near_duplicate_filter(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: the smallest doc_id's, the first written where ids repeat.

    A null id stays only where its group has no other. Whole rows are written beside their
    fingerprints; the search reads only the narrow columns, and no row looks up its group:
    each group names its one row.
    """
    uid, fp = "__strand_uid", "__strand_fp"
    marked = docs.withColumn(uid, F.monotonically_increasing_id())
    rows = saved(fingerprints(marked, marked.columns, name=fp), "printed")
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(uid).alias("uid"))
    _, smallest = rooted_prints(rows.select(key.alias("key"), F.col(fp).alias("fp")), "key")
    return rows.join(smallest.select(F.col("group")["uid"].alias(uid)), uid, "left_semi").select(*docs.columns)


def op4_simhash(spark, sf_dir) -> DataFrame:
    from .common import table

    prints = saved(fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]), "prints")
    grouped = near_duplicate_groups(prints, "doc_id")
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("group").alias("component_id"))
