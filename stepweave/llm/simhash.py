"""SimHash near-duplicates through anchor points of a covering code.

A fingerprint has 64 bits; two link at up to 3 differing bits. The 64 bits hold two blocks of 31
bits. Of two linked fingerprints at least one block differs in at most one bit (two blocks, three
bits). On a block the anchors are the words of the Hamming code of length 31: it is perfect, so
every value lies within covering radius 1 of exactly one anchor. Each fingerprint is replicated to
every anchor within covering radius + threshold = 2 of its block (1 or 16 anchors). The anchor next
to one end of a linked pair is then within 2 of the other end, so both meet there; nothing is lost.

Per anchor the fingerprints are compared by breadth-first search over what is not yet reached, which
yields a spanning forest instead of all pairs. An anchor with more than ``CHUNK`` fingerprints is dealt out once more by
the four parts of the other block; what is still larger is split into chunks that meet in cells of two chunks each, so a
task holds at most 2 * CHUNK of a group.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, each, fresh, written
from .components import components

BITS = 31
DISTANCE = 3
#: Fingerprints of one anchor that are compared in one piece.
CHUNK = 8192
#: Bytes of a text that are split into words at a time.
SLICE = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256


def _bit_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8) + _LANE
    return (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BIT).ravel()


def simhash(raw: bytes | None, shingle: int = 3, slice_bytes: int = SLICE) -> int:
    """Fingerprint of a whole UTF-8 text; no words: 0. Long texts are read in slices with the last words carried over."""
    digest = xxhash.xxh64_intdigest
    counts, total, carry, pos, raw = np.zeros(64, np.int64), 0, [], 0, raw or b""
    while pos < len(raw):
        cut = _SPACE.search(raw, min(len(raw), pos + slice_bytes))
        end = cut.start() if cut else len(raw)
        words = carry + raw[pos:end].translate(LOWER).split()
        pos = end + 1
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[:-shingle] + 1).tolist()]
            counts += _bit_counts([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
            total += len(starts)
            words = words[len(words) - shingle + 1 :]
        carry = words
    if not total:
        return digest(b" ".join(carry), 42) if carry else 0
    return int((counts * 2 > total).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def _fingerprint_batches(batches):
    for b in batches:
        prints = np.fromiter(map(simhash, each(b.column(2))), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) per row; a null text counts as empty."""
    text = F.col(text_col).cast("string")
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.cast("binary").alias("raw"))
    return arrow_map(raw, _fingerprint_batches, "doc_id long, text_hash long, fp long")


def anchors(prints: DataFrame) -> DataFrame:
    """(key, fp): each distinct fingerprint at every anchor within 2 of each of its blocks."""
    parity = [sum(1 << (i - 1) for i in range(1, BITS + 1) if i >> j & 1) for j in range(5)]
    rows = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("block")).withColumn("x", F.expr(f"if(block = 0, fp, shiftrightunsigned(fp, {BITS})) & {(1 << BITS) - 1}L"))
    rows = rows.withColumn("s", F.expr(" + ".join(f"(bit_count(x & {m}L) % 2) * {1 << j}" for j, m in enumerate(parity))))
    near = f"""transform(concat(array(if(s = 0, x, x ^ shiftleft(1L, s - 1))),
        transform(filter(sequence(1, {BITS}), i -> i < (i ^ s)), i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))),
        c -> c + block * {1 << 32}L)"""
    return rows.select("fp", F.explode(F.expr(near)).alias("key"))


def _forest(prints: np.ndarray, distance: int, out: list[np.ndarray]) -> None:
    rest = prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                hit = rest[near]
                out.append(np.stack([np.full_like(hit, x), hit], axis=1))
                queue.extend(hit)
                rest = rest[~near]


def _compare(keys: np.ndarray, prints: np.ndarray, distance: int, small: int = 12) -> np.ndarray:
    """Links among rows of equal key; keys are sorted. Small groups are compared by shifting the whole array."""
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    out: list[np.ndarray] = []
    for k in np.flatnonzero(sizes > small):
        _forest(prints[bounds[k] : bounds[k + 1]], distance, out)
    few = np.repeat((sizes > 1) & (sizes <= small), sizes)
    keys, prints = keys[few], prints[few]
    for shift in range(1, min(small, len(keys))):
        same = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(same):
            break
        a, b = prints[same], prints[same + shift]
        near = np.bitwise_count(a ^ b) <= distance
        out.append(np.stack([a[near], b[near]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _link_batches(distance: int):
    def run(batches):
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(k, f):
            found = np.unique(_compare(k, f, distance).view(np.int64), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            prints = np.concatenate([prints, b.column(1).to_numpy().view(np.uint64)])
            if len(keys):
                last = int(np.searchsorted(keys, keys[-1]))
                if last:
                    yield links(keys[:last], prints[:last])
                    keys, prints = keys[last:], prints[last:]
        if len(keys):
            yield links(keys, prints)

    return run


def links(prints: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints at up to ``distance`` (at most 3) differing bits."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the covering is made for distances up to 3")
    near = written(anchors(prints).select("key", "fp"), "anchors")
    hot = written(near.groupBy("key").count().where(F.col("count") > chunk).select("key"), "hot")
    rows = near
    if not hot.isEmpty():
        # of a hot anchor's links, the other block differs in at most three bits too, so one of its four parts is alike:
        # each print goes to its four parts' groups, and only a group that is still hot is split into cells of two chunks
        other = F.expr(f"if(key >= {1 << 32}L, fp, shiftrightunsigned(fp, {BITS})) & {(1 << BITS) - 1}L")
        parts = near.join(hot, "key").withColumn("x", other).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(3))))
        parts = written(parts.select(F.xxhash64("key", "p", F.expr("shiftrightunsigned(x, 8 * p) & 255L")).alias("key"), "fp"), "parts")
        still = parts.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).alias("g"))
        cells = parts.join(still, "key").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        cells = cells.select(F.xxhash64("key", F.least("c", "k"), F.greatest("c", "k")).alias("key"), "fp")
        rows = near.join(hot, "key", "left_anti").unionByName(parts.join(still, "key", "left_anti").select("key", "fp")).unionByName(cells)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link_batches(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row of docs.

    root: smallest fingerprint of the component; component_id: its smallest doc_id. Null text: like the
    empty text, fingerprint 0. Null doc_id: keeps its row, never becomes a component's id unless it has no other.
    Repeated rows stay repeated. An empty table gives no rows. Extra columns are not looked at.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    comp = components(links(nodes.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = named.join(comp.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root", "left").select("fp", "root", F.when(F.col("least").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(written(named, "named"), "fp")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component of near-duplicates, that of the smallest doc_id (nulls last); columns as given."""
    if not docs.columns:
        return docs
    found = near_duplicates(docs, id_col, text_col, distance)
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    ids, hashes, k = fresh(docs, "keep_id", "keep_hash", "text_hash")
    keep = keep.select(F.coalesce("k.doc_id", F.lit(-(1 << 63)).cast("long")).alias(ids), F.col("k.text_hash").alias(hashes))
    own = docs.withColumn(ids, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn(hashes, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return own.join(keep, [ids, hashes]).dropDuplicates([ids, hashes]).select(*[F.col(f"`{c}`") for c in docs.columns])
