"""Histogram sort into shards of near-equal bytes; DataFrame operations only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side. Splitters are found
by counting: the bytes below evenly spaced probe keys are summed over all partitions, the interval
that holds a target is probed again, until the bytes below a splitter are within tolerance of the
target or the interval is a single key. Then rows move once, to the bucket that the splitters name.
Only probe counts (at most ``PROBES`` + one first round of 4096) reach the driver in a round.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, load, text_or_empty, written

PROBES = 1 << 16
#: Bytes of text that one bucket (the unit of the exchange) should hold, and the most buckets of a shard.
BUCKET_BYTES, BUCKETS = 8 << 20, 4096
MIN = -(1 << 63)


class _Splitter:
    """A target of bytes and the interval of keys (128 bits, unsigned) that holds it."""

    def __init__(self, target: float, slack: float):
        self.target, self.slack = target, slack
        self.prefix, self.bits, self.below, self.rows = 0, 0, 0, 0  # the interval: keys that begin with these bits; what lies below it
        self.key: int | None = None


def _digit(hi: Column, lo: Column, start: int, width: int) -> Column:
    """Bits [start, start + width) of the key, from the most significant; a digit never crosses the two halves."""
    half = hi if start < 64 else lo
    return F.shiftrightunsigned(half, 64 - (start % 64) - width).bitwiseAND(F.lit((1 << width) - 1))


def splitters(keys: DataFrame, targets: list[tuple[float, float]]) -> list[_Splitter]:
    """keys(hi, lo, size), hi and lo as unsigned bit patterns. For each (target bytes, slack) the key that has as near that many bytes below it as asked for."""
    todo = [_Splitter(*t) for t in targets]
    done = list(todo)
    bits = 0
    while todo:
        live = sorted({s.prefix for s in todo})
        width = min(12, 64 - bits % 64, max(1, (PROBES // len(live)).bit_length() - 1))
        hi, lo = F.col("hi"), F.col("lo")
        # the live prefixes, at most one a splitter, meet the keys as a small table
        signed = lambda p: p - (1 << 64) if p >= 1 << 63 else p
        if bits <= 64:
            prefix = (F.shiftrightunsigned(hi, 64 - bits) if bits < 64 else hi) if bits else F.lit(0).cast("long"), F.lit(0).cast("long")
            halves = [signed(p) for p in live], [0] * len(live)
        else:
            prefix = hi, F.shiftrightunsigned(lo, 128 - bits) if bits < 128 else lo
            halves = [signed(p >> (bits - 64)) for p in live], [signed(p & ((1 << (bits - 64)) - 1)) for p in live]
        table = keys.sparkSession.range(1).select(F.posexplode(F.arrays_zip(_longs(halves[0]).alias("p_hi"), _longs(halves[1]).alias("p_lo"))).alias("at", "own")).select("at", "own.*").toDF("at", "p_hi", "p_lo")
        inside = keys.withColumn("p_hi", prefix[0]).withColumn("p_lo", prefix[1]).join(F.broadcast(table), ["p_hi", "p_lo"])
        counts: dict[int, list] = {}
        for r in inside.groupBy("at", _digit(hi, lo, bits, width).alias("d")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
            counts.setdefault(live[r["at"]], []).append((r["d"], r["b"], r["n"]))
        for s in todo:
            below, rows = s.below, s.rows
            near = (abs(below - s.target), s.prefix << width, below, rows)
            inner = None
            for d, b, n in sorted(counts.get(s.prefix, [])):
                if below + b > s.target and inner is None:
                    inner = (d, below, rows)
                below, rows = below + b, rows + n
                near = min(near, (abs(below - s.target), (s.prefix << width) + d + 1, below, rows))
            full = bits + width
            if near[0] <= s.slack or full == 128 or inner is None:
                s.key, s.below, s.rows = near[1] << (128 - full), near[2], near[3]
            else:
                s.prefix, s.below, s.rows = (s.prefix << width) + inner[0], inner[1], inner[2]
        bits += width
        todo = [s for s in todo if s.key is None]
    return done


def _signed(k: int) -> tuple[int, int]:
    """The two halves of an unsigned key so that signed comparison orders them."""
    return (k >> 64) + MIN, (k & ((1 << 64) - 1)) + MIN


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> tuple[DataFrame, list[str]]:
    """df with its size, shard and slot; the names of these three columns (other names if df has such columns).

    Size: UTF-8 bytes of the text (null: none) plus 8. Shards differ by ``tolerance`` of a shard's mean, or
    by a row where single rows are larger. Slots run from 0 without gaps in each shard, in key order. Equal
    texts are in one shard unless they straddle a boundary that the tolerance can't move off them. Null ids
    sort first. Rows equal in text and id share a key, so they are not split from each other (their ids are not
    keys then). An empty table gives no rows.
    """
    size, shard, slot, hi, lo, bucket = fresh(df, "size", "shard", "slot", "key_hi", "key_lo", "bucket")
    text = text_or_empty(text_col)
    own = df.withColumn(size, (F.octet_length(text) + F.lit(8)).cast("long")).withColumn(hi, F.xxhash64(text)).withColumn(lo, F.coalesce(F.col(id_col).cast("long"), F.lit(MIN).cast("long")))
    keys = written(own.select(F.col(hi).bitwiseXOR(F.lit(MIN)).alias("hi"), F.col(lo).bitwiseXOR(F.lit(MIN)).alias("lo"), F.col(size).alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = max(1, min(BUCKETS, -(-total // (shards * BUCKET_BYTES))))
    mean, step = total / shards, total / shards / per
    found = splitters(keys, [(step * k, mean * tolerance if k % per == 0 else step * 0.25) for k in range(1, shards * per)])
    ends = sorted((s.key, k) for k, s in enumerate(found, 1))
    order = [found[k - 1] for _, k in ends]  # splitters of little slack can pass one another; the shards' own are exact
    marks = [k for k in range(per, shards * per, per)]
    cuts = {found[k - 1].key for k in marks}
    bounds = [s for i, s in enumerate(order) if i == 0 or s.key != order[i - 1].key]
    top = 1 << max(0, len(bounds)).bit_length()
    bh, bl = _longs([_signed(min(s.key, (1 << 128) - 1))[0] for s in bounds] or [0]), _longs([_signed(min(s.key, (1 << 128) - 1))[1] for s in bounds] or [0])
    beyond = [i for i, s in enumerate(bounds) if s.key >= 1 << 128]
    n = beyond[0] if beyond else len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(top.bit_length()))])

    def step_up(p: Column, w: Column) -> Column:
        h, low = F.get(bh, p + w - 1), F.get(bl, p + w - 1)
        return F.when((p + w <= n) & ((h < F.col(hi)) | ((h == F.col(hi)) & (low <= F.col(lo)))), p + w).otherwise(p)

    own = own.withColumn(bucket, F.aggregate(steps, F.lit(0), step_up) if n else F.lit(0))
    # of each bucket: its shard and the rows of that shard before it
    shard_of, before, start, at = [], [], 0, 0
    marks_left = sorted(found[k - 1].key for k in marks)
    for i in range(n + 1):
        if i:
            k = bounds[i - 1].key
            if k in cuts:
                at, start = sum(m <= k for m in marks_left[: bisect_left(marks_left, k + 1)]), bounds[i - 1].rows
            before.append(bounds[i - 1].rows - start)
        else:
            before.append(0)
        shard_of.append(at)
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(hi, lo))
    out = own.withColumn(slot, rank - 1 + F.get(_longs(before), F.col(bucket))).withColumn(shard, F.get(_longs(shard_of), F.col(bucket)).cast("int"))
    return out.drop(hi, lo, bucket), [size, shard, slot]


def op3_histogram_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes; the texts move with their rows, and size and checksum are those of the texts found there."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out, (_, shard, slot) = shard_rows(docs, 24)
    text = text_or_empty()
    return out.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col(shard).alias("shard"), F.col(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
