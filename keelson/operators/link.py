"""Link packets: payload decoding and stream audit.

fixed values: packet layout (little endian)
  0 magic "SB", 2 version, 3 sequence u16, 5 flags, 6 clock u32 (0.1 s of day),
  10 bins, 11 first centre i8, 12 step, 13 tick ms u16, 15 latency u16 (0.01 s),
  17 scores u8 (1/200), then ranges u16 (cm, 65535 none), then optional p u8, checksum
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.ordered import SLICE, scan, time_slices
from keelson.plans.quantiles import with_quantiles

HEADER = 17
HAS_P, SCORER_OK, SEG_FRESH, HAS_LATENCY, YOLO_FRESH = 1, 2, 4, 8, 16


def payload_bytes(payload: Column) -> Column:
    """Array of byte values."""
    return F.transform(F.sequence(F.lit(1), F.length(payload)), lambda i: F.conv(F.hex(F.substring(payload, i, F.lit(1))), 16, 10).cast("int"))


def decode(packets: DataFrame) -> DataFrame:
    """Adds ``valid`` and the decoded fields (null when invalid)."""
    # a one-element generator keeps the byte array a real column: filters on decoded fields
    # are then not rewritten into copies of the byte expression
    d = packets.filter(F.length("payload") > 0).select("*", F.explode(F.array(payload_bytes(F.col("payload")))).alias("b"))
    b = lambda i: F.get("b", F.lit(i) if isinstance(i, int) else i)
    u16 = lambda i: b(i) + b(i + 1) * 256
    n = b(10)
    has_p = b(5).bitwiseAND(HAS_P) > 0
    size = F.lit(HEADER + 1) + n * 3 + F.when(has_p, n).otherwise(0)
    total = F.aggregate("b", F.lit(0), lambda s, x: s + x)
    ok = (F.size("b") > HEADER) & (b(0) == 0x53) & (b(1) == 0x42) & (b(2) == 1) & (F.size("b") == size) & (total % 256 == 0)
    d = d.withColumn("valid", F.coalesce(ok, F.lit(False)))
    v = lambda c: F.when(F.col("valid"), c)
    ds = b(6).cast("bigint") + b(7) * 256 + b(8) * 65536 + b(9).cast("bigint") * 16777216
    first = b(11) - F.when(b(11) > 127, 256).otherwise(0)
    flag = lambda m: b(5).bitwiseAND(m) > 0
    lat = u16(15)

    def per_bin(i):
        r = b(F.lit(HEADER) + n + i * 2) + b(F.lit(HEADER + 1) + n + i * 2) * 256
        return F.struct(i.cast("bigint").alias("bin_index"), (first + i * b(12)).cast("double").alias("center_deg"), (b(F.lit(HEADER) + i) / 200.0).alias("score"),
                        F.when(r != 65535, r / 100.0).alias("min_range_m"), F.when(has_p, b(F.lit(HEADER) + n * 3 + i) / 200.0).alias("p"))

    return d.select(
        *packets.columns, "valid", v(u16(3)).cast("bigint").alias("seq"), v(ds).alias("deciseconds"), v(u16(13)).cast("bigint").alias("tick_ms"),
        v(flag(SCORER_OK)).alias("scorer_ok"), v(flag(SEG_FRESH)).alias("seg_fresh"), v(flag(YOLO_FRESH)).alias("yolo_fresh"),
        v(F.when(flag(HAS_LATENCY) & (lat != 65535), lat / 100.0)).alias("latency_s"),
        v(F.transform(F.sequence(F.lit(0), n - 1), per_bin)).alias("bins"))


def decoded_bins(decoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return decoded.filter("valid").select(*keys, F.explode("bins").alias("z")).select(*keys, "z.*")


def sequence_audit(packets: DataFrame, keys: Sequence[str], slice_len: float = 10_000) -> DataFrame:
    """Packets, missing numbers (16-bit wrap) and latency percentiles per link.
    ``packets``: keys, pos, seq, latency_s."""
    d = scan(time_slices(packets, "pos", slice_len), list(keys), ["pos"], lag={"__p": F.col("seq")})
    gap = F.when(F.col("__p").isNotNull(), F.pmod(F.col("seq") - F.col("__p"), F.lit(65536)))
    g = d.groupBy(*keys).agg(
        F.count("*").alias("received"), F.sum(F.coalesce(F.greatest(gap - 1, F.lit(0)), F.lit(0))).cast("bigint").alias("missing"), F.count_if(gap > 1).alias("gaps"),
        F.count_if(gap == 0).alias("repeats"))
    return with_quantiles(g, packets, keys, {"latency_p50": (F.col("latency_s"), 0.5), "latency_p95": (F.col("latency_s"), 0.95)})


def fragment_audit(fragments: DataFrame, keys: Sequence[str], slice_len: float = 10_000) -> DataFrame:
    """Completed packets and dropped partials per link.  A fragment with index 0 opens a
    packet; a wrong tag or index, or a new opening, drops an open one.
    ``fragments``: keys, pos, tag, idx, final."""
    keys = list(keys)
    d = scan(time_slices(fragments, "pos", slice_len), keys, ["pos"], run_sum={"__g": F.when(F.col("idx") == 0, 1).otherwise(0), "__n": F.lit(1)}).filter("__g > 0")
    start = d.filter("idx = 0").select(*keys, "__g", F.col("__n").alias("__n0"), F.col("tag").alias("__tag"))
    j = d.join(start, keys + ["__g"])
    good = (F.col("tag") == F.col("__tag")) & (F.col("idx") == F.col("__n") - F.col("__n0"))
    g = j.groupBy(*keys, "__g").agg(F.min(F.when(~good, F.col("__n"))).alias("bad"), F.min(F.when(good & F.col("final"), F.col("__n"))).alias("fin"))
    last = g.groupBy(*keys).agg(F.max("__g").alias("__last"))
    done = F.col("fin").isNotNull() & (F.col("bad").isNull() | (F.col("fin") < F.col("bad")))
    lost = ~done & (F.col("bad").isNotNull() | (F.col("__g") < F.col("__last")))
    return g.join(last, keys).groupBy(*keys).agg(F.count_if(done).alias("completed"), F.count_if(lost).alias("dropped_partials"))
