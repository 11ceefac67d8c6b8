"""Writers: feature tables, sector records, releases, listings, ingest reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import clock
from keelson.operators.curation import deleted_clip_keys, mark_cut
from keelson.plans.joins import checked_join
from keelson.session import cut_lineage

FRAME = ["clip_id", "frame_index"]


def write_features(bins: DataFrame, frames: DataFrame, meta: DataFrame, root: str, targets: DataFrame | None = None) -> None:
    """Feature tables by clip; a missing modality stays null.  Rows are gathered by clip
    and a frame slice, so one long clip is written by many tasks.  Only the clips at hand are
    replaced; those written before stay.  ``meta`` names its clip in ``clip_id``."""
    for name, df in (("bins", bins), ("frames", frames), ("targets", targets)):
        if df is None:
            continue
        part = F.floor(F.col("frame_index") / 5000)
        _by_clip(df.repartition("clip_id", part)).parquet(f"{root}/{name}")
    # a partitioned table needs a column of its own
    _by_clip(meta if len(meta.columns) > 1 else meta.withColumn("version", F.lit(None).cast("string"))).parquet(f"{root}/meta")


def _by_clip(df: DataFrame):
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("clip_id")


def config_hash(text) -> object:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def sector_json(bins: DataFrame, carry: dict[str, str], arrays: dict[str, str], protocol: int = 1) -> DataFrame:
    """One JSON record per frame, arrays in bin order; absent extensions are left out."""
    item = F.struct("bin_index", *[F.col(c).alias(n) for n, c in arrays.items()])
    g = bins.groupBy(*FRAME).agg(F.array_sort(F.collect_list(item)).alias("b"), *[F.first(c).alias(n) for n, c in carry.items()])
    rec = F.struct(F.lit(protocol).alias("protocol"), *carry, *[F.col("b")[n].alias(n) for n in arrays])
    return g.select(*FRAME, F.to_json(rec, {"ignoreNullFields": "true"}).alias("value"))


def write_sectors(records: DataFrame, path: str) -> None:
    """JSON lines in frame order, one folder per clip; other clips' folders stay."""
    rows = records.repartition("clip_id", F.floor(F.col("frame_index") / 5000)).sortWithinPartitions("clip_id", "frame_index")
    _by_clip(rows.select("clip_id", "value")).text(path)


def label_totals(labels: DataFrame) -> DataFrame:
    """Totals and audited counts per scene, with an overall row."""
    return labels.rollup("scene").agg(F.count("*").alias("total"), F.count_if("audited").alias("audited")).withColumn("scene", F.coalesce("scene", F.lit("(all)")))


def release_manifest(clips: DataFrame, labels: DataFrame, configs: DataFrame, **split) -> DataFrame:
    """(section, item, value) rows: clips per split, label totals, configuration hashes."""
    s = clips.withColumn("split", clock.assign_split(F.col("clip_id"), **split)["split"])
    a = s.groupBy("split").count().select(F.lit("split").alias("section"), F.col("split").alias("item"), F.col("count").cast("string").alias("value"))
    lt = label_totals(labels)
    b = lt.select(F.lit("labels").alias("section"), F.col("scene").alias("item"), F.concat_ws("/", F.col("audited").cast("string"), F.col("total").cast("string")).alias("value"))
    c = configs.select(F.lit("config").alias("section"), F.col("name").alias("item"), config_hash(F.col("content")).alias("value"))
    return a.unionByName(b).unionByName(c)


def write_release(manifest: DataFrame, path: str) -> None:
    """Refuses to overwrite an existing release."""
    manifest.write.mode("errorifexists").parquet(path)


FRAME_OBJECT = r"^([^/]+)/(?:frames|thermal|seg)/ts=(\d{2}-\d{2}-\d{2}\.\d)\.(?:jpg|png)$"


def export_listing(objects: DataFrame, cuts: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Objects to ship: frame images whose time lies in a cut of their clip are left out,
    everything else is kept, deleted clips are refused.  ``objects``: key;
    ``cuts``: clip_key, start_ts, end_ts."""
    o = objects.withColumn("clip_key", F.regexp_extract("key", r"^([^/]+)/", 1))
    if sets is not None:
        o = checked_join(o, deleted_clip_keys(sets), ["clip_key"], "left_anti", spread="key")
    t = F.regexp_extract("key", FRAME_OBJECT, 2)
    o = o.withColumn("t_s", F.when(t != "", clock.seconds_of_day(t)))
    c = cuts.select(F.col("clip_key").alias("clip_id"), clock.seconds_of_day(F.col("start_ts")).alias("start_ms"), clock.seconds_of_day(F.col("end_ts")).alias("end_ms"))
    # many objects bear one time: each time of a clip is placed among the cuts once
    times = o.filter("t_s IS NOT NULL").select(F.col("clip_key").alias("clip_id"), "t_s").distinct()
    cut = cut_lineage(mark_cut(times, c, t="t_s", width=600.0).filter("cut").select(F.col("clip_id").alias("clip_key"), "t_s"))
    return checked_join(o, cut, ["clip_key", "t_s"], "left_anti", spread="key").select("key")


def ingest_report(listing: DataFrame, radar_headers: DataFrame) -> DataFrame:
    """Per chunk: streams present and whether it may be ingested.  The fisheye video is
    mandatory and radar must carry its columns; attitude and frame clocks never gate.
    ``listing``: mission, stamp, stream; ``radar_headers``: mission, stamp, header."""
    g = listing.groupBy("mission", "stamp").agg(F.array_join(F.array_sort(F.collect_set("stream")), ",").alias("streams"),
                                                F.bool_or(F.col("stream") == "fisheye").alias("__f"), F.bool_or(F.col("stream") == "mmwave").alias("__r"))
    h = radar_headers.withColumn("__ok", F.forall(F.array(*[F.lit(c) for c in ("Date", "Time", "X", "Y", "Z")]), lambda c: F.array_contains(F.split("header", ","), c)))
    j = g.join(h.select("mission", "stamp", "__ok"), ["mission", "stamp"], "left")
    radar_ok = ~F.col("__r") | F.coalesce("__ok", F.lit(False))
    err = F.when(~F.col("__f"), "fisheye missing").when(~radar_ok, "radar columns missing")
    return j.select("mission", "stamp", "streams", err.isNull().alias("ok"), F.coalesce(err, F.lit("")).alias("error"))


def stream_statistics(radar: DataFrame, frames: DataFrame) -> DataFrame:
    """Per clip: radar rows, heartbeats, points, Doppler and SNR counts, loop rate and
    warnings.  ``frames``: clip_id, t_s."""
    r = radar.groupBy("clip_id").agg(
        F.count("*").alias("radar_rows"), F.count_if(F.col("x").isNull() & F.col("y").isNull() & F.col("z").isNull()).alias("heartbeats"),
        F.count("x").alias("points"), F.count_if(F.col("x").isNotNull() & F.col("v").isNotNull()).alias("doppler"),
        F.count_if(F.col("x").isNotNull() & F.col("snr").isNotNull()).alias("snr_rows"))
    span = F.max("t_s") - F.min("t_s")
    f = frames.groupBy("clip_id").agg(F.count("*").alias("frames"), F.when(span > 0, F.count("*") / span).alias("loop_fps"))
    return r.join(f, "clip_id", "full_outer").withColumns({
        "degraded": F.coalesce(F.col("loop_fps") < 1.5, F.lit(False)), "no_doppler": F.coalesce((F.col("points") > 0) & (F.col("doppler") == 0), F.lit(False))})
