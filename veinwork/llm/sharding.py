"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (native: DataFrame functions only).

The ring is cut into RING_SLOTS slots; every shard owns VNODES of them by hash, and a row belongs to the first
virtual node at or after its own slot, clockwise. A shard holds floor(N / shards) rows, or one more for the
first N mod shards shards, so counts differ by one at most. Rows of a full shard continue clockwise to the next
shard that has room. Whole tables are never ranked in one place: slots are cut into about sqrt(N / RING_SLOTS)
bins, rows are numbered within a bin, and bins get offsets. All that is broadcast has at most RING_SLOTS plus
twice the shards rows, whatever the input's size.

Cases: null text has size 8 and crc 0; null or repeated ids are rows like any other (equal rows are
interchangeable, however many); an empty table gives no rows; extra columns are ignored by assign() and kept by spread().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

SHARDS = 24
#: A power of two; the slot is the top bits of the ring position.
RING_SLOTS = 4096
VNODES = 64
#: More rows than this at one ring position (equal id and checksum) are numbered by file part, not in one task.
HOT_ROWS = 5000
_BITS = RING_SLOTS.bit_length() - 1


def ring_position(*cols: Column) -> Column:
    """A uniform long in [0, 2^62)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def ring_slot(pos: Column) -> Column:
    return F.shiftright(pos, 62 - _BITS).cast("int")


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """(slot, home, pref): pref lists all shards in the order in which a row of this slot meets them clockwise."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    nodes = nodes.select("shard", ring_slot(ring_position(F.lit("vnode"), F.col("shard"), F.col("v"))).alias("at"))
    # distance from every slot to each shard's next virtual node: shards * vnodes is fixed, so this is small
    first = nodes.groupBy("shard").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    slots = spark.range(RING_SLOTS).select(F.col("id").cast("int").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    far = F.coalesce(F.array_min(F.filter("ats", lambda a: a >= F.col("slot"))) - F.col("slot"), F.array_min("ats") + RING_SLOTS - F.col("slot"))
    met = slots.join(F.broadcast(first), "shard").groupBy("slot").agg(F.sort_array(F.collect_list(F.struct(far.alias("far"), F.col("shard")))).alias("met"))
    return met.select("slot", F.col("met")[0]["shard"].alias("home"), F.transform("met", lambda x: x["shard"]).alias("pref"))


def _segments(slots: DataFrame, shards: int) -> DataFrame:
    """slots: (slot, home, pref, n). Segments (slot, shard, lo, hi, base): the rows lo <= rank < hi of a slot go to
    shard, where they take places from base. Own rows come first, in ring order; then overflow walks clockwise."""
    total, one = Window.partitionBy(), Window.partitionBy("home").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    room = lambda shard, n: F.floor(n / shards) + F.when(shard < n % shards, 1).otherwise(0)
    own = (
        slots.withColumn("all", F.sum("n").over(total))
        .withColumn("before", F.coalesce(F.sum("n").over(one), F.lit(0)))
        .withColumn("own", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), room(F.col("home"), F.col("all")) - F.col("before"))))
    )
    kept = own.where("own > 0").select("slot", F.col("home").alias("shard"), F.lit(0).cast("long").alias("lo"), F.col("own").alias("hi"))
    # one row: the room left in each shard, and the slots with overflow in ring order
    used = own.groupBy("home").agg(F.sum("own").alias("used"))
    left = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: room(s, F.col("all")) - F.coalesce(F.element_at("used", s), F.lit(0).cast("long")))
    state = (
        used.agg(F.map_from_entries(F.collect_list(F.struct("home", "used"))).alias("used"))
        .join(own.agg(F.max("all").alias("all"), F.sort_array(F.collect_list(F.when(F.col("n") > F.col("own"), F.struct("slot", "own", "n", "pref")))).alias("over")), how="inner")
        .select(left.alias("left"), "over")
    )
    seg_type = "array<struct<slot:int,shard:int,lo:bigint,hi:bigint>>"

    def walk(acc: Column, x: Column) -> Column:
        def step(a: Column, shard: Column) -> Column:
            take = F.least(x["n"] - a["lo"], F.get(a["left"], shard))
            seg = F.struct(x["slot"].alias("slot"), shard.alias("shard"), a["lo"].alias("lo"), (a["lo"] + take).alias("hi"))
            return F.struct(
                (a["lo"] + take).alias("lo"),
                F.when(take > 0, F.transform(a["left"], lambda r, i: F.when(i == shard, r - take).otherwise(r))).otherwise(a["left"]).alias("left"),
                F.when(take > 0, F.concat(a["out"], F.array(seg).cast(seg_type))).otherwise(a["out"]).alias("out"),
            )

        start = F.struct(x["own"].alias("lo"), acc["left"].alias("left"), F.array().cast(seg_type).alias("out"))
        return F.aggregate(x["pref"], start, step, lambda a: F.struct(a["left"].alias("left"), F.concat(acc["out"], a["out"]).alias("out")))

    moved = state.select(F.inline(F.aggregate("over", F.struct(F.col("left").alias("left"), F.array().cast(seg_type).alias("out")), walk, lambda a: a["out"])))
    placed = Window.partitionBy("shard").orderBy("lo", "slot").rowsBetween(Window.unboundedPreceding, -1)
    return kept.unionByName(moved).withColumn("base", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(placed), F.lit(0)))


def place(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows: (row, pos), pos the ring position. row, shard and slot (its place there, gapless from 0). rows is read twice."""
    spark = rows.sparkSession
    n = rows.count()
    bins = max(1, round((n / RING_SLOTS) ** 0.5))
    width = max(1, (1 << (62 - _BITS)) // bins)
    at = rows.select("row", "pos", ring_slot(F.col("pos")).alias("at"), F.floor(F.pmod(F.col("pos"), F.lit(1 << (62 - _BITS))) / F.lit(width)).cast("int").alias("bin"))
    counts = at.groupBy("at", "bin").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("at").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("off", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    slots = ring(spark, shards).join(counts.groupBy(F.col("at").alias("slot")).agg(F.sum("n").alias("n")), "slot", "left").fillna(0, ["n"])
    segments = staged(_segments(slots, shards).withColumnRenamed("slot", "seg_slot"), "segments")
    # positions that very many rows share are looked for in crowded bins alone; their rows are numbered by file part
    crowded = staged(counts.where(F.col("n") > HOT_ROWS + 4 * n / RING_SLOTS / bins), "crowded")
    hot = None
    if crowded.limit(1).count():
        hot = staged(at.join(crowded.select("at", "bin"), ["at", "bin"]).groupBy("pos").count().where(F.col("count") > HOT_ROWS).select("pos"), "hot")
    in_bin = Window.partitionBy("at", "bin").orderBy("pos")
    cold = at if hot is None else at.join(hot, "pos", "left_anti")
    ranked = cold.withColumn("rank", F.row_number().over(in_bin) - 1).join(offsets.select("at", "bin", "off"), ["at", "bin"]).select("row", "at", (F.col("rank") + F.col("off")).alias("rank"))
    if hot is not None:
        many = staged(at.join(hot, "pos").select("row", "pos", "at", "bin", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "hot-rows")
        shares = many.groupBy("at", "bin", "pos", "part").agg(F.count(F.lit(1)).alias("m"))
        total = shares.groupBy("at", "bin").agg(F.sum("m").alias("hot"))
        before = Window.partitionBy("at", "bin").orderBy("pos", "part").rowsBetween(Window.unboundedPreceding, -1)
        # behind the bin's other rows
        starts = shares.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).join(offsets, ["at", "bin"]).join(total, ["at", "bin"])
        starts = starts.select("pos", "part", (F.col("off") + F.col("n") - F.col("hot") + F.col("before")).alias("start"))
        one = Window.partitionBy("pos", "part").orderBy("place")
        ranked = ranked.unionByName(many.withColumn("rank", F.row_number().over(one) - 1).join(starts, ["pos", "part"]).select("row", "at", (F.col("rank") + F.col("start")).alias("rank")))
    # at most RING_SLOTS + 2 * shards rows
    found = ranked.join(F.broadcast(segments), (F.col("at") == F.col("seg_slot")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select("row", "shard", (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    slim = staged(slim.select(F.struct("doc_id", "size", "text_crc32").alias("row"), ring_position(F.col("doc_id"), F.col("text_crc32")).alias("pos")), "sharding")
    return place(slim, shards).select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def spread(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """docs with shard and slot added (an own column of that name is replaced). The placement is settled on ids and
    checksums; texts are moved once, to number the rows of a bin."""
    pos = ring_position(F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return place(docs.select(F.struct(*kept).alias("row"), pos.alias("pos")), shards).select("row.*", "shard", "slot")


def op5_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))
