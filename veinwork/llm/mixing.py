"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words; a document's expected copies are target / source size (times its
weight against the source's mean weight, if weights are given), at most MAX_COPIES. The whole copies are certain.
For the remaining fraction p a fixed number of documents is drawn: they rank by (u / (1 - u)) / (p / (1 - p)),
u uniform by hash of the id, and the lowest n win. The draw is stratified by size, in bands an eighth of an
octave wide or less, so that a fixed number of documents is a nearly fixed number of words: from the largest band
down, n is the nearest whole number for the band's expected words plus what the bands before it missed.

A stratum's n-th smallest rank is found from counts of about sqrt(N) bins and the rows of one bin, so no group
is ranked in one task. Equal ranks (equal or null ids) are broken by a hash of the whole row, found alike; rows that
are equal in all columns are counted and not told apart. All sums are of whole numbers (fractions count in 2^-20), so reruns agree.

Cases: null text has no words; a document without words is never taken; null source is a source of its own, last
in order; null ids share one random number, and so do repeated ids, but no stratum takes more rows than it draws; an empty table gives no rows; extra columns
are ignored by plan() and kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, small, staged, word_count

MAX_COPIES = 3
SEED = "mix-1"
UNIT = 1 << 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_COPIES) -> DataFrame:
    """sizes: (source, source_size). Adds sid (order by code point, null last) and target: the total shared by weight,
    none above cap times its source's size. The level at which shares stop comes from one pass over sources in the
    order of cap * size / weight, which is the end of resharing the excess again and again."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("full_at", "sid")
    s = sizes.withColumn("sid", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1).cast("double"))
    s = s.withColumn("full_at", (F.lit(cap) * F.col("source_size")) / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    full = F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - full) / open_weight)
    s = s.withColumn("level", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "sid", "level"))).over(Window.partitionBy())["level"])
    target = F.least(F.col("weight") * F.col("level"), (F.lit(cap) * F.col("source_size")).cast("double"))
    return s.select("source", "source_size", "sid", F.coalesce(target, F.lit(0.0)).alias("target"))


def uniform(id_col: Column, seed: str = SEED) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def size_band(size: Column) -> Column:
    """Eight bands to an octave, by whole numbers alone."""
    return F.call_function("shiftright", size * 8, (F.length(F.bin(size)) - 1).cast("int")).cast("int") + F.length(F.bin(size)) * 8


def _expect(rows: DataFrame) -> DataFrame:
    """Adds whole (certain copies), p (the rest in UNITs), band, rank to rows with size, source_size, target, weight, mean_weight."""
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("weight") / F.col("mean_weight")).otherwise(0.0)
    copies = F.least(F.greatest(F.coalesce(copies, F.lit(0.0)), F.lit(0.0)), F.lit(float(MAX_COPIES)))
    rows = rows.withColumn("whole", F.floor(copies)).withColumn("p", F.least(F.floor((copies - F.floor(copies)) * UNIT), F.lit(UNIT - 1)))
    odds = (F.col("p") / F.lit(float(UNIT))) / (1.0 - F.col("p") / F.lit(float(UNIT)))
    u = F.col("u")
    return rows.withColumn("band", size_band(F.col("size"))).withColumn("rank", F.when(F.col("p") > 0, (u / (1.0 - u)) / odds))


def draw_sizes(strata: DataFrame) -> DataFrame:
    """strata: (sid, band, n, p_sum, p_words). Adds take, the number of documents to draw, from the largest band down."""
    one = F.struct("band", "n", (F.col("p_sum") / F.lit(float(UNIT))).cast("double").alias("p_sum"), (F.col("p_words").cast("double") / F.lit(float(UNIT))).alias("p_words"))
    lists = strata.groupBy("sid").agg(F.sort_array(F.collect_list(one), asc=False).alias("bands"))  # some 8 * log2(longest text)
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<band:int,take:bigint>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        mean = b["p_words"] / b["p_sum"]
        want = acc["carry"] + b["p_words"]
        take = F.least(F.greatest(F.floor(want / mean + 0.5), F.lit(0)), b["n"]).cast("bigint")
        return F.struct((want - take * mean).alias("carry"), F.concat(acc["out"], F.array(F.struct(b["band"].alias("band"), take.alias("take")))).alias("out"))

    takes = lists.select("sid", F.inline(F.aggregate("bands", start, step, lambda a: a["out"])))
    return strata.join(takes, ["sid", "band"])


def _cuts(rows: DataFrame) -> DataFrame:
    """(sid, band, cut): the largest rank that is drawn in the stratum."""
    part = rows.where("p > 0 and size > 0")
    strata = part.groupBy("sid", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p_sum"), F.sum((F.col("p") * F.col("size")).cast("decimal(38,0)")).alias("p_words"))
    strata = staged(draw_sizes(strata).withColumn("odds", F.col("p_sum") / (F.col("n") * UNIT - F.col("p_sum"))), "mix-strata")
    # rank times the stratum's mean odds is about odds of a uniform number, so these bins hold about sqrt(n) rows
    spread = F.col("rank") * F.col("odds")
    binned = part.join(strata.select("sid", "band", "n", "take", "odds").where("take > 0").transform(small), ["sid", "band"])
    binned = binned.withColumn("bin", F.floor(spread / (1.0 + spread) * F.ceil(F.sqrt("n"))).cast("int"))
    ahead = Window.partitionBy("sid", "band").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # settled before the window, or the counting itself would be dealt by stratum
    bins = staged(binned.groupBy("sid", "band", "bin").agg(F.count(F.lit(1)).alias("c"), F.first("take").alias("take")), "mix-bins")
    bins = bins.withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    edge = bins.where("before < take and take <= before + c").select("sid", "band", "bin", (F.col("take") - F.col("before")).alias("nth"))
    edge = small(staged(edge, "mix-edge"))  # a row per stratum at most
    cuts = staged(_nth(binned.join(edge, ["sid", "band", "bin"]), "rank").select("sid", "band", F.col("at").alias("cut"), "left", "ties"), "mix-ranks")
    # the rows at the cut, where not all are drawn, again by bins, of their hashes
    tied = part.join(small(cuts.where("left < ties")), ["sid", "band"]).where("rank = cut")
    tied = tied.withColumn("bin", F.floor((F.col("tie") / float(1 << 64) + 0.5) * F.ceil(F.sqrt("ties"))).cast("int"))
    bins = staged(tied.groupBy("sid", "band", "bin").agg(F.count(F.lit(1)).alias("c"), F.first("left").alias("left")), "mix-ties")
    bins = bins.withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    edge = bins.where("before < left and left <= before + c").select("sid", "band", "bin", (F.col("left") - F.col("before")).alias("nth"))
    ends = _nth(tied.select("sid", "band", "bin", "tie").join(edge, ["sid", "band", "bin"]), "tie")
    ends = ends.select("sid", "band", F.col("at").alias("cut_tie"), F.col("left").alias("equal_left"), F.col("ties").alias("equal_rows"))
    return staged(cuts.select("sid", "band", "cut").join(ends, ["sid", "band"], "left"), "mix-cuts")


def _nth(rows: DataFrame, value: str) -> DataFrame:
    """rows: (sid, band, bin, nth, value). at: each bin's nth smallest value; ties: the rows that have it; left: how many of them are among the first nth."""
    counts = rows.groupBy("sid", "band", "bin", value).agg(F.count(F.lit(1)).alias("ties"), F.first("nth").alias("nth"))
    ahead = Window.partitionBy("sid", "band", "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("ties").over(ahead), F.lit(0)))
    return counts.where("before < nth and nth <= before + ties").select("sid", "band", F.col(value).alias("at"), (F.col("nth") - F.col("before")).alias("left"), "ties")


def row_hash(columns: list[tuple[str, str]], column=lambda c: F.col(f"`{c}`")) -> Column:
    """A hash of all columns, given as (name, type); which are null counts, too."""
    parts = [F.to_json(F.struct(column(c))) if "map<" in kind else column(c) for c, kind in columns]
    return F.xxhash64(*parts, F.concat(*(column(c).isNull().cast("string") for c, _ in columns)))


def _measure(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), weight.alias("weight"), row_hash(docs.dtypes).alias("tie"))


def _sources(slim: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    fixed = F.sum((F.col("weight") * UNIT).cast("decimal(20,0)") * F.col("size")).cast("double") / F.lit(float(UNIT))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), fixed.alias("__ws"))
    out = targets(sizes.select("source", "source_size"), weights).join(sizes.select(F.col("source").alias("__s"), "__ws"), F.col("source").eqNullSafe(F.col("__s")))
    return staged(out.select(F.col("source").alias("__source"), "source_size", "sid", "target", F.when(F.col("source_size") > 0, F.col("__ws") / F.col("source_size")).alias("mean_weight")), "mix-sources")


def _copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    settled = cuts.where("equal_left < equal_rows").limit(1).count() == 0
    cuts = cuts.select(F.col("sid").alias("__sid"), F.col("band").alias("__band"), "cut", "cut_tie", "equal_left", "equal_rows")
    joined = rows.join(small(cuts), (F.col("sid") == F.col("__sid")) & (F.col("band") == F.col("__band")), "left")
    before = (F.col("rank") < F.col("cut")) | (F.col("rank") == F.col("cut")) & (F.col("cut_tie").isNull() | (F.col("tie") <= F.col("cut_tie")))
    copies = lambda drawn: F.when(F.col("size") > 0, F.col("whole") + drawn).otherwise(0).cast("long")
    drawn = joined.withColumn("copies", copies(F.coalesce(before.cast("long"), F.lit(0))))
    if settled:
        return drawn
    # equal rows of which some are drawn: one of each stratum's stands for all
    split = F.coalesce((F.col("rank") == F.col("cut")) & (F.col("tie") == F.col("cut_tie")) & (F.col("equal_left") < F.col("equal_rows")), F.lit(False))
    one = joined.where(split).groupBy("__sid", "__band").agg(F.first(F.struct(*joined.columns)).alias("__one")).select("__one.*")
    each = one.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("equal_rows").cast("int"))))
    each = each.withColumn("copies", copies((F.col("__i") <= F.col("equal_left")).cast("long"))).drop("__i")
    return drawn.where(~split).unionByName(each)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weight_col: str | None = None, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    slim = staged(_measure(docs, id_col, text_col, source_col, weight_col), "mix-sizes")
    rows = _expect(slim.join(_sources(slim, weights), F.col("source").eqNullSafe(F.col("__source"))).withColumn("u", uniform(F.col("doc_id"))))
    out = _copies(rows, _cuts(rows))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their own columns. The cuts, a table of some rows per
    source, are settled on sizes first; a second pass over docs applies them, so texts aren't shuffled for the draw."""
    slim = staged(_measure(docs, id_col, text_col, source_col, None), "mix-sizes")
    sources = _sources(slim, weights)
    measured = slim.join(sources, F.col("source").eqNullSafe(F.col("__source"))).withColumn("u", uniform(F.col("doc_id")))
    cuts = _cuts(_expect(measured))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    row = lambda c: F.col("__row").getField(c)
    whole = whole.select("__row", row(source_col).alias("source"), word_count(row(text_col)).alias("size"), F.lit(1.0).alias("weight"), uniform(row(id_col)).alias("u"), row_hash(docs.dtypes, row).alias("tie"))
    out = _copies(_expect(whole.join(sources, F.col("source").eqNullSafe(F.col("__source")))), cuts).where("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__row.*")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, source_size, sid, weight, 3 * source_size / weight AS full_at, sum(source_size) OVER ()::BIGINT AS total
  FROM (SELECT *, (1 + sid % 3)::DOUBLE AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT AS sid FROM d GROUP BY source))
), l AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY full_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY full_at, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM s
), t AS (
  SELECT source, source_size, sid, least(weight * (SELECT level FROM l WHERE full_at >= level ORDER BY full_at, sid LIMIT 1), (3 * source_size)::DOUBLE) AS target FROM l
), e AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.sid, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0 END AS copies,
    (('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, floor(copies)::BIGINT AS whole, least(floor((copies - floor(copies)) * 1048576), 1048575)::BIGINT AS p,
    (((size * 8) >> (length(bin(size)) - 1)) + length(bin(size)) * 8)::INT AS band FROM e
), q AS (
  SELECT *, (u / (1.0::DOUBLE - u)) / ((p / 1048576.0::DOUBLE) / (1.0::DOUBLE - p / 1048576.0::DOUBLE)) AS rnk FROM r
), b AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY band DESC) AS i FROM (
    SELECT sid, band, count(*) AS n, sum(p)::DOUBLE / 1048576.0::DOUBLE AS p_sum, sum(p * size)::DOUBLE / 1048576.0::DOUBLE AS p_words
    FROM q WHERE p > 0 AND size > 0 GROUP BY sid, band)
), f AS (
  SELECT sid, band, i, least(greatest(floor(p_words / (p_words / p_sum) + 0.5::DOUBLE), 0), n)::BIGINT AS take,
    p_words - least(greatest(floor(p_words / (p_words / p_sum) + 0.5::DOUBLE), 0), n) * (p_words / p_sum) AS carry FROM b WHERE i = 1
  UNION ALL
  SELECT b.sid, b.band, b.i, least(greatest(floor((f.carry + b.p_words) / (b.p_words / b.p_sum) + 0.5::DOUBLE), 0), b.n)::BIGINT,
    (f.carry + b.p_words) - least(greatest(floor((f.carry + b.p_words) / (b.p_words / b.p_sum) + 0.5::DOUBLE), 0), b.n) * (b.p_words / b.p_sum)
  FROM f JOIN b ON b.sid = f.sid AND b.i = f.i + 1
), k AS (
  SELECT q.*, CASE WHEN q.p > 0 AND q.size > 0 AND row_number() OVER (PARTITION BY q.sid, q.band, q.p > 0 AND q.size > 0 ORDER BY q.rnk) <= f.take THEN 1 ELSE 0 END AS drawn
  FROM q LEFT JOIN f ON f.sid = q.sid AND f.band = q.band
)
SELECT doc_id, size, source_size, target, (size * (whole + drawn))::BIGINT AS taken, source,
  CASE WHEN size > 0 THEN whole + drawn ELSE 0 END::BIGINT AS copies FROM k
"""
