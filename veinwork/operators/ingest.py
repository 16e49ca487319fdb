"""Harmonising of assay exports as one job: columns to canonical form, row by row verdicts, audits, merges with a base table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import columns as c
from veinwork.operators.windows import keep_first

#: Trace elements that count as predictors beside the major oxides.
TRACES = [f"{e}_icpms" for e in ("Th", "U", "Rb", "Cs", "Nb", "Ta", "Pb", "Ba", "Sr", "Zr", "V", "Hf")]
PLACE = ["Longitude", "Longitude_min", "Longitude_max", "Latitude", "Latitude_min", "Latitude_max"]
REASONS = ("material", "missing_core", "bad_coordinates", "too_few_predictors")


def harmonised(df: DataFrame, source_name: str, materials: tuple[str, ...] = ("WHOLE ROCK",), minimum_predictors: int = 8, feot_equivalent: bool = False) -> DataFrame:
    """df: strings under canonical names (tables.read_exports). Numbers, midpoints of ranges, material code and label, iron,
    oxide sum, provenance; reject: why the row is out (the first of REASONS), null for rows to keep. No row is dropped here, so an
    audit can count them; kept() drops them. Columns that no file has are null."""
    has = set(df.columns)
    absent = [x for x in [*PLACE, *c.OXIDES, *TRACES, "Li_icpms", "FeOT", "material"] if x not in has]
    df = df.select("*", *(F.lit(None).cast("string").alias(x) for x in absent))
    iron = F.coalesce(c.number("FeOT") * c.IRON_FACTOR, c.number("Fe2O3")) if feot_equivalent else c.number("Fe2O3")
    converted = c.number("FeOT").isNotNull() & F.lit(feot_equivalent)
    numbers = {x: iron if x == "Fe2O3" else c.number(x) for x in [*PLACE, *c.OXIDES, *TRACES, "Li_icpms"]}
    code = c.material_code("material")
    other = [x for x in df.columns if x not in numbers and x not in ("FeOT", "material")]
    out = df.select(*other, *(v.alias(k) for k, v in numbers.items()), code.alias("material_code"), c.material_batch("material").alias("material_batch"), c.material_label(code).alias("material"), F.when(converted, "FEOT_CONVERTED_TO_FE2O3T").otherwise("ORIGINAL_FE2O3").alias("iron_provenance"))
    for x in ("Longitude", "Latitude"):
        out = out.withColumn(x, F.coalesce(x, c.midpoint(f"{x}_min", f"{x}_max")) if x in has else c.midpoint(f"{x}_min", f"{x}_max"))
    predictors = c.present(*c.OXIDES, *TRACES)
    wanted = [w for w in ("WR", "GL") if w in materials or {"WR": "WHOLE ROCK", "GL": "VOLCANIC GLASS"}[w] in materials]
    core = F.col("Li_icpms").isNotNull() & F.col("Longitude").isNotNull() & F.col("Latitude").isNotNull()
    why = F.when(~F.coalesce(F.col("material_code").isin(wanted), F.lit(False)) & F.lit("material" in has and bool(wanted)), REASONS[0])
    why = why.when(~core, REASONS[1]).when(~(F.col("Longitude").between(-180, 180) & F.col("Latitude").between(-90, 90)), REASONS[2]).when(predictors < minimum_predictors, REASONS[3])
    return out.withColumn("oxide_sum", c.closure(*c.OXIDES)).withColumn("source_dataset", F.lit(source_name)).withColumn("reject", why)


def kept(rows: DataFrame) -> DataFrame:
    return rows.where("reject is null").drop("reject")


def audit(rows: DataFrame, key: str = "source_file") -> DataFrame:
    """By file: rows read and kept, and how many each reason put out."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("reject").isNull()).alias("rows_kept"), *(F.count_if(F.col("reject") == r).alias(f"rejected_{r}") for r in REASONS))


def merged(base: DataFrame, external: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """base and then external rows, one per key (the base's before the external's), and an audit row: rows of both, of the union, without repeats."""
    both = base.withColumn("origin", F.lit("base")).unionByName(external.withColumn("origin", F.lit("external")), allowMissingColumns=True)
    out = keep_first(both, keys, [F.asc("origin"), *order])
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counted = both.agg(F.count_if(F.col("origin") == "base").alias("base_rows"), F.count_if(F.col("origin") == "external").alias("external_rows"), F.count(F.lit(1)).alias("combined_rows"))
    return out, counted.join(n(out, "unique_rows"), how="inner").withColumn("duplicates", F.col("combined_rows") - F.col("unique_rows"))


def adapted(df: DataFrame, mapping: dict[str, str], scale: dict[str, float], keep: list[str], constants: dict[str, str]) -> DataFrame:
    """A configured adapter: target name -> source column, factors to the target's unit, columns passed through, constant
    provenance columns. A mapped column that df lacks is an error."""
    if absent := [v for v in mapping.values() if v not in df.columns]:
        raise ValueError(f"mapped columns are missing: {absent}")
    value = lambda k, v: (c.number(v) * scale[k] if k in scale else F.col(v)).alias(k)
    return df.select(*(value(k, v) for k, v in mapping.items()), *(x for x in keep if x in df.columns), *(F.lit(v).alias(k) for k, v in constants.items()))


def health(df: DataFrame, key: list[str], numbers: list[str]) -> DataFrame:
    """One row: rows, repeated keys, and the missing values of each number."""
    return df.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct(*key)).alias("repeated"), *(F.count_if(F.col(x).isNull()).alias(f"missing_{x}") for x in numbers))


def age_gate(df: DataFrame, age: str, most: float = 0.5) -> DataFrame:
    """One row: the share of missing ages and whether the column may be used."""
    return df.agg(F.avg(c.missing_to_null(age).isNull().cast("double")).alias("missing")).withColumn("include_age", F.col("missing") <= most)


def feature_schema(columns: list[str], include_age: bool) -> list[str]:
    """The feature columns that are there, in fixed order."""
    return [x for x in [*c.OXIDES, "Age", "rock_group", "age_group", "Alkali_Sum", "Mg_Number", "A_CNK_proxy", "K_Mg_ratio"] if x in columns and (include_age or x != "Age")]


def aligned(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """df brought to a model's features (name -> type): detection limits and missing marks resolved, numbers read, absent columns
    null, the fixed order; what else df has goes."""
    by = {x.strip().lower(): x for x in df.columns[::-1]}

    def one(name: str, kind: str) -> Column:
        found = by.get(name.lower())
        if found is None:
            return F.lit(None).cast(kind).alias(name)
        text = c.missing_to_null(c.detection_limit(F.col(f"`{found}`").cast("string")))
        return (c.number(text) if kind == "double" else c.category(text)).alias(name)

    return df.select(*(one(k, v) for k, v in features.items()))
