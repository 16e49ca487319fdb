"""Column functions for geochemical sample tables: cleaning, ids, gates, distances. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MISSING = ["", "nan", "none", "null", "na", "n/a", "-"]
OXIDES = ["SiO2", "TiO2", "Al2O3", "Fe2O3", "MnO", "MgO", "CaO", "Na2O", "K2O", "P2O5"]
CORE_OXIDES = ["SiO2", "Al2O3", "CaO", "Na2O", "K2O"]
IRON_FACTOR = 1.111348
EARTH_KM = 6371.0088
EPSILON = 1e-6
AGE_GROUPS = {
    "devonian": "paleozoic", "carboniferous": "paleozoic", "permian": "paleozoic", "jurassic": "mesozoic", "cretaceous": "mesozoic",
    "paleogene": "cenozoic", "miocene": "cenozoic", "upper miocene": "cenozoic", "lower miocene": "cenozoic", "middle miocene": "cenozoic",
    "mio pliocene": "cenozoic", "pliocene": "cenozoic", "upper pliocene": "cenozoic", "lower piocene": "cenozoic", "quaternary": "cenozoic",
}
ROCK_RULES = [
    (("andesite", "basalt", "dacite", "rhyolite", "lava"), "volcanic"),
    (("ruff", "tuff", "ignim", "pyro"), "pyroclastic"),
    (("granite", "granodior", "gabbro", "diorite", "monzon", "tomalit", "tonalit"), "plutonic"),
    (("gneiss", "amphibolite", "granulite", "serpentinite"), "metamorphic"),
    (("sediment",), "sedimentary"),
    (("porphyr",), "porphyry"),
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str) -> Column:
    """A finite double, null for anything else."""
    v = _c(x).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def detection_limit(x: Column | str) -> Column:
    """'<v' gives half of v, '>v' gives v, other text is trimmed."""
    t = F.trim(_c(x))
    sign, value = F.regexp_extract(t, r"^([<>])\s*([0-9]+(?:\.[0-9]+)?)$", 1), F.regexp_extract(t, r"^([<>])\s*([0-9]+(?:\.[0-9]+)?)$", 2)
    return F.when(sign == "<", (value.try_cast("double") / 2).cast("string")).when(sign == ">", value).otherwise(t)


def missing_to_null(x: Column | str) -> Column:
    return F.when(~F.lower(F.trim(_c(x))).isin(MISSING), _c(x))


def first_number(*columns: Column | str) -> Column:
    """The first alias of a row that holds a number."""
    return F.coalesce(*(number(c) for c in columns))


def clean_text(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.translate(_c(x), "\u00a0", " "), r"\s+", " "))


def material_code(x: Column | str) -> Column:
    t = F.upper(F.trim(_c(x)))
    code = F.regexp_extract(t, r"^(?:/\s*)?(WR|GL)(?:\s*\[(\d+)\])?$", 1)
    return F.when(t == "WHOLE ROCK", "WR").when(t == "VOLCANIC GLASS", "GL").when(code != "", code)


def material_batch(x: Column | str) -> Column:
    b = F.regexp_extract(F.upper(F.trim(_c(x))), r"^(?:/\s*)?(WR|GL)(?:\s*\[(\d+)\])?$", 2)
    return F.when(b != "", b)


def material_label(code: Column | str) -> Column:
    return F.when(_c(code) == "WR", "WHOLE ROCK").when(_c(code) == "GL", "VOLCANIC GLASS")


def total_iron(feot: Column | str, fe2o3: Column | str) -> Column:
    """FeOT as Fe2O3 where it is measured, else Fe2O3; never their sum."""
    return F.coalesce(number(feot) * IRON_FACTOR, number(fe2o3))


def closure(*oxides: Column | str) -> Column:
    """The sum of the oxides, null unless all are there."""
    return reduce(lambda a, b: a + b, (_c(o) for o in oxides))


def present(*columns: Column | str) -> Column:
    return reduce(lambda a, b: a + b, (_c(c).isNotNull().cast("int") for c in columns))


def midpoint(low: Column | str, high: Column | str) -> Column:
    return (_c(low) + F.coalesce(_c(high), _c(low))) / 2


def category(x: Column | str) -> Column:
    t = F.lower(F.trim(_c(x)))
    return F.when(t.isNull() | (t == ""), "unknown").otherwise(t)


def age_group(x: Column | str) -> Column:
    t = category(x)
    return F.coalesce(F.create_map(*(F.lit(v) for kv in AGE_GROUPS.items() for v in kv))[t], t)


def by_rules(x: Column | str, rules=tuple(ROCK_RULES)) -> Column:
    """The label of the first rule with a needle in the text; unknown stays unknown, no rule gives other."""
    t, out = category(x), None
    out = F.when(t == "unknown", "unknown")
    for needles, label in rules:
        out = out.when(t.rlike("|".join(needles)), label)
    return out.otherwise("other")


def derived_features() -> dict[str, Column]:
    na, k, mg, fe, al, ca = (F.col(c) for c in ("Na2O", "K2O", "MgO", "Fe2O3", "Al2O3", "CaO"))
    return {
        "Alkali_Sum": na + k,
        "Mg_Number": mg / (mg + fe + EPSILON),
        "A_CNK_proxy": al / (ca + na + k + EPSILON),
        "K_Mg_ratio": k / (mg + EPSILON),
    }


def cell(lat: Column | str, lon: Column | str, degrees: float = 0.5) -> Column:
    return F.concat(F.lit("g_"), F.floor((_c(lat) + 90) / degrees).cast("string"), F.lit("_"), F.floor((_c(lon) + 180) / degrees).cast("string"))


def sample_id(reference: Column, name: Column, lat: Column | str, lon: Column | str, prefix: str = "GEOROC") -> Column:
    """A stable id of source, name and place."""
    text = F.concat_ws("|", F.lit(prefix), reference, name, F.format_string("%.6f", _c(lat)), F.format_string("%.6f", _c(lon)))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 16))


def safe_id(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"[^\p{L}\p{N}_-]", "_")


def site_id(lat: Column | str, lon: Column | str) -> Column:
    return F.format_string("%.5f|%.5f", _c(lat), _c(lon))


def path_id(path: Column | str) -> Column:
    return F.substring(F.sha2(F.lower(F.translate(_c(path), "\\", "/")), 256), 1, 20)


#: The labels, and the limits between them.
def eligibility(verification: Column | str, source: Column | str) -> Column:
    v, s = F.upper(F.trim(F.coalesce(_c(verification), F.lit("")))), F.trim(F.coalesce(_c(source), F.lit("")))
    return (
        F.when(v.isin("FIELD_VERIFIED_SURFACE", "GPS_AND_SURFACE_VERIFIED"), "verified")
        .when(v.rlike("EXCLUDE|SUBSURFACE|DRILL_CORE|INVALID"), "excluded")
        .when(v.isin("PRE_SCREENED_NOT_FIELD_VERIFIED", "PROVISIONAL_SITE_REVIEW"), "provisional")
        .when(s.startswith("GEOROC_B_SURFACE_PROVISIONAL"), "provisional")
        .otherwise("historical")
    )


def decimals(x: Column | str) -> Column:
    """Digits after the point of a plain decimal number's text."""
    return F.length(F.regexp_extract(F.trim(F.coalesce(_c(x), F.lit(""))), r"^[-+]?\d+\.(\d+)$", 1))


#: The labels, and the limits between them.
def screening_tier(complete: Column, dec_lat: Column, dec_lon: Column, repeated: Column, comment: Column | str, ambiguous: Column | None = None) -> Column:
    note = F.coalesce(_c(comment), F.lit(""))
    weak = ~complete | (dec_lat <= 2) | (dec_lon <= 2) | (repeated >= 4) | (F.lit(False) if ambiguous is None else ambiguous)
    return (
        F.when(note.rlike(r"(?i)\b(?:DRILL CORE|DRILL HOLE|BOREHOLE|UNDERGROUND)\b"), "EXCLUDE_SUBSURFACE_LABEL")
        .when(weak | note.rlike(r"(?i)\b(?:MINE|LITHIUM PROJECT|OPEN PIT)\b"), "MANUAL_SOURCE_REVIEW")
        .otherwise("PROVISIONAL_SITE_REVIEW")
    )


def citation_ids(x: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))


def citation_key(x: Column | str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(citation_ids(x))), ";")


def dois(x: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"(?i)doi:\s*(10\.\d+/\S+)"), F.lit(1))


def country(location: Column | str) -> Column:
    t = F.trim(F.get(F.split(F.coalesce(_c(location), F.lit("")), "/"), F.lit(2)))
    return F.when(t.isNull() | (t == ""), "UNKNOWN").otherwise(t)


def name_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\[\d+\]", "")), r"[^a-z0-9]", "")


def author_year(x: Column | str) -> Column:
    """surname|year of a reference, null without either."""
    who, year = F.regexp_extract(_c(x), r"^\s*([A-Za-z'-]+)", 1), F.regexp_extract(_c(x), r"\b((?:19|20)\d{2})\b", 1)
    return F.when((who != "") & (year != ""), F.concat(F.lower(who), F.lit("|"), year))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def offset_point(lat: Column, lon: Column, metres: Column, direction: Column) -> dict[str, Column]:
    ns = F.when(direction == "N", 1).when(direction == "S", -1).otherwise(0)
    ew = F.when(direction == "E", 1).when(direction == "W", -1).otherwise(0)
    return {"lat": lat + ns * metres / 111132.0, "lon": lon + ew * metres / (111320.0 * F.cos(F.radians(lat)))}


def half_extent_m(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Half the diagonal of a location's bounds; null unless they are bounds."""
    dy, dx = (lat_max - lat_min) * 111132.0, (lon_max - lon_min) * 111320.0 * F.cos(F.radians((lat_min + lat_max) / 2))
    return F.when((lat_max >= lat_min) & (lon_max >= lon_min) & (F.abs(lat_min) <= 90) & (F.abs(lat_max) <= 90), F.sqrt(dx * dx + dy * dy) / 2)


#: The labels, and the limits between them.
def surface_gate(depth: Column | str, rock: Column | str) -> Column:
    return (
        F.when(number(depth) > 0, "EXCLUDE_BURIED_DRILL_SAMPLE")
        .when(F.upper(_c(rock)).startswith("PLU"), "HOLD_PLUTONIC_ENCLAVE_SURFACE_MATCH")
        .otherwise("HOLD_SURFACE_REPRESENTATIVENESS_UNVERIFIED")
    )


def first_true(*cases: tuple[Column, str], default: str) -> Column:
    """The label of the first condition that holds."""
    out = F.when(*cases[0])
    for c, label in cases[1:]:
        out = out.when(c, label)
    return out.otherwise(default)


#: The labels, and the limits between them.
def distance_band(km: Column) -> Column:
    return first_true((km < 50, "EXCLUDE_NEAR_TRAINING"), (km < 100, "HOLD_BUFFER_50_100KM"), default="DISTANT_CANDIDATE")


#: The labels, and the limits between them.
def priority(score: Column) -> Column:
    return first_true((score >= 0.70, "alta"), (score >= 0.40, "media"), default="baja")


def outside_share(values: dict[str, Column], low: dict[str, Column], high: dict[str, Column]) -> Column:
    """Share of features that are null or outside their bounds."""
    flags = [F.when(v.isNull() | (v < low[k]) | (v > high[k]), 1).otherwise(0) for k, v in values.items()]
    return reduce(lambda a, b: a + b, flags) / float(len(flags))


#: The labels, and the limits between them.
def outcome(y: Column, score: Column, threshold: Column | float) -> Column:
    hit = score >= threshold
    return F.when(y == 1, F.when(hit, "VP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("VN"))


#: The labels, and the limits between them.
def concordance(high_a: Column, high_b: Column) -> Column:
    return F.when(high_a & high_b, "both_high").when(high_a, "first_high_only").when(high_b, "second_high_only").otherwise("both_low")


#: The labels, and the limits between them.
def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(r.isNull(), "not_available").otherwise(first_true((a < 0.2, "very_weak"), (a < 0.4, "weak"), (a < 0.6, "moderate"), (a < 0.8, "strong"), default="very_strong"))


def scene_day(scene: Column | str) -> Column:
    """An ISO date at the start, or the first YYYYMMDD token of a scene id that is a day."""
    s = _c(scene)
    tokens = F.transform(F.regexp_extract_all(s, F.lit(r"(?:^|_|T)(\d{8})(?=T|_|$)"), F.lit(1)), lambda t: F.try_to_timestamp(t, F.lit("yyyyMMdd")).cast("date"))
    return F.coalesce(F.try_to_timestamp(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date"), F.get(F.array_compact(tokens), F.lit(0)))
