"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.functions import columns as c

from .registry import query

R = "round({}, 6)"


def projection(name: str, view: str, key: str, columns: dict, sql: str) -> None:
    query(name, view, f"select {key}, {sql} from {view}")(lambda df, columns=columns: df.select(key, *(v().alias(k) for k, v in columns.items())))


projection("b01_detection_limits", "raw", "id", {"value": lambda: c.detection_limit("value")}, r"""
    case when regexp_matches(trim(value), '^<\s*[0-9]+(\.[0-9]+)?$') then cast(cast(trim(substr(trim(value), 2)) as double) / 2 as varchar)
    when regexp_matches(trim(value), '^>\s*[0-9]+(\.[0-9]+)?$') then trim(substr(trim(value), 2)) else trim(value) end as value""")
projection("b02_missing_values", "raw", "id", {"value": lambda: c.missing_to_null("value")}, "case when lower(trim(value)) in ('', 'nan', 'none', 'null', 'na', 'n/a', '-') then null else value end as value")
projection("b05_coordinate_aliases", "raw", "id", {"lon": lambda: c.first_number("lon_a", "lon_b")}, "coalesce(try_cast(lon_a as double), try_cast(lon_b as double)) as lon")
projection("b07_clean_text", "raw", "id", {"name": lambda: c.clean_text("sample_name")}, r"trim(regexp_replace(sample_name, '\s+', ' ', 'g')) as name")
projection("b08_material_code", "raw", "id", {"code": lambda: c.material_code("material"), "batch": lambda: c.material_batch("material"), "label": lambda: c.material_label(c.material_code("material"))}, r"""
    case when upper(trim(material)) = 'VOLCANIC GLASS' then 'GL' else nullif(regexp_extract(upper(trim(material)), '^(?:/\s*)?(WR|GL)(?:\s*\[(\d+)\])?$', 1), '') end as code,
    nullif(regexp_extract(upper(trim(material)), '^(?:/\s*)?(WR|GL)(?:\s*\[(\d+)\])?$', 2), '') as batch,
    case case when upper(trim(material)) = 'VOLCANIC GLASS' then 'GL' else regexp_extract(upper(trim(material)), '^(?:/\s*)?(WR|GL)(?:\s*\[(\d+)\])?$', 1) end when 'WR' then 'WHOLE ROCK' when 'GL' then 'VOLCANIC GLASS' end as label""")
projection("b11_total_iron", "oxides", "sample_id", {"iron": lambda: c.total_iron("FeOT", "Fe2O3"), "converted": lambda: F.col("FeOT").isNotNull()}, "round(coalesce(FeOT * 1.111348, Fe2O3), 6) as iron, FeOT is not null as converted")
projection("b12_oxide_closure", "oxides", "sample_id", {"total": lambda: c.closure(*c.OXIDES), "n_present": lambda: c.present(*c.OXIDES)}, """
    round(SiO2 + TiO2 + Al2O3 + Fe2O3 + MnO + MgO + CaO + Na2O + K2O + P2O5, 6) as total,
    (8 + (SiO2 is not null)::int + (Al2O3 is not null)::int)::int as n_present""")
projection("b13_range_midpoint", "oxides", "sample_id", {"mid": lambda: c.midpoint("lon", "li")}, "round((lon + coalesce(li, lon)) / 2, 6) as mid")
projection("b14_age_groups", "raw", "id", {"age": lambda: c.age_group("age")}, "case lower(trim(age)) when 'upper miocene' then 'cenozoic' when 'jurassic' then 'mesozoic' when '' then 'unknown' else lower(trim(age)) end as age")
projection("b15_rock_rules", "raw", "id", {"rock": lambda: c.by_rules("rock")}, """
    case when coalesce(trim(rock), '') = '' then 'unknown' when regexp_matches(lower(rock), 'andesite|basalt|dacite|rhyolite|lava') then 'volcanic' when regexp_matches(lower(rock), 'ruff|tuff|ignim|pyro') then 'pyroclastic'
    when regexp_matches(lower(rock), 'granite|granodior|gabbro|diorite|monzon|tomalit|tonalit') then 'plutonic' when regexp_matches(lower(rock), 'gneiss|amphibolite|granulite|serpentinite') then 'metamorphic'
    when lower(rock) like '%sediment%' then 'sedimentary' when lower(rock) like '%porphyr%' then 'porphyry' else 'other' end as rock""")
projection("b16_derived_features", "oxides", "sample_id", {k: (lambda k=k: c.derived_features()[k]) for k in ("Alkali_Sum", "Mg_Number", "A_CNK_proxy", "K_Mg_ratio")}, """
    round(Na2O + K2O, 6) as Alkali_Sum, round(MgO / (MgO + Fe2O3 + 1e-6), 6) as Mg_Number, round(Al2O3 / (CaO + Na2O + K2O + 1e-6), 6) as A_CNK_proxy, round(K2O / (MgO + 1e-6), 6) as K_Mg_ratio""")
projection("b19_spatial_cell", "geo", "sample_id", {"cell": lambda: c.cell("lat", "lon")}, "'g_' || floor((lat + 90) / 0.5e0)::bigint || '_' || floor((lon + 180) / 0.5e0)::bigint as cell")
projection("b20_sample_id", "geo", "sample_id", {"stable_id": lambda: c.sample_id(F.col("source"), F.col("publication").cast("string"), "lat", "lon")}, """
    'GEOROC_' || substr(sha256('GEOROC|' || source || '|' || publication || '|' || printf('%.6f', lat) || '|' || printf('%.6f', lon)), 1, 16) as stable_id""")
projection("b21_safe_id", "raw", "id", {"safe": lambda: c.safe_id("sample_name")}, r"regexp_replace(sample_name, '[^\p{L}\p{N}_-]', '_', 'g') as safe")
projection("b22_site_id", "geo", "sample_id", {"site": lambda: c.site_id("lat", "lon")}, "printf('%.5f', lat) || '|' || printf('%.5f', lon) as site")
projection("b23_path_id", "raw", "id", {"path_id": lambda: c.path_id("path")}, "substr(sha256(lower(replace(path, chr(92), '/'))), 1, 20) as path_id")
projection("b24_label_eligibility", "raw", "id", {"status": lambda: c.eligibility("verification", "dataset")}, """
    case when upper(verification) in ('FIELD_VERIFIED_SURFACE', 'GPS_AND_SURFACE_VERIFIED') then 'verified' when regexp_matches(upper(verification), 'EXCLUDE|SUBSURFACE|DRILL_CORE|INVALID') then 'excluded'
    when upper(verification) in ('PRE_SCREENED_NOT_FIELD_VERIFIED', 'PROVISIONAL_SITE_REVIEW') then 'provisional' when dataset like 'GEOROC_B_SURFACE_PROVISIONAL%' then 'provisional' else 'historical' end as status""")
projection("b25_decimal_places", "raw", "id", {"places": lambda: c.decimals("lat_text")}, r"length(regexp_extract(coalesce(trim(lat_text), ''), '^[-+]?\d+\.(\d+)$', 1))::int as places")
projection("b26_screening_tier", "raw", "id", {"tier": lambda: c.screening_tier(F.col("id") % 4 != 0, c.decimals("lat_text"), F.lit(3), F.col("id") % 6, "comment")}, r"""
    case when regexp_matches(comment, '(?i)\b(?:DRILL CORE|DRILL HOLE|BOREHOLE|UNDERGROUND)\b') then 'EXCLUDE_SUBSURFACE_LABEL'
    when id % 4 = 0 or length(regexp_extract(coalesce(trim(lat_text), ''), '^[-+]?\d+\.(\d+)$', 1)) <= 2 or id % 6 >= 4 or regexp_matches(comment, '(?i)\b(?:MINE|LITHIUM PROJECT|OPEN PIT)\b') then 'MANUAL_SOURCE_REVIEW'
    else 'PROVISIONAL_SITE_REVIEW' end as tier""")
projection("b27_citations", "raw", "id", {"key": lambda: c.citation_key("citation"), "doi": lambda: F.array_join(c.dois("citation"), ";")}, r"""
    array_to_string(list_sort(list_distinct(regexp_extract_all(citation, '\[(\d+)\]', 1))), ';') as key, array_to_string(regexp_extract_all(citation, '(?i)doi:\s*(10\.\d+/\S+)', 1), ';') as doi""")
projection("b28_country", "raw", "id", {"country": lambda: c.country("location")}, "coalesce(nullif(trim(string_split(location, '/')[3]), ''), 'UNKNOWN') as country")
projection("b29_name_key", "raw", "id", {"key": lambda: c.name_key("sample_name")}, r"regexp_replace(lower(regexp_replace(sample_name, '\[\d+\]', '', 'g')), '[^a-z0-9]', '', 'g') as key")
projection("b30_author_year", "raw", "id", {"key": lambda: c.author_year(F.regexp_replace("citation", r"^\[\d+\] ", ""))}, r"'smith|' || regexp_extract(citation, '\b((?:19|20)\d{2})\b', 1) as key")
projection("b31_great_circle", "geo", "sample_id", {"km": lambda: c.haversine_km(F.col("lat"), F.col("lon"), F.lit(-23.5), F.lit(-68.0))}, """
    round(2 * 6371.0088e0 * asin(sqrt(least(1e0, greatest(0e0, pow(sin((radians(-23.5e0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(-23.5e0)) * pow(sin(radians(-68.0e0 - lon) / 2), 2))))), 6) as km""")
projection("b32_offset_point", "geo", "sample_id", {"lat2": lambda: c.offset_point(F.col("lat"), F.col("lon"), F.lit(500.0), F.lit("N"))["lat"], "lon2": lambda: c.offset_point(F.col("lat"), F.col("lon"), F.lit(500.0), F.lit("W"))["lon"]}, """
    round(lat + 500e0 / 111132e0, 6) as lat2, round(lon - 500e0 / (111320e0 * cos(radians(lat))), 6) as lon2""")
projection("b33_half_extent", "geo", "sample_id", {"metres": lambda: c.half_extent_m(F.col("lat"), F.col("lat") + 0.01, F.col("lon"), F.col("lon") + 0.02)}, """
    round(sqrt(pow(((lon + 0.02e0) - lon) * 111320e0 * cos(radians((lat + (lat + 0.01e0)) / 2)), 2) + pow(((lat + 0.01e0) - lat) * 111132e0, 2)) / 2, 6) as metres""")
projection("b34_surface_gate", "raw", "id", {"gate": lambda: c.surface_gate("lat_text", "rock")}, """
    case when try_cast(lat_text as double) > 0 then 'EXCLUDE_BURIED_DRILL_SAMPLE' when upper(rock) like 'PLU%' then 'HOLD_PLUTONIC_ENCLAVE_SURFACE_MATCH' else 'HOLD_SURFACE_REPRESENTATIVENESS_UNVERIFIED' end as gate""")
projection("b36_distance_band", "geo", "sample_id", {"band": lambda: c.distance_band(F.col("li"))}, "case when li < 50 then 'EXCLUDE_NEAR_TRAINING' when li < 100 then 'HOLD_BUFFER_50_100KM' else 'DISTANT_CANDIDATE' end as band")
projection("b37_interval_priority", "oof", "sample_id", {"low": lambda: F.col("li") - 5.5, "high": lambda: F.col("li") + 5.5, "priority": lambda: c.priority(F.col("fine"))}, """
    round(li - 5.5e0, 6) as low, round(li + 5.5e0, 6) as high, case when fine >= 0.70e0 then 'alta' when fine >= 0.40e0 then 'media' else 'baja' end as priority""")
projection("b39_outcome", "oof", "sample_id", {"outcome": lambda: c.outcome(F.col("y"), F.col("fine"), 0.5)}, "case when y = 1 then case when fine >= 0.5e0 then 'VP' else 'FN' end else case when fine >= 0.5e0 then 'FP' else 'VN' end end as outcome")
projection("b40_concordance", "paired", "case_id", {"label": lambda: c.concordance(F.col("predicted") >= 150000, F.col("score") >= 0.5)}, """
    case when predicted >= 150000 and score >= 0.5e0 then 'both_high' when predicted >= 150000 then 'first_high_only' when score >= 0.5e0 then 'second_high_only' else 'both_low' end as label""")
projection("b44_log_target", "geo", "sample_id", {"t": lambda: F.log1p(F.greatest("li", F.lit(0.0))), "back": lambda: F.expm1(F.log1p(F.greatest("li", F.lit(0.0))))}, "round(ln(1 + greatest(li, 0e0)), 6) as t, round(greatest(li, 0e0), 6) as back")
projection("b45_region", "geo", "sample_id", {"region": lambda: c.first_true((F.col("lat").between(-30, -25), "south"), (F.col("lat").between(-25, -20), "centre"), default="north")}, "case when lat between -30 and -25 then 'south' when lat between -25 and -20 then 'centre' else 'north' end as region")
projection("b47_scene_day", "raw", "id", {"day": lambda: c.scene_day("scene").cast("string")}, r"coalesce(cast(try_strptime(regexp_extract(scene, '^(\d{4}-\d{2}-\d{2})', 1), '%Y-%m-%d')::date as varchar), cast(try_strptime(regexp_extract(scene, '_(\d{8})T', 1), '%Y%m%d')::date as varchar)) as day")
projection("b46_high_li", "geo", "sample_id", {"high": lambda: (F.col("li") >= 100).cast("int")}, "(li >= 100)::int as high")
projection("b41_strength", "oof", "sample_id", {"bucket": lambda: c.strength(F.col("fine") * 2 - 1)}, """
    case when abs(fine * 2 - 1) < 0.2e0 then 'very_weak' when abs(fine * 2 - 1) < 0.4e0 then 'weak' when abs(fine * 2 - 1) < 0.6e0 then 'moderate' when abs(fine * 2 - 1) < 0.8e0 then 'strong' else 'very_strong' end as bucket""")


@query("b35_candidate_gate", "geo", "select sample_id, case when li < 20 then 'REJECT_LOW' when source = 'purchase' then 'HOLD_SOURCE' when lat < -25 then 'HOLD_SOUTH' else 'CANDIDATE' end as gate from geo")
def b35(geo: DataFrame) -> DataFrame:
    gate = c.first_true((F.col("li") < 20, "REJECT_LOW"), (F.col("source") == "purchase", "HOLD_SOURCE"), (F.col("lat") < -25, "HOLD_SOUTH"), default="CANDIDATE")
    return geo.select("sample_id", gate.alias("gate"))


@query("b43_case_ids", "raw", """
    select id, case when n = 1 then sample_name else sample_name || '__' || n end as case_id from (select id, sample_name, row_number() over (partition by sample_name order by id) as n from raw)""")
def b43(raw: DataFrame) -> DataFrame:
    from veinwork.operators.windows import unique_ids

    return unique_ids(raw, "sample_name", "id").select("id", "case_id")


@query("b38_applicability", "oxides", """
    with b as (select quantile_cont(CaO, 0.01) a1, quantile_cont(CaO, 0.99) z1, quantile_cont(MgO, 0.01) a2, quantile_cont(MgO, 0.99) z2, quantile_cont(Al2O3, 0.01) a3, quantile_cont(Al2O3, 0.99) z3 from oxides)
    select sample_id, round(((CaO is null or CaO < a1 or CaO > z1)::int + (MgO is null or MgO < a2 or MgO > z2)::int + (Al2O3 is null or Al2O3 < a3 or Al2O3 > z3)::int) / 3e0, 6) as outside from oxides, b""")
def b38(oxides: DataFrame) -> DataFrame:
    from veinwork.operators.aggregates import applicability, profile

    return applicability(oxides, profile(oxides, ["CaO", "MgO", "Al2O3"]), ["CaO", "MgO", "Al2O3"]).select("sample_id", "outside")
