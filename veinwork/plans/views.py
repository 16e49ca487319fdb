"""Stand-ins for the engine's inputs, derived from the driver's tables, and the same views as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source tables, SQL that Spark and DuckDB both read). Literals with an exponent are doubles in both.
VIEWS: dict[str, str] = {
    "geo": """
        select event_id as sample_id, -75e0 + (event_id * 37 % 1000) / 100e0 as lon, -30e0 + (event_id * 91 % 1500) / 100e0 as lat,
            value as li, event_type as source, user_id as publication, ts
        from events""",
    "oxides": """
        select p_partkey as sample_id, p_brand as source, p_type as material,
            case when p_partkey % 7 = 0 then null else 45e0 + p_partkey % 30 end as SiO2, (p_partkey % 11) / 10e0 as TiO2,
            case when p_partkey % 13 = 0 then null else 10e0 + p_partkey % 9 end as Al2O3, 1e0 + p_partkey % 8 as Fe2O3,
            (p_partkey % 4) / 10e0 as MnO, (p_partkey % 9) / 2e0 as MgO, 1e0 + p_partkey % 7 as CaO, 2e0 + (p_partkey % 5) / 2e0 as Na2O,
            1e0 + p_partkey % 6 as K2O, (p_partkey % 3) / 10e0 as P2O5,
            case when p_partkey % 3 = 0 then null else 90e0 + p_partkey % 15 end as measured_total,
            case when p_partkey % 5 = 0 then null else 1e0 + p_partkey % 12 end as FeOT,
            case when p_partkey % 2 = 0 then 100e0 + p_partkey % 50 end as Rb, case when p_partkey % 4 <> 0 then 300e0 end as Sr,
            case when p_partkey % 6 <> 0 then p_size * 1e0 end as li, -80e0 + (p_partkey * 37 % 3000) / 100e0 as lon, -40e0 + (p_partkey * 91 % 3500) / 100e0 as lat
        from part""",
    "raw": """
        select p_partkey as id,
            case p_partkey % 6 when 0 then concat('<', cast(p_partkey % 97 as varchar(10)), '.5') when 1 then concat(' ', cast(p_partkey % 50 as varchar(10)), ' ')
                when 2 then ' n/a ' when 3 then concat('>', cast(p_partkey % 31 as varchar(10))) when 4 then '-' else cast(p_partkey as varchar(20)) end as value,
            case p_partkey % 5 when 0 then 'WR' when 1 then '/ wr [2]' when 2 then 'Volcanic Glass' when 3 then ' gl [17] ' else p_type end as material,
            case p_partkey % 4 when 0 then 'Upper Miocene' when 1 then ' JURASSIC ' when 2 then '' else 'Archean' end as age,
            case p_partkey % 6 when 0 then 'Porphyritic andesite' when 1 then 'Granodiorite' when 2 then 'tuff' when 3 then null when 4 then ' ' else 'Schist' end as rock,
            case p_partkey % 3 when 0 then '-68.25' when 1 then 'x' end as lon_a, case when p_partkey % 2 = 0 then '-67.5' else '  ' end as lon_b,
            case p_partkey % 4 when 0 then '-12.345' when 1 then '7.5' when 2 then '12' else null end as lat_text,
            concat('Name ', cast(p_partkey % 40 as varchar(10)), ' [', cast(p_partkey % 9 as varchar(10)), ']') as sample_name,
            concat('A / B / ', case when p_partkey % 5 = 0 then '' else substr(p_brand, 1, 7) end, ' / C') as location,
            concat('[', cast(p_partkey % 23 as varchar(10)), '] Smith ', cast(1980 + p_partkey % 40 as varchar(10)), ' [', cast(p_partkey % 7 as varchar(10)), '] doi: 10.', cast(1000 + p_partkey % 9 as varchar(10)), '/x', cast(p_partkey as varchar(20))) as citation,
            case p_partkey % 5 when 0 then 'DRILL CORE 12' when 1 then 'near lithium project' when 2 then 'open pitted' else 'outcrop' end as comment,
            case p_partkey % 5 when 0 then 'gps_and_surface_verified' when 1 then 'drill_core sample' when 2 then 'PROVISIONAL_SITE_REVIEW' else '' end as verification,
            case when p_partkey % 2 = 0 then 'GEOROC_B_SURFACE_PROVISIONAL_X' else 'OTHER' end as dataset,
            concat('C:', chr(92), 'Data', chr(92), p_brand, '/', cast(p_partkey as varchar(20)), '.NPY') as path,
            case p_partkey % 3 when 0 then concat('S2A_2024', case when p_partkey % 2 = 0 then '0229' else '0231' end, 'T101_x') when 1 then '2023-05-17T10:00' else 'none' end as scene
        from part""",
    "export": """
        select cast(p_partkey as varchar(20)) as id, cast(p_partkey % 4 as varchar(10)) as file_no, concat('N\u00e9 ', p_brand) as sample_name,
            case p_partkey % 5 when 0 then 'WR' when 1 then '/ wr [2]' when 2 then 'Volcanic Glass' when 3 then 'Whole Rock' else p_type end as material,
            case when p_partkey % 6 = 0 then 'n.d.' else cast(p_size as varchar(20)) end as li,
            case when p_partkey % 11 = 0 then null else cast(p_partkey % 400 - 200 as varchar(20)) end as lon_min, case when p_partkey % 2 = 0 then null else cast(p_partkey % 400 - 198 as varchar(20)) end as lon_max,
            cast(p_partkey % 100 - 50 as varchar(20)) as lat_min, cast(p_partkey % 100 - 49 as varchar(20)) as lat_max,
            case when p_partkey % 7 = 0 then 'x' else cast(45 + p_partkey % 30 as varchar(20)) end as SiO2,
            case when p_partkey % 3 = 0 then 'x' else cast(p_partkey % 11 as varchar(20)) end as TiO2,
            case when p_partkey % 5 = 0 then 'x' else cast(10 + p_partkey % 9 as varchar(20)) end as Al2O3,
            case when p_partkey % 2 = 0 then 'x' else cast(1 + p_partkey % 8 as varchar(20)) end as Fe2O3,
            case when p_partkey % 3 = 0 then 'x' else cast(p_partkey % 4 as varchar(20)) end as MnO,
            case when p_partkey % 11 = 0 then 'x' else cast(p_partkey % 9 as varchar(20)) end as MgO,
            case when p_partkey % 4 = 0 then 'x' else cast(1 + p_partkey % 7 as varchar(20)) end as CaO,
            case when p_partkey % 13 = 0 then 'x' else cast(2 + p_partkey % 5 as varchar(20)) end as Na2O,
            case when p_partkey % 5 = 0 then 'x' else cast(1 + p_partkey % 6 as varchar(20)) end as K2O,
            case when p_partkey % 2 = 0 then 'x' else cast(p_partkey % 3 as varchar(20)) end as P2O5,
            case when p_partkey % 5 = 0 then null else cast(1 + p_partkey % 12 as varchar(20)) end as FeOT, case when p_partkey % 3 = 0 then cast(p_partkey % 90 as varchar(20)) end as Rb
        from part""",
    "oof": """
        select event_id as sample_id, cast(event_id * 7919 % 10007 as double) / 10007e0 as fine, (event_id % 11) / 10e0 as coarse,
            case when value >= 100e0 or event_id * 7919 % 10007 > 8000 then 1 else 0 end as y, value as li,
            concat('g_', cast(floor((event_id * 91 % 1500) / 50e0) as int), '_', cast(floor((event_id * 37 % 1000) / 50e0) as int)) as cell,
            cast(floor((event_id * 37 % 1000) / 50e0) as int) % 5 as fold, event_type as cohort
        from events""",
    "reg": """
        select l_suppkey as grp, l_returnflag as source, l_quantity as y, l_extendedprice / 1000e0 as pred, l_linenumber % 5 as fold from lineitem""",
    "pixels": """
        select vec_id, embedding from embeddings""",
    "scen": """
        select event_id as id, user_id % 8 as region, event_type as campaign, case when extract(day from ts) <= 15 then 'summer' else 'winter' end as season,
            cast(2020 + event_id % 3 as int) as year, case when event_id % 10 = 0 then null else (event_id * 7919 % 10007) / 10007e0 end as score
        from events""",
    "paired": """
        select o_orderkey as case_id, o_totalprice as predicted, c_acctbal as balance, (c_acctbal + 1000e0) / 11000e0 as score,
            case when o_orderkey % 9 = 0 then null else o_totalprice * 0.8e0 end as low_q90, o_orderpriority as grp
        from orders join customer on o_custkey = c_custkey""",
}

TABLES = {"geo": ["events"], "oxides": ["part"], "raw": ["part"], "export": ["part"], "oof": ["events"], "reg": ["lineitem"], "pixels": ["embeddings"], "scen": ["events"], "paired": ["orders", "customer"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    sql = VIEWS[name]
    for t in frames:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """An oracle query with the views it names in front."""
    head = ", ".join(f"{n} as ({VIEWS[n].replace('varchar(10)', 'varchar').replace('varchar(20)', 'varchar')})" for n in names)
    return f"with recursive {head}, {sql[4:].lstrip()}" if sql.lstrip().lower().startswith("with") else f"with {head} {sql}"
