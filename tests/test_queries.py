"""The entry point, and a share of the queries against DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
SOME = ["b01_detection_limits", "b20_sample_id", "c06_qc_protocols", "d07_nearest_neighbour", "e08_protocol_summary", "e16_regression_metrics", "e18_e19_auc_ap_by_cohort", "f09_balanced_queue", "g01_group_folds", "g08_cluster_bootstrap", "i04_spectral_indices", "k08_independence_gate",
        "a01_tabular_load", "a03_ingest_audit", "a09_set_fingerprint", "a14_scene_metadata", "b10_harmonised_rows", "e22_group_metrics", "e50_distance_strata", "f06_average_rank", "f12_apart_pilot", "f14_frozen_threshold", "g02_stratified_group_folds", "g07_ablation_arms", "i12_patch_quality", "j05_nested_cv", "j12_batch_score", "k04_fold_audit", "k09_release_gate", "n20_matrix_verification", "s03_idempotent_upsert",
        "n17_overfit_audit", "e49_generalisation_gap", "j06_gated_competition", "g08_paired_bootstrap", "k15_paired_diagnostic", "n12_release_closure", "i05_feature_vector", "i08_append_features", "n24_feature_assembly", "i14_image_perturbation", "g14_noise_stress", "j08_calibration", "n18_nested_calibration", "k03_preflight", "k07_sample_contract"]
#: VEINWORK_ALL=1 in the environment runs every query that has SQL.
if os.environ.get("VEINWORK_ALL"):
    SOME = sorted(x for x in entry.oracle_sql() if not x.startswith("op") and x != "pipeline")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, float) else str(v)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "part", "lineitem", "orders", "customer", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted((tuple(plain(x) for x in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
