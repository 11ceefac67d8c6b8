"""A spread of named queries against their checking SQL (``python tests/oracle.py`` runs all)."""

import pytest

from keelson.queries import CATALOG
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
SPREAD = [
    "flagship_sector_fusion", "A02_A03_A04_P11_radar_bins", "J14_frame_point_matching", "J02_attitude_nearest", "A43_cut_stats", "W12_activity_sessions",
    "W02_sector_confirmation", "H01_heading_recommendation", "J06_F05_A12_association_chain", "A10_water_edge", "J11_A17_P37_target_table",
    "A21_stratified_report", "J15_box_scoring", "J17_nms", "J12_A29_bearing_report", "S12_A32_trial_summary", "P42_packet_decode", "A36_condition_matrix",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SPREAD)
def test_query(spark, con, name):
    status, detail = compare(spark, con, CATALOG[name], SF)
    assert status == "ok", (status, detail)


def test_entry_points():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120
