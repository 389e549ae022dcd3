"""A selection of registered queries beside DuckDB (``compare.py`` runs them all)."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = ("canon_columns", "entity_keys", "kpis", "breakdowns_gs", "camp_stats", "assignment_totals", "running_max_delta", "completion",
          "company_table_filtered", "center_table", "residence_facts", "residence_coverage", "facets", "stratified_sample",
          "camera_plan_join", "plans_csv", "stream_ingest", "camps_csv", "residences_csv", "gates_json", "dq_missing_columns",
          "dq_row_width", "connected_routes", "connected_routes_exits", "route_gaps_shifted", "camera_stats", "camera_direction", "exit_routes_geojson",
          "exit_points_geojson", "republished_snapshot", "stream_files", "dq_no_data", "wildcard_lookup", "exit_route_lookup", "entity_sort", "by_path_order", "filter_entrance_camp", "available_labels")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name]) is None


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
