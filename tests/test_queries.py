"""A few registered queries against their SQL; ``python -m checks.compare`` runs them all."""

import pytest

from checks import registered
from checks.compare import connect, rows_of

QUERIES, ORACLES = registered()
SOME = ("q1_check_photos", "p06_photo_rows", "g05_item_truth", "w01_group_split", "a26_record_slices", "j10_greedy_matches",
        "w05_suppression", "a23_threshold_grid", "t06_line_matches", "a35_run_agreement", "a12_prototypes", "a13_several_prototypes",
        "a20_fitted_temperature", "e02_fitted_decision", "j11_detection_boxes", "a38_vector_gates", "s05_one_object", "a06_profile",
        "t06_document_lines", "k05_weighted_draws", "j16_closest_boxes", "a36_detector_agreement", "w03_risk_coverage")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 120
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    cursor = connect(folder).execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
