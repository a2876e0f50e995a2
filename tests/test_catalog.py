import os

import pytest

import __spark_entry__
from relgrove.plans import catalog
from tests.compare import differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["subject_id", "object_id"]


@pytest.mark.parametrize("name", ["list_objects_direct", "wildcard_list_subjects", "userset_nested_recursive", "ttu_cross_type", "grouped_expression", "closure_inherited_exclusion", "contextual_check", "page_objects", "expand_users_leaf", "expand_users_unbounded", "expand", "expand_recursive", "explain", "check_depth_25", "contextual_subjects", "explain_intersection", "explain_exclusion", "explain_ttu", "explain_userset", "sql_functions", "bulk_from_arrays", "doctor_misfits", "doctor_signatures"])
def test_sql_gives_the_same_rows(spark, name):
    assert differences(spark, name, SF) is None


def test_all_have_a_query_and_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) and len(catalog.QUERIES) >= 65
