"""Every registered query against its DuckDB SQL on the smallest tables."""

import re

import pytest

from sightline.registry import COVERS, ORACLES, QUERIES
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, con, name):
    assert not difference(spark, small, con, QUERIES[name], ORACLES[name])


#: Operators of the survey that no query claims: model inference, HTTP, PDF, a vector database, the cache.
NOT_REBUILT = {"S21", "S23", "S24", "S25", "X5"}
#: Rows of the survey by family.
FAMILIES = {"S": 25, "P": 52, "Q": 8, "F": 18, "J": 26, "A": 46, "W": 21, "U": 6, "C": 21, "G": 19, "T": 7, "X": 6}


def labels(text):
    return [w for w in text.split(":")[0].split() if re.fullmatch("[A-Z][0-9]+", w)] if ":" in text else []


def test_every_query_says_what_it_covers_and_every_operator_is_said():
    assert set(COVERS) == set(QUERIES) and all(COVERS.values())
    said = {label for text in COVERS.values() for label in labels(text)}
    every = {f"{family}{i}" for family, n in FAMILIES.items() for i in range(1, n + 1)}
    assert said <= every
    assert every - said == NOT_REBUILT | INSIDE


#: Operators that work on the driver's settings and have a unit test instead of a query.
INSIDE = {"P48"}


def test_range_join_has_no_nested_loop(spark, small):
    plan = QUERIES["range_join_edges"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_only_its_columns(spark, small):
    plan = QUERIES["track_left_join"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
