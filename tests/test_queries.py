import pytest

from meshlark.plans import catalogue

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    same(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.model_checks()))
def test_model_check_equals_sql(spark, con, name):
    f, sql = catalogue.model_checks()[name]
    same(f(spark, SF), con, sql)


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0
