import pytest

from millrace.plans import catalog

from .compare import mismatch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_are_those_of_the_sql(spark, name):
    assert mismatch(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF) is None
