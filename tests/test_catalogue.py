import pytest
from oracle import DATA, same
from pyspark.sql import functions as F

from quillstone.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(catalogue.QUERIES[name](spark, DATA), catalogue.SQL[name])


@pytest.mark.parametrize("name", ["commit_codec", "journal_codec", "person_codec", "tag_codec"])
def test_customers_of_one_row_group_are_coded_in_more_than_one_task(spark, name):
    rows = catalogue.QUERIES[name](spark, DATA)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
