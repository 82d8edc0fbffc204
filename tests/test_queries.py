import pytest
from conftest import DATA, same

import __spark_entry__
from codeloom.plans import more  # noqa: F401
from codeloom.plans import queries as plans


@pytest.mark.parametrize("name", list(plans.SQL))
def test_query_is_what_its_sql_says(spark, duck, name):
    same(plans.QUERIES[name](spark, DATA), duck.execute(plans.SQL[name]))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def chain(spark, tmp_path, ends):
    """Tables of files first .. last, each of which depends on the next; 7 is the entry, 8 was modified, 4 is a test."""
    first, last = ends
    sizes = {7: 50, 8: 48, 4: 1}
    part = [(k, "n", "b", "t", sizes.get(k, 20)) for k in range(first, last + 1)]
    item = [(k, k + i, 1, i, 1.0, 1.0, 0.0, "A", "1998-08-01") for k in range(first, last) for i in (0, 1)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_shipdate string"
    spark.createDataFrame(item, names).selectExpr("* except (l_shipdate)", "l_shipdate::timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_five_levels(spark, tmp_path):
    sf = chain(spark, tmp_path, (1, 13))
    got = lambda name, *columns: {tuple(r) for r in plans.QUERIES[name](spark, sf).select(*columns).collect()}
    assert got("blast_dependents", "node", "depth") == {(7 - d, d) for d in range(1, 6)}
    assert got("blast_dependencies", "node", "depth") == {(7 + d, d) for d in range(1, 6)}
    assert got("blast_truncated", "truncated") == {(True,)}
    assert got("review_impact", "node", "depth") == {(8 - d, d) for d in range(1, 6)}
    assert got("candidate_tests", "node", "depth") == {(4, 4)}
    assert got("no_known_tests", "node") == set()
    assert got("impact_evidence", "src", "dst") == {(8 - d, 9 - d) for d in range(1, 6)}


def test_nothing_is_cut_within_five_levels(spark, tmp_path):
    assert not plans.QUERIES["blast_truncated"](spark, chain(spark, tmp_path, (2, 12))).first().truncated


def test_entries_have_no_edge_of_any_kind(spark, tmp_path):
    orders = [(1, 10, "1-URGENT"), (2, 11, "1-URGENT"), (3, 11, "5-LOW"), (4, 12, "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").selectExpr("*", "timestamp '1998-08-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(10,), (11,), (12,), (13,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert {r.node for r in plans.QUERIES["inferred_entries"](spark, str(tmp_path)).collect()} == {10, 13}
