"""What a review of round 4 found, one small case each."""

import duckdb

from gleanery.operators import boards
from gleanery.plans import landed_queries
from tests.test_entry import normal


def test_company_pages_give_all_people(spark):
    """all people of a page, over several sections, in its order; hidden ones are counted, repeated ones once."""
    card = lambda i: f'<li><a href="/in/p-{i}"></a><h3>{"LinkedIn Member" if i % 10 == 0 else f"Ann {i}"}</h3><h4>x</h4></li>'
    section = lambda ids: f'<section data-test-id="employees-at"><ul>{"".join(map(card, ids))}</ul></section>'
    page = f'<link rel="canonical" href="https://www.linkedin.com/company/c/">{section(range(300, 100, -1))}{section(range(150))}'
    r = boards.company_pages(spark.createDataFrame([(page, "https://www.linkedin.com/company/c/")], "html string, company string")).first()
    assert [c.name for c in r.contacts] == [f"Ann {i}" for i in (*range(300, 100, -1), *range(101)) if i % 10]
    assert (r.status, r.masked) == ("found", 31)


def test_company_pages_query_counts_all_people(spark, tmp_path):
    """neither the query nor its SQL stops at a number of people."""
    spark.range(1, 141).selectExpr("id as c_custkey", "cast(id % 2 as int) as c_nationkey", "if(id % 10 = 0, -1.0D, 1.0D) as c_acctbal", "'S' as c_mktsegment").union(spark.range(141, 261).selectExpr("id", "0", "1.0D", "'S'")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3).selectExpr("cast(id as int) as n_nationkey", "0 as n_regionkey").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for name in ("customer", "nation"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = landed_queries.board_company_pages(spark, str(tmp_path)).toPandas()
    assert dict(zip(got.company, got.n_people, strict=True)) == {0: 176, 1: 70, 2: 0}
    assert normal(got) == normal(con.sql(landed_queries.ORACLE_SQL["board_company_pages"]).df())
