import pytest

from caseflow.plans.catalog import result_shape, to_json_rows
from caseflow.plans.sql import QueryRejected, query


@pytest.fixture(scope="module")
def views(spark, fixture_facts):
    spark.range(3).createOrReplaceTempView("secret_view")
    spark.range(3).createOrReplaceGlobalTempView("other_tenant")
    spark.udf.register("my_function", lambda x: x)
    spark.sql("CREATE TABLE IF NOT EXISTS stored_table USING parquet AS SELECT 1 AS id")
    spark.sql("CREATE OR REPLACE VIEW stored_view AS SELECT 1 AS id")
    yield {"disease_data": fixture_facts}
    spark.sql("DROP VIEW stored_view")
    spark.sql("DROP TABLE stored_table")


@pytest.mark.parametrize("sql", [
    "", "   ", "DROP TABLE disease_data", "SELECT 1; DROP TABLE x", "INSERT INTO disease_data SELECT * FROM disease_data",
    "SHOW TABLES", "SET spark.sql.ansi.enabled=false", "CREATE TABLE x AS SELECT 1", "not sql at all",
    "SELECT * FROM secret_view", "SELECT * FROM disease_data a, secret_view b", "SELECT * FROM global_temp.other_tenant",
    "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM disease_data WHERE count IN (SELECT id FROM secret_view)",
    "SELECT (SELECT max(id) FROM secret_view) AS m FROM disease_data",
    "WITH s AS (SELECT * FROM secret_view) SELECT * FROM s", "SELECT * FROM disease_data UNION SELECT * FROM secret_view",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM disease_data",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM range(5)",
    "SELECT no_such_column FROM disease_data", "SELECT * FROM IDENTIFIER('secret_view')", "SELECT * FROM IDENTIFIER('disease' || '_data')",
    "EXECUTE IMMEDIATE 'SELECT * FROM secret_view'", "EXECUTE IMMEDIATE 'SELECT * FROM disease_data'",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')", "SELECT IDENTIFIER('upper')('a')",
    "DESCRIBE TABLE secret_view", "DESCRIBE disease_data", "ALTER TABLE secret_view RENAME TO b", "ALTER VIEW secret_view AS SELECT 1",
    "TRUNCATE TABLE disease_data", "REFRESH TABLE secret_view", "EXPLAIN SELECT * FROM disease_data", "CACHE TABLE disease_data",
    "DECLARE x INT DEFAULT 1", "BEGIN SELECT 1; END", "MERGE INTO disease_data USING disease_data b ON true WHEN MATCHED THEN DELETE",
    "SELECT TRANSFORM(state) USING 'cat' FROM disease_data", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT my_function(state) FROM disease_data", "SELECT session.my_function(state) FROM disease_data",
    "SELECT builtin.reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT system.builtin.upper(state) FROM disease_data",
    "SELECT current_user()", "SELECT input_file_name() FROM disease_data", "SELECT * FROM stored_table", "SELECT * FROM default.stored_table",
    "SELECT * FROM spark_catalog.default.stored_table", "SELECT * FROM stored_view", "SELECT * FROM disease_data TIMESTAMP AS OF '2024-01-01'",
    "SELECT * FROM disease_data WHERE EXISTS (SELECT 1 FROM secret_view)", "SELECT * FROM disease_data a, LATERAL (SELECT * FROM secret_view) b",
    "SELECT * FROM (SELECT * FROM secret_view) disease_data", "WITH disease_data AS (SELECT * FROM secret_view) SELECT * FROM disease_data",
    "FROM secret_view SELECT *", "TABLE secret_view", "SELECT max(id) FILTER (WHERE id IN (SELECT id FROM secret_view)) FROM (SELECT 1 AS id)",
    "SELECT transform(array(1), x -> (SELECT max(id) FROM secret_view)) AS y", "SELECT 1 ORDER BY (SELECT max(id) FROM secret_view)",
    "SELECT * FROM disease_data JOIN secret_view USING (id)", "SELECT 1 LIMIT (SELECT max(id) FROM secret_view)",
    "WITH RECURSIVE r AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM r) SELECT * FROM r",
])
def test_rejected(spark, views, sql):
    with pytest.raises(QueryRejected):
        query(spark, sql, views).collect()


@pytest.mark.parametrize("sql", [
    "SELECT REPLACE(disease_name, 'a', 'b') AS x FROM disease_data",
    "SELECT 'drop; insert' AS x FROM disease_data LIMIT 1",
    "WITH m AS (SELECT disease_name, SUM(count) AS c FROM disease_data GROUP BY 1) SELECT * FROM m ORDER BY disease_name",
    "SELECT a.state FROM disease_data a JOIN disease_data b ON a.state = b.state",
    "SELECT explode(sequence(1, 2)) AS i FROM disease_data", "SELECT state, i FROM disease_data LATERAL VIEW explode(array(1, 2)) t AS i",
    "SELECT * FROM VALUES (1, 'a') AS v(x, y)", "SELECT state, row_number() OVER (PARTITION BY state ORDER BY count) AS n FROM disease_data",
    "SELECT state, sum(count) AS c FROM disease_data GROUP BY ROLLUP (state) HAVING sum(count) > 0 ORDER BY 1 LIMIT 3 OFFSET 1",
    "SELECT * FROM (SELECT state, data_source, count FROM disease_data) PIVOT (sum(count) FOR data_source IN ('nndss', 'tracker'))",
    "SELECT DISTINCT state FROM disease_data WHERE state IN (SELECT state FROM disease_data WHERE count > 1) EXCEPT SELECT 'TX'",
    "SELECT state, (SELECT max(count) FROM disease_data b WHERE b.state = a.state) AS m FROM disease_data a",
    "WITH secret_view AS (SELECT 1 AS id) SELECT * FROM secret_view", "SELECT a.state FROM DISEASE_DATA a",
    "SELECT CASE WHEN count > 1 THEN 'x' ELSE 'y' END AS c, transform(array(1, 2), x -> x + 1) AS t FROM disease_data",
])
def test_allowed(spark, views, sql):
    assert query(spark, sql, views).collect()


def test_session_keeps_no_trace(spark, views):
    before = sorted(t.name for t in spark.catalog.listTables())
    rows = query(spark, "SELECT state, count FROM facts", {"facts": views["disease_data"]})
    assert sorted(t.name for t in spark.catalog.listTables()) == before
    # the result is the caller's: it joins with its frames and runs again
    assert rows.join(views["disease_data"].select("state").distinct(), "state").count() == rows.where("state IS NOT NULL").count()


def test_settings_of_the_caller_hold(spark, views):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert query(spark, "SELECT CAST('x' AS INT) AS i", views).collect()[0].i is None
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_json_rows_format_dates(spark, fixture_facts):
    from caseflow.plans import queries as Q
    series = Q.national_timeseries(fixture_facts, "measles")
    assert any('"period":"2024-01-01"' in r["json"] for r in to_json_rows(series).collect())
    assert result_shape(series) == {"columns": ["disease_name", "period", "total_cases"], "row_count": series.count()}
