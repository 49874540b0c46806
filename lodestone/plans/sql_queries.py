"""The SQL surface: text that Spark SQL runs as it is."""

from __future__ import annotations

from lodestone.plans.registry import QUERIES, query, spark_sql

spark_sql("sql_filter_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity < 5 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag <> 'N'", "lineitem")
spark_sql("sql_join_multiway", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name", "orders customer nation region")
spark_sql("sql_join_outer", "SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "customer orders")
spark_sql("sql_join_full", "SELECT coalesce(n_nationkey, -1) AS nation, count(s_suppkey) AS suppliers, count(n_name) AS named FROM nation FULL OUTER JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY coalesce(n_nationkey, -1)", "nation supplier")
spark_sql("sql_semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)", "orders lineitem")
spark_sql("sql_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "customer orders")
spark_sql("sql_theta_join", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
spark_sql("sql_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <> n_regionkey", "region nation")
spark_sql("sql_group_having", "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_custkey HAVING count(*) > 8", "orders")
spark_sql("sql_count_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag", "lineitem")
spark_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
spark_sql("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
spark_sql("sql_grouping_sets", "SELECT event_type, user_id % 4 AS part, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), ())", "events", "SELECT event_type, part, count(*) AS n FROM (SELECT event_type, user_id % 4 AS part FROM events) GROUP BY GROUPING SETS ((event_type), (part), ())")
spark_sql("sql_rank", "SELECT o_custkey, o_orderkey, rk, dr FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS dr FROM orders) AS x WHERE rk <= 3", "orders")
spark_sql("sql_running_sum", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM events", "events")
spark_sql("sql_moving_average", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM events", "events")
spark_sql("sql_lag", "SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events", "events")
spark_sql("sql_ntile", "SELECT c_custkey, ntile(7) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS tile FROM customer", "customer")
spark_sql("sql_correlated", "SELECT s_suppkey, s_acctbal FROM supplier s WHERE s_acctbal > (SELECT avg(s2.s_acctbal) FROM supplier s2 WHERE s2.s_nationkey = s.s_nationkey)", "supplier")
spark_sql("sql_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)", "orders")
spark_sql("sql_setops", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", "customer supplier nation")
spark_sql("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer supplier")
spark_sql("sql_union_all", "SELECT 'c' AS kind, c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey", "customer supplier")
spark_sql("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5", "orders")
spark_sql("sql_case", "SELECT o_orderpriority, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS tier, count(*) AS n FROM orders WHERE o_orderstatus LIKE 'F%' OR o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderpriority, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END", "orders")
spark_sql("sql_scalars", "SELECT c_custkey, upper(substr(c_name, 1, 4)) AS head, length(c_name) AS n, abs(round(c_acctbal, 1)) AS bal, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer", "customer")
spark_sql("sql_dates", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)", "orders")
spark_sql("sql_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
spark_sql("sql_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t", "region")
spark_sql("sql_tpch_q1", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", "lineitem")
spark_sql("sql_tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10", "customer orders lineitem")
spark_sql("sql_tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", "customer orders lineitem supplier nation")


@query()
def sql_approximate(t):
    from pyspark.sql import functions as F

    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


assert "sql_approximate" in QUERIES
