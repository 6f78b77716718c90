"""Queries over the test tables, each with the SQL that another engine answers alike.

``SUITE`` maps a name to (statement of the dialect, oracle SQL).  Where the oracle
text is None it is the statement itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.plans.run import query
from quillon.sources.parquet import relation

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def tables(spark: SparkSession, sf_dir: str) -> _Lazy:
    return _Lazy(spark, sf_dir)


class _Lazy:
    """Tables opened when a query names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.found = spark, sf_dir, {}

    def get(self, name: str):
        if name in TABLES and name not in self.found:
            self.found[name] = relation(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        return self.found.get(name)


def run(spark: SparkSession, sf_dir: str, text: str, params=()) -> DataFrame:
    return query(spark, text, tables(spark, sf_dir), params).df


def _nested(start: str, around: str, depth: int) -> str:
    for _ in range(depth):
        start = around.format(start)
    return start


#: Long arithmetic and long lists of arguments.
_CHAIN = "l_quantity" + "".join(f" {'-' if k % 3 else '+'} {c}" for k, c in enumerate(["l_tax", "l_discount", "l_quantity", "l_extendedprice"] * 15))
_TERMS = ", ".join(f"l_quantity * {k}.0 - l_extendedprice" for k in range(1, 13))

SUITE: dict[str, tuple[str, str | None]] = {
    # projection, filters, predicates
    "scan_star": ("SELECT * FROM nation", None),
    "scan_table_star": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey", None),
    "one_row": ("SELECT 1 AS one, 'x' AS x WHERE TRUE", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS x"),
    "project_alias": ("SELECT c_custkey AS k, c_name n, c_acctbal FROM customer", None),
    "filter_cmp": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000.0 AND o_orderkey <> 7", None),
    "filter_and_or_not": ("SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 45) AND NOT p_brand = 'Brand#11'", None),
    "filter_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12.5 AND l_discount NOT BETWEEN 0.02 AND 0.08", None),
    "filter_in_list": ("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)", None),
    "filter_like": ("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7_' AND c_mktsegment NOT LIKE 'b%g'", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%7_' AND lower(c_mktsegment) NOT LIKE 'b%g'"),
    "is_distinct_null": ("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL AND o_custkey IS NOT NULL AND nullif(o_orderpriority, '5-LOW') IS NOT '1-URGENT'", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL AND o_custkey IS NOT NULL AND nullif(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT'"),
    "filter_int_real": ("SELECT p_partkey FROM part WHERE p_size <= 4.5 AND p_partkey > 10.25 AND p_size != 3.0", None),
    "precedence": ("SELECT p_partkey, 1 + p_size * 2 > 30 = (p_size < 20) AS v FROM part", "SELECT p_partkey, ((1 + p_size * 2) > 30) = (p_size < 20) AS v FROM part"),
    # arithmetic and text operators
    "arith_int": ("SELECT o_orderkey, o_orderkey * 3 + o_custkey - 7 AS v, - o_custkey AS m FROM orders", None),
    "arith_real": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS v FROM lineitem", None),
    "int_division": ("SELECT o_orderkey, o_orderkey / 7 AS d, (0 - o_orderkey) / 4 AS m FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, CAST(trunc((0 - o_orderkey) / 4.0) AS BIGINT) AS m FROM orders"),
    "modulo": ("SELECT o_orderkey, o_orderkey % 7 AS m, (0 - o_orderkey) % 5 AS n FROM orders", None),
    "arith_chain": (f"SELECT l_orderkey, l_linenumber, {_CHAIN} AS v FROM lineitem", None),
    "arith_nested": (f"SELECT l_orderkey, l_linenumber, {_nested('l_quantity', '({} / 2.0 + l_tax) * 1.5', 12)} AS v FROM lineitem", None),
    "minmax_many": (f"SELECT l_orderkey, l_linenumber, min({_TERMS}) AS a, max({_TERMS}) AS b FROM lineitem", f"SELECT l_orderkey, l_linenumber, least({_TERMS}) AS a, greatest({_TERMS}) AS b FROM lineitem"),
    "substr_nested": (f"SELECT c_custkey, {_nested('c_name', 'substr({}, 1 + c_custkey % 2, length(c_name) - 1)', 6)} AS v FROM customer", f"SELECT c_custkey, {_nested('c_name', 'substr({}, 1 + c_custkey % 2, length(c_name) - 1)', 6)} AS v FROM customer"),
    "concat": ("SELECT c_custkey, c_name || '/' || c_mktsegment AS v FROM customer", None),
    # functions
    "fn_abs": ("SELECT c_custkey, abs(c_acctbal) AS a, abs(c_custkey - 100) AS b FROM customer", None),
    "fn_length": ("SELECT doc_id, length(text) AS n FROM documents", None),
    "fn_lower_upper": ("SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u FROM customer", None),
    "fn_trim": ("SELECT p_partkey, trim(p_name, 'pP') AS a, ltrim(p_brand, 'Brand') AS b, rtrim(p_type, 'EDR') AS c, trim('  ' || p_name || ' ') AS d FROM part", None),
    "fn_replace": ("SELECT p_partkey, replace(p_type, 'E', '__') AS v, replace(p_type, '', 'x') AS w FROM part", "SELECT p_partkey, replace(p_type, 'E', '__') AS v, p_type AS w FROM part"),
    "fn_instr": ("SELECT c_custkey, instr(c_mktsegment, 'IN') AS v FROM customer", "SELECT c_custkey, CAST(instr(c_mktsegment, 'IN') AS BIGINT) AS v FROM customer"),
    "fn_substr": ("SELECT c_custkey, substr(c_name, 3, 4) AS a, substr(c_name, -3) AS b, substr(c_name, -3, 2) AS c, substr(c_name, 2) AS d FROM customer", None),
    "fn_coalesce": ("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '5-LOW'), 'none') AS v, ifnull(nullif(o_orderstatus, 'O'), 'open') AS w FROM orders", None),
    "fn_nullif": ("SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS v FROM lineitem", None),
    "fn_min_max": ("SELECT l_orderkey, l_linenumber, min(l_tax, l_discount) AS a, max(l_orderkey, l_partkey, l_suppkey) AS b, max('a', nullif(l_returnflag, 'A')) AS c FROM lineitem", "SELECT l_orderkey, l_linenumber, least(l_tax, l_discount) AS a, greatest(l_orderkey, l_partkey, l_suppkey) AS b, CASE WHEN l_returnflag <> 'A' THEN greatest('a', l_returnflag) END AS c FROM lineitem"),
    "fn_round": ("SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS a, round(l_quantity, 3) AS b FROM lineitem", None),
    "fn_round_many": (
        "SELECT l_orderkey, l_linenumber, round(l_discount / 1e20, 25) AS a, round(l_discount / 1e20, 22) AS b, round(l_discount / 1e25, 24) AS c, round(l_quantity, 300) AS d FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100) AS BIGINT) || 'e-22' AS DOUBLE) AS a, CAST(CAST(round(l_discount * 100) AS BIGINT) || 'e-22' AS DOUBLE) AS b, 0.0::DOUBLE AS c, l_quantity AS d FROM lineitem",
    ),
    "fn_cast_number": ("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS a, CAST(l_orderkey AS REAL) AS b, CAST(CAST(l_partkey AS TEXT) AS INTEGER) AS c FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS a, CAST(l_orderkey AS DOUBLE) AS b, l_partkey AS c FROM lineitem"),
    "fn_cast_text": ("SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS a, CAST(o_orderkey > 50 AS TEXT) AS b, CAST(CAST(o_orderkey > 50 AS INTEGER) AS BOOLEAN) AS c FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey > 50 THEN 'true' ELSE 'false' END AS b, o_orderkey > 50 AS c FROM orders"),
    "fn_cast_timestamp": ("SELECT o_orderkey, CAST(o_orderdate AS TEXT) AS a, CAST(CAST(o_orderdate AS TEXT) AS TIMESTAMP) AS b FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS a, o_orderdate AS b FROM orders"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000.0 THEN 'high' WHEN o_totalprice > 100000.0 THEN 'mid' END AS v FROM orders", None),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS v FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS BIGINT) AS v FROM orders"),
    "case_lazy": ("SELECT o_orderkey, CASE WHEN o_custkey > 10 THEN 1000 / (o_custkey - 10) ELSE 0 END AS v FROM orders", "SELECT o_orderkey, CAST(CASE WHEN o_custkey > 10 THEN 1000 // (o_custkey - 10) ELSE 0 END AS BIGINT) AS v FROM orders"),
    # joins
    "join_inner": ("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", None),
    "join_left": ("SELECT o_orderkey, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45.0", None),
    "join_left_where_null": ("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL", None),
    "join_three": ("SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_range": ("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_partkey >= s_suppkey AND p_partkey < s_suppkey + 3", None),
    "join_like": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON b.n_name LIKE a.n_name || '%'", None),
    "join_cross_on_true": ("SELECT r_name, n_name FROM region JOIN nation ON TRUE", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_mixed": ("SELECT n_name, s_suppkey, c_custkey FROM nation JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000.0", None),
    # aggregation
    "agg_global": ("SELECT count(*) AS n, count(nullif(l_returnflag, 'N')) AS f, sum(l_orderkey) AS s, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem", "SELECT count(*) AS n, count(nullif(l_returnflag, 'N')) AS f, CAST(sum(l_orderkey) AS BIGINT) AS s, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem"),
    "agg_empty": ("SELECT count(*) AS n, sum(o_orderkey) AS s, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0"),
    "agg_group": ("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_group_expr": ("SELECT p_size / 10 AS decade, count(*) AS n FROM part GROUP BY p_size / 10", "SELECT CAST(p_size // 10 AS BIGINT) AS decade, count(*) AS n FROM part GROUP BY 1"),
    "agg_having": ("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 5 AND max(c_acctbal) > 9000.0", None),
    "agg_having_only": ("SELECT max(r_name) AS m FROM region HAVING count(*) = 5", None),
    "agg_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, sum(DISTINCT o_custkey) AS s, min(DISTINCT o_custkey) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, min(DISTINCT o_custkey) AS m FROM orders GROUP BY o_orderstatus"),
    "agg_minmax_text": ("SELECT c_mktsegment, min(c_name) AS a, max(c_name) AS b FROM customer GROUP BY c_mktsegment", None),
    "agg_avg": ("SELECT l_returnflag, round(avg(l_quantity), 4) AS q, round(avg(l_orderkey), 4) AS k FROM lineitem GROUP BY l_returnflag", None),
    "agg_constant_key": ("SELECT 1 AS one, count(*) AS n FROM nation GROUP BY 1, n_regionkey", "SELECT CAST(1 AS BIGINT) AS one, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "agg_exact_sum": ("SELECT o_orderstatus, round(sum(o_totalprice), 4) AS s, sum(DISTINCT o_totalprice) = sum(o_totalprice) AS same FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(fsum(o_totalprice), 4) AS s, fsum(DISTINCT o_totalprice) = fsum(o_totalprice) AS same FROM orders GROUP BY o_orderstatus"),
    "agg_exact_sum_large": (
        "SELECT sum(CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 1e16 WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN -1e16 ELSE 1.0 END) AS s, sum(CASE o_orderkey % 2 WHEN 0 THEN 0.0 ELSE 1e-3 END) AS t FROM orders",
        "SELECT CAST(count(*) - 2 AS DOUBLE) AS s, sum(CASE o_orderkey % 2 WHEN 0 THEN 0 ELSE 1 END) / 1000 AS t FROM orders",
    ),
    # order, limits, distinct
    "order_nulls": ("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey", None),
    "order_nulls_desc": ("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY nullif(o_orderstatus, 'P') DESC, o_orderkey DESC", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders"),
    "order_nulls_topk": ("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s, o_orderkey DESC LIMIT 40", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey DESC LIMIT 40"),
    "order_ordinal": ("SELECT c_mktsegment, c_custkey FROM customer ORDER BY 1 DESC, 2", None),
    "order_alias": ("SELECT o_orderkey AS k, 0 - o_orderkey AS o_orderkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey AS k, 0 - o_orderkey AS o_orderkey FROM orders ORDER BY 2"),
    "order_hidden": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey", None),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_order_hidden": ("SELECT DISTINCT c_mktsegment FROM customer ORDER BY length(c_mktsegment), c_mktsegment LIMIT 3", "SELECT c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) ORDER BY length(c_mktsegment), c_mktsegment LIMIT 3"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET 5", None),
    "limit_subquery": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) FROM region) * 2", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10"),
    "limit_negative": ("SELECT n_name FROM nation ORDER BY n_name LIMIT -1 OFFSET -3", "SELECT n_name FROM nation"),
    "topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10", None),
    # subqueries
    "sub_scalar": ("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", None),
    "sub_scalar_corr": ("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders", None),
    "sub_exists": ("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49.0)", None),
    "sub_not_exists": ("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", None),
    "sub_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000.0)", None),
    "sub_not_in_null": ("SELECT c_custkey FROM customer WHERE (c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)) IS NULL", None),
    "sub_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000.0)", None),
    "sub_in_value_3vl": ("SELECT n_nationkey, nullif(n_nationkey, 3) IN (SELECT nullif(s_nationkey, 5) FROM supplier WHERE s_acctbal < 3000.0) AS v FROM nation", None),
    "sub_not_in_empty": ("SELECT n_nationkey, n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0) AS v FROM nation", None),
    "sub_two_level": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = c_nationkey + 1))", None),
    "sub_in_having": ("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) FROM nation) * 2", None),
    "sub_over_group_key": ("SELECT c_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS s, count(*) AS n FROM customer GROUP BY c_nationkey", None),
    "sub_in_order_by": ("SELECT n_nationkey FROM nation ORDER BY (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) DESC, n_nationkey LIMIT 5", "SELECT n_nationkey FROM nation ORDER BY (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) DESC, n_nationkey LIMIT 5"),
    "sub_mixed_agg": ("SELECT n_nationkey, (SELECT sum(n_nationkey + r_regionkey) FROM region) AS v FROM nation", "SELECT n_nationkey, CAST(5 * n_nationkey + 10 AS BIGINT) AS v FROM nation"),
    "sub_corr_limit": ("SELECT n_nationkey, (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) AS v FROM nation", None),
    "sub_in_on": ("SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > (SELECT avg(s_acctbal) FROM supplier)", "WITH a AS (SELECT avg(s_acctbal) AS m FROM supplier) SELECT n_name, s_suppkey FROM nation LEFT JOIN (SELECT supplier.* FROM supplier, a WHERE s_acctbal > m) ON s_nationkey = n_nationkey"),
    "sub_corr_fallible": (
        "SELECT c_custkey, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE 1000 / l_linenumber > 200 AND o_custkey = c_custkey) AS n FROM customer",
        "SELECT c_custkey, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE 1000 // l_linenumber > 200 AND o_custkey = c_custkey) AS n FROM customer",
    ),
    "join_on_exists": (
        "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > s_acctbal + 9000.0)",
        "SELECT n_name, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > s_acctbal + 9000.0)) ON s_nationkey = n_nationkey",
    ),
    "sub_in_grouped_corr": ("SELECT o_orderkey FROM orders o WHERE o_totalprice IN (SELECT max(o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey)", None),
    "sub_empty_agg": ("SELECT n_nationkey, (SELECT count(*) + 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9500.0) AS v FROM nation", None),
    "sub_lazy_rows": ("SELECT n_nationkey, CASE WHEN n_nationkey < 0 THEN (SELECT s_suppkey FROM supplier) ELSE 1 END AS v FROM nation", "SELECT n_nationkey, CAST(1 AS BIGINT) AS v FROM nation"),
    # combinations
    "tpch_q1": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= CAST('2001-06-01T00:00:00Z' AS TIMESTAMP) GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY l_returnflag, l_linestatus"),
    "tpch_q3": ("SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < CAST('1998-06-01T00:00:00Z' AS TIMESTAMP) GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-06-01' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10"),
    "tpch_q4": ("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority", None),
    "tpch_q5": ("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name ORDER BY revenue DESC", None),
    "tpch_q6": ("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", None),
    "tpch_q10": ("SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20", None),
    "tpch_q12": ("SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus"),
    "tpch_q13": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%low%' GROUP BY c_custkey", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND lower(o_orderpriority) NOT LIKE '%low%' GROUP BY c_custkey"),
    "tpch_q14": ("SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'E%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey", "SELECT round(100.0 * sum(CASE WHEN lower(p_type) LIKE 'e%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "tpch_q18": ("SELECT c_name, o_orderkey, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250.0) GROUP BY c_name, o_orderkey", None),
    "events_by_user": ("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, max(value) AS top FROM events GROUP BY user_id HAVING count(*) > 2", None),
    "docs_by_lang": ("SELECT lang, source, count(*) AS n, max(length(text)) AS longest FROM documents GROUP BY lang, source", None),
    "labels_join": ("SELECT d.lang, l.quality, l.toxic, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang, l.quality, l.toxic", None),
}
