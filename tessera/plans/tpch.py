"""The decision-support queries that the tables allow, adapted where columns are missing."""

from __future__ import annotations

from tessera.registry import sql

_REV = "l_extendedprice * (1 - l_discount)"

sql(
    "tpch_q1",
    f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum({_REV}), 4) AS sum_disc_price, round(sum({_REV} * (1 + l_tax)), 3) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
    round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
sql(
    "tpch_q3",
    f"""SELECT l_orderkey, round(sum({_REV}), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
sql(
    "tpch_q4",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)
    GROUP BY o_orderpriority""",
)
sql(
    "tpch_q5",
    f"""SELECT n_name, round(sum({_REV}), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name""",
)
sql("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
sql(
    "tpch_q7",
    f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum({_REV}), 4) AS revenue
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
    WHERE n1.n_regionkey <> n2.n_regionkey GROUP BY n1.n_name, n2.n_name, year(l_shipdate)""",
)
sql(
    "tpch_q8",
    f"""SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(CASE WHEN n2.n_regionkey = 1 THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS mkt_share
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
    GROUP BY year(o_orderdate)""",
)
sql(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, round(sum({_REV}), 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R'
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
sql(
    "tpch_q12",
    """SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_line_count,
    sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_line_count
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'N') GROUP BY l_linestatus""",
    """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
    CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'N') GROUP BY l_linestatus""",
)
sql(
    "tpch_q13",
    """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) t GROUP BY c_count""",
)
sql(
    "tpch_q14",
    f"""SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS promo_revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
sql(
    "tpch_q15",
    f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({_REV}), 4) AS total_revenue FROM lineitem GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
)
sql(
    "tpch_q17",
    """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
    JOIN (SELECT l_partkey AS k, 0.2 * avg(l_quantity) AS lim FROM lineitem GROUP BY l_partkey) t ON k = p_partkey WHERE l_quantity < lim""",
)
sql(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
    GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
sql(
    "tpch_q19",
    f"""SELECT round(sum({_REV}), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 16 AND 30 AND l_quantity BETWEEN 10 AND 20)""",
)
sql(
    "tpch_q22",
    """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
    WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    GROUP BY c_nationkey""",
)
# Late is a line shipped over 90 days after its order: the tables have no dates of commitment or receipt.
sql(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
    WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '90' DAY AND n_regionkey < 3
    AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
    AND NOT EXISTS (SELECT 1 FROM lineitem l3 JOIN orders o3 ON o3.o_orderkey = l3.l_orderkey
        WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o3.o_orderdate + INTERVAL '90' DAY)
    GROUP BY s_name""",
)
