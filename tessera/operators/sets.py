"""Set operations."""

from __future__ import annotations

from tessera.registry import sql

_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 2000"
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql(f"set_{_name}", f"{_A} {_op} {_B}")
sql("set_union_by_name", "SELECT k, n FROM (SELECT n_nationkey AS k, n_name AS n FROM nation UNION ALL SELECT r_regionkey AS k, r_name AS n FROM region) t")
sql("set_union_widening", "SELECT k FROM (SELECT CAST(n_nationkey AS INT) AS k FROM nation UNION ALL SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) t")
