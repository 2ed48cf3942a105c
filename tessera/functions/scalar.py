"""The function catalogue: a registered query for each function, over a table or a stated example.

``SPEC`` has a line a function: name, view, kind of value, Spark expression and, where the oracle's
dialect differs, its expression. Kinds are l (whole number), d (number, rounded), s (text), b (truth
value) and a (array, compared as text). Views are the tables under short names; view 1 is a single row,
for functions that are held against a stated value, and CD has distinct keys, for sketches beside an exact count.
"""

from __future__ import annotations

from tessera.functions.spec import AGGREGATES, SCALARS
from tessera.registry import sql

_VIEWS = {
    "1": ("SELECT 1 AS k", None),
    "C": ("SELECT c_custkey AS k, c_name AS s, c_acctbal AS d, c_nationkey AS i, c_mktsegment AS g FROM customer", None),
    "CD": (
        "SELECT DISTINCT c_custkey AS k, c_mktsegment AS g FROM customer",
        "SELECT c_custkey AS k, c_name AS s, c_acctbal AS d, c_nationkey AS i, c_mktsegment AS g FROM customer",
    ),
    "O": ("SELECT o_orderkey AS k, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS dt, o_totalprice AS d, o_custkey AS i, o_orderpriority AS s FROM orders", None),
    "E": ("SELECT event_id AS k, ts, user_id AS i, value AS d, props AS j, event_type AS s FROM events", None),
    "A": (
        "SELECT c_custkey AS k, array(c_nationkey, c_custkey % 7, c_nationkey, 3L) AS a, array(c_custkey % 5, 3L, NULL) AS b, array('x', c_mktsegment, 'y') AS w FROM customer",
        "SELECT c_custkey AS k, [c_nationkey, c_custkey % 7, c_nationkey, 3] AS a, [c_custkey % 5, 3, NULL] AS b, ['x', c_mktsegment, 'y'] AS w FROM customer",
    ),
    "M": (
        "SELECT c_custkey AS k, map('n', CAST(c_nationkey AS BIGINT), 'c', c_custkey) AS m, c_mktsegment AS g FROM customer",
        "SELECT c_custkey AS k, MAP {'n': CAST(c_nationkey AS BIGINT), 'c': c_custkey} AS m, c_mktsegment AS g FROM customer",
    ),
    "P": ("SELECT page_id AS k, url AS u FROM pages", None),
    "L": ("SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity AS q, l_extendedprice AS d, l_discount AS e, l_tax AS t, l_suppkey AS i, l_returnflag AS g FROM lineitem", None),
}
_KINDS = {
    "l": ("CAST({} AS BIGINT)",) * 2,
    "d": ("round(CAST({} AS DOUBLE), 6)",) * 2,
    "s": ("CAST({} AS STRING)", "CAST({} AS VARCHAR)"),
    "b": ("({})",) * 2,
    "a": ("array_join(transform({}, e -> CAST(e AS STRING)), ',', 'N')", "array_to_string([coalesce(CAST(e AS VARCHAR), 'N') for e in {}], ',')"),
}


def _lines(text: str):
    for line in text.strip().splitlines():
        if line.strip() and not line.startswith("--"):
            name, view, kind, *exprs = (x.strip() for x in line.split("¦"))
            yield name, view, kind, exprs[0], exprs[-1]


for _name, _view, _kind, _spark, _duck in _lines(SCALARS):
    _a, _b = _VIEWS[_view]
    sql(f"fn_{_name}", f"SELECT k, {_KINDS[_kind][0].format(_spark)} AS v FROM ({_a}) t", f"SELECT CAST(k AS {'INT' if _view == '1' else 'BIGINT'}) AS k, {_KINDS[_kind][1].format(_duck)} AS v FROM ({_b or _a}) t")

for _name, _view, _kind, _spark, _duck in _lines(AGGREGATES):
    _a, _b = _VIEWS[_view]
    sql(f"agg_fn_{_name}", f"SELECT g, {_KINDS[_kind][0].format(_spark)} AS v FROM ({_a}) t GROUP BY g", f"SELECT g, {_KINDS[_kind][1].format(_duck)} AS v FROM ({_b or _a}) t GROUP BY g")
