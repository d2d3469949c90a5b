"""Components over the links of all parts against a plain union-find."""

from __future__ import annotations

from loomspan.plans import catalogue


def plainly(lines, orders):
    customer, parent, first = dict(orders), {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for order, part, supplier in lines:
        c = customer.get(order)
        if c is None:
            continue
        parent.setdefault(c, c)
        a, b = find(c), find(first.setdefault((part, supplier), c))
        parent[max(a, b)] = min(a, b)
    sizes = {}
    for c in parent:
        sizes[find(c)] = sizes.get(find(c), 0) + 1
    return {(c, find(c)) for c in parent if sizes[find(c)] > 1}


def test_all_parts_link(spark, tmp_path):
    # parts 1, 7 and 20; customers 4 and 9 meet only through part 7
    lines = [(1, 20, 1), (2, 20, 1), (3, 1, 2), (4, 1, 2), (2, 7, 3), (3, 7, 3), (5, 1, 9), (6, 3, 3), (7, 3, 3)]
    orders = [(1, 3), (2, 4), (3, 9), (4, 10), (5, 11), (6, 12), (7, 13)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {tuple(r) for r in catalogue.queries()["connected_components"](spark, str(tmp_path)).select("node", "component").collect()}
    assert found == plainly(lines, orders)


def test_all_parts_link_in_the_tables(spark, duck, sf_dir):
    lines = duck.execute("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem").fetchall()
    orders = duck.execute("SELECT o_orderkey, o_custkey FROM orders").fetchall()
    found = {tuple(r) for r in catalogue.queries()["connected_components"](spark, sf_dir).select("node", "component").collect()}
    assert found == plainly(lines, orders)
