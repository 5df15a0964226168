"""A small authored graph with answers worked out by hand."""

from loomgraph.schema import EDGES, NODES, Graph

NODE_ROWS = [
    ("route:/cart", "route", "/cart", "app/cart/page.tsx", None, None, None),
    ("route:/orders", "route", "/orders", "app/orders/page.tsx", None, None, None),
    ("route:/help", "route", "/help", None, None, None, None),
    ("app/cart/page.tsx#CartPage", "component", "CartPage", "app/cart/page.tsx", 20, None, None),
    ("app/orders/page.tsx#OrdersPage", "component", "OrdersPage", "app/orders/page.tsx", 30, None, None),
    ("src/CartList.tsx#CartList", "component", "CartList", "src/CartList.tsx", 160, None, None),
    ("src/Button.tsx#Button", "component", "Button", "src/Button.tsx", 10, None, None),
    ("src/Orphan.tsx#Orphan", "component", "Orphan", "src/Orphan.tsx", 5, None, None),
    ("src/useCart.ts#useCart", "hook", "useCart", "src/useCart.ts", 12, None, None),
    ("src/useOld.ts#useOld", "hook", "useOld", "src/useOld.ts", 8, None, None),
    ("src/ctx.ts#CartCtx", "context", "CartCtx", "src/ctx.ts", None, None, None),
    ("api:POST /orders", "api", "POST /orders", None, None, None, None),
    ("api:GET /api/orders", "api", "GET /api/orders", None, None, None, None),
    ("api:ROUTE /api/orders", "api", "/api/orders", "app/api/orders/route.ts", None, None, True),
    *[(f"src/{x}.ts", "file", f"{x}.ts", f"src/{x}.ts", None, None, None) for x in "abc"],
]
SHORT = {r[2]: r[0] for r in NODE_ROWS} | {"a": "src/a.ts", "b": "src/b.ts", "c": "src/c.ts"}
EDGE_ROWS = [
    ("/cart", "routes_to", "CartPage"), ("/orders", "routes_to", "OrdersPage"), ("CartPage", "renders", "CartList"), ("CartList", "renders", "Button"), ("OrdersPage", "renders", "Button"),
    ("CartList", "uses", "useCart"), ("useCart", "uses", "CartCtx"), ("CartList", "calls", "POST /orders"), ("OrdersPage", "calls", "GET /api/orders"), ("CartPage", "navigates_to", "/orders"),
    ("OrdersPage", "navigates_to", "/help"), ("a", "imports", "b"), ("b", "imports", "a"), ("c", "imports", "a"), ("c", "imports", "c"),
]


def shop(spark, without_nodes=(), without_edges=()):
    nodes = [(i, t, n, f, None, None, None, s, loc, d) for i, t, n, f, loc, s, d in NODE_ROWS if n not in without_nodes]
    edges = [(SHORT[a], SHORT[b], k, None, None, None) for a, k, b in EDGE_ROWS if (a, b) not in without_edges]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def names(df, column="id"):
    back = {v: k for k, v in SHORT.items() if not (k.endswith(".ts") and "/" not in k)}
    return {back.get(r[column], r[column]) for r in df.collect()}
