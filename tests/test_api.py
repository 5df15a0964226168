import pytest

from loomgraph.api import Engine, main
from loomgraph.operators import lookup
from loomgraph.plans import report
from loomgraph.sources import store
from tests.graphs import SHORT, shop


def test_answers(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    engine = Engine(spark, str(tmp_path), folder)
    with pytest.raises(LookupError):
        engine.search("x")
    store.save_graph(shop(spark, without_nodes=("Orphan",)), folder, "r", "2026-01-01T00:00:00.000Z")
    store.save_graph(shop(spark), folder, "r", "2026-01-02T00:00:00.000Z")
    assert "CartList" in engine.search("cartl") and "Medium" in engine.impact("Button")
    assert "4 hops" in engine.trace("/cart", "GET /api/orders") and engine.trace("/cart", "/cart").startswith("No flow path")
    assert "added" in engine.diff() and "Orphan" in engine.timeline()
    assert "| 1 | 4 |" in engine.what_if("remove", "CartCtx").replace("| 2 |", "") or "Medium" in engine.what_if("remove", "CartCtx")
    assert "cart" in engine.feature() and "CartList" in engine.feature("CART")
    with pytest.raises(LookupError, match="orders"):
        engine.feature("nope")
    assert "search" in engine.savings()


def test_pages_and_trees(spark, tmp_path):
    graph = shop(spark)
    assert report.component_tree(graph, SHORT["CartPage"]) == "- CartPage (app/cart/page.tsx)\n  - CartList\n    - Button"
    text = report.page(graph, "a <b>", f"{tmp_path}/page")
    rows = "".join(p.read_text() for p in (tmp_path / "page" / "nodes").glob("part-*"))
    assert "a &lt;b&gt;" in text and "edges/part-" in text and "CartList" in rows and "<" not in rows
    assert report.flowchart(graph, lookup.out_edges(graph, SHORT["CartPage"]).selectExpr("src", "dst", "kind AS label")).count("-->") == 2


def test_command_line_errors(spark, tmp_path, capsys):
    assert main(["--folder", str(tmp_path / "none"), "search", "x"]) == 1 and "error" in capsys.readouterr().out
