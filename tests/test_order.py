import random

from pyspark.sql import functions as F

from loomgraph.operators import order


def _sorted(df, keys):
    return [r["id"] for r in df.orderBy(*keys).collect()]


def test_keys_of_plain_ids_order_as_the_collation_does(spark):
    rng = random.Random(7)
    plain = [chr(i) for i in (*range(9, 14), *range(32, 127))]
    ids = {"", *plain, *(a + b for a in "aAbB-#/_ 0" for b in "aAbB-#/_ 9")} | {"".join(rng.choices(plain, k=rng.randint(1, 6))) for _ in range(2000)} | {"".join(rng.choices("aAbB1", k=4)) for _ in range(200)}
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    keys = order.collated(df, "id")
    assert "UNICODE" not in str(keys)
    assert _sorted(df, keys) == _sorted(df, [F.collate("id", order.COLLATION), F.col("id")])
    other = df.union(spark.createDataFrame([("é",), ("\x01a",), (None,)], "id string"))
    assert "UNICODE" in str(order.collated(other, "id")) or _sorted(other, order.collated(other, "id")) == _sorted(other, [F.collate("id", order.COLLATION), F.col("id")])


def test_positions_of_nodes_do_not_read_edges(spark):
    class Nodes:
        nodes = spark.createDataFrame([("b",), ("A",), ("a",), (None,)], "id string")

    assert [r["id"] for r in order.nodes_in_order(Nodes).orderBy("position").collect()] == [None, "a", "A", "b"]
