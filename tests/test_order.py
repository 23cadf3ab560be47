import random

from pyspark.sql import functions as F

from lexiloom.operators import order



def test_running_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 3)
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), k, rng.randint(0, 5)) for k in range(60)]
    df = spark.createDataFrame(data, "g string, pos long, v long").withColumn("block", order.block_of("pos"))
    got = {(r.g, r.pos): r.s for r in order.running_sum(df, ["g"], ["block"], ["pos"], F.col("v"), "s").collect()}
    assert got == {(g, p): sum(v for h, q, v in data if h == g and q <= p) for g, p, _ in data}
    ranks = sorted(r.k for r in order.rank_from_zero(df, ["g"], ["block"], ["pos"], "k").where("g is null").collect())
    assert ranks == list(range(len(ranks)))
    assert order.running_sum(df.where("false"), ["g"], ["block"], ["pos"], F.col("v"), "s").count() == 0
