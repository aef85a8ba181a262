import random

from pyspark.sql import functions as F

from lodespar.functions import call
from lodespar.functions import geometry as g
from lodespar.operators.spatial import spatial_join


def test_join(spark):
    rng = random.Random(4)
    points = [(i, f"POINT ({rng.uniform(0, 10)} {rng.uniform(0, 10)})") for i in range(60)] + [(98, None), (99, "POINT EMPTY")]
    boxes = [(i, (x := rng.uniform(0, 9), y := rng.uniform(0, 9), w := rng.uniform(0.1, 3))[0] * 0 or f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y + w}, {x} {y}))") for i in range(25)]
    shape = lambda rows, k, s: spark.createDataFrame(rows, f"{k} int, w string").select(k, call("ansi", "ST_GeometryFromText", "w").alias(s))
    p, b = shape(points, "pid", "ps"), shape(boxes, "bid", "bs")
    want = {(i, j) for i, a in points if a for j, c in boxes if g.intersects(g.from_text(a), g.from_text(c))}
    assert {(r.pid, r.bid) for r in spatial_join(p, b, "ps", "bs", size=0.7).select("pid", "bid").collect()} == want
    left = spatial_join(p, b, "ps", "bs", size=5.0, kind="left")
    assert left.count() == len(want) + sum(not any(i == k for k, _ in want) for i, _ in points)
    near = {(i, j) for i, a in points if a for j, c in boxes if (g.distance(g.from_text(a), g.from_text(c)) or 9 if g.points(g.from_text(a)) else 9) <= 0.5 or (i, j) in want}
    got = [(r.pid, r.bid) for r in spatial_join(p, b, "ps", "bs", within=0.5, size=2.0).where(F.col("pid") < 90).select("pid", "bid").collect()]
    assert len(got) == len(set(got)) and set(got) == near
