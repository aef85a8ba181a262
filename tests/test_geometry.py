import pytest
from pyspark.sql import functions as F

from lodespar.functions import binary, call
from lodespar.functions import geometry as g


@pytest.mark.parametrize("wkt", ["POINT (1 2)", "LINESTRING (0 0, 1 1.5, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POLYGON EMPTY"])
def test_forms(wkt):
    x = g.from_text(wkt)
    assert g.to_text(x) == wkt and g.to_text(g.from_binary(g.to_binary(x))) == wkt and g.to_text(g.from_json(g.to_json(x))) == wkt


SQUARE, HOLED = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"


@pytest.mark.parametrize("f,a,b,want", [
    (g.contains, SQUARE, "POINT (1 1)", True), (g.contains, SQUARE, "POINT (0 1)", False), (g.contains, HOLED, "POINT (2 2)", False), (g.contains, SQUARE, "LINESTRING (1 1, 3 3)", True), (g.contains, SQUARE, "LINESTRING (1 1, 5 5)", False),
    (g.contains, SQUARE, "POLYGON ((1 1, 2 1, 2 2, 1 1))", True), (g.intersects, SQUARE, "LINESTRING (-1 2, 9 2)", True), (g.intersects, HOLED, "POINT (2 2)", False), (g.touches, SQUARE, "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))", True),
    (g.touches, SQUARE, "POINT (0 0)", True), (g.overlaps, SQUARE, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))", True), (g.overlaps, SQUARE, SQUARE, False), (g.crosses, "LINESTRING (-1 2, 9 2)", SQUARE, True), (g.crosses, "LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", True),
    (g.equals, "LINESTRING (0 0, 2 2)", "LINESTRING (2 2, 1 1, 0 0)", True), (g.distance, SQUARE, "POINT (7 8)", 5.0), (g.distance, SQUARE, "POINT (2 2)", 0.0),
])
def test_relations(f, a, b, want):
    assert f(g.from_text(a), g.from_text(b)) == want


def test_measures():
    assert g.area(g.from_text(HOLED)) == 12 and g.length(g.from_text(SQUARE)) == 16 and g.to_text(g.centroid(g.from_text(SQUARE))) == "POINT (2 2)"
    assert g.to_text(g.convex_hull(g.from_text("MULTIPOINT ((0 0), (2 0), (1 1), (2 2), (0 2))"))) == "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"


def test_columns(spark):
    c = lambda n, *a: call("ansi", n, *a)
    x = spark.createDataFrame([(SQUARE, 1.0, 1.0), (None, 1.0, 1.0)], "w string, x double, y double")
    shape = c("ST_GeometryFromText", "w")
    got = x.select(c("ST_Contains", shape, c("ST_Point", "x", "y")).alias("a"), c("ST_Area", shape).alias("b"), c("ST_AsText", c("ST_Envelope", shape)).alias("e")).collect()
    assert [tuple(r) for r in got] == [(True, 16.0, "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))"), (None, None, None)]


def test_bytes_and_addresses(spark):
    assert binary.murmur3_x64_128(b"") == b"\0" * 16 and binary.murmur3_x64_128(b"The quick brown fox jumps over the lazy dog").hex() == "6c1b07bc7bbc4be347939ac4a93c437a"
    c = lambda n, *a: call("ansi", n, *a)
    r = spark.range(1).select(
        F.hex(c("hmac_sha256", F.lit("what do ya want for nothing?"), F.lit("Jefe"))).alias("h"), c("from_ieee754_64", c("to_ieee754_64", F.lit(1.5))).alias("d"), c("ip_prefix", F.lit("192.168.255.255"), 9).alias("p"), c("is_subnet_of", F.lit("1.2.3.128/26"), F.lit("1.2.3.129")).alias("s"),
        c("is_private_ip", F.lit("10.0.0.1")).alias("v"), c("ip_prefix_collapse", F.array(F.lit("192.168.0.0/24"), F.lit("192.168.1.0/24"))).alias("k"), c("normalize", F.lit("é")).alias("n"),
    ).first()
    assert r.h == "5BDCC146BF60754E6A042426089575C75A003F089D2739839DEC58B964EC3843" and r.d == 1.5 and r.p == "192.128.0.0/9" and r.s and r.v and r.k == ["192.168.0.0/23"] and r.n == "é"


def test_simplify_and_nearest():
    assert g.to_text(g.simplify(g.from_text("LINESTRING (0 0, 1 0.1, 2 0, 3 2)"), 0.5)) == "LINESTRING (0 0, 2 0, 3 2)"
    assert g.to_text(g.simplify(g.from_text(HOLED), 2.5)) == SQUARE and g.simplify(g.from_text(HOLED), 9.0)[1] == []
    a, b = g.nearest_points(g.from_text(SQUARE), g.from_text("POINT (7 2)"))
    assert (g.to_text(a), g.to_text(b)) == ("POINT (4 2)", "POINT (7 2)")


def test_tiles(spark):
    t = g._tile(3, 5, 3)
    box = g.tile_polygon(t)
    centre = g.centroid(box)
    assert g.tiles_of(centre, 3) == [t] and len(g.tiles_of(box, 4)) >= 4 and len(g.tiles_around(0.0, 0.0, 3)) == 9 and len(g.tiles_around(0.0, 0.0, 1)) == 4
    inner = g._box((-179.0, -80.0, 179.0, 80.0))
    assert g.dissolved_tiles(inner, 3) == [g._tile(0, 0, 0)]
    x = spark.range(1).select(call("ansi", "bing_tile_at", 10.0, 20.0, 7).alias("a"), call("ansi", "bing_tiles_around", F.lit(10.0), F.lit(20.0), F.lit(7)).alias("b")).first()
    assert x.a in x.b and g._tile_at(20.0, 10.0, 7) == g._untile(x.a)[:2]


def test_equal_arguments_are_worked_out_once():
    import pyarrow as pa

    calls, kept = [], {}
    cols = (pa.array([b"a", None, b"a", b"b", b"a"] * 40), pa.array([0.0, 1.0, 0.0, float("nan"), -0.0] * 40), pa.array([[b"x"], [], None, [b"x"], [b"x"]] * 40, pa.list_(pa.binary())), pa.nulls(200))
    want = [repr(r) for r in zip(*[c.to_pylist() for c in cols])]
    one = lambda row: calls.append(row) or repr(row)
    assert g._each(one, cols, kept) == want and len(calls) == 5
    assert g._each(one, cols, kept) == want and len(calls) == 5
    large = (pa.array([b"z" * 1000] * 9),)
    assert g._each(one, large, kept) == g._each(one, large, kept) and len(calls) == 7
    many = (pa.array(range(5000)),)
    assert g._each(lambda row: row[0], many, kept) == list(range(5000)) and len(kept) <= g.KEPT
    assert g._each(one, (pa.array([], pa.float64()),), kept) == []


def test_few_tasks_are_spread(spark, sf_dir):
    from lodespar.plans import ansi_queries

    assert ansi_queries.shapes(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
