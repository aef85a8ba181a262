"""What the functions are documented to give, where a name of Spark's means something else."""

import math

import pytest
from pyspark.sql import functions as F

from lodespar import operators as O
from lodespar.functions import buckets, call
from lodespar.sources import read_delimited


def p(name, *args, **options):
    return call("ansi", name, *args, **options)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("values,kind,want", [
    ([1], "bigint", "vmaSXOnPGBc="), ([0], "int", "AAAAAAAAAAA="), ([None], "int", "h8rrhbF5N54="), ([1, 2, 3], "smallint", "1g6VH0bvnP4="), ([1, 2, 3], "tinyint", "1g6VH0bvnP4="), ([1.0], "double", "AAAIJ+Q63dI="), ([99.9], "double", "iVY+6I1lKyo="),
    ([1.0, 2.0, 3.0], "double", "AACEg9cR14o="), ([math.nan] * 3, "double", "AACMau93L28="), ([-0.0], "double", "AAAAAAAAAAA="), ([[1, 2], [3, 4]], "array<bigint>", "/jjpuD6xkXs="), ([[12, None]], "array<bigint>", "sr3HNuzc+7Y="), ([[1, 2], None, []], "array<bigint>", "Nlzernkj88A="),
])
def test_checksum(spark, values, kind, want):
    assert spark.createDataFrame([(v,) for v in values], f"x {kind}").agg(F.base64(p("checksum", "x"))).first()[0] == want


def test_checksum_of_many_rows(spark):
    """More rows than a sum of 40-bit numbers can take in 64 bits."""
    many = spark.range(0, 20_000_000, 1, 8).select((F.col("id") % 4).alias("x"))
    few = spark.createDataFrame([(0,), (1,), (2,), (3,)], "x bigint")
    part = int.from_bytes(few.agg(p("checksum", "x")).first()[0], "little")
    assert int.from_bytes(many.agg(p("checksum", "x")).first()[0], "little") == part * 5_000_000 % (1 << 64)
    assert few.where("x > 9").agg(p("checksum", "x")).first()[0] is None


def test_random(spark):
    got = spark.range(200).select(p("random").alias("a"), p("random", 10).alias("b"), p("random", 5, 9).alias("c"), p("rand").alias("d")).collect()
    assert all(0 <= r.a < 1 and 0 <= r.b < 10 and 5 <= r.c < 9 and 0 <= r.d < 1 for r in got) and len({r.b for r in got}) == 10 and {r.c for r in got} == {5, 6, 7, 8}
    with pytest.raises(Exception, match="upper bound"):
        one(spark, p("random", 9, 5))


@pytest.mark.parametrize("c,want", [
    (lambda: p("trim", F.lit("\t\n a b  ")), "a b"), (lambda: p("ltrim", F.lit("\t a ")), "a "), (lambda: p("rtrim", F.lit(" a\r\n")), " a"), (lambda: p("trim", F.lit("xyaxy"), "xy"), "a"), (lambda: p("rtrim", F.lit("axx"), "x"), "a"), (lambda: p("sign", F.lit(-5)), -1),
    (lambda: F.typeof(p("sign", F.lit(-5).cast("smallint"))), "smallint"), (lambda: p("sign", F.lit(2.5)), 1.0), (lambda: F.typeof(p("date_trunc", "month", F.lit("2024-05-06").cast("date"), date=True)), "date"), (lambda: p("try", F.lit("x").cast("int")), None), (lambda: p("try", F.lit(7)), 7),
    (lambda: p("try", F.raise_error(F.lit("no")).cast("int")), None), (lambda: p("json_string_to_array_cast", F.lit("[1, 2]"), "bigint"), [1, 2]), (lambda: p("json_string_to_map_cast", F.lit('{"a": 1}'), "string", "int"), {"a": 1}), (lambda: p("parse_presto_data_size", F.lit("2.5kB")), 2560),
])
def test_values(spark, c, want):
    assert one(spark, c()) == want


def test_weighted_percentile(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (5, 8), (9, 1)], "x int, w bigint")
    got = df.agg(p("approx_percentile", "x", [0.0, 0.5, 1.0], weight=F.col("w")).alias("a"), p("approx_percentile", "x", 0.5, weight=F.col("w")).alias("b")).first()
    assert got.a == [1, 5, 9] and got.b == 5
    with pytest.raises(Exception, match="negative"):
        df.agg(p("approx_percentile", "x", 0.5, weight=-F.col("w"))).collect()


def test_maps_of_groups(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 6), (1, "b", 7), (1, None, 8), (2, None, 1)], "g int, k string, v int").coalesce(1)
    m = F.create_map(F.coalesce("k", F.lit("z")), "v")
    got = {r.g: r for r in df.groupBy("g").agg(p("map_agg", "k", "v").alias("a"), p("multimap_agg", "k", "v").alias("b"), p("histogram", "k").alias("c"), p("map_union_sum", m).alias("d"), p("map_union", m).alias("e")).collect()}
    assert got[1].a == {"a": 6, "b": 5} and got[1].b == {"a": [6], "b": [5, 7]} and got[1].c == {"a": 1, "b": 2} and got[1].d == {"a": 6, "b": 12, "z": 8} and got[1].e == {"a": 6, "b": 5, "z": 8}
    assert got[2].a == {} and got[2].c == {} and got[2].d == {"z": 1}


def test_published_hashes(spark):
    assert buckets.murmur3_32([b"iceberg", (34).to_bytes(8, "little"), b"", bytes([0, 1, 2, 3]), b"abcde"]).astype("int32").tolist()[:4] == [1210000089, 2017239379, 0, -188683207]
    q = lambda name, *a: call("spark", name, *a)
    r = spark.range(1).select(
        q("bucket", 1 << 30, F.lit(34)).alias("a"), q("bucket", 1 << 30, F.lit("iceberg")).alias("b"), q("bucket", 1 << 30, F.lit("14.20").cast("decimal(9,2)")).alias("c"), q("bucket", 1 << 30, F.lit("2017-11-16").cast("date")).alias("d"), q("bucket", 8, F.lit(None).cast("int")).alias("e"),
        q("truncate", 10, F.lit(-1), "number").alias("f"), q("truncate", 50, F.lit("10.65").cast("decimal(9,2)"), "decimal(2)").alias("g"), q("truncate", 3, F.lit("iceberg")).alias("h"), q("hash_with_seed", 42, F.lit(1)).alias("i"), F.hash(F.lit(1)).alias("j"),
    ).first()
    mask = (1 << 31) - 1
    assert [r.a, r.b, r.c, r.d] == [(h & mask) % (1 << 30) for h in (2017239379, 1210000089, -500754589, -653330422)] and r.e is None
    assert r.f == -10 and float(r.g) == 10.5 and r.h == "ice" and r.i == r.j


def test_bloom_filter(spark):
    q = lambda name, *a: call("spark", name, *a)
    bloom = spark.range(1000).agg(q("bloom_filter_agg", F.xxhash64("id"), 1000, 10_000)).first()[0]
    held = {r.id for r in spark.range(5000).where(q("might_contain", bloom, F.xxhash64("id"))).collect()}
    assert set(range(1000)) <= held and len(held) < 1400


def test_range_join_keeps_unmatched_ranges_once(spark):
    points = spark.createDataFrame([(1, 5), (2, 100)], "i int, x int")
    ranges = spark.createDataFrame([("a", 0, 50), ("b", 200, 260), ("c", 9, 3), ("d", None, None)], "r string, lo int, hi int")
    got = lambda kind: sorted((r.i or 0, r.r or "") for r in O.range_join(points, ranges, "x", "lo", "hi", 10.0, kind=kind).collect())
    assert got("right") == [(0, "b"), (0, "c"), (0, "d"), (1, "a")] and got("full") == [(0, "b"), (0, "c"), (0, "d"), (1, "a"), (2, "")]
    with pytest.raises(ValueError):
        got("sideways")


def test_header_of_each_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("a|b\n1|x\na|b\n" + f"{k}|y\n")
    got = sorted((r.a, r.b) for r in read_delimited(spark, str(tmp_path), "a string, b string", field="|", skip_header=True).collect())
    assert got == [("0", "y")] + [("1", "x")] * 3 + [("1", "y"), ("2", "y")] + [("a", "b")] * 3


def test_frames_of_empty_and_wide_bounds(spark):
    df = spark.createDataFrame([(g, i, float(i)) for g in (1, None) for i in range(600)], "g int, i int, v double")
    x = O.column_frame(df, ["g"], ["i"], "v", F.when(F.col("i") % 7 == 0, 5).otherwise(-300), F.when(F.col("i") % 7 == 0, 2).otherwise(2), lambda a: F.struct(F.size(a).alias("n"), F.array_max(a).alias("m")), "f")
    for r in x.collect():
        lo, hi = (r.i + 5, r.i + 2) if r.i % 7 == 0 else (max(r.i - 300, 0), min(r.i + 2, 599))
        assert (r.f.n, r.f.m) == ((hi - lo + 1, float(hi)) if hi >= lo else (0, None))


def test_stems():
    from lodespar.functions.stemming import stem

    known = {"consigned": "consign", "knightly": "knight", "generate": "generat", "running": "run", "happiness": "happi", "relational": "relat", "digitizer": "digit", "hopping": "hop", "hoping": "hope", "skies": "sky", "dying": "die", "news": "news", "caresses": "caress", "ponies": "poni", "ties": "tie", "agreed": "agre", "cry": "cri", "by": "by", "say": "say", "vileness": "vile", "analogously": "analog", "adoption": "adopt", "controlling": "control", "Generous": "generous", "communication": "communic", "gas": "gas"}
    assert {w: stem(w) for w in known} == known


def test_lengths_of_text(spark):
    q = lambda name, *a: call("spark", name, *a)
    for name, good in (("varchar_type_write_side_check", "abc"), ("char_type_write_side_check", "abc")):
        assert one(spark, q(name, F.lit("abc  "), 3)) == good and one(spark, q(name, F.lit(None).cast("string"), 3)) is None
        with pytest.raises(Exception, match="exceeds"):
            one(spark, q(name, F.lit("abcd"), 3))
    assert one(spark, q("char_type_write_side_check", F.lit("a"), 3)) == "a  " and one(spark, q("read_side_padding", F.lit("abcd"), 3)) == "abcd"


def test_groups_in_parts(spark):
    """Groups of more rows than a part, null keys and null values, as the plain aggregates give them."""
    from lodespar.functions import aggregates as A

    df = spark.range(0, 30_000, 1, 3).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("x"))
    add = lambda s, v: s + v
    size = F.size(p("array_agg", "x"))
    plain = {r.g: r for r in df.groupBy("g").agg(size.alias("n"), F.sum("x").alias("s")).collect()}
    assert {r.g: r.n for r in A.in_parts(df, ["g"], {"n": size}, {"n": F.sum("n")}).collect()} == {g: r.n for g, r in plain.items()}
    assert {r.g: r.r for r in A.reduces(df, ["g"], "x", F.lit(0).cast("bigint"), add, add, "r").collect()} == {g: r.s for g, r in plain.items()}


@pytest.mark.parametrize("n", [1, 3, 50])
def test_ends_hold_no_group(spark, n):
    df = spark.createDataFrame([(x,) for x in (3, None, 1, 3, 2, 9)], "x int").withColumn("y", -F.col("x"))
    got = df.agg(p("max", "x", n).alias("a"), p("min", "x", n).alias("b"), p("max_by", "x", "y", n).alias("c"), p("min_by", "x", "y", n).alias("d"))
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    low = [1, 2, 3, 3, 9]
    assert tuple(got.first()) == (low[::-1][:n], low[:n], [*low, None][:n], [None, *low[::-1]][:n])
