"""Tables of the public decision-support benchmark at any scale, from a seed, by column expressions only.

Keys, cardinalities and how columns depend on each other follow its published
specification; texts and draws are this module's own, so rows aren't those of
another generator. A row depends on its key alone: any partition can be made
anywhere, again, and without the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the specification.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
NATIONS = (
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4), ("ETHIOPIA", 0), ("FRANCE", 3), ("GERMANY", 3), ("INDIA", 2), ("INDONESIA", 2), ("IRAN", 4), ("IRAQ", 4), ("JAPAN", 2), ("JORDAN", 4), ("KENYA", 0), ("MOROCCO", 0), ("MOZAMBIQUE", 0), ("PERU", 1), ("CHINA", 2), ("ROMANIA", 3),
    ("SAUDI ARABIA", 4), ("VIETNAM", 2), ("RUSSIA", 3), ("UNITED KINGDOM", 3), ("UNITED STATES", 1),
)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MODES = ("REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB")
INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN")
TYPES = (("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"), ("ANODIZED", "BURNISHED", "PLATED", "POLISHED", "BRUSHED"), ("TIN", "NICKEL", "BRASS", "STEEL", "COPPER"))
CONTAINERS = (("SM", "LG", "MED", "JUMBO", "WRAP"), ("CASE", "BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM"))
COLORS = ("almond", "azure", "beige", "black", "blue", "brown", "coral", "cream", "cyan", "forest", "ghost", "green", "grey", "indian", "ivory", "khaki", "lace", "lemon", "lime", "linen", "magenta", "mint", "navy", "olive", "orange", "orchid", "peach", "pink", "plum", "red", "rose", "salmon", "sienna", "sky", "snow", "steel", "tan", "violet", "wheat", "white")
_FIRST, _LAST, _TODAY = "1992-01-01", "1998-08-02", "1995-06-17"

SUPPLIERS, PARTS, CUSTOMERS, ORDERS = 10_000, 200_000, 150_000, 1_500_000


class Tables:
    """The tables of one scale and seed."""

    def __init__(self, spark: SparkSession, scale: float = 0.01, seed: int = 0, partitions: int | None = None):
        self.spark, self.seed, self.partitions = spark, seed, partitions
        self.suppliers, self.parts, self.customers, self.orders = (max(int(n * scale), 1) for n in (SUPPLIERS, PARTS, CUSTOMERS, ORDERS))

    def _draw(self, what: str, below: int, *keys: Column) -> Column:
        """A number from 0 to below, by a hash of keys."""
        return F.pmod(F.xxhash64(F.lit(f"{self.seed}:{what}"), *keys), F.lit(below))

    def _one(self, what: str, of: tuple[str, ...], *keys: Column) -> Column:
        return F.get(F.array(*[F.lit(x) for x in of]), self._draw(what, len(of), *keys).cast("int"))

    def _money(self, what: str, low: int, high: int, *keys: Column) -> Column:
        return ((F.lit(low) + self._draw(what, high - low + 1, *keys)) / 100).cast("decimal(12,2)")

    def _words(self, what: str, n: int, *keys: Column) -> Column:
        return F.concat_ws(" ", *[self._one(f"{what}{i}", COLORS, *keys) for i in range(n)])

    def _phone(self, nation: Column, *keys: Column) -> Column:
        return F.concat_ws("-", (nation + 10).cast("string"), *[F.lpad((self._draw(f"phone{i}", 10**n, *keys)).cast("string"), n, "0") for i, n in enumerate((3, 3, 4))])

    def _range(self, n: int) -> DataFrame:
        return self.spark.range(1, n + 1, 1, self.partitions)

    def region(self) -> DataFrame:
        return self.spark.createDataFrame([(i, n, f"region {n.lower()}") for i, n in enumerate(REGIONS)], "r_regionkey bigint, r_name string, r_comment string")

    def nation(self) -> DataFrame:
        return self.spark.createDataFrame([(i, n, r, f"nation {n.lower()}") for i, (n, r) in enumerate(NATIONS)], "n_nationkey bigint, n_name string, n_regionkey bigint, n_comment string")

    def supplier(self) -> DataFrame:
        k = F.col("id")
        nation = self._draw("s_nation", 25, k)
        return self._range(self.suppliers).select(k.alias("s_suppkey"), F.format_string("Supplier#%09d", k).alias("s_name"), self._words("s_address", 2, k).alias("s_address"), nation.alias("s_nationkey"), self._phone(nation, F.lit("s"), k).alias("s_phone"), self._money("s_acctbal", -99_999, 999_999, k).alias("s_acctbal"), self._words("s_comment", 6, k).alias("s_comment"))

    def customer(self) -> DataFrame:
        k = F.col("id")
        nation = self._draw("c_nation", 25, k)
        return self._range(self.customers).select(k.alias("c_custkey"), F.format_string("Customer#%09d", k).alias("c_name"), self._words("c_address", 2, k).alias("c_address"), nation.alias("c_nationkey"), self._phone(nation, F.lit("c"), k).alias("c_phone"), self._money("c_acctbal", -99_999, 999_999, k).alias("c_acctbal"), self._one("c_segment", SEGMENTS, k).alias("c_mktsegment"), self._words("c_comment", 6, k).alias("c_comment"))

    @staticmethod
    def _retail(k: Column) -> Column:
        return ((90_000 + F.floor(k / 10) % 20_001 + 100 * (k % 1000)) / 100).cast("decimal(12,2)")

    def part(self) -> DataFrame:
        k = F.col("id")
        maker = self._draw("p_mfgr", 5, k) + 1
        kind = F.concat_ws(" ", *[self._one(f"p_type{i}", t, k) for i, t in enumerate(TYPES)])
        box = F.concat_ws(" ", *[self._one(f"p_container{i}", t, k) for i, t in enumerate(CONTAINERS)])
        return self._range(self.parts).select(
            k.alias("p_partkey"), self._words("p_name", 5, k).alias("p_name"), F.format_string("Manufacturer#%d", maker).alias("p_mfgr"), F.format_string("Brand#%d%d", maker, self._draw("p_brand", 5, k) + 1).alias("p_brand"), kind.alias("p_type"), (self._draw("p_size", 50, k) + 1).cast("int").alias("p_size"),
            box.alias("p_container"), self._retail(k).alias("p_retailprice"), self._words("p_comment", 2, k).alias("p_comment"),
        )

    def _supplier_of(self, part: Column, i: Column) -> Column:
        """The i-th of a part's four suppliers, i from 0."""
        s = self.suppliers
        return (part + i * (F.lit(s // 4) + F.floor((part - 1) / s))) % s + 1

    def partsupp(self) -> DataFrame:
        k, i = F.col("id"), F.col("i")
        four = self._range(self.parts).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
        return four.select(k.alias("ps_partkey"), self._supplier_of(k, i).alias("ps_suppkey"), (self._draw("ps_qty", 9999, k, i) + 1).cast("int").alias("ps_availqty"), self._money("ps_cost", 100, 100_000, k, i).alias("ps_supplycost"), self._words("ps_comment", 8, k, i).alias("ps_comment"))

    def _ordered(self) -> DataFrame:
        """Orders with their lines as an array, which both tables are made of."""
        n = F.col("id") - 1
        key = F.floor(n / 8) * 32 + n % 8 + 1
        o = self._range(self.orders).select(key.alias("o"))
        k = F.col("o")
        days = self.spark.range(1).select(F.datediff(F.lit(_LAST).cast("date"), F.lit(_FIRST).cast("date"))).first()[0]
        o = o.withColumn("day", F.date_add(F.lit(_FIRST).cast("date"), self._draw("o_date", days - 150, k).cast("int")))

        def line(i: Column) -> Column:
            part = self._draw("l_part", self.parts, k, i) + 1
            many = self._draw("l_quantity", 50, k, i) + 1
            ship = F.date_add(F.col("day"), (1 + self._draw("l_ship", 121, k, i)).cast("int"))
            got = F.date_add(ship, (1 + self._draw("l_receipt", 30, k, i)).cast("int"))
            today = F.lit(_TODAY).cast("date")
            return F.struct(
                part.alias("l_partkey"), self._supplier_of(part, self._draw("l_supp", 4, k, i)).alias("l_suppkey"), i.cast("int").alias("l_linenumber"), many.cast("decimal(12,2)").alias("l_quantity"), (many * self._retail(part)).cast("decimal(12,2)").alias("l_extendedprice"),
                (self._draw("l_discount", 11, k, i) / 100).cast("decimal(12,2)").alias("l_discount"), (self._draw("l_tax", 9, k, i) / 100).cast("decimal(12,2)").alias("l_tax"), F.when(got > today, "N").when(self._draw("l_flag", 2, k, i) == 0, "R").otherwise("A").alias("l_returnflag"),
                F.when(ship > today, "O").otherwise("F").alias("l_linestatus"), ship.alias("l_shipdate"), F.date_add(F.col("day"), (30 + self._draw("l_commit", 61, k, i)).cast("int")).alias("l_commitdate"), got.alias("l_receiptdate"), self._one("l_instruct", INSTRUCTIONS, k, i).alias("l_shipinstruct"),
                self._one("l_mode", MODES, k, i).alias("l_shipmode"), self._words("l_comment", 3, k, i).alias("l_comment"),
            )

        return o.withColumn("lines", F.transform(F.sequence(F.lit(1), (1 + self._draw("o_lines", 7, k)).cast("int")), line))

    def lineitem(self) -> DataFrame:
        return self._ordered().select(F.col("o").alias("l_orderkey"), F.inline("lines"))

    def orders_(self) -> DataFrame:
        k, lines = F.col("o"), F.col("lines")
        price = F.aggregate(lines, F.lit(0).cast("decimal(38,4)"), lambda s, x: (s + x["l_extendedprice"] * (1 + x["l_tax"]) * (1 - x["l_discount"])).cast("decimal(38,4)"))
        done = F.size(F.filter(lines, lambda x: x["l_linestatus"] == "F"))
        # a third of the customers has no orders
        customer = self._draw("o_cust", max(self.customers - self.customers // 3, 1), k)
        customer = customer + F.floor(customer / 2) + 1
        clerk = F.format_string("Clerk#%09d", self._draw("o_clerk", max(self.orders // 1500, 1), k) + 1)
        return self._ordered().select(
            k.alias("o_orderkey"), customer.alias("o_custkey"), F.when(done == F.size(lines), "F").when(done == 0, "O").otherwise("P").alias("o_orderstatus"), price.cast("decimal(12,2)").alias("o_totalprice"), F.col("day").alias("o_orderdate"),
            self._one("o_priority", PRIORITIES, k).alias("o_orderpriority"), clerk.alias("o_clerk"), F.lit(0).alias("o_shippriority"), self._words("o_comment", 4, k).alias("o_comment"),
        )


def tpch_table(spark: SparkSession, name: str, scale: float = 0.01, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """One of region, nation, supplier, customer, part, partsupp, orders and lineitem."""
    made: dict[str, Callable[[], DataFrame]] = {n: getattr(Tables(spark, scale, seed, partitions), f"{n}_" if n == "orders" else n) for n in ("region", "nation", "supplier", "customer", "part", "partsupp", "orders", "lineitem")}
    return made[name]()
