"""Models over the driver's tables, and small networks with known answers. Each comes as a DataFrame of codes and as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..network import Model, Network
from ..operators import discretize as d

ROLES = ("assistant", "system", "user")
EVENTS = ("click", "error", "purchase", "signup", "view")
FLAGS, STATUSES = ("A", "N", "R"), ("F", "O")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ORDER_STATUSES = ("F", "O", "P")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LANGS = ("de", "en", "es", "fr")
SITES = tuple(f"src{i}" for i in range(20))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Coded:
    """Cards of the variables and the SQL of their codes."""

    cards: dict[str, int]
    sql: str

    def network(self, *edges: tuple[str, str]) -> Network:
        return Network.of(self.cards, edges)


def _place(column: str, domain: tuple[str, ...]) -> str:
    return f"CAST(list_position([{', '.join(repr(x) for x in domain)}], {column}) - 1 AS INTEGER)"


CONV = Coded(
    {"role": 3, "turn": 8, "size": 16},
    f"SELECT {_place('role', ROLES)} AS role, CAST(turn AS INTEGER) AS turn, CAST(least(floor(log2(length(text) + 1)), 15) AS INTEGER) AS size FROM conversations",
)
LI = Coded(
    {"flag": 3, "status": 2, "qty": 5, "disc": 11, "tax": 9},
    f"SELECT {_place('l_returnflag', FLAGS)} AS flag, {_place('l_linestatus', STATUSES)} AS status, CAST(least(greatest(floor((l_quantity - 1) / 10), 0), 4) AS INTEGER) AS qty, CAST(round(l_discount * 100) AS INTEGER) AS disc, CAST(round(l_tax * 100) AS INTEGER) AS tax FROM lineitem",
)
CUST = Coded(
    {"seg": 5, "reg": 5, "ostat": 3, "prio": 5, "price": 5},
    f"SELECT {_place('c_mktsegment', SEGMENTS)} AS seg, CAST(n_regionkey AS INTEGER) AS reg, {_place('o_orderstatus', ORDER_STATUSES)} AS ostat, {_place('o_orderpriority', PRIORITIES)} AS prio, CAST(least(greatest(floor(o_totalprice / 100000), 0), 4) AS INTEGER) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
EV = Coded(
    {"kind": 5, "hour": 24, "bin": 10},
    f"SELECT {_place('event_type', EVENTS)} AS kind, CAST(hour(ts) AS INTEGER) AS hour, CAST(least(greatest(floor(value / 50), 0), 9) AS INTEGER) AS bin FROM events",
)
DOC = Coded(
    {"lang": 4, "source": 20, "length": 16, "quality": 2, "toxic": 2},
    f"SELECT {_place('lang', LANGS)} AS lang, {_place('source', SITES)} AS source, CAST(least(floor(log2(greatest(n_chars, 1))), 15) AS INTEGER) AS length, quality, toxic FROM documents JOIN labels USING (doc_id)",
)


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations")
    return t.select(d.label(F.col("role"), ROLES).alias("role"), F.col("turn").cast("int").alias("turn"), d.log2_width(F.length("text") + 1, 16).alias("size"))


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    return t.select(
        d.label(F.col("l_returnflag"), FLAGS).alias("flag"), d.label(F.col("l_linestatus"), STATUSES).alias("status"), d.width(F.col("l_quantity"), 1, 10, 5).alias("qty"),
        d.rounded(F.col("l_discount"), 100).alias("disc"), d.rounded(F.col("l_tax"), 100).alias("tax"),
    )


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem. Lines are counted per order before the join, so the join moves orders, not lines."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        d.label(F.col("c_mktsegment"), SEGMENTS).alias("seg"), F.col("n_regionkey").cast("int").alias("reg"), d.label(F.col("o_orderstatus"), ORDER_STATUSES).alias("ostat"),
        d.label(F.col("o_orderpriority"), PRIORITIES).alias("prio"), d.width(F.col("o_totalprice"), 0, 100_000, 5).alias("price"), "n",
    )


def ev_codes(events: DataFrame) -> DataFrame:
    """Codes of an events table or stream, with its time."""
    return events.select(d.label(F.col("event_type"), EVENTS).alias("kind"), F.hour("ts").cast("int").alias("hour"), d.width(F.col("value"), 0, 50, 10).alias("bin"), "ts")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev_codes(_table(spark, sf_dir, "events")).drop("ts")


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id")
    return both.select(d.label(F.col("lang"), LANGS).alias("lang"), d.label(F.col("source"), SITES).alias("source"), d.log2_width(F.col("n_chars"), 16).alias("length"), F.col("quality").cast("int"), F.col("toxic").cast("int"))


PEARL = Model.of(
    Network.of({"R": 2, "S": 2, "W": 2, "H": 2}, [("R", "W"), ("R", "H"), ("S", "H")], "pearl", 1),
    {"R": (0.2, 0.8), "S": (0.1, 0.9), "W": {0: (1, 0), 1: (0.2, 0.8)}, "H": {(0, 0): (1, 0), (0, 1): (1, 0), (1, 0): (0.9, 0.1), (1, 1): (0, 1)}},
)
CHAIN = Model.of(
    Network.of({"A": 3, "B": 3, "C": 2, "D": 3}, [("A", "B"), ("B", "C"), ("C", "D")], "chain", 1),
    {"A": (0.3, 0.6, 0.1), "B": {0: (0.2, 0.3, 0.5), 1: (0.3, 0.3, 0.4), 2: (0.8, 0.1, 0.1)}, "C": {0: (0.5, 0.5), 1: (0.7, 0.3), 2: (0.4, 0.6)}, "D": {0: (0.4, 0.3, 0.3), 1: (0.2, 0.6, 0.2)}},
)
FIVE = Model.of(
    Network.of({f"V{i}": 2 for i in range(1, 6)}, [("V1", "V2"), ("V1", "V3"), ("V2", "V4"), ("V2", "V5"), ("V3", "V5")], "five", 1),
    {"V1": (0.5, 0.5), "V2": {0: (0.8, 0.2), 1: (0.1, 0.9)}, "V3": {0: (0.7, 0.3), 1: (0.4, 0.6)}, "V4": {0: (0.6, 0.4), 1: (0.1, 0.9)}, "V5": {(0, 0): (0.1, 0.9), (0, 1): (0.2, 0.8), (1, 0): (0.3, 0.7), (1, 1): (0.4, 0.6)}},
)
SYM = Model.of(Network.of({"A": 2, "B": 2, "C": 2}, [("A", "B"), ("B", "C")], "sym"), {"A": (0.2, 0.8), "B": {0: (0.9, 0.1), 1: (0.1, 0.9)}, "C": {0: (0.7, 0.3), 1: (0.2, 0.8)}})
CPT3 = Model.of(Network.of({"V1": 2, "V2": 2, "V3": 3}, [("V1", "V3"), ("V2", "V3")], "cpt3", 1), {"V1": (0.5, 0.5), "V2": (0.5, 0.5), "V3": {(0, 0): (0.25, 0.09, 0.66), (1, 0): (0.1, 0.15, 0.75), (0, 1): (0.15, 0.45, 0.4), (1, 1): (0, 0.5, 0.5)}})
