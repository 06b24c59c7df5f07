"""Graphs of many-membered edges from relational tables, and the schemas of the engine's tables.

Atoms of all kinds share one id space: a code of the type times STRIDE plus the table's key. Every incidence row is one member
of one edge, and a member occurs at most once in an edge, so repeated lines are folded first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.sources.scratch import spread

STRIDE = 10_000_000_000
#: Codes of the types.
CODES = {"Customer": 1, "Part": 2, "Supplier": 3, "Nation": 4, "Region": 5, "User": 6, "Document": 7, "Event": 8, "Order": 11, "Basket": 12, "Supply": 13, "Account": 14, "Session": 15}
NODE_TYPES = ("Customer", "Part", "Supplier", "Nation", "Region")
FOREVER, EVER = 9223372036854775807, -9223372036854775808
FIXED = 1_000_000_000  # weights are whole numbers of billionths, so that sums are exact in any order
INCIDENCE = "edge_id long, member_id long, type string, kind string, pos long, roles array<string>, weight_fp long, valid_from long, valid_to long, qualifier long"


def atom(kind: str, key: Column | str) -> Column:
    return F.lit(CODES[kind] * STRIDE) + (F.col(key) if isinstance(key, str) else key).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def _incidence(df: DataFrame, kind: str, ordered: bool = False) -> DataFrame:
    """Fills in what a projection doesn't set."""
    have = set(df.columns)
    default = {"pos": F.lit(-1), "weight_fp": F.lit(FIXED), "valid_from": F.lit(EVER), "valid_to": F.lit(FOREVER), "qualifier": F.lit(None)}
    for name, value in default.items():
        if name not in have:
            df = df.withColumn(name, value.cast("long"))
    return df.withColumn("type", F.lit(kind)).withColumn("kind", F.lit("ORDERED" if ordered else "SET")).select(*[x.split()[0] for x in INCIDENCE.split(", ")])


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of orders with lines: the parts, weighted by quantity, valid from their first shipping."""
    lines = table(spark, sf_dir, "lineitem").select(atom("Basket", "l_orderkey").alias("edge_id"), atom("Part", "l_partkey").alias("member_id"), "l_quantity", millis("l_shipdate").alias("at"))
    folded = spread(lines, "edge_id", "member_id").groupBy("edge_id", "member_id").agg((F.sum("l_quantity") * FIXED).cast("long").alias("weight_fp"), F.min("at").alias("valid_from"))
    return _incidence(folded.withColumn("roles", F.array(F.lit("part"))), "Basket")


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of orders: the customer, the parts and the suppliers, each in a role of its name."""
    lines = table(spark, sf_dir, "lineitem")
    parts = [
        table(spark, sf_dir, "orders").select(atom("Order", "o_orderkey").alias("edge_id"), atom("Customer", "o_custkey").alias("member_id"), F.lit(0).alias("role")),
        lines.select(F.inline(F.array(*[F.struct(atom("Order", "l_orderkey").alias("edge_id"), atom(kind, key).alias("member_id"), F.lit(i).alias("role")) for i, kind, key in ((1, "Part", "l_partkey"), (2, "Supplier", "l_suppkey"))]))),
    ]
    # Numbers for roles, as rows of one width take a third less memory than those with texts.
    rows = spread(parts[0].union(parts[1]), "edge_id", "member_id").distinct()
    name = F.element_at(F.array(*map(F.lit, ("customer", "part", "supplier"))), F.col("role") + 1)
    return _incidence(rows.withColumn("roles", F.array(name)), "Order")


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of parts: their suppliers, weighted by lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(atom("Supply", "l_partkey").alias("edge_id"), atom("Supplier", "l_suppkey").alias("member_id")).agg((F.count("*") * FIXED).alias("weight_fp"))
    return _incidence(lines.withColumn("roles", F.array(F.lit("supplier"))), "Supply")


def account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of customers whose members are their order edges, and their nation."""
    orders = table(spark, sf_dir, "orders").select(atom("Account", "o_custkey").alias("edge_id"), atom("Order", "o_orderkey").alias("member_id"), F.lit("order").alias("role"))
    nations = table(spark, sf_dir, "customer").select(atom("Account", "c_custkey"), atom("Nation", "c_nationkey"), F.lit("nation"))
    return _incidence(orders.union(nations).withColumn("roles", F.array("role")), "Account")


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered edges of a user's events of a day. Positions are labels that grow with time and leave gaps, so no window is needed to make them."""
    day = F.floor(millis("ts") / 86_400_000).cast("long")
    edge = F.lit(CODES["Session"] * STRIDE) + F.col("user_id").cast("long") * 100_000 + day
    events = table(spark, sf_dir, "events").select(edge.alias("edge_id"), atom("Event", "event_id").alias("member_id"), millis("ts").alias("pos"), F.array("event_type").alias("roles"), millis("ts").alias("valid_from"))
    return _incidence(events, "Session", ordered=True)


INCIDENCES = {"Basket": basket, "Order": order, "Supply": supply, "Account": account, "Session": session}


def incidence(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """The incidences of the given edge types, of all without any."""
    found = [INCIDENCES[t](spark, sf_dir) for t in types or INCIDENCES]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def nodes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Wide view of a node type: atom_id, type, key and its declared properties."""
    source = {"Customer": ("customer", "c_custkey", "c_name"), "Part": ("part", "p_partkey", "p_name"), "Supplier": ("supplier", "s_suppkey", "s_name"), "Nation": ("nation", "n_nationkey", "n_name"), "Region": ("region", "r_regionkey", "r_name"), "Event": ("events", "event_id", "event_type")}
    name, key, label = source[kind]
    df = table(spark, sf_dir, name)
    return df.select(atom(kind, key).alias("atom_id"), F.lit(kind).alias("type"), F.concat(F.lit(f"{kind}#"), F.col(key)).alias("key"), F.col(label).alias("name"), *[c for c in df.columns if c not in (key, label)])


def edges(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Wide view of an edge type that has properties."""
    if kind in ("Basket", "Order"):
        df = table(spark, sf_dir, "orders")
        return df.select(atom(kind, "o_orderkey").alias("atom_id"), F.lit(kind).alias("type"), "o_totalprice", "o_orderstatus", "o_orderpriority", millis("o_orderdate").alias("o_orderdate"))
    if kind == "Supply":
        df = table(spark, sf_dir, "part")
        return df.select(atom(kind, "p_partkey").alias("atom_id"), F.lit(kind).alias("type"), "p_brand", "p_type", "p_size", "p_retailprice")
    df = table(spark, sf_dir, "customer")
    return df.select(atom("Account", "c_custkey").alias("atom_id"), F.lit("Account").alias("type"), "c_mktsegment", "c_acctbal")
