"""The registered queries of the graph engine, each with SQL that says the same.

Queries run over the whole projected tables. Fixed atoms (two parts, a customer, a day) stand for a caller's arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.functions import values as V
from hyperweave.operators import algebra, evidence, flow, inspect, overlap, semantic, structure, temporal, views
from hyperweave.operators import rank as ranking
from hyperweave.operators.pattern import Pattern, match
from hyperweave.operators.sample import swap_members
from hyperweave.plans.match import Match
from hyperweave.sources import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Incidences and views as SQL.
CTE = {
    "basket": "SELECT 120000000000 + l_orderkey AS edge_id, 20000000000 + l_partkey AS member_id, 'part' AS role, CAST(sum(l_quantity) * 1000000000 AS BIGINT) AS weight_fp, min(epoch_ms(l_shipdate)) AS valid_from, 9223372036854775807 AS valid_to FROM lineitem GROUP BY l_orderkey, l_partkey",
    "ord": "SELECT 110000000000 + o_orderkey AS edge_id, 10000000000 + o_custkey AS member_id, 'customer' AS role FROM orders UNION SELECT 110000000000 + l_orderkey, 20000000000 + l_partkey, 'part' FROM lineitem UNION SELECT 110000000000 + l_orderkey, 30000000000 + l_suppkey, 'supplier' FROM lineitem",
    "supply": "SELECT 130000000000 + l_partkey AS edge_id, 30000000000 + l_suppkey AS member_id, 'supplier' AS role, count(*) * 1000000000 AS weight_fp FROM lineitem GROUP BY l_partkey, l_suppkey",
    "account": "SELECT 140000000000 + o_custkey AS edge_id, 110000000000 + o_orderkey AS member_id, 'order' AS role FROM orders UNION SELECT 140000000000 + c_custkey, 40000000000 + c_nationkey, 'nation' FROM customer",
    "session": "SELECT 150000000000 + user_id * 100000 + CAST(floor(epoch_ms(ts) / 86400000) AS BIGINT) AS edge_id, 80000000000 + event_id AS member_id, epoch_ms(ts) AS pos, event_type AS role FROM events",
    "ev": "SELECT 110000000000 + o_orderkey AS atom_id, * FROM orders",
    "pv": "SELECT 20000000000 + p_partkey AS atom_id, * FROM part",
    "cv": "SELECT 10000000000 + c_custkey AS atom_id, * FROM customer",
    "sv": "SELECT 30000000000 + s_suppkey AS atom_id, * FROM supplier",
}
PART_A, PART_B = R.CODES["Part"] * R.STRIDE + 1, R.CODES["Part"] * R.STRIDE + 2
SUPPLY_A, SUPPLY_B = R.CODES["Supply"] * R.STRIDE + 1, R.CODES["Supply"] * R.STRIDE + 2
ACCOUNT = R.CODES["Account"] * R.STRIDE + 1
CUSTOMER = R.CODES["Customer"] * R.STRIDE + 1
DAY = 86_400_000
T0 = 883612800000  # 1998-01-01


def query(sql: str | None = None, name: str | None = None):
    """Registers a function as a query; the SQL may name the tables of CTE."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            used = [f"{n} AS ({body})" for n, body in CTE.items() if f" {n} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ").replace("(", " ")]
            text = sql.strip()
            if used:
                text = "WITH RECURSIVE " + ", ".join(used) + (", " + text[len("WITH "):] if text.startswith("WITH ") else " " + text)
            ORACLES[key] = text
        return f

    return add


def matching(spark: SparkSession, sf: str, kind: str, *types: str) -> Match:
    view = R.nodes(spark, sf, kind) if kind in (*R.NODE_TYPES, "Event") else R.edges(spark, sf, kind)
    return Match(view, R.incidence(spark, sf, *(types or ("Order",))))


# --- scans, filters, expressions -------------------------------------------------------------------------------------


@query("SELECT atom_id FROM (SELECT 10000000000 + c_custkey AS atom_id FROM customer UNION ALL SELECT 20000000000 + p_partkey FROM part UNION ALL SELECT 30000000000 + s_suppkey FROM supplier UNION ALL SELECT 40000000000 + n_nationkey FROM nation UNION ALL SELECT 50000000000 + r_regionkey FROM region)")
def scan_catalog(spark, sf):
    out = None
    for kind in R.NODE_TYPES:
        df = R.nodes(spark, sf, kind).select("atom_id")
        out = df if out is None else out.union(df)
    return out


@query("SELECT atom_id, p_name AS name, p_size FROM pv")
def scan_type(spark, sf):
    return R.nodes(spark, sf, "Part").select("atom_id", "name", "p_size")


@query("SELECT edge_id FROM ord WHERE member_id IN (20000000001, 10000000001) GROUP BY edge_id HAVING count(DISTINCT member_id) = 2")
def scan_intersection(spark, sf):
    return algebra.containing(R.order(spark, sf), [(PART_A, ["part"]), (CUSTOMER, ["customer"])])


@query("SELECT member_id FROM supply WHERE edge_id = 130000000001")
def scan_members(spark, sf):
    return algebra.members(R.supply(spark, sf), SUPPLY_A)


@query("SELECT atom_id, o_totalprice FROM ev WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
def scan_property_range(spark, sf):
    price = F.col("o_totalprice")
    return R.edges(spark, sf, "Order").where((price >= 100000) & (price < 150000)).select("atom_id", "o_totalprice")


@query("SELECT atom_id, p_name AS name FROM pv WHERE atom_id = 20000000001")
def scan_point(spark, sf):
    return R.nodes(spark, sf, "Part").where(F.col("atom_id") == PART_A).select("atom_id", "name")


@query("SELECT atom_id, p_name AS name FROM pv WHERE p_partkey = 7")
def scan_key(spark, sf):
    return R.nodes(spark, sf, "Part").where(F.col("key") == "Part#7").select("atom_id", "name")


@query("SELECT atom_id, o_totalprice FROM ev WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def match_filter(spark, sf):
    return matching(spark, sf, "Order").where(V.all_of(V.gt(F.col("o_totalprice"), 200000), V.eq(F.col("o_orderstatus"), "F"))).returns(atom_id=F.col("atom_id"), o_totalprice=F.col("o_totalprice"))


@query("SELECT atom_id, p_size FROM pv WHERE p_size BETWEEN 10 AND 20")
def match_between(spark, sf):
    return matching(spark, sf, "Part").where(V.between(F.col("p_size"), 10, 20)).returns(atom_id=F.col("atom_id"), p_size=F.col("p_size"))


@query("SELECT atom_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS s FROM pv WHERE NOT coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END > 25, false)")
def match_not_null_logic(spark, sf):
    s = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    return matching(spark, sf, "Part").where(~V.gt(s, 25)).returns(atom_id=F.col("atom_id"), s=s)


@query("SELECT DISTINCT a.edge_id AS atom_id FROM ord a JOIN ord b ON a.edge_id = b.edge_id WHERE a.member_id = 20000000001 AND b.member_id = 10000000001 OR a.member_id = 20000000001 AND b.member_id = 30000000001")
def match_or_union(spark, sf):
    m = matching(spark, sf, "Order")
    one, two = (m.contains(PART_A, x).returns() for x in (CUSTOMER, R.CODES["Supplier"] * R.STRIDE + 1))
    return one.union(two).distinct()


@query("SELECT edge_id AS atom_id FROM ord WHERE member_id IN (20000000001, 30000000002) GROUP BY edge_id HAVING count(DISTINCT member_id) = 2")
def match_contains(spark, sf):
    return matching(spark, sf, "Order").contains(PART_A, R.CODES["Supplier"] * R.STRIDE + 2).returns()


@query("SELECT edge_id AS atom_id FROM ord WHERE member_id = 10000000001 AND role = 'customer'")
def match_has_role(spark, sf):
    return matching(spark, sf, "Order").has(CUSTOMER, "customer").returns()


@query("SELECT atom_id, s_name AS name FROM sv WHERE atom_id IN (SELECT member_id FROM supply WHERE edge_id = 130000000001)")
def match_in_edge(spark, sf):
    return matching(spark, sf, "Supplier", "Supply").member_of(SUPPLY_A).returns(atom_id=F.col("atom_id"), name=F.col("name"))


@query(f"SELECT DISTINCT edge_id AS atom_id FROM basket WHERE valid_from <= {T0}")
def match_valid_at(spark, sf):
    return matching(spark, sf, "Basket", "Basket").valid_at(T0).returns()


@query("SELECT atom_id, o_totalprice FROM ev ORDER BY o_totalprice DESC, atom_id LIMIT 25")
def match_order_limit(spark, sf):
    return matching(spark, sf, "Order").order_by(F.col("o_totalprice"), descending=True).limit(25).returns(atom_id=F.col("atom_id"), o_totalprice=F.col("o_totalprice"))


@query("SELECT count(*) AS n, count(CASE WHEN p_size % 5 <> 0 THEN 1 END) AS sizes, CAST(sum(p_size) AS DOUBLE) AS total, avg(p_size) AS mean, min(p_name) AS least, max(p_name) AS most, min_by(p_brand, p_retailprice * 1000000 + p_partkey) AS first_brand FROM part")
def match_aggregate(spark, sf):
    s = F.col("p_size")
    m = matching(spark, sf, "Part").order_by(F.col("p_retailprice"))
    return m.aggregates({"n": F.count("*"), "sizes": F.count(F.when(s % 5 != 0, s)), "total": F.sum(s.cast("double")), "mean": F.avg(s), "least": F.min("name"), "most": F.max("name")}, {"first_brand": F.col("p_brand")})


@query("SELECT atom_id, p_size FROM pv WHERE p_size <> 0")
def match_truthy(spark, sf):
    return matching(spark, sf, "Part").where(V.truthy(F.col("p_size"))).returns(atom_id=F.col("atom_id"), p_size=F.col("p_size"))


@query("SELECT atom_id, coalesce(c.n, 0) AS card FROM ev LEFT JOIN (SELECT edge_id, count(*) AS n FROM ord GROUP BY edge_id) c ON c.edge_id = atom_id")
def fn_card(spark, sf):
    return matching(spark, sf, "Order").with_card().returns(atom_id=F.col("atom_id"), card=F.col("card"))


@query("SELECT atom_id, coalesce(d.n, 0) AS degree FROM pv LEFT JOIN (SELECT member_id, count(*) AS n FROM ord GROUP BY member_id) d ON d.member_id = atom_id")
def fn_degree(spark, sf):
    return matching(spark, sf, "Part").with_degree().returns(atom_id=F.col("atom_id"), degree=F.col("degree"))


@query("SELECT edge_id, sum(weight_fp) / 1000000000::DOUBLE AS weight FROM basket GROUP BY edge_id")
def fn_weight(spark, sf):
    return R.basket(spark, sf).groupBy("edge_id").agg((F.sum("weight_fp") / F.lit(1e9)).alias("weight"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 20")
def fn_json(spark, sf):
    k = V.json(F.col("props"), "$.k", "bigint")
    return R.table(spark, sf, "events").select("event_id", k.alias("k")).where("k < 20")


@query("SELECT atom_id, lower(coalesce(n, 'null')) AS low, upper(coalesce(n, 'null')) AS up, length(coalesce(n, 'null')) AS len FROM (SELECT atom_id, CASE WHEN p_size % 7 <> 0 THEN p_name END AS n FROM pv)")
def fn_text(spark, sf):
    n = F.when(F.col("p_size") % 7 != 0, F.col("name"))
    return R.nodes(spark, sf, "Part").select("atom_id", V.lower(n).alias("low"), V.upper(n).alias("up"), V.length(n).alias("len"))


@query("SELECT atom_id, p_size + 3 AS a, p_size * 2 - 1 AS b, CASE WHEN p_size = 1 THEN 'Infinity'::DOUBLE ELSE 10 / (p_size - 1)::DOUBLE END AS c FROM pv")
def fn_arithmetic(spark, sf):
    s = F.col("p_size")
    return R.nodes(spark, sf, "Part").select("atom_id", (s + 3).alias("a"), (s * 2 - 1).alias("b"), V.divide(10, s - 1).alias("c"))


# --- set algebra -----------------------------------------------------------------------------------------------------


@query("SELECT member_id FROM supply WHERE edge_id = 130000000001 INTERSECT SELECT member_id FROM supply WHERE edge_id = 130000000002")
def set_intersect(spark, sf):
    return algebra.intersect(R.supply(spark, sf), SUPPLY_A, SUPPLY_B)


@query("SELECT DISTINCT member_id FROM supply WHERE edge_id IN (130000000001, 130000000002)")
def set_union(spark, sf):
    return algebra.union(R.supply(spark, sf), SUPPLY_A, SUPPLY_B)


@query("SELECT member_id FROM supply WHERE edge_id = 130000000001 EXCEPT SELECT member_id FROM supply WHERE edge_id = 130000000002")
def set_difference(spark, sf):
    return algebra.difference(R.supply(spark, sf), SUPPLY_A, SUPPLY_B)


@query("""WITH a AS (SELECT member_id FROM supply WHERE edge_id = 130000000001), b AS (SELECT member_id FROM supply WHERE edge_id = 130000000002),
n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y, (SELECT count(*) FROM a JOIN b USING (member_id)) AS z)
SELECT z = x AS subset, z = x AND z = y AS equal, z / (x + y - z)::DOUBLE AS jaccard, z / least(x, y)::DOUBLE AS containment, z AS overlap FROM n""")
def set_measures(spark, sf):
    return algebra.measures(R.supply(spark, sf), SUPPLY_A, SUPPLY_B)


@query("""SELECT 139999999999 AS edge_id, member_id, min_by(weight_fp, edge_id) AS weight_fp FROM supply WHERE edge_id IN (130000000001, 130000000002) GROUP BY member_id""")
def set_union_into(spark, sf):
    return algebra.combined(R.supply(spark, sf), SUPPLY_A, SUPPLY_B, "union", 139_999_999_999).select("edge_id", "member_id", "weight_fp")


# --- flow ------------------------------------------------------------------------------------------------------------


def _acctbal(spark, sf):
    return R.nodes(spark, sf, "Supplier").select("atom_id", F.col("s_acctbal").alias("value"))


@query("SELECT member_id, s_acctbal AS value, weight_fp / 1000000000::DOUBLE AS weight, role FROM supply LEFT JOIN sv ON atom_id = member_id WHERE edge_id = 130000000001")
def gather(spark, sf):
    return flow.gather(R.supply(spark, sf), SUPPLY_A, _acctbal(spark, sf)).select("member_id", "value", "weight", F.col("roles")[0].alias("role"))


for _how in ("sum", "min", "max", "mean", "count"):
    for _weighted in (False, True):
        _w = "weight_fp / 1000000000::DOUBLE"
        _v = f"s_acctbal * {_w}" if _weighted else "s_acctbal"
        _total = f"sum(CAST({_v} AS DECIMAL(38, 9)))::DOUBLE"
        _sql = {"sum": _total, "min": f"min({_v})", "max": f"max({_v})", "count": "count(s_acctbal)", "mean": f"{_total} / " + (f"sum(CAST({_w} AS DECIMAL(38, 9)))::DOUBLE" if _weighted else "count(*)")}[_how]
        query(f"SELECT {_sql} AS {_how} FROM supply JOIN sv ON atom_id = member_id WHERE edge_id = 130000000001", f"reduce_{_how}" + "_weighted" * _weighted)(lambda spark, sf, how=_how, weighted=_weighted: flow.reduce_edge(flow.gather(R.supply(spark, sf), SUPPLY_A, _acctbal(spark, sf)), how, weighted))


def _prices(spark, sf):
    return R.edges(spark, sf, "Basket").select("atom_id", F.col("o_totalprice").alias("value"))


@query("SELECT member_id, sum(CAST(o_totalprice AS DECIMAL(38, 9)))::DOUBLE AS value FROM basket JOIN orders ON edge_id = 120000000000 + o_orderkey GROUP BY member_id")
def scatter(spark, sf):
    return flow.scatter(R.basket(spark, sf), _prices(spark, sf))


@query("SELECT member_id, sum(CAST(o_totalprice * (weight_fp / 1000000000::DOUBLE) AS DECIMAL(38, 9)))::DOUBLE AS value FROM basket JOIN orders ON edge_id = 120000000000 + o_orderkey GROUP BY member_id")
def scatter_weighted(spark, sf):
    return flow.scatter(R.basket(spark, sf), _prices(spark, sf), weighted=True)


def _sizes(spark, sf):
    return R.nodes(spark, sf, "Part").select("atom_id", F.col("p_size").cast("double").alias("value"))


@query("SELECT edge_id, sum(CAST(p_size::DOUBLE AS DECIMAL(38, 9)))::DOUBLE AS value FROM basket JOIN pv ON atom_id = member_id GROUP BY edge_id")
def edge_values(spark, sf):
    return flow.edge_values(R.basket(spark, sf), _sizes(spark, sf))


@query("SELECT member_id, sum(CAST(1.0::DOUBLE * y AS DECIMAL(38, 9)))::DOUBLE AS value FROM basket JOIN (SELECT edge_id, sum(CAST(p_size::DOUBLE AS DECIMAL(38, 9)))::DOUBLE AS y FROM basket JOIN pv ON atom_id = member_id GROUP BY edge_id) USING (edge_id) GROUP BY member_id")
def node_values(spark, sf):
    inc = R.basket(spark, sf)
    return flow.scatter(inc, flow.edge_values(inc, _sizes(spark, sf)).withColumnRenamed("edge_id", "atom_id"))


@query("""WITH down AS (SELECT edge_id, sum(CAST(p_size::DOUBLE * (weight_fp / 1000000000::DOUBLE) AS DECIMAL(38, 9)))::DOUBLE AS y FROM basket JOIN pv ON atom_id = member_id GROUP BY edge_id)
SELECT member_id, sum(CAST(y * (weight_fp / 1000000000::DOUBLE) AS DECIMAL(38, 9)))::DOUBLE AS value FROM basket JOIN down USING (edge_id) GROUP BY member_id""")
def propagate(spark, sf):
    return flow.propagate(R.basket(spark, sf), _sizes(spark, sf))


@query("""SELECT edge_id, count(*) AS cardinality, min(member_id) AS first_member, max(member_id) AS last_member, sum(weight_fp) / 1000000000::DOUBLE AS weight_sum, min(weight_fp) / 1000000000::DOUBLE AS weight_min, max(weight_fp) / 1000000000::DOUBLE AS weight_max, min(valid_from) AS valid_from, 'part' AS roles FROM basket GROUP BY edge_id""")
def edge_summary(spark, sf):
    return flow.edge_summary(R.basket(spark, sf)).withColumn("roles", F.array_join("roles", ",")).drop("valid_to")


@query("SELECT edge_id, CAST(sum(weight_fp) AS DOUBLE) / 1000000000 / count(*) AS mean FROM basket GROUP BY edge_id")
def group_kernel(spark, sf):
    def mean(frame):
        each = frame.groupby("edge_id", as_index=False, dropna=False).agg(total=("weight_fp", "sum"), n=("weight_fp", "size"))
        return each.assign(mean=each["total"] / 1e9 / each["n"])[["edge_id", "mean"]]

    return flow.kernel(R.basket(spark, sf).select("edge_id", "weight_fp"), mean, "edge_id long, mean double")


# --- neighbours and overlaps -----------------------------------------------------------------------------------------


@query("SELECT b.member_id AS neighbor, count(*) AS shared FROM ord a JOIN ord b ON a.edge_id = b.edge_id WHERE a.member_id = 20000000001 AND b.member_id <> 20000000001 GROUP BY b.member_id")
def neighbors_node(spark, sf):
    return overlap.neighbors_of_node(R.order(spark, sf), PART_A)


@query("SELECT b.edge_id AS neighbor, count(*) AS shared FROM supply a JOIN supply b ON a.member_id = b.member_id WHERE a.edge_id = 130000000001 AND b.edge_id <> 130000000001 GROUP BY b.edge_id HAVING count(*) >= 2")
def neighbors_edge(spark, sf):
    return overlap.neighbors_of_edge(R.supply(spark, sf), SUPPLY_A, 2)


@query("SELECT count(*) >= 1 AS adjacent FROM (SELECT edge_id FROM ord WHERE member_id IN (20000000001, 30000000001) GROUP BY edge_id HAVING count(DISTINCT member_id) = 2)")
def adjacent(spark, sf):
    return overlap.adjacent(R.order(spark, sf), PART_A, R.CODES["Supplier"] * R.STRIDE + 1)


_PAIRS = 'SELECT a.edge_id AS "left", b.edge_id AS "right", count(*) AS overlap FROM basket a JOIN basket b ON a.member_id = b.member_id AND a.edge_id < b.edge_id GROUP BY 1, 2 HAVING count(*) >= {}'
query(f"SELECT overlap, count(*) AS pairs FROM ({_PAIRS.format(1)}) GROUP BY overlap", "overlap_join_t1")(lambda spark, sf: overlap.overlap_histogram(R.basket(spark, sf)))
for _t in (2, 3):
    query(_PAIRS.format(_t), f"overlap_join_t{_t}")(lambda spark, sf, t=_t: overlap.overlap_join(R.basket(spark, sf), t))
query(_PAIRS.format(2), "overlap_join_prefix")(lambda spark, sf: overlap.overlap_join(R.basket(spark, sf), 2, prefix=True))


@query('SELECT a.edge_id AS "left", b.edge_id AS "right", CAST(sum(least(a.weight_fp, b.weight_fp)) AS BIGINT) AS weight_fp FROM basket a JOIN basket b ON a.member_id = b.member_id AND a.edge_id < b.edge_id GROUP BY 1, 2 HAVING sum(least(a.weight_fp, b.weight_fp)) > 60000000000')
def weighted_overlap(spark, sf):
    return overlap.weighted_overlap(R.basket(spark, sf), 60.0)


@query("""WITH pairs AS (SELECT a.edge_id, b.edge_id AS partner, count(*) AS overlap FROM basket a JOIN basket b ON a.member_id = b.member_id AND a.edge_id <> b.edge_id GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY overlap DESC, partner) AS place FROM pairs) WHERE place <= 2""")
def view_overlap_topk(spark, sf):
    return overlap.overlap_top(R.basket(spark, sf), 2)


# --- structure, patterns, ranking ------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT member_id FROM account WHERE edge_id = 140000000001)
SELECT 1 AS size, member_id::VARCHAR AS members FROM m UNION ALL SELECT 2, a.member_id || ',' || b.member_id FROM m a JOIN m b ON a.member_id < b.member_id""")
def closure_dim1(spark, sf):
    return structure.closure(R.account(spark, sf), ACCOUNT, 1).select(F.col("size").cast("int").alias("size"), F.array_join("members", ",").alias("members"))


@query("""WITH m AS (SELECT member_id FROM account WHERE edge_id = 140000000001)
SELECT 1 AS size, member_id::VARCHAR AS members FROM m UNION ALL SELECT 2, a.member_id || ',' || b.member_id FROM m a JOIN m b ON a.member_id < b.member_id
UNION ALL SELECT 3, a.member_id || ',' || b.member_id || ',' || c.member_id FROM m a JOIN m b ON a.member_id < b.member_id JOIN m c ON b.member_id < c.member_id""")
def closure_dim2(spark, sf):
    return structure.closure(R.account(spark, sf), ACCOUNT, 2).select(F.col("size").cast("int").alias("size"), F.array_join("members", ",").alias("members"))


_EXPAND = """WITH link AS (SELECT edge_id, member_id FROM account UNION ALL SELECT edge_id, member_id FROM ord),
walk AS (SELECT [140000000001::BIGINT] AS path, 140000000001::BIGINT AS atom, 0 AS d
UNION ALL SELECT list_append(path, member_id), member_id, d + 1 FROM walk JOIN link ON edge_id = atom WHERE d < {depth} AND NOT list_contains(path[:-2], atom))
SELECT array_to_string(path, ',') AS path, atom, CASE WHEN atom NOT IN (SELECT edge_id FROM link) THEN 'EMIT' WHEN list_contains(path[:-2], atom) THEN 'CYCLE' ELSE 'DEPTH_LIMIT' END AS status
FROM walk WHERE atom NOT IN (SELECT edge_id FROM link) OR d = {depth} OR list_contains(path[:-2], atom)"""


@query(_EXPAND.format(depth=2))
def expand_depth2(spark, sf):
    inc = R.incidence(spark, sf, "Account", "Order")
    return structure.expand(inc, ACCOUNT, 2).select(F.array_join("path", ",").alias("path"), "atom", "status")


@query(_EXPAND.format(depth=1))
def expand_depth1(spark, sf):
    inc = R.incidence(spark, sf, "Account", "Order")
    return structure.expand(inc, ACCOUNT, 1).select(F.array_join("path", ",").alias("path"), "atom", "status")


@query("""SELECT edge_id, member_id, 1 AS hop FROM supply WHERE edge_id = 130000000001""")
def neighborhood(spark, sf):
    return structure.neighborhood(R.supply(spark, sf), [SUPPLY_A], 1)


@query("SELECT DISTINCT x.edge_id AS x, y.edge_id AS y, x.member_id AS p FROM basket x JOIN basket y ON x.member_id = y.member_id AND x.edge_id <> y.edge_id WHERE x.member_id = 20000000001")
def pattern_contains(spark, sf):
    p = Pattern().contains("x", "p").contains("y", "p").distinct("x", "y").bind("p", PART_A)
    return match(R.basket(spark, sf), p)


@query("SELECT DISTINCT c.edge_id AS e, c.member_id AS c, s.member_id AS s FROM ord c JOIN ord s ON c.edge_id = s.edge_id JOIN ord p ON p.edge_id = c.edge_id WHERE c.role = 'customer' AND s.role = 'supplier' AND p.member_id = 20000000001")
def pattern_roles(spark, sf):
    p = Pattern().contains("e", "c", "customer").contains("e", "s", "supplier").contains("e", "p").bind("p", PART_A)
    return match(R.order(spark, sf), p).select("e", "c", "s")


@query("SELECT DISTINCT edge_id AS e, member_id AS s FROM ord WHERE member_id IN (SELECT 30000000000 + s_suppkey FROM supplier)")
def pattern_typed_member(spark, sf):
    atoms = R.nodes(spark, sf, "Supplier").select("atom_id", F.lit("Supplier").alias("type"))
    return match(R.order(spark, sf), Pattern().contains("e", "s").typed("s", "Supplier"), atoms)


@query('SELECT a.edge_id AS a, b.edge_id AS b FROM basket a JOIN basket b ON a.member_id = b.member_id AND a.edge_id <> b.edge_id GROUP BY 1, 2 HAVING count(*) >= 2')
def pattern_shared(spark, sf):
    return match(R.basket(spark, sf), Pattern().shared("a", "b", ">=", 2).distinct("a", "b"))


@query("""WITH n AS (SELECT edge_id, count(*) AS n FROM basket GROUP BY edge_id)
SELECT a.edge_id AS a, b.edge_id AS b FROM basket a JOIN basket b ON a.member_id = b.member_id AND a.edge_id <> b.edge_id JOIN n ON n.edge_id = a.edge_id GROUP BY a.edge_id, b.edge_id, n.n HAVING count(*) = n.n""")
def pattern_subset(spark, sf):
    return match(R.basket(spark, sf), Pattern().subset("a", "b").distinct("a", "b"))


@query("SELECT edge_id AS e FROM basket WHERE edge_id IN (SELECT edge_id FROM basket WHERE member_id = 20000000001) GROUP BY edge_id HAVING count(*) BETWEEN 3 AND 5")
def pattern_card(spark, sf):
    p = Pattern().contains("e", "p").card("e", ">=", 3).card("e", "<=", 5).bind("p", PART_A)
    return match(R.basket(spark, sf), p).select("e")


@query(f"SELECT DISTINCT edge_id AS e, member_id AS p FROM basket WHERE valid_from <= {T0}")
def pattern_valid_at(spark, sf):
    return match(R.basket(spark, sf), Pattern().contains("e", "p").valid_at("e", T0))


_FILL = "CASE WHEN max(CASE WHEN member_id = {0} AND role IN ({1}) THEN 2 WHEN member_id = {0} THEN 1 ELSE 0 END) {2} THEN {3}::DOUBLE ELSE 0.0::DOUBLE END"


def _rank_sql(parts: dict[str, str], scale: float, table: str, having: str = "true", join: str = "", top: int = 20) -> str:
    score = " + ".join(f"({sql}) * ({ranking.PARTS[k]}::DOUBLE / {scale}::DOUBLE)" for k, sql in parts.items())
    return f"SELECT edge_id, round({score}, 9) AS score FROM {table} {join} GROUP BY edge_id HAVING {having} ORDER BY {score} DESC, edge_id LIMIT {top}"


def _ranked(df):
    return df.select("edge_id", F.round("score", 9).alias("score"))


_A, _B = "20000000001", "30000000001"
_MEMBERS = f"({_FILL.format(_A, repr('part'), '> 0', 1)} + {_FILL.format(_B, repr('supplier'), '> 0', 2)}) / 3"
_ROLES = f"({_FILL.format(_A, repr('part'), '= 2', 1)} + {_FILL.format(_B, repr('supplier'), '= 2', 2)}) / 3"
_TOPO = "least(count(*), 6) / greatest(count(*), 6)::DOUBLE"
_SLOTS = [ranking.Slot(PART_A, roles=("part",)), ranking.Slot(R.CODES["Supplier"] * R.STRIDE + 1, roles=("supplier",), weight=2.0)]


@query(_rank_sql({"members": _MEMBERS, "roles": _ROLES, "topology": _TOPO}, sum(ranking.PARTS[k] for k in ("members", "roles", "topology")), " ord "))
def rank_anchor(spark, sf):
    return _ranked(ranking.rank(R.order(spark, sf), _SLOTS, size=6, top=20))


@query(_rank_sql({"members": "1.0::DOUBLE", "roles": "1.0::DOUBLE", "topology": _TOPO}, 0.6, " ord ", "max(CASE WHEN member_id = 20000000001 AND role = 'part' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN member_id BETWEEN 30000000000 AND 39999999999 THEN 1 ELSE 0 END) = 1"))
def rank_typed_slot(spark, sf):
    anyone = ranking.Slot(low=3 * R.STRIDE, high=4 * R.STRIDE - 1, required=True)
    return _ranked(ranking.rank(R.order(spark, sf), [ranking.Slot(PART_A, roles=("part",), required=True), anyone], size=6, top=20))


@query(_rank_sql({"members": "1.0::DOUBLE", "roles": "1.0::DOUBLE", "time": f"max(CASE WHEN member_id = 20000000001 THEN CASE WHEN valid_from <= {T0} THEN 1.0::DOUBLE ELSE exp(-(valid_from - {T0})::DOUBLE / {90.0 * DAY}::DOUBLE) END END)"}, 0.7, " basket ", "max(CASE WHEN member_id = 20000000001 THEN 1 ELSE 0 END) = 1"))
def rank_time_at(spark, sf):
    return _ranked(ranking.rank(R.basket(spark, sf), [ranking.Slot(PART_A, required=True)], at=T0, tau=90.0 * DAY, top=20))


@query(_rank_sql({"members": "1.0::DOUBLE", "roles": "1.0::DOUBLE", "time": f"max(CASE WHEN member_id = 20000000001 THEN greatest({T0 + 365 * DAY} - greatest(valid_from, {T0}), 0)::DOUBLE / {365.0 * DAY}::DOUBLE END)"}, 0.7, " basket ", "max(CASE WHEN member_id = 20000000001 THEN 1 ELSE 0 END) = 1"))
def rank_time_during(spark, sf):
    return _ranked(ranking.rank(R.basket(spark, sf), [ranking.Slot(PART_A, required=True)], during=(T0, T0 + 365 * DAY), top=20))


@query(_rank_sql({"members": "1.0::DOUBLE", "roles": "1.0::DOUBLE", "attributes": "(max(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + max(greatest(0.0::DOUBLE, 1 - abs(o_totalprice - 100000) / 50000::DOUBLE))) / 2"}, 0.7, " basket ", "max(CASE WHEN member_id = 20000000001 THEN 1 ELSE 0 END) = 1", "JOIN orders ON edge_id = 120000000000 + o_orderkey"))
def rank_prefer(spark, sf):
    prefer = [ranking.Preference("o_orderstatus", "F"), ranking.Preference("o_totalprice", 100000.0, 50000.0)]
    return _ranked(ranking.rank(R.basket(spark, sf), [ranking.Slot(PART_A, required=True)], edges=R.edges(spark, sf, "Basket"), prefer=prefer, top=20))


# --- inspection ------------------------------------------------------------------------------------------------------


@query("SELECT -1 AS position, member_id, 'supplier' AS role, weight_fp / 1000000000::DOUBLE AS weight FROM supply WHERE edge_id = 130000000001 AND weight_fp BETWEEN 1000000000 AND 2000000000")
def members_of(spark, sf):
    df = inspect.members_of(R.supply(spark, sf), SUPPLY_A, role="supplier", weights=(1.0, 2.0))
    return df.select(F.col("position").cast("int").alias("position"), "member_id", F.col("roles")[0].alias("role"), "weight")


@query("SELECT edge_id, row_number() OVER (PARTITION BY edge_id ORDER BY pos, member_id) - 1 AS position, member_id, role FROM session ")
def members_ordered(spark, sf):
    return inspect.positions(R.session(spark, sf)).select("edge_id", "position", "member_id", F.col("roles")[0].alias("role"))


@query("SELECT edge_id, role, -1::BIGINT AS position FROM ord WHERE member_id = 20000000001")
def incident_to(spark, sf):
    return inspect.incident_to(R.order(spark, sf), PART_A).select("edge_id", F.col("roles")[0].alias("role"), "position")


@query("""SELECT 'id' AS attribute, '130000000001' AS value UNION ALL SELECT 'type', 'Supply' UNION ALL SELECT 'kind', 'SET' UNION ALL SELECT 'cardinality', (SELECT count(*) FROM supply WHERE edge_id = 130000000001)::VARCHAR
UNION ALL SELECT 'weight', ((SELECT sum(weight_fp) FROM supply WHERE edge_id = 130000000001) / 1000000000::DOUBLE)::VARCHAR UNION ALL SELECT 'degree', '0'
UNION ALL SELECT 'p_brand', p_brand FROM part WHERE p_partkey = 1 UNION ALL SELECT 'p_type', p_type FROM part WHERE p_partkey = 1 UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part WHERE p_partkey = 1 UNION ALL SELECT 'p_retailprice', p_retailprice::VARCHAR FROM part WHERE p_partkey = 1""")
def describe(spark, sf):
    return inspect.describe(R.supply(spark, sf), SUPPLY_A, R.edges(spark, sf, "Supply"))


_HISTOGRAM = "SELECT length(bin(n))::BIGINT AS bucket, count(*) AS rows, CAST(sum(n) AS BIGINT) AS total, max(n) AS largest FROM (SELECT count(*) AS n FROM ord GROUP BY {}) GROUP BY 1"


@query(_HISTOGRAM.format("edge_id"))
def cardinality_histogram(spark, sf):
    return inspect.cardinality_histogram(R.order(spark, sf))


@query(_HISTOGRAM.format("member_id"))
def degree_histogram(spark, sf):
    return inspect.degree_histogram(R.order(spark, sf))


@query("""WITH e AS (SELECT count(*) AS n FROM basket GROUP BY edge_id), m AS (SELECT count(*) AS n FROM basket GROUP BY member_id)
SELECT 'edges' AS metric, count(*)::DOUBLE AS value FROM e UNION ALL SELECT 'incidences', sum(n)::DOUBLE FROM e UNION ALL SELECT 'mean_cardinality', avg(n) FROM e UNION ALL SELECT 'largest_cardinality', max(n)::DOUBLE FROM e
UNION ALL SELECT 'members', count(*)::DOUBLE FROM m UNION ALL SELECT 'mean_degree', avg(n) FROM m UNION ALL SELECT 'largest_degree', max(n)::DOUBLE FROM m""")
def statistics(spark, sf):
    return inspect.statistics(R.basket(spark, sf))


# --- time, views, evidence -------------------------------------------------------------------------------------------


def _log(spark, sf):
    """A log in which each basket is put in the generation of its order's year, and some are removed later."""
    years = R.table(spark, sf, "orders").select(R.atom("Basket", "o_orderkey").alias("edge_id"), F.year("o_orderdate").cast("long").alias("gen"), (F.col("o_orderkey") % 5 == 0).alias("gone"), R.millis("o_orderdate").alias("at"))
    rows = R.basket(spark, sf).join(years, "edge_id").withColumn("branch", F.lit("main"))
    put = F.struct(F.lit("PUT").alias("op"), F.col("gen").alias("gen"), F.col("at").alias("at"))
    removed = F.struct(F.lit("REMOVE").alias("op"), (F.col("gen") + 1).alias("gen"), (F.col("at") + 365 * DAY).alias("at"))
    each = F.when(F.col("gone"), F.array(put, removed)).otherwise(F.array(put))
    return rows.select(*[c for c in rows.columns if c not in ("gone", "gen", "at")], F.inline(each))


_SNAP = "SELECT edge_id, member_id FROM basket JOIN orders ON edge_id = 120000000000 + o_orderkey WHERE year(o_orderdate) <= {0} AND NOT (o_orderkey % 5 = 0 AND year(o_orderdate) + 1 <= {0})"


@query(_SNAP.format(1998))
def as_of(spark, sf):
    return temporal.snapshot(_log(spark, sf), 1998).select("edge_id", "member_id")


@query(f"""WITH a AS ({_SNAP.format(1997)}), b AS ({_SNAP.format(1998)})
SELECT edge_id, member_id, CASE WHEN a.edge_id IS NULL THEN 'ADDED' ELSE 'REMOVED' END AS change FROM a FULL OUTER JOIN b USING (edge_id, member_id) WHERE a.edge_id IS NULL OR b.edge_id IS NULL
UNION ALL SELECT edge_id, NULL, CASE WHEN x.edge_id IS NULL THEN 'CREATED' ELSE 'DELETED' END FROM (SELECT DISTINCT edge_id FROM a) x FULL OUTER JOIN (SELECT DISTINCT edge_id FROM b) y USING (edge_id) WHERE x.edge_id IS NULL OR y.edge_id IS NULL""")
def diff_snapshots(spark, sf):
    return temporal.diff_between(_log(spark, sf), 1997, 1998)


@query(f"""WITH a AS ({_SNAP.format(1997)}), b AS ({_SNAP.format(1998)}), m AS (SELECT edge_id, member_id FROM a JOIN b USING (edge_id, member_id) WHERE member_id % 3 = 0)
SELECT edge_id, member_id, CASE WHEN a.edge_id IS NULL THEN 'ADDED' ELSE 'REMOVED' END AS change FROM a FULL OUTER JOIN b USING (edge_id, member_id) WHERE a.edge_id IS NULL OR b.edge_id IS NULL
UNION ALL SELECT edge_id, NULL, CASE WHEN x.edge_id IS NULL THEN 'CREATED' ELSE 'DELETED' END FROM (SELECT DISTINCT edge_id FROM a) x FULL OUTER JOIN (SELECT DISTINCT edge_id FROM b) y USING (edge_id) WHERE x.edge_id IS NULL OR y.edge_id IS NULL
UNION ALL SELECT edge_id, member_id, 'UPDATED' FROM m""")
def diff_updates(spark, sf):
    """Every third member has another weight in the later snapshot."""
    log = _log(spark, sf)
    later = temporal.snapshot(log, 1998)
    return temporal.diff(temporal.snapshot(log, 1997), later.withColumn("weight_fp", F.col("weight_fp") + F.when(F.col("member_id") % 3 == 0, 1).otherwise(0)))


@query(f"""WITH a AS ({_SNAP.format(1997)}), b AS ({_SNAP.format(1998)})
SELECT edge_id, member_id, CASE WHEN a.edge_id IS NULL THEN 'PUT' ELSE 'REMOVE' END AS op FROM a FULL OUTER JOIN b USING (edge_id, member_id) WHERE a.edge_id IS NULL OR b.edge_id IS NULL""")
def merge_branch(spark, sf):
    log = _log(spark, sf)
    base = temporal.snapshot(log, 1997)
    return temporal.merge(base, temporal.snapshot(log, 1998), base)[0].select("edge_id", "member_id", "op")


def _sides(spark, sf):
    """Two sides of a fork: one raises the weight of members of even id, the other drops those divisible by 3 and raises edges divisible by 5."""
    base = R.basket(spark, sf)
    source = base.withColumn("weight_fp", F.col("weight_fp") + F.when(F.col("member_id") % 2 == 0, 1).otherwise(0)).where("edge_id % 11 <> 0")
    target = base.where("member_id % 3 <> 0").withColumn("weight_fp", F.col("weight_fp") + F.when(F.col("edge_id") % 5 == 0, 2).otherwise(0))
    return base, source, target


_SIDES = """theirs AS (SELECT edge_id, member_id, CASE WHEN edge_id % 11 = 0 THEN 'REMOVE' ELSE 'PUT' END AS op FROM basket WHERE member_id % 2 = 0 OR edge_id % 11 = 0),
ours AS (SELECT edge_id, member_id FROM basket WHERE member_id % 3 = 0 OR edge_id % 5 = 0), lost AS (SELECT edge_id FROM basket GROUP BY edge_id HAVING count(CASE WHEN member_id % 3 <> 0 THEN 1 END) = 0)"""


@query(f"""WITH {_SIDES}
SELECT edge_id, member_id, 'membership' AS conflict FROM theirs JOIN ours USING (edge_id, member_id) WHERE edge_id % 11 <> 0 AND edge_id NOT IN (SELECT edge_id FROM lost)
UNION ALL SELECT DISTINCT edge_id, NULL, 'deleted-while-modified' FROM ours WHERE edge_id % 11 = 0 AND edge_id NOT IN (SELECT edge_id FROM lost)
UNION ALL SELECT DISTINCT edge_id, NULL, 'modified-while-deleted' FROM theirs WHERE edge_id % 11 <> 0 AND edge_id IN (SELECT edge_id FROM lost)""")
def merge_conflicts(spark, sf):
    return temporal.merge(*_sides(spark, sf), "TARGET")[1]


@query(f"""WITH {_SIDES}
SELECT edge_id, member_id, op FROM theirs WHERE (edge_id, member_id) NOT IN (SELECT (edge_id, member_id) FROM ours) AND edge_id NOT IN (SELECT edge_id FROM lost)
AND NOT (edge_id % 11 = 0 AND edge_id IN (SELECT edge_id FROM ours))""")
def merge_keep_target(spark, sf):
    return temporal.merge(*_sides(spark, sf), "TARGET")[0].select("edge_id", "member_id", "op")


@query("""SELECT atom_id, 'status' AS name, CASE WHEN atom_id % 2 = 0 THEN 'X' END AS text, CASE WHEN atom_id % 2 = 0 THEN 'PUT' ELSE 'REMOVE' END AS op FROM ev WHERE (atom_id % 2 = 0 OR atom_id % 7 = 0) AND atom_id % 3 <> 0""")
def merge_properties(spark, sf):
    """A property that one side sets on even atoms and takes from those divisible by 7, the other changes on those divisible by 3."""
    base = R.table(spark, sf, "orders").select((F.lit(11 * R.STRIDE) + F.col("o_orderkey")).alias("atom_id"), F.lit("status").alias("name"), F.col("o_orderstatus").alias("text"))
    source = base.withColumn("text", F.when(F.col("atom_id") % 2 == 0, "X").otherwise(F.col("text"))).where("atom_id % 2 = 0 or atom_id % 7 <> 0")
    target = base.withColumn("text", F.when(F.col("atom_id") % 3 == 0, "Y").otherwise(F.col("text")))
    return temporal.merge_rows(base, source, target, ["atom_id", "name"], "TARGET")[0]


@query("SELECT gen, count(*) AS changes FROM (SELECT year(o_orderdate)::BIGINT AS gen FROM basket JOIN orders ON edge_id = 120000000000 + o_orderkey UNION ALL SELECT year(o_orderdate) + 1 FROM basket JOIN orders ON edge_id = 120000000000 + o_orderkey WHERE o_orderkey % 5 = 0) GROUP BY gen ORDER BY gen DESC LIMIT 3")
def history(spark, sf):
    commits = _log(spark, sf).groupBy("gen").agg(F.count("*").alias("changes"))
    return temporal.history(commits, 3)


@query("SELECT member_id, count(*) AS degree FROM basket JOIN orders ON edge_id = 120000000000 + o_orderkey WHERE o_orderkey % 5 <> 0 GROUP BY member_id")
def view_degree(spark, sf):
    return views.degree(temporal.member_changes(_log(spark, sf)))


@query("SELECT edge_id, count(*) AS cardinality FROM basket JOIN orders ON edge_id = 120000000000 + o_orderkey WHERE o_orderkey % 5 <> 0 GROUP BY edge_id")
def view_cardinality(spark, sf):
    return views.cardinality(temporal.member_changes(_log(spark, sf)))


@query(f"""WITH c AS (SELECT epoch_ms(o_orderdate) AS tm, 1 AS d FROM basket JOIN orders ON edge_id = 120000000000 + o_orderkey UNION ALL SELECT epoch_ms(o_orderdate) + {365 * DAY}, -1 FROM basket JOIN orders ON edge_id = 120000000000 + o_orderkey WHERE o_orderkey % 5 = 0)
SELECT CAST(floor(tm / {30 * DAY}::DOUBLE) AS BIGINT) * {30 * DAY} AS bucket, count(CASE WHEN d > 0 THEN 1 END) AS added, count(CASE WHEN d < 0 THEN 1 END) AS removed FROM c GROUP BY 1""")
def view_activity(spark, sf):
    return views.activity(temporal.member_changes(_log(spark, sf)), 30 * DAY)


def _qualified(spark, sf):
    inc = R.supply(spark, sf).withColumn("qualifier", F.col("member_id") % 4)
    spec = [(0, "OBSERVED", 1.0), (1, "DERIVED", 0.9), (2, "DERIVED", 0.3), (3, "REJECTED", 0.9)]
    q = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("qualifier_id"), F.lit(b).alias("assertion"), F.lit(c).alias("confidence")) for a, b, c in spec])).alias("r")).select("r.*")
    return inc, q


@query("SELECT member_id FROM supply WHERE edge_id = 130000000001 AND member_id % 4 IN (0, 1)")
def members_policy(spark, sf):
    inc, q = _qualified(spark, sf)
    return inspect.members_of(inc, SUPPLY_A, qualifiers=q, policy="SUPPORTED", least=0.5).select("member_id")


@query(f"""SELECT event_id AS signal_id FROM events WHERE epoch_ms(ts) < 1704153600000 AND epoch_ms(ts) + 60000 > 1704110400000 AND 20000000000 + event_id % 2000 IN (SELECT member_id FROM basket WHERE edge_id BETWEEN 120000000000 AND 120000000099 AND valid_from < 1704153600000)""")
def signals_overlap(spark, sf):
    ids = list(range(12 * R.STRIDE, 12 * R.STRIDE + 100))
    signals = R.table(spark, sf, "events").select(F.col("event_id").alias("signal_id"), (F.lit(2 * R.STRIDE) + F.col("event_id") % 2000).alias("atom_id"), R.millis("ts").alias("begin"), (R.millis("ts") + 60000).alias("end"))
    return evidence.signals_for(R.basket(spark, sf), signals, ids, 1704110400000, 1704153600000).select("signal_id")


@query("SELECT atom_id, value FROM (SELECT user_id AS atom_id, max_by(event_type, event_id) AS value FROM events GROUP BY user_id)")
def state_at(spark, sf):
    e = R.table(spark, sf, "events")
    states = e.select(F.col("user_id").alias("atom_id"), F.lit("activity").alias("schema"), F.col("event_type").alias("value"), R.millis("ts").alias("valid_from"), F.lit(R.FOREVER).alias("valid_to"), F.col("event_id").alias("version"))
    return evidence.state_at(states).select("atom_id", "value")


@query("""WITH RECURSIVE up AS (SELECT o_custkey AS c, o_orderkey + 1000000000 AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
links AS (SELECT c AS id, n, e AS "to", 'evidence' AS kind FROM up UNION ALL SELECT o_orderkey + 1000000000, 0, (o_custkey + 1) % 1000, 'source' FROM orders WHERE o_orderkey % 3 = 0),
walk AS (SELECT [0::BIGINT] AS step, 1::BIGINT AS id, 'assertion' AS kind, [1::BIGINT] AS path
UNION ALL SELECT list_append(step, n), "to", l.kind, list_append(path, "to") FROM walk w JOIN links l ON l.id = w.id WHERE len(step) < 4 AND len(path) = len(list_distinct(path))),
first AS (SELECT id, min(step) AS step FROM walk GROUP BY id),
again AS (SELECT DISTINCT w.step FROM (SELECT step, path, unnest(range(1, len(path))) AS i FROM walk) w JOIN first f ON f.id = w.path[w.i] WHERE w.step[:w.i] <> f.step)
SELECT array_to_string(w.step, ',') AS step, w.id AS id, CASE WHEN w.step = f.step THEN w.kind ELSE 'cycle' END AS kind FROM walk w JOIN first f ON f.id = w.id WHERE w.step NOT IN (SELECT step FROM again)""")
def trace_provenance(spark, sf):
    o = R.table(spark, sf, "orders")
    assertions = o.select(F.col("o_custkey").alias("c"), "o_orderkey").groupBy(F.col("c").alias("id")).agg(F.sort_array(F.collect_list(F.col("o_orderkey") + 1_000_000_000)).alias("evidence"))
    sources = o.select((F.col("o_orderkey") + 1_000_000_000).alias("id"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") + 1) % 1000).alias("source"))
    return evidence.trace(assertions, sources, 1, 4).withColumn("step", F.array_join("step", ","))


@query("""SELECT 'cardinality' AS kept, edge_id AS id, count(*) AS n, true AS same FROM basket GROUP BY edge_id UNION ALL SELECT 'degree', member_id, count(*), true FROM basket GROUP BY member_id""")
def sample_swaps(spark, sf):
    """What swaps keep: sizes of edges and degrees of members; `same` says that no membership comes twice."""
    rows = swap_members(R.basket(spark, sf), swaps=5000, seed=3).rows
    each = lambda kept, by: rows.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("edge_id", "member_id").alias("d")).select(F.lit(kept).alias("kept"), F.col(by).alias("id"), "n", (F.col("n") == F.col("d")).alias("same"))
    return each("cardinality", "edge_id").union(each("degree", "member_id"))


# --- semantic plane --------------------------------------------------------------------------------------------------

_QUERY = [((i * 37) % 17 - 8) / 8 for i in range(64)]


@query(f"SELECT vec_id AS atom_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], [{', '.join(map(str, _QUERY))}]::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], [{', '.join(map(str, _QUERY))}]::DOUBLE[]), vec_id LIMIT 20")
def similar_topk(spark, sf):
    vectors = R.table(spark, sf, "embeddings").select(F.col("vec_id").alias("atom_id"), F.col("embedding").alias("vector"))
    return semantic.nearest(vectors, _QUERY, 20).select("atom_id", F.round("distance", 6).alias("distance"))


_HASHED = """t AS (SELECT 20000000000 + p_partkey AS atom_id, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS tok FROM part UNION ALL SELECT -1, unnest(['small', 'ring'])),
f AS (SELECT atom_id, tok AS x, 1.0::DOUBLE AS w FROM t UNION ALL SELECT atom_id, substr('^' || tok || '$', i::INT, 3), 0.5 FROM (SELECT atom_id, tok, unnest(range(1, length(tok) + 1)) AS i FROM t)),
h AS (SELECT atom_id, ('0x' || substr(md5(x), 1, 15))::BIGINT % 64 AS dim, sum(CASE WHEN substr(md5(x), 16, 1) >= '8' THEN w ELSE -w END) AS v FROM f GROUP BY 1, 2),
u AS (SELECT atom_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY atom_id)) AS v FROM h)"""


@query(f"WITH {_HASHED} SELECT atom_id, dim, round(v, 4) AS value FROM u WHERE v <> 0 AND atom_id > 0")
def encoder_hashing(spark, sf):
    docs = R.nodes(spark, sf, "Part").select("atom_id", F.col("name").alias("text"))
    each = semantic.embed(docs, 64).select("atom_id", F.posexplode("vector").alias("dim", "value"))
    return each.where("value <> 0").select("atom_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 4).alias("value"))


@query(f"WITH {_HASHED}, d AS (SELECT a.atom_id, 1 - sum(a.v * b.v) AS distance FROM u a JOIN u b ON b.atom_id = -1 AND a.dim = b.dim WHERE a.atom_id > 0 GROUP BY a.atom_id) SELECT round(distance, 4) AS distance, count(*) AS n FROM d WHERE distance < 0.6 GROUP BY 1")
def similar_text(spark, sf):
    """How many parts there are at each distance under 0.6; equal distances are told apart by rounding errors alone."""
    docs = R.nodes(spark, sf, "Part").select("atom_id", F.col("name").alias("text"))
    target = semantic.encode_text("small ring", 64).tolist()
    found = semantic.embed(docs, 64).select(semantic.cosine_distance(F.col("vector"), F.array(*[F.lit(x) for x in target])).alias("d"))
    return found.where("d < 0.6").groupBy(F.round("d", 4).alias("distance")).agg(F.count("*").alias("n"))
