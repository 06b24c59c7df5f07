"""Graph operators on a small graph whose answers are worked out by hand, and the registered queries against SQL."""

import math
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hyperweave import queries as Q
from hyperweave.functions import values as V
from hyperweave.operators import algebra, evidence, flow, inspect, overlap, semantic, structure, temporal, views
from hyperweave.operators import rank as ranking
from hyperweave.operators.pattern import Pattern, match
from hyperweave.operators.sample import swap_members
from hyperweave.plans.match import Match
from hyperweave.sources import relational as R

ANN, BEN, CAT, PILL = 1, 2, 3, 4
E1, E2, E3, PATH = 11, 12, 13, 14


def row(edge, member, roles=(), weight=1.0, valid=(R.EVER, R.FOREVER), pos=-1, kind="SET", type="Claim", qualifier=None):
    return (edge, member, type, kind, pos, list(roles), round(weight * R.FIXED), valid[0], valid[1], qualifier)


@pytest.fixture(scope="module")
def inc(spark):
    rows = [
        row(E1, ANN, ["buyer", "approver"], 0.5, (100, 200)), row(E1, BEN, ["seller"]), row(E1, PILL),
        row(E2, ANN, ["buyer"]), row(E2, CAT, ["provider"]),
        row(E3, CAT), row(E3, BEN),
        row(PATH, ANN, pos=10, kind="ORDERED", type="Route"), row(PATH, BEN, pos=20, kind="ORDERED", type="Route"), row(PATH, E1, pos=15, kind="ORDERED", type="Route"),
    ]
    return spark.createDataFrame(rows, R.INCIDENCE).cache()


def ids(df, column=None):
    return sorted(r[column or df.columns[0]] for r in df.collect())


def test_algebra(inc):
    assert ids(algebra.intersect(inc, E1, E3)) == [BEN]
    assert ids(algebra.union(inc, E1, E2)) == [ANN, BEN, CAT, PILL]
    assert ids(algebra.difference(inc, E1, E3)) == [ANN, PILL]
    got = algebra.measures(inc, E2, E3).first()
    assert (got.subset, got.equal, got.jaccard, got.containment, got.overlap) == (False, False, 1 / 3, 0.5, 1)
    empty = algebra.measures(inc, 98, 99).first()
    assert (empty.subset, empty.jaccard, empty.containment) == (True, 1.0, 0.0)
    made = algebra.combined(inc, E1, E2, "union", 77).collect()
    assert {(r.member_id, r.weight_fp) for r in made} == {(ANN, R.FIXED // 2), (BEN, R.FIXED), (PILL, R.FIXED), (CAT, R.FIXED)}
    with pytest.raises(ValueError):
        algebra.combined(inc, E1, PATH, "union", 77)
    assert ids(algebra.containing(inc, [ANN, (BEN, ["seller"])])) == [E1]
    assert ids(algebra.containing(inc, [(ANN, ["nobody"])])) == []


def test_flow(spark, inc):
    assert flow.reduce_edge(flow.gather(inc, E1), "sum").first()[0] == 2.5
    ages = spark.createDataFrame([(ANN, 34.0), (BEN, 41.0), (CAT, None)], "atom_id long, value double")
    gathered = flow.gather(inc, E1, ages)
    assert flow.reduce_edge(gathered, "mean").first()[0] == 37.5
    assert flow.reduce_edge(gathered, "sum", weighted=True).first()[0] == 17 + 41
    assert flow.reduce_edge(gathered, "count").first()[0] == 2
    text = spark.createDataFrame([(ANN, "x")], "atom_id long, value string")
    assert math.isnan(flow.reduce_edge(flow.gather(inc, E1, text), "sum").first()[0])
    assert {r.edge_id: r.value for r in flow.edge_values(inc, ages).collect()}[E1] == 75.0
    cost = spark.createDataFrame([(E1, 120.5), (E2, 80.0)], "atom_id long, value double")
    assert {r.member_id: r.value for r in flow.scatter(inc, cost).collect()} == {ANN: 200.5, BEN: 120.5, PILL: 120.5, CAT: 80.0, E1: 0.0}


def test_kernel_gets_whole_edges_many_at_a_time(spark):
    """Edges of 1 to 40 members, some longer than a batch: each comes once and whole, and calls are far fewer than edges."""
    import pandas as pd

    rows = [(e, m) for e in range(300) for m in range(e % 40 + 1)]
    df = spark.createDataFrame([*rows, (None, 1), (None, 2)], "edge_id long, member_id long")

    def sizes(f):
        return f.groupby("edge_id", as_index=False, dropna=False).agg(n=("member_id", "size")).assign(calls=[1] + [0] * (f["edge_id"].nunique(dropna=False) - 1))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        got = flow.kernel(df, sizes, "edge_id long, n long, calls long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.edge_id is None, r.edge_id or 0, r.n) for r in got) == [(False, e, e % 40 + 1) for e in range(300)] + [(True, 0, 2)]
    assert sum(r.calls for r in flow.kernel(df, sizes, "edge_id long, n long, calls long").collect()) < 30
    frames = [pd.DataFrame({"edge_id": x}) for x in ([1, 1], [], [1, 2], [2], [3, 4], [4, 4], [5])]
    assert [f["edge_id"].tolist() for f in flow.whole_edges(iter(frames))] == [[1, 1, 1], [2, 2, 3], [4, 4, 4], [5]]


def test_overlap(inc):
    claims = inc.where("type = 'Claim'")
    assert {(r.left, r.right, r.overlap) for r in overlap.overlap_join(claims, 0).collect()} == {(E1, E2, 1), (E1, E3, 1), (E2, E3, 1)}
    assert overlap.overlap_join(inc, 2).collect() == overlap.overlap_join(inc, 2, prefix=True).collect()
    assert {r.neighbor for r in overlap.neighbors_of_node(claims, ANN).collect()} == {BEN, CAT, PILL}
    assert {r.neighbor for r in overlap.neighbors_of_edge(inc, E1).collect()} == {E2, E3, PATH}
    assert overlap.adjacent(inc, ANN, BEN, 2).first()[0] and not overlap.adjacent(inc, ANN, CAT, 2).first()[0]


@pytest.fixture(scope="module")
def crowd(spark):
    """Edges of 0 to 40 members out of 50, some alike, with weights."""
    import random

    rng = random.Random(8)
    sizes = [1, 1, 2, 2, 3, 5, 16, 17, 30, 40]
    edges = {100 + i: rng.sample(range(50), sizes[i % 10]) for i in range(60)} | {200: [1, 2, 3], 201: [1, 2, 3], 202: [1, 2, 3, 4], 203: [7], 204: [7]}
    weights = {(e, m): rng.randint(1, 40) for e, ms in edges.items() for m in ms}
    df = spark.createDataFrame([row(e, m, weight=w) for (e, m), w in weights.items()], R.INCIDENCE).cache()
    pairs = {(a, b): [min(weights[a, m], weights[b, m]) for m in set(edges[a]) & set(edges[b])] for a in edges for b in edges if a < b}
    return df, edges, {k: v for k, v in pairs.items() if v}


def test_overlaps_of_small_and_large_edges(crowd):
    df, edges, pairs = crowd
    for t in (1, 2, 3, 6):
        want = {k: len(v) for k, v in pairs.items() if len(v) >= t}
        for prefix in (False, True):
            assert {(r.left, r.right): r.overlap for r in overlap.overlap_join(df, t, prefix).collect()} == want
    assert {r.overlap: r.pairs for r in overlap.overlap_histogram(df).collect()} == Counter(map(len, pairs.values()))
    for t in (0.0, 20.0, 60.0):
        assert sorted((r.left, r.right, r.weight_fp) for r in overlap.weighted_overlap(df, t).collect()) == sorted((*k, sum(v) * R.FIXED) for k, v in pairs.items() if sum(v) > t)
    for k in (1, 2, 7):
        each = {e: sorted((-len(v), b if a == e else a) for (a, b), v in pairs.items() if e in (a, b))[:k] for e in edges}
        got = overlap.overlap_top(df, k).collect()
        assert sorted((r.edge_id, r.place, r.partner, r.overlap) for r in got) == sorted((e, i, p, -n) for e, found in each.items() for i, (n, p) in enumerate(found, 1))


def test_pairs_that_share_one_member_are_not_listed(crowd):
    """Joins on a single member are left to what only large edges, single members or heavy weights bring in."""
    import re

    for df in (overlap.overlap_join(crowd[0], 2), match(crowd[0], Pattern().shared("a", "b", ">=", 2).distinct("a", "b"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert any("a#" in x and "b#" in x for x in re.findall(r"Join Inner.*", plan))


def test_patterns_of_small_and_large_edges(crowd):
    df, edges, pairs = crowd
    sets = {e: set(m) for e, m in edges.items() if m}
    for apart in (True, False):
        done = lambda p: match(df, p.distinct("a", "b") if apart else p)
        both = [(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if not (apart and a == b) and sets[a] & sets[b]]
        for op, n, holds in ((">=", 2, lambda c: c >= 2), ("=", 3, lambda c: c == 3), ("<=", 2, lambda c: c <= 2), ("!=", 1, lambda c: c != 1)):
            assert sorted((r.a, r.b) for r in done(Pattern().shared("a", "b", op, n)).collect()) == sorted((a, b) for a, b, c in both if holds(c))
        assert sorted((r.a, r.b) for r in done(Pattern().subset("a", "b")).collect()) == sorted((a, b) for a, b, c in both if c == len(sets[a]))


def test_structure(spark, inc):
    walk = structure.expand(inc, PATH, 3).orderBy("place").collect()
    assert [(r.atom, r.status) for r in walk] == [(ANN, "EMIT"), (ANN, "EMIT"), (BEN, "EMIT"), (PILL, "EMIT"), (BEN, "EMIT")]
    assert walk[1].path == [PATH, E1, ANN]
    flat = structure.expand(inc, PATH, 1).orderBy("place").collect()
    assert [(r.atom, r.status, r.path) for r in flat] == [(ANN, "EMIT", [PATH, ANN]), (E1, "DEPTH_LIMIT", [PATH, E1]), (BEN, "EMIT", [PATH, BEN])]
    loop = spark.createDataFrame([row(21, 22), row(22, 21)], R.INCIDENCE)
    assert [(r.atom, r.status, r.path) for r in structure.expand(loop, 21, 5).collect()] == [(21, "CYCLE", [21, 22, 21])]
    # The root and the nested edge cost a step each.
    short = structure.expand(inc, PATH, 3, budget=3).orderBy("place").collect()
    assert [(r.atom, r.status) for r in short] == [(ANN, "EMIT"), (ANN, "BUDGET_EXHAUSTED")]
    assert [r.status for r in structure.expand(inc, PATH, 3, budget=7).collect()].count("BUDGET_EXHAUSTED") == 0
    diamond = spark.createDataFrame([row(31, 32), row(31, 33), row(32, 34), row(33, 34), row(34, 1)], R.INCIDENCE)
    assert sorted(r.path for r in structure.expand(diamond, 31, 4).collect()) == [[31, 32, 34, 1], [31, 33, 34, 1]]
    childless = spark.createDataFrame([(21,), (22,), (23,)], "edge_id long")
    assert structure.expand(spark.createDataFrame([row(21, 23)], R.INCIDENCE), 21, 3, edges=childless).count() == 0
    with pytest.raises(ValueError):
        structure.expand(inc, ANN)
    assert sorted(map(tuple, (r.members for r in structure.closure(inc, E2, 1).collect()))) == [(ANN,), (ANN, CAT), (CAT,)]
    assert structure.closure(inc, E1, 2).count() == 7


def test_pattern(inc):
    claims = inc.where("type = 'Claim'")
    got = match(claims, Pattern().contains("x", "p").contains("y", "p").distinct("x", "y").bind("p", CAT))
    assert {(r.x, r.y) for r in got.collect()} == {(E2, E3), (E3, E2)}
    assert ids(match(inc, Pattern().contains("e", "p", "buyer").card("e", ">", 2)), "e") == [E1]
    assert ids(match(inc, Pattern().contains("e", "p").valid_at("e", 250).bind("p", ANN)), "e") == [E2, PATH]
    assert match(inc, Pattern().edge("e", "Nothing").contains("e", "p")).count() == 0
    atoms = inc.sparkSession.createDataFrame([(ANN, "Person"), (PILL, "Drug"), (E1, "Claim")], "atom_id long, type string")
    assert {r.p for r in match(inc, Pattern().contains("e", "p").typed("p", "Person"), atoms).collect()} == {ANN}
    assert {r.p for r in match(inc, Pattern().contains("e", "p").typed("p", "Claim"), atoms).collect()} == {E1}
    with pytest.raises(ValueError):
        match(inc, Pattern().contains("e", "p").contains("f", "q"))
    assert match(inc, Pattern().contains("e", "p").bind("e", E1).contains("f", "q").bind("f", E2), product=True).count() == 6


def test_rank(inc):
    slots = [ranking.Slot(ANN, roles=("buyer",), required=True), ranking.Slot(BEN, roles=("provider",))]
    rows = ranking.rank(inc, slots, at=150, top=5).collect()
    assert [r.edge_id for r in rows] == [E1, E2]
    assert rows[0].members == 1.0 and rows[0].roles == 0.5 and rows[0].time == 1.0 and rows[0].topology is None
    late = ranking.rank(inc, [ranking.Slot(ANN, required=True, roles=("approver",))], at=299, tau=100.0).first()
    assert late.time == pytest.approx(math.exp(-1))
    with pytest.raises(ValueError):
        ranking.rank(inc, [], top=5)


def test_inspect(spark, inc):
    assert [(r.position, r.member_id) for r in inspect.members_of(inc, PATH).orderBy("position").collect()] == [(0, ANN), (1, E1), (2, BEN)]
    assert {r.position for r in inspect.members_of(inc, E1, role="seller").collect()} == {-1}
    assert ids(inspect.members_of(inc, E1, at=250), "member_id") == [BEN, PILL]
    assert {(r.edge_id, r.position) for r in inspect.incident_to(inc, BEN).collect()} == {(E1, -1), (E3, -1), (PATH, 2)}
    q = spark.createDataFrame([(1, "REJECTED", 0.9)], "qualifier_id long, assertion string, confidence double")
    marked = evidence.with_evidence(inc, E1, BEN, 1)
    assert ids(inspect.members_of(marked, E1, qualifiers=q, policy="SUPPORTED"), "member_id") == [ANN, PILL]
    assert {r.bucket: r.rows for r in inspect.cardinality_histogram(inc).collect()} == {2: 4}


def test_values(spark):
    df = spark.createDataFrame([(1, 4.0, "Ab", '{"a": [{"b": 1}, {"b": 2}]}'), (2, None, None, "no")], "id int, x double, s string, j string")
    x = F.col("x")
    first = lambda c: [r[0] for r in df.orderBy("id").select(c).collect()]
    assert first(~V.gt(x, 3)) == [False, True]
    assert first(V.ne(x, 4.0)) == [False, True] and first(V.eq(x, None)) == [False, False]
    assert first(V.between(x, None, 5)) == [True, False]
    assert first(V.lower(F.col("s"))) == ["ab", "null"] and first(V.length(F.col("s"))) == [2, 4]
    assert first(V.divide(x, 0)) == [math.inf, None]
    assert first(V.json(F.col("j"), "$.a[*].b", "int")) == [1, None]
    assert first(V.bits(F.col("id"))) == [1, 2]


def test_match(spark, inc):
    people = spark.createDataFrame([(ANN, "P", 34), (BEN, "P", 41), (CAT, "P", None)], "atom_id long, type string, age int")
    m = Match(people, inc)
    assert [r.atom_id for r in m.order_by(F.col("age"), descending=True).returns().collect()] == [BEN, ANN, CAT]
    assert [r.atom_id for r in m.order_by(F.col("age")).limit(1).returns().collect()] == [CAT]
    got = m.order_by(F.col("age"), descending=True).limit(1).aggregates({"n": F.count("*")}, {"first": F.col("atom_id")}).first()
    assert (got.n, got.first) == (3, BEN)
    assert ids(m.member_of(E3).returns()) == [BEN, CAT]
    assert {r.atom_id: r.degree for r in m.with_degree().returns(atom_id=F.col("atom_id"), degree=F.col("degree")).collect()} == {ANN: 3, BEN: 3, CAT: 2}


def test_time(spark, inc):
    put = inc.where("type = 'Claim'").withColumn("gen", F.lit(1).cast("long")).withColumn("branch", F.lit("main")).withColumn("op", F.lit("PUT"))
    gone = put.where(f"edge_id = {E3}").withColumn("gen", F.lit(2).cast("long")).withColumn("op", F.lit("REMOVE"))
    log = put.union(gone)
    one, two = temporal.snapshot(log, 1), temporal.snapshot(log, 2)
    assert one.count() == 7 and two.count() == 5
    assert {(r.member_id, r.change) for r in temporal.diff(one, two).collect()} == {(CAT, "REMOVED"), (BEN, "REMOVED"), (None, "DELETED")}
    fewer = one.where(f"not (edge_id = {E1} and member_id = {BEN})")
    with pytest.raises(ValueError):
        temporal.merge(one, fewer, fewer)
    assert temporal.merge(one, two, two)[0].count() == 0  # both sides deleted the same edge
    taken, conflicts = temporal.merge(one, two, one)
    assert taken.count() == 2 and conflicts.count() == 0
    assert {r.member_id: r.degree for r in views.degree(temporal.member_changes(log)).collect()} == {ANN: 2, BEN: 1, CAT: 1, PILL: 1}


def test_trace_and_signals(spark, inc):
    a = spark.createDataFrame([(1, [101, 102])], "id long, evidence array<long>")
    e = spark.createDataFrame([(101, 1), (102, None)], "id long, source long")
    assert [(r.id, r.kind) for r in evidence.trace(a, e, 1).orderBy("step").collect()] == [(1, "assertion"), (101, "evidence"), (1, "cycle"), (102, "evidence")]
    s = spark.createDataFrame([(7, ANN, 150, 300), (8, CAT, 150, 300)], "signal_id long, atom_id long, begin long, end long")
    assert ids(evidence.signals_for(inc, s, [E1], 120, 160), "signal_id") == [7]


def test_swaps_keep_degrees_and_sizes(spark):
    rows = [row(100 + e, (e * 3 + k * 7) % 30, weight=0.5 + k) for e in range(10) for k in range(4)]
    before = spark.createDataFrame(rows, R.INCIDENCE)
    after = swap_members(before, 40, seed=5)
    for key in ("edge_id", "member_id"):
        assert sorted(before.groupBy(key).count().collect()) == sorted(after.rows.groupBy(key).count().collect())
    pairs = {(r.edge_id, r.member_id) for r in after.rows.collect()}
    assert len(pairs) == 40 and pairs != {(r[0], r[1]) for r in rows}
    assert after.accepted > 0 and after.accepted + after.rejected == 40
    again = swap_members(before, 40, seed=5)
    assert {(r.edge_id, r.member_id) for r in again.rows.collect()} == pairs and again[1:] == after[1:]
    alone = swap_members(before.where("edge_id = 100"), 3)
    assert alone.rows.count() == 4 and alone[1:] == (0, 3)


def test_merge_of_edges_and_properties(spark):
    base = spark.createDataFrame([row(1, 11), row(1, 12), row(2, 11), row(3, 11, kind="ORDERED", pos=1), row(3, 12, kind="ORDERED", pos=2), row(4, 11)], R.INCIDENCE)
    source = spark.createDataFrame([row(1, 11, weight=2.0), row(1, 12), row(3, 12, kind="ORDERED", pos=1), row(3, 11, kind="ORDERED", pos=2), row(4, 11), row(4, 13)], R.INCIDENCE)
    target = spark.createDataFrame([row(1, 11), row(1, 12), row(1, 14), row(2, 11), row(2, 15), row(3, 11, kind="ORDERED", pos=1), row(3, 12, kind="ORDERED", pos=2), row(3, 16, kind="ORDERED", pos=3)], R.INCIDENCE)
    found = lambda how: {(r.edge_id, r.member_id, r.op) for r in temporal.merge(base, source, target, how)[0].collect()}
    whole = {(1, 11, "PUT"), (3, 11, "PUT"), (3, 12, "PUT"), (3, 16, "REMOVE")}
    assert found("SOURCE") == whole | {(2, 11, "REMOVE"), (2, 15, "REMOVE")}
    assert found("TARGET") == whole
    kinds = {(r.edge_id, r.conflict) for r in temporal.merge(base, source, target, "TARGET")[1].collect()}
    assert kinds == {(2, "deleted-while-modified"), (4, "modified-while-deleted")}
    with pytest.raises(ValueError):
        temporal.merge(base, source, target)
    props = [spark.createDataFrame(x, "atom_id long, name string, text string") for x in ([(1, "a", "x"), (1, "b", "x"), (2, "a", "x")], [(1, "a", "y"), (2, "a", "z"), (3, "a", "n")], [(1, "a", "w"), (1, "b", "x"), (2, "a", "z")])]
    rows, conflicts = temporal.merge_rows(*props, ["atom_id", "name"], "TARGET")
    assert {(r.op, r.atom_id, r.name, r.text) for r in rows.collect()} == {("REMOVE", 1, "b", None), ("PUT", 3, "a", "n")}
    assert [(r.atom_id, r.name) for r in conflicts.collect()] == [(1, "a")]


def test_diff_of_one_log_equals_diff_of_snapshots(spark, inc):
    put = inc.where("type = 'Claim'").withColumn("gen", F.lit(1).cast("long")).withColumn("branch", F.lit("main")).withColumn("op", F.lit("PUT"))
    log = put.union(put.where(f"edge_id = {E3}").withColumn("gen", F.lit(2).cast("long")).withColumn("op", F.lit("REMOVE"))).union(put.where(f"edge_id = {E1}").withColumn("gen", F.lit(3).cast("long")).withColumn("weight_fp", F.lit(7).cast("long")))
    for a, b in ((1, 3), (2, 3), (3, 1), (0, 2)):
        want = temporal.diff(temporal.snapshot(log, a), temporal.snapshot(log, b))
        assert sorted(map(str, want.collect())) == sorted(map(str, temporal.diff_between(log, a, b).collect()))


def plan_of(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_merge_shuffles_its_three_sides_once(inc):
    changes, conflicts = temporal.merge(inc, inc.where("member_id <> 3"), inc, "TARGET")
    assert "Join" not in plan_of(changes) and plan_of(changes).count("Repartition") == 1
    assert sorted((r.edge_id, r.member_id, r.op) for r in changes.collect()) == [(E2, CAT, "REMOVE"), (E3, CAT, "REMOVE")]
    assert conflicts.count() == 0


def test_rank_sorts_no_rows(inc):
    for asked in ({}, {"at": 150}):
        found = ranking.rank(inc, [ranking.Slot(ANN, roles=("buyer",)), ranking.Slot(BEN)], size=3, **asked)
        assert "SortAggregate" not in plan_of(found, "executedPlan")


def test_subsets_meet_members_without_a_product_of_partitions(spark, inc):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = structure.closure(inc, E1, 2)
        assert "CartesianProduct" not in plan_of(found, "executedPlan")
        assert found.count() == 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_tasks_grow_with_the_tables_read(spark, tmp_path, monkeypatch):
    from hyperweave.sources import scratch

    spark.range(10).selectExpr("id as l_orderkey", "id as l_partkey", "id as l_suppkey", "1.0D as l_quantity", "timestamp '2000-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(10).selectExpr("id as o_orderkey", "id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    tables = [R.order(spark, str(tmp_path)), R.basket(spark, str(tmp_path))]
    size = [scratch.input_bytes(df) for df in tables]
    assert min(size) > 1000 and scratch.input_bytes(tables[0].join(tables[1], "edge_id")) == sum(size)
    monkeypatch.setattr(scratch, "SHARE", 100)
    for make, n in ((R.order, size[0]), (R.basket, size[1])):
        assert f", {n // 100}" in plan_of(make(spark, str(tmp_path)))
    assert tables[0].count() == 30


def test_semantic(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, None)], "atom_id long, text string")
    near = semantic.nearest(semantic.embed(docs, 64), semantic.encode_text("Red APPLE", 64).tolist(), 3).collect()
    assert near[0].atom_id == 1 and near[0].distance == pytest.approx(0, abs=1e-6)
    assert next(r for r in near if r.atom_id == 3).distance == 1.0


def test_continuous_view_equals_batch(spark, tmp_path):
    from hyperweave.streaming import continuous

    rows = [(1, 10, E1, ANN, 1), (1, 10, E1, BEN, 1), (2, 70_000, E1, BEN, -1), (3, 80_000, E2, ANN, 1)]
    folder = f"file://{tmp_path}/in"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, continuous.CHANGES).coalesce(1).write.mode("append").parquet(folder)
        for view in ("degree", "activity"):
            continuous.keep(continuous.changes(spark, folder, 1), view, f"file://{tmp_path}/{view}", f"file://{tmp_path}/c-{view}").awaitTermination()
    assert {tuple(r) for r in continuous.current(spark, f"file://{tmp_path}/degree")[0].collect()} == {(ANN, 2)}
    assert {tuple(r) for r in continuous.current(spark, f"file://{tmp_path}/activity")[0].collect()} == {(0, 2, 0), (60_000, 1, 1)}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["overlap_join_t2", "scatter_weighted", "match_aggregate", "rank_prefer", "diff_snapshots", "diff_updates", "pattern_subset", "pattern_typed_member", "expand_depth2", "expand_depth1", "merge_conflicts", "merge_keep_target", "merge_properties", "trace_provenance", "sample_swaps", "encoder_hashing", "similar_text"])
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({Q.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(df.select(*columns).collect()) == plain(want)
