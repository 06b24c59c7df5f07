"""The statement language over a store, on a small graph of claims."""

import pytest

from hyperweave.plans.lexer import SyntaxProblem
from hyperweave.plans.session import open_session

SETUP = """
CREATE NODE TYPE Person (name STRING INDEXED REQUIRED, age INT INDEXED);
CREATE NODE TYPE Drug (name STRING);
CREATE SET EDGE TYPE Claim (amount FLOAT INDEXED) ROLES (buyer, seller, provider, approver);
CREATE ORDERED EDGE TYPE Route;
BEGIN;
INSERT NODE Person 'ann' {name: 'Ann', age: 34} AS $ann;
INSERT NODE Person 'ben' {name: 'Ben', age: 41} AS $ben;
INSERT NODE Person 'cat' {name: 'Cat'} AS $cat;
INSERT NODE Drug 'pill' {name: 'Pill'} AS $pill;
INSERT EDGE Claim {amount: 120.5} MEMBERS ($ann AS buyer|approver WEIGHT 0.5, $ben AS seller, $pill) AS $c1;
INSERT EDGE Claim {amount: 80.0} MEMBERS ($ann AS buyer, $cat AS provider) AS $c2;
INSERT EDGE Claim {amount: 15.0} MEMBERS ($cat, $ben) AS $c3;
INSERT EDGE Route MEMBERS ($ann, $ben, $cat) AS $route;
DOCUMENT $ann '{"zip": 94110}';
COMMIT
"""


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    s = open_session(spark, f"file://{tmp_path_factory.mktemp('graph')}")
    s.run_script(SETUP)
    return s


def values(df):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.collect()]


def test_match(session):
    assert values(session.run("MATCH c:Claim WHERE c CONTAINS ($ann, $ben) RETURN c.amount, card(c)")) == [(120.5, 3)]
    assert values(session.run("MATCH c:Claim WHERE c HAS @Person:'cat' AS provider RETURN c.amount")) == [80.0]
    assert values(session.run("MATCH p:Person WHERE NOT p.age > 35 RETURN p.name ORDER BY p.age DESC")) == ["Ann", "Cat"]
    assert values(session.run("MATCH p:Person WHERE p.age BETWEEN 30 AND 45 RETURN p.name ORDER BY p.age DESC LIMIT 1")) == ["Ben"]
    assert values(session.run("MATCH p:Person RETURN count(*) AS n, max(p.name) AS last")) == [(3, "Cat")]
    assert values(session.run("MATCH p:Person WHERE json(p, '$.zip') = 94110 OR p.name = 'Ben' RETURN lower(p.name) AS n ORDER BY p.name")) == ["ann", "ben"]


def test_operators(session):
    assert values(session.run("REDUCE sum(weight) OVER $c1")) == [2.5]
    assert values(session.run("SUBSET $c3, $c1")) == [False]
    assert values(session.run("OVERLAP $c1, $c2")) == [1]
    assert len(values(session.run("OVERLAP JOIN Claim THRESHOLD 1"))) == 3
    assert [r[0] for r in values(session.run("MEMBERS OF $route"))] == [0, 1, 2]
    assert len(values(session.run("CLOSURE $c2 DIM 1"))) == 3


def test_versions_and_branches(session):
    before = session.base
    session.run("SET $ann.age = 35")
    assert values(session.run("MATCH p:Person WHERE p = $ann RETURN p.age")) == [35.0]
    assert values(session.run(f"AT GENERATION {before} MATCH p:Person WHERE p = $ann RETURN p.age")) == [34.0]
    with pytest.raises(ValueError, match="past"):
        session.run(f"AT GENERATION {before} SET $ann.age = 1")
    session.run_script("BEGIN; INSERT NODE Person 'dan' {name: 'Dan'}; ROLLBACK")
    assert values(session.run("MATCH p:Person WHERE key(p) = 'dan' RETURN p.name")) == []
    session.run_script("CREATE BRANCH trial; USE BRANCH trial; ADD $pill TO $route AT 1; REMOVE AT 0 FROM $route")
    assert [r[1] for r in values(session.run("MEMBERS OF $route"))] == [session.variables[v] for v in ("$pill", "$ben", "$cat")]
    session.run("USE MAIN")
    assert len(values(session.run("MEMBERS OF $route"))) == 3
    session.run("MERGE BRANCH trial")
    assert [r[1] for r in values(session.run("MEMBERS OF $route"))] == [session.variables[v] for v in ("$pill", "$ben", "$cat")]


def test_problems(session):
    for text in ("MATCH p:Nothing RETURN p.name", "INSERT NODE Person {age: 3}", "INSERT NODE Person 'ann' {name: 'x'}", "MATCH p RETURN no(p)", "DESCRIBE $nobody"):
        with pytest.raises(ValueError):
            session.run(text)
    with pytest.raises(SyntaxProblem):
        session.run("MATCH p:Person RETURN p.name extra")


def test_more_statements(session):
    v = session.variables
    rows = values(session.run("PATTERN (x:Claim, y:Claim, p) WHERE x CONTAINS p AND y CONTAINS p AND x != y AND p = $cat"))
    assert {r[:2] for r in rows} == {(v["$c2"], v["$c3"]), (v["$c3"], v["$c2"])}
    ranked = session.run("RANK EDGE c:Claim LIKE ($ann AS buyer REQUIRED, $ben AS seller) TOP 3").collect()
    assert [r.edge_id for r in ranked] == [v["$c1"], v["$c2"]]
    session.run_script("EVIDENCE 'lab' AS $e1; EVIDENCE 'lab' SOURCE 1 AS $e2; QUALIFY $ben IN $c1 AS REJECTED CONFIDENCE 0.9 EVIDENCE ($e1, $e2) AS $q")
    assert [(r.id, r.kind) for r in session.run("TRACE $q").collect()] == [(1, "assertion"), (-1, "evidence"), (-2, "evidence"), (1, "cycle")]
    session.run_script("STATE $ann = 'well'; STATE $ann = 'ill' VALID [10, 20)")
    assert [(r.value, r.version) for r in session.states(15).collect()] == [("ill", 2)] and session.states(30).count() == 0
    session.run_script("SIGNAL ON $ann CLOCK 'utc' FROM 100 TO 200")
    assert session.run("SIGNALS FOR $c1 DURING [150, 160)").count() == 1 and session.run("SIGNALS FOR $c3 DURING [150, 160)").count() == 0
    session.run_script("EMBED $ann TEXT 'red apple'; EMBED $ben TEXT 'green pear'")
    assert values(session.run("MATCH p:Person WHERE p SIMILAR TO 'apple' TOP 1 RETURN p.name")) == ["Ann"]
    degree = {r.member_id: r.degree for r in session.run("VIEW DEGREE").collect()}
    assert degree[v["$ben"]] == session.run("INCIDENT TO $ben").count()
    sample = session.run("SAMPLE 4 SWAPS ON Claim SEED 3 INTO BRANCH null_model")
    assert sample["accepted"] + sample["rejected"] == 4
    before = values(session.run("MATCH c:Claim RETURN card(c) ORDER BY id(c)"))
    session.run("USE BRANCH null_model")
    assert values(session.run("MATCH c:Claim RETURN card(c) ORDER BY id(c)")) == before
    session.run("USE MAIN")


def test_functions_of_edges_and_states(session):
    v = session.variables
    session.run_script("STATE $cat = 'well' VALID [10, 20)")
    rows = values(session.run("MATCH c:Claim WHERE overlap(c, $c3) > 0 RETURN id(c) AS c, overlap(c, $c3) AS o, jaccard(c, $c3) AS j ORDER BY id(c)"))
    assert rows == [(v["$c1"], 1, 0.25), (v["$c2"], 1, 1 / 3), (v["$c3"], 2, 1.0)]
    assert values(session.run("MATCH c:Claim WHERE c = $c2 RETURN overlap(c, c), jaccard($c2, $c3)")) == [(2, 1 / 3)]
    listed = ",".join(f"@{r[1]}" for r in values(session.run("MEMBERS OF $route")))
    assert values(session.run("MATCH r:Route RETURN members(r)")) == [listed]
    assert values(session.run("MATCH p:Person WHERE state(p) = 'well' AND state(p, 15) = 'well' RETURN p.name")) == ["Cat"]
    assert values(session.run("MATCH p:Person WHERE state(p, 25) = 'well' RETURN p.name")) == []


def test_policies_and_typed_members(session):
    v = session.variables
    session.run("QUALIFY $cat IN $c3 AS DERIVED CONFIDENCE 0.4")
    members = lambda text: {r[1] for r in values(session.run(f"MEMBERS OF $c3 {text}"))}
    assert members("POLICY ANY") == {v["$cat"], v["$ben"]}
    assert members("POLICY SUPPORTED") == members("POLICY OBSERVED") == {v["$ben"]}
    assert members("POLICY SUPPORTED 0.3 LIMIT 5") == {v["$cat"], v["$ben"]}
    rows = values(session.run("PATTERN (e:Claim, p:Drug) WHERE e CONTAINS p"))
    assert rows == [(v["$c1"], v["$pill"])]
    with pytest.raises(ValueError):
        session.run("PATTERN (e:Claim, p:Nothing) WHERE e CONTAINS p")


def test_rank_by_type_preference_and_weights(session):
    v = session.variables
    first = lambda text: session.run(text).first().edge_id
    assert first("RANK EDGE c:Claim LIKE (ANY Drug REQUIRED) TOP 3") == v["$c1"]
    assert first("RANK EDGE c:Claim LIKE ($cat) PREFER c.amount NEAR 15 SCALE 10 TOP 3") == v["$c3"]
    assert first("RANK EDGE c:Claim LIKE ($cat AS buyer OR provider) PREFER c.amount NEAR 15 SCALE 10 WEIGHTS (roles 1, attributes 0) TOP 3") == v["$c2"]
    with pytest.raises(ValueError):
        session.run("RANK EDGE c:Claim LIKE ($cat) WEIGHTS (nothing 1) TOP 3")


def test_views_indexes_and_tenants(session):
    session.run("CREATE VIEW sizes AS CARDINALITY; CREATE VIEW busy AS DEGREE CONTINUOUS")
    before = session.run("VIEW sizes KEY $c3").first().cardinality
    session.run("ADD $pill TO $c3")
    assert session.run("VIEW sizes KEY $c3").first().cardinality == before
    shown = {r.name: (r.kind, r.behind) for r in session.run("SHOW VIEWS").collect()}
    assert shown == {"sizes": ("CARDINALITY", 1), "busy": ("DEGREE", 0)}
    session.run("REFRESH VIEW sizes")
    assert session.run("VIEW sizes KEY $c3").first().cardinality == before + 1
    assert session.run("VIEW busy KEY $pill").first().degree == session.run("INCIDENT TO $pill").count()
    session.run("REMOVE $pill FROM $c3; DROP VIEW sizes")
    assert [r.name for r in session.run("SHOW VIEWS").collect()] == ["busy"]
    session.run("CREATE INDEX ON Person (age); CREATE JSON INDEX ON Person ('$.zip') AS INT")
    for text in ("CREATE INDEX ON Person (nothing)", "USE TENANT nobody", "USE BRANCH nowhere", "DROP BRANCH main", "VIEW sizes"):
        with pytest.raises(ValueError):
            session.run(text)
    session.run("CREATE TENANT other; USE TENANT other")
    assert session.run("MATCH p RETURN count(*)").first()[0] == 0
    session.run("USE TENANT default")


def test_compaction_loading_and_branches(session):
    before = sorted(values(session.run("MATCH c:Claim RETURN id(c), card(c)")))
    old = session.base
    new = session.run("COMPACT")
    assert new > old and sorted(values(session.run("MATCH c:Claim RETURN id(c), card(c)"))) == before
    assert sorted(values(session.run(f"AT GENERATION {old} MATCH c:Claim RETURN id(c), card(c)"))) == before
    top = session.store.top()
    people = session.spark.range(50).selectExpr(f"id + {top + 1} AS atom_id", "'Person' AS type", "'NODE' AS kind", "concat('p', id) AS key")
    session.load(atoms=people)
    assert session.run("MATCH p:Person WHERE key(p) = 'p49' RETURN id(p)").first()[0] == top + 50
    assert session.run("INSERT NODE Person {name: 'New'}") == top + 51
    session.run("CREATE BRANCH short")
    session.run("DROP BRANCH short")
    assert "short" not in values(session.run("SHOW BRANCHES"))


def test_manifests_are_exclusive(spark, tmp_path):
    from hyperweave.sources.store import Conflict, GraphStore

    a, b = GraphStore(spark, f"file://{tmp_path}"), GraphStore(spark, f"file://{tmp_path}")
    a.commit({}, "main", 0)
    target = f"{b.path}/commits/000000001.json"
    draft = f"{b.path}/commits/.draft"
    with b.fs.open_output_stream(draft) as f:
        f.write(b"{}")
    with pytest.raises(Conflict):
        b._publish(draft, target)
    assert len(b.commits()) == 1 and a.commit({}, "main", 1) == 2
