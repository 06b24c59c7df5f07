"""A session: statements in text, staged writes, branches and versions over a GraphStore.

Reads compile to DataFrames; writes are staged as rows, seen by the session's own reads, and appended at commit. Without BEGIN
every writing statement commits by itself. Variables ($name) hold atom ids and outlive statements.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.functions import values as V
from hyperweave.operators import algebra, flow, inspect, overlap, structure, temporal
from hyperweave.plans.lexer import SyntaxProblem, Token, tokens
from hyperweave.plans.match import Match
from hyperweave.plans.statements import Statements
from hyperweave.sources.relational import EVER, FIXED, FOREVER
from hyperweave.sources.store import KEYS, SCHEMAS, GraphStore

NUMBERS = {"INT", "INTEGER", "LONG", "FLOAT", "DOUBLE", "REAL", "DECIMAL", "TIMESTAMP", "TIME", "BOOL"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


class Value:
    """An expression: a column, and whether it is text; a property of no declared type offers both readings."""

    def __init__(self, column: Column, text: bool = False, other: Column | None = None, aggregate: bool = False):
        self.column, self.text, self.other, self.aggregate = column, text, other, aggregate

    def read(self, text: bool) -> Column:
        return self.column if text == self.text or self.other is None else self.other


class Session(Statements):
    def __init__(self, store: GraphStore, tenant: str = "default"):
        self.store, self.spark, self.tenant = store, store.spark, tenant
        self.branch, self.version, self.variables = "main", None, {}
        self.staged: dict[str, list[tuple]] | None = None
        self.base = self._head()

    # --- state -------------------------------------------------------------------------------------------------------

    def _head(self) -> int:
        return max((c["gen"] for c in self.store.seen(self.branch, 1 << 60)), default=0)

    def table(self, name: str) -> DataFrame:
        """A table as this session sees it: a version, or the head with what is staged on top."""
        rows = self.store.read(name, self.branch, self.version if self.version is not None else 1 << 60)
        mine = (self.staged or {}).get(name)
        if mine and self.version is None:
            last = {tuple(r[1 + k] for k in range(len(KEYS[name]))): r for r in mine}
            put = self.spark.createDataFrame(list(last.values()), f"op string, {SCHEMAS[name]}")
            rows = rows.join(put.select(*KEYS[name]), KEYS[name], "left_anti").unionByName(put.where("op = 'PUT'").drop("op").select(*rows.columns))
        if name == "atoms":
            rows = rows.where(F.col("tenant") == self.tenant)
        return rows

    def incidence(self) -> DataFrame:
        atoms = self.table("atoms").select(F.col("atom_id").alias("edge_id"), "type", "kind")
        return self.table("members").join(atoms, "edge_id")

    def types(self) -> dict[str, dict]:
        found = self.table("records").where("kind = 'type'").collect()  # one row for each declared type
        return {(t := json.loads(r["body"]))["name"].upper(): t for r in found}

    def _write(self, rows: dict[str, list[tuple]]) -> None:
        if self.version is not None:
            raise ValueError("a past version can't be written")
        alone = self.staged is None
        staged = {} if alone else self.staged
        for name, values in rows.items():
            staged.setdefault(name, []).extend(values)  # type: ignore[union-attr]
        if alone:
            self.staged = staged
            self.commit()

    def commit(self) -> int:
        staged, self.staged = self.staged or {}, None
        last = {name: list({tuple(r[1 + k] for k in range(len(KEYS[name]))): r for r in rows}.values()) for name, rows in staged.items()}
        self.base = self.store.commit(last, self.branch, self.base) if any(last.values()) else self.base
        return self.base

    def _new_id(self) -> int:
        return max([self.store.top(), *(r[1] for r in (self.staged or {}).get("atoms", []))]) + 1

    # --- reading statements ------------------------------------------------------------------------------------------

    def run_script(self, text: str) -> list[Any]:
        """Runs statements separated by semicolons, after all have been cut; stops at the first that fails."""
        parts: list[list[Token]] = [[]]
        for t in tokens(text):
            if t.is_(";") or t.kind == "end":
                parts.append([])
            else:
                parts[-1].append(t)
        return [self._run(p) for p in parts if p]

    def run(self, text: str) -> Any:
        return self.run_script(text)[-1]

    def _run(self, statement: list[Token]) -> Any:
        self.t, self.i = [*statement, Token("end", "", statement[-1].at + 1)], 0
        word = self._word()
        handler = getattr(self, f"_do_{word.lower()}", None)
        if handler is None:
            raise SyntaxProblem(f"unknown statement {word}")
        out = handler()
        if self._peek().kind != "end":
            raise SyntaxProblem(f"unexpected {self._peek().value!r} at {self._peek().at}")
        return out

    def _peek(self, k: int = 0) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def _next(self) -> Token:
        t = self._peek()
        self.i += 1
        return t

    def _maybe(self, *words: str) -> bool:
        """Takes the words if all follow."""
        if all(self._peek(k).is_(w) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def _need(self, *words: str) -> None:
        if not self._maybe(*words):
            raise SyntaxProblem(f"{' '.join(words)} expected at {self._peek().at}")

    def _word(self) -> str:
        t = self._next()
        if t.kind != "word":
            raise SyntaxProblem(f"a word expected at {t.at}")
        return t.value

    def _text(self) -> str:
        t = self._next()
        if t.kind != "text":
            raise SyntaxProblem(f"a quoted text expected at {t.at}")
        return t.value

    def _number(self) -> float | int:
        sign = -1 if self._maybe("-") else 1
        t = self._next()
        if t.kind != "number":
            raise SyntaxProblem(f"a number expected at {t.at}")
        return sign * (float(t.value) if any(c in t.value for c in ".eE") else int(t.value))

    def _limit(self) -> int | None:
        return int(self._number()) if self._maybe("LIMIT") else None

    def _ref(self) -> int:
        t = self._next()
        if t.kind == "variable":
            if t.value not in self.variables:
                raise ValueError(f"{t.value} isn't bound")
            return self.variables[t.value]
        if not t.is_("@"):
            raise SyntaxProblem(f"a reference expected at {t.at}")
        if self._peek().kind == "number":
            return int(self._number())
        kind = self._word()
        self._need(":")
        key = self._text()
        found = self.table("atoms").where((F.upper("type") == kind.upper()) & (F.col("key") == key)).select("atom_id").limit(1).collect()
        if not found:
            raise ValueError(f"no {kind} has the key {key!r}")
        return found[0][0]

    def _literal(self) -> Any:
        if self._maybe("TRUE"):
            return True
        if self._maybe("FALSE"):
            return False
        if self._maybe("NULL"):
            return None
        return self._text() if self._peek().kind == "text" else self._number()

    def _bag(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self._maybe("{"):
            while not self._maybe("}"):
                name = self._word()
                self._need(":")
                out[name] = self._literal()
                self._maybe(",")
        return out

    def _period(self) -> tuple[int, int]:
        if not self._maybe("VALID"):
            return EVER, FOREVER
        self._need("[")
        a = int(self._number())
        self._need(",")
        b = int(self._number())
        self._need(")")
        if a >= b:
            raise ValueError("an empty period")
        return a, b

    def _member(self, edge: int, pos: int) -> tuple:
        """op, edge, member, pos, roles, weight, period and no qualifier: a member that is there already is replaced whole."""
        member, roles = self._ref(), []
        if self._maybe("AS"):
            roles.append(self._word())
            while self._maybe("|"):
                roles.append(self._word())
        weight = self._number() if self._maybe("WEIGHT") else 1
        return ("PUT", edge, member, pos, roles, round(weight * FIXED), *self._period(), None)

    def _bind(self, atom: int) -> int:
        if self._maybe("AS"):
            self.variables[self._next().value] = atom
        return atom

    # --- definitions and writes --------------------------------------------------------------------------------------

    def _do_create(self) -> Any:
        if self._maybe("BRANCH"):
            name = self._word()
            if name in self.store.branches():
                raise ValueError(f"{name} exists")
            return self.store.commit({}, self.branch, self._head(), extra={"fork": name})
        if self._maybe("TENANT"):
            name = self._word()
            if name in self.tenants():
                raise ValueError(f"{name} exists")
            self._put("tenant", self._record_id("tenant"), {"name": name})
            return name
        if self._maybe("VIEW"):
            return self._create_view()
        if self._maybe("INDEX") or self._maybe("JSON", "INDEX"):
            return self._create_index()
        kind = "NODE" if self._maybe("NODE") else "ORDERED" if self._maybe("ORDERED") else "SET"
        if kind != "NODE":
            self._maybe("SET")
            self._need("EDGE")
        self._need("TYPE")
        name, fields, roles = self._word(), {}, []
        if self._maybe("("):
            while not self._maybe(")"):
                field, tag = self._word(), self._word().upper()
                fields[field] = {"tag": tag, "indexed": self._maybe("INDEXED"), "required": self._maybe("REQUIRED")}
                self._maybe(",")
        if self._maybe("ROLES"):
            self._need("(")
            while not self._maybe(")"):
                roles.append(self._word())
                self._maybe(",")
        known = self.types()
        if name.upper() in known:
            raise ValueError(f"{name} exists")
        body = {"name": name, "kind": kind, "fields": fields, "roles": roles if kind != "NODE" else []}
        self._write({"records": [("PUT", len(known) + 1, "type", json.dumps(body))]})
        return name

    def _type(self, name: str, edge: bool) -> dict:
        found = self.types().get(name.upper())
        if found is None or (found["kind"] != "NODE") != edge:
            raise ValueError(f"no {'edge' if edge else 'node'} type {name}")
        return found

    def _properties(self, atom: int, bag: dict[str, Any], declared: dict, period: tuple[int, int] = (EVER, FOREVER)) -> list[tuple]:
        out = []
        for name, value in bag.items():
            tag = declared.get(name, {}).get("tag")
            if tag and value is not None and (tag in NUMBERS) == isinstance(value, str):
                raise ValueError(f"{name} is {tag}")
            text = isinstance(value, str)
            out.append(("PUT", atom, name, tag or ("STRING" if text else "FLOAT"), None if text or value is None else float(value), value if text else None, *period))
        return out

    def _do_insert(self) -> int:
        edge = not self._maybe("NODE")
        if edge:
            self._need("EDGE")
        kind = self._type(self._word(), edge)
        key = self._text() if self._peek().kind == "text" else None
        if key is not None and self.table("atoms").where((F.col("type") == kind["name"]) & (F.col("key") == key)).limit(1).count():
            raise ValueError(f"{kind['name']} {key!r} exists")
        bag = self._bag()
        missing = [n for n, f in kind["fields"].items() if f["required"] and bag.get(n) is None]
        if missing:
            raise ValueError(f"{missing[0]} is required")
        atom = self._new_id()
        rows = {"atoms": [("PUT", atom, kind["name"], kind["kind"], key, self.tenant)], "properties": self._properties(atom, bag, kind["fields"])}
        if edge:
            self._need("MEMBERS")
            self._need("(")
            members: dict[int, tuple] = {}
            while not self._maybe(")"):
                m = self._member(atom, len(members))
                if kind["roles"] and set(m[4]) - set(kind["roles"]):
                    raise ValueError(f"{kind['name']} has no such role")
                members[m[2]] = m if m[2] not in members else (*m[:3], members[m[2]][3], *m[4:])
                self._maybe(",")
            rows["members"] = [(*m[:3], m[3] * FIXED if kind["kind"] == "ORDERED" else -1, *m[4:]) for m in members.values()]
        self._bind(atom)
        self._write(rows)
        return atom

    def _do_add(self) -> None:
        member = self._ref()
        self._need("TO")
        edge = self._ref()
        index = int(self._number()) if self._maybe("AT") else None
        ordered = [r["pos"] for r in self.incidence().where((F.col("edge_id") == edge) & (F.col("kind") == "ORDERED")).orderBy("pos", "member_id").select("pos").collect()]
        pos = -1
        if ordered:  # a label between its neighbours', so that no other row changes
            at = len(ordered) if index is None else index
            low = ordered[at - 1] if at else ordered[0] - 2 * FIXED
            pos = (low + (ordered[at] if at < len(ordered) else low + 2 * FIXED)) // 2
        roles, weight = [], 1
        if self._maybe("AS"):
            roles.append(self._word())
            while self._maybe("|"):
                roles.append(self._word())
        if self._maybe("WEIGHT"):
            weight = self._number()
        self._write({"members": [("PUT", edge, member, pos, roles, round(weight * FIXED), *self._period(), None)]})

    def _gone(self, edge: int, member: int) -> tuple:
        return ("REMOVE", edge, member, None, None, None, None, None, None)

    def _do_remove(self) -> None:
        if self._maybe("AT"):
            index = int(self._number())
            self._need("FROM")
            edge = self._ref()
            found = inspect.members_of(self.incidence(), edge).where(F.col("position") == index).select("member_id").collect()
            self._write({"members": [self._gone(edge, r[0]) for r in found]})
        else:
            member = self._ref()
            self._need("FROM")
            self._write({"members": [self._gone(self._ref(), member)]})

    def _do_set(self) -> None:
        atom = self._ref()
        self._need(".")
        name = self._word()
        self._need("=")
        value = self._literal()
        kind = self.table("atoms").where(F.col("atom_id") == atom).select("type").first()
        declared = self.types().get(kind[0].upper(), {"fields": {}})["fields"] if kind else {}
        self._write({"properties": self._properties(atom, {name: value}, declared, self._period())})

    def _do_unset(self) -> None:
        atom = self._ref()
        self._need(".")
        self._write({"properties": [("REMOVE", atom, self._word(), None, None, None, None, None)]})

    def _do_document(self) -> None:
        atom, text = self._ref(), self._text()
        json.loads(text)
        self._write({"records": [("PUT", atom, "document", text)]})

    def _do_delete(self) -> None:
        """The atom leaves every edge, loses its members if it is one, its properties and its document."""
        atom = self._ref()
        links = self.table("members").where((F.col("edge_id") == atom) | (F.col("member_id") == atom)).select("edge_id", "member_id").collect()
        names = self.table("properties").where(F.col("atom_id") == atom).select("name").collect()
        self._write({"atoms": [("REMOVE", atom, None, None, None, None)], "members": [self._gone(*r) for r in links], "properties": [("REMOVE", atom, r[0], None, None, None, None, None) for r in names], "records": [("REMOVE", atom, "document", None)]})

    # --- transactions, branches, versions ----------------------------------------------------------------------------

    def _do_begin(self) -> None:
        self._maybe("SERIALIZABLE")
        if self.staged is not None:
            raise ValueError("a transaction is open")
        self.staged, self.base = {}, self._head()

    def _do_commit(self) -> int:
        return self.commit()

    def _do_rollback(self) -> None:
        self.staged = None

    _do_abort = _do_rollback

    def _do_use(self) -> None:
        if self.staged:
            raise ValueError("a transaction is open")
        if self._maybe("TENANT"):
            name = self._word()
            if name not in self.tenants():
                raise ValueError(f"no tenant {name}")
            self.tenant = name
            return
        name = "main" if self._maybe("MAIN") else (self._need("BRANCH") or self._word())
        if name not in self.store.branches():
            raise ValueError(f"no branch {name}")
        self.branch = name
        self.base = self._head()

    def tenants(self) -> list[str]:
        found = self.table("records").where("kind = 'tenant'").orderBy("id").collect()  # one row for each declared tenant
        return ["default", *(json.loads(r["body"])["name"] for r in found)]

    def _do_drop(self) -> None:
        if self._maybe("VIEW"):
            self._drop_view(self._word())
            return
        self._need("BRANCH")
        name = self._word()
        if name in ("main", self.branch) or name not in self.store.branches():
            raise ValueError(f"branch {name} can't be dropped")
        self.store.commit({}, self.branch, self._head(), extra={"drop": name})
        self.base = self._head()

    def _do_compact(self) -> int:
        """Writes the branch's tables as they are; reads begin there from now on."""
        if self.staged:
            raise ValueError("a transaction is open")
        self.store.compact(self.branch)
        self.base = self._head()
        return self.base

    def _do_checkpoint(self) -> int:
        """Commits are durable when they return, so there is nothing left to write: the number of the last one."""
        return self._head()

    def load(self, **tables: DataFrame) -> int:
        """Appends DataFrames to the tables of those names in one commit, without passing rows through the driver."""
        if self.version is not None or self.staged:
            raise ValueError("loading needs the head and no open transaction")
        rows = {name: df.withColumn("op", F.lit("PUT")) for name, df in tables.items()}
        if "atoms" in rows and "tenant" not in rows["atoms"].columns:
            rows["atoms"] = rows["atoms"].withColumn("tenant", F.lit(self.tenant))
        self.base = self.store.commit(rows, self.branch, self.base)
        return self.base

    def _at(self, gen: int) -> Any:
        old, self.version = self.version, gen
        try:
            handler = getattr(self, f"_do_{self._word().lower()}")
            return handler()
        finally:
            self.version = old

    def _do_at(self) -> Any:
        self._need("GENERATION")
        return self._at(int(self._number()))

    def _do_as(self) -> Any:
        self._need("OF")
        t = int(self._number())
        return self._at(max((c["gen"] for c in self.store.seen(self.branch, 1 << 60) if c["at"] <= t), default=0))

    def _do_history(self) -> DataFrame:
        n = self._limit() or 20
        seen = self.store.seen(self.branch, 1 << 60)
        rows = [(c["gen"], c["branch"], c["at"], sum(c["tables"].values())) for c in seen if c["gen"] > seen[-1]["gen"] - n]
        return self.spark.createDataFrame(rows[::-1], "gen long, branch string, at long, changes long")

    def _snapshot(self, branch: str, gen: int) -> DataFrame:
        old = self.branch, self.version
        self.branch, self.version = branch, gen
        try:
            return self.incidence()
        finally:
            self.branch, self.version = old

    def _do_diff(self) -> DataFrame:
        if self._maybe("BRANCH"):
            a = self._word()
            self._need("AND")
            return temporal.diff(self._snapshot(a, 1 << 60), self._snapshot(self._word(), 1 << 60))
        self._need("GENERATION")
        a = int(self._number())
        self._need("AND")
        return temporal.diff(self._snapshot(self.branch, a), self._snapshot(self.branch, int(self._number())))

    def _do_merge(self) -> int:
        self._need("BRANCH")
        source = self._word()
        how = self._word().upper() if self._maybe("ON", "CONFLICT") else "FAIL"
        parent, gen = next((c["branch"], c["gen"]) for c in self.store.commits() if c.get("fork") == source)
        rows, _ = temporal.merge(self._snapshot(parent, gen), self._snapshot(source, 1 << 60), self._snapshot(parent, 1 << 60), how)
        changed = {"members": rows}
        for name in ("atoms", "properties", "records"):
            sides = [self.store.read(name, b, g) for b, g in ((parent, gen), (source, 1 << 60), (parent, 1 << 60))]
            changed[name], _ = temporal.merge_rows(*sides, KEYS[name], how)
        self.branch = parent
        self.base = self.store.commit(changed, parent, self._head())
        return self.base

    # --- queries -----------------------------------------------------------------------------------------------------

    def _do_explain(self) -> str:
        self._need("MATCH")
        df = self._do_match()
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _do_match(self) -> DataFrame:
        self.var = self._word()
        atoms = self.table("atoms")
        if self._maybe(":"):
            kind = self._word()
            if kind.upper() not in self.types():
                raise ValueError(f"no type {kind}")
            atoms = atoms.where(F.upper("type") == kind.upper())
        self.view, self.joined = atoms, set()
        condition = self._condition() if self._maybe("WHERE") else None
        items: list[tuple[str, Value]] = []
        if self._maybe("RETURN"):
            while True:
                start = self.i
                v = self._sum()
                name = self._word() if self._maybe("AS") else "".join(t.value for t in self.t[start : self.i])
                items.append((name, v))
                if not self._maybe(","):
                    break
        else:
            items.append((self.var, Value(F.col("atom_id"))))
        by, down = None, False
        if self._maybe("ORDER", "BY"):
            by = self._sum().column
            down = self._maybe("DESC")
            self._maybe("ASC")
        m = Match(self.view, self.incidence()).where(condition) if condition is not None else Match(self.view, self.incidence())
        if by is not None:
            m = m.order_by(by, down)
        n = self._limit()
        if any(v.aggregate for _, v in items):
            return m.aggregates({k: v.column for k, v in items if v.aggregate}, {k: v.column for k, v in items if not v.aggregate}).select(*[k for k, _ in items])
        if n is not None:
            m = m.limit(n)
        return m.returns(**{k: v.column for k, v in items})

    def _flag(self, ids: DataFrame) -> Column:
        """Whether the atom is among ids (atom_id), as a column that any condition can use."""
        name = f"flag{len(self.joined)}"
        self.joined.add(name)
        self.view = self.view.join(ids.distinct().withColumn(name, F.lit(True)), "atom_id", "left")
        return F.coalesce(F.col(name), F.lit(False))

    def _condition(self) -> Column:
        out = self._all()
        while self._maybe("OR"):
            out = out | self._all()
        return out

    def _all(self) -> Column:
        out = self._not()
        while self._maybe("AND"):
            out = out & self._not()
        return out

    def _not(self) -> Column:
        if self._maybe("NOT"):
            return ~self._not()
        inc = self.incidence
        if self._peek().is_("("):
            back = self.i
            self._need("(")
            try:
                out = self._condition()
                self._need(")")
                return out
            except SyntaxProblem:
                self.i = back
        if self._peek().kind == "word" and self._peek().value == self.var:
            here = self._peek(1)
            if here.is_("CONTAINS"):
                self.i += 2
                self._need("(")
                members = [self._ref()]
                while self._maybe(","):
                    members.append(self._ref())
                self._need(")")
                return self._flag(algebra.containing(inc(), members).withColumnRenamed("edge_id", "atom_id"))
            if here.is_("HAS"):
                self.i += 2
                member = self._ref()
                roles = [self._word()] if self._maybe("AS") else []
                return self._flag(algebra.containing(inc(), [(member, roles)]).withColumnRenamed("edge_id", "atom_id"))
            if here.is_("IN"):
                self.i += 2
                return self._flag(algebra.members(inc(), self._ref()).withColumnRenamed("member_id", "atom_id"))
            if here.is_("SIMILAR"):
                self.i += 2
                self._need("TO")
                text = self._text()
                return self._flag(self.similar(text, int(self._number()) if self._maybe("TOP") else 10).select("atom_id"))
            if here.is_("VALID"):
                self.i += 2
                self._need("AT")
                t = int(self._number())
                rows = inc().where((F.col("valid_from") <= t) & (F.col("valid_to") > t))
                return self._flag(rows.select(F.explode(F.array("edge_id", "member_id")).alias("atom_id")))
            if here.is_("="):
                self.i += 2
                return F.col("atom_id") == self._ref()
        left = self._sum()
        if self._maybe("BETWEEN"):
            low = self._sum()
            self._need("AND")
            return V.between(left.read(low.text), low.column, self._sum().column)
        for sign, f in (("!=", V.ne), ("<>", V.ne), ("<=", V.le), (">=", V.ge), ("=", V.eq), ("<", V.lt), (">", V.gt)):
            if self._maybe(sign):
                right = self._sum()
                text = left.text and left.other is None or right.text and right.other is None
                if left.other is None and right.other is None and left.text != right.text:
                    return F.lit(sign in ("!=", "<>"))  # values of different kinds are never equal, and none is less
                return f(left.read(text), right.read(text))
        return V.truthy(left.column, "text" if left.text else "number")

    def _sum(self) -> Value:
        out = self._product()
        while self._peek().is_("+", "-"):
            sign = self._next().value
            right = self._product()
            a, b = out.read(False), right.read(False)
            out = Value(a + b if sign == "+" else a - b, aggregate=out.aggregate or right.aggregate)
        return out

    def _product(self) -> Value:
        out = self._atom()
        while self._peek().is_("*", "/"):
            sign = self._next().value
            right = self._atom()
            a, b = out.read(False), right.read(False)
            out = Value(a * b if sign == "*" else V.divide(a, b), aggregate=out.aggregate or right.aggregate)
        return out

    def _property(self, name: str) -> Value:
        if name not in self.joined:
            self.joined.add(name)
            mine = self.table("properties").where(F.col("name") == name).select("atom_id", F.col("number").alias(f"n_{name}"), F.col("text").alias(f"t_{name}"))
            self.view = self.view.join(mine, "atom_id", "left")
        tags = {t["fields"][name]["tag"] for t in self.types().values() if name in t["fields"]}
        number, text = F.col(f"n_{name}"), F.col(f"t_{name}")
        if tags and not tags & NUMBERS:
            return Value(text, text=True)
        return Value(number) if tags else Value(number, other=text)

    def _counted(self, name: str, key: str, value: Column) -> Value:
        if name not in self.joined:
            self.joined.add(name)
            sums = self.incidence().groupBy(F.col(key).alias("atom_id")).agg(value.alias(name))
            self.view = self.view.join(sums, "atom_id", "left")
        return Value(F.coalesce(F.col(name), F.lit(0)))

    def _atom(self) -> Value:
        t = self._peek()
        if self._maybe("("):
            out = self._sum()
            self._need(")")
            return out
        if t.kind == "word" and self._peek(1).is_("("):
            return self._call()
        if t.kind == "word" and t.value == self.var:
            self.i += 1
            return self._property(self._word()) if self._maybe(".") else Value(F.col("atom_id"))
        value = self._literal()
        return Value(F.lit(value), text=isinstance(value, str))

    def _call(self) -> Value:
        name = self._word().upper()
        self._need("(")
        if name in AGGREGATES:
            arg = None if self._maybe("*") or self._peek().is_(")") else self._sum()
            self._need(")")
            c = arg.column if arg else F.lit(1)
            number = F.lit(0.0) if arg is not None and arg.text else c.cast("double")
            made = {"COUNT": F.count(c), "SUM": F.sum(F.when(c.isNotNull(), number)), "AVG": F.avg(F.when(c.isNotNull(), number)), "MIN": F.min(c), "MAX": F.max(c)}[name]
            return Value(made, text=bool(arg and arg.text and name in ("MIN", "MAX")), aggregate=True)
        if name in ("LOWER", "UPPER", "LENGTH"):
            arg = self._sum()
            self._need(")")
            return Value({"LOWER": V.lower, "UPPER": V.upper, "LENGTH": V.length}[name](arg.read(True)), text=name != "LENGTH")
        if name == "NOW":
            self._need(")")
            return Value(F.unix_millis(F.current_timestamp()))
        if name in ("OVERLAP", "JACCARD"):
            return self._shared_with(name)
        if name == "MEMBERS":
            return self._member_list()
        if name == "STATE":
            return self._state_of()
        if self._word() != self.var:
            raise SyntaxProblem(f"{self.var} expected at {self._peek().at}")
        path = self._text() if self._maybe(",") else None
        self._need(")")
        if name == "JSON":
            if "$document" not in self.joined:
                self.joined.add("$document")
                mine = self.table("records").where("kind = 'document'").select(F.col("id").alias("atom_id"), F.col("body").alias("document"))
                self.view = self.view.join(mine, "atom_id", "left")
            return Value(V.json(F.col("document"), path, "double"), other=V.json(F.col("document"), path, "string"))
        if name in ("ID", "TYPE", "KEY"):
            return Value(F.col({"ID": "atom_id", "TYPE": "type", "KEY": "key"}[name]), text=name != "ID")
        if name in ("CARD", "CARDINALITY"):
            return self._counted("card", "edge_id", F.count("*"))
        if name == "DEGREE":
            return self._counted("degree", "member_id", F.count("*"))
        if name in ("WEIGHT", "WEIGHTSUM"):
            return self._counted("weight", "edge_id", F.sum("weight_fp") / F.lit(float(FIXED)))
        raise ValueError(f"unknown function {name.lower()}()")

    def _subject(self) -> int | None:
        """An argument that names an atom; None is the variable of the MATCH."""
        if self._peek().kind == "word" and self._peek().value == self.var:
            self.i += 1
            return None
        return self._ref()

    def _of(self, rows: DataFrame, atom: int | None, name: str) -> Column:
        """A column of rows (atom_id, name) for the variable's atoms, or for one atom, whose row all get."""
        label = f"{name}{len(self.joined)}"
        self.joined.add(label)
        if atom is None:
            self.view = self.view.join(rows.withColumnRenamed(name, label), "atom_id", "left")
        else:
            one = rows.where(F.col("atom_id") == atom).agg(F.max(name).alias(label))
            self.view = self.view.crossJoin(F.broadcast(one))  # one row
        return F.col(label)

    def _shared_with(self, name: str) -> Value:
        """overlap(a, b) and jaccard(a, b): shared members of two edges, and their share of all members of either."""
        a = self._subject()
        self._need(",")
        b = self._subject()
        self._need(")")
        rows = self.incidence().select("edge_id", "member_id").distinct()
        sizes = rows.groupBy(F.col("edge_id").alias("atom_id")).agg(F.count("*").alias("size"))
        size = lambda x: F.coalesce(self._of(sizes, x, "size"), F.lit(0).cast("long"))
        if a == b:
            both = size(a)
        else:
            fixed = a if a is not None else b
            met = rows.join(rows.where(F.col("edge_id") == fixed).select("member_id"), "member_id", "left_semi")
            met = met.groupBy(F.col("edge_id").alias("atom_id")).agg(F.count("*").alias("both"))
            both = F.coalesce(self._of(met, None if None in (a, b) else b, "both"), F.lit(0).cast("long"))
        if name == "OVERLAP":
            return Value(both)
        either = size(a) + size(b) - both
        return Value(F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1))))

    def _member_list(self) -> Value:
        """members(e): the members of an edge in their order, as @1,@2; one text for each edge, however large."""
        atom = self._subject()
        self._need(")")
        listed = self.incidence().groupBy(F.col("edge_id").alias("atom_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "member_id"))).alias("m"))
        text = F.array_join(F.transform("m.member_id", lambda m: F.concat(F.lit("@"), m.cast("string"))), ",")
        return Value(F.coalesce(self._of(listed.select("atom_id", text.alias("members")), atom, "members"), F.lit("")), text=True)

    def _state_of(self) -> Value:
        """state(x) and state(x, t): the state bound to an atom last, if it holds at t."""
        atom = self._subject()
        at = int(self._number()) if self._maybe(",") else None
        self._need(")")
        return Value(self._of(self.states(at).select("atom_id", F.col("value").alias("state")), atom, "state"), text=True)

    # --- operators as statements -------------------------------------------------------------------------------------

    def _cut(self, df: DataFrame, *order: str) -> DataFrame:
        n = self._limit()
        df = df.orderBy(*order)
        return df if n is None else df.limit(n)

    def _do_members(self) -> DataFrame:
        self._need("OF")
        edge, role, weights, at = self._ref(), None, None, None
        if self._maybe("ROLE"):
            role = self._word()
        if self._maybe("WEIGHT", "BETWEEN"):
            low = self._number()
            self._need("AND")
            weights = (float(low), float(self._number()))
        if self._maybe("VALID", "AT"):
            at = int(self._number())
        policy, least = "ANY", 0.5
        if self._maybe("POLICY"):
            policy = self._word().upper()
            if policy not in ("OBSERVED", "ANY", "SUPPORTED"):
                raise ValueError(f"no policy {policy}")
            if policy == "SUPPORTED" and self._peek().kind == "number":
                least = float(self._number())
        found = inspect.members_of(self.incidence(), edge, role, weights, at, self.qualifiers(), policy, least)
        return self._cut(found, "position", "member_id")

    def _do_incident(self) -> DataFrame:
        self._need("TO")
        atom = self._ref()
        at = int(self._number()) if self._maybe("VALID", "AT") else None
        return inspect.incident_to(self.incidence(), atom, at).orderBy("edge_id")

    def _do_describe(self) -> DataFrame:
        return inspect.describe(self.incidence(), self._ref())

    def _do_show(self) -> DataFrame:
        if self._maybe("BRANCHES"):
            return self.spark.createDataFrame([(b,) for b in self.store.branches()], "branch string")
        if self._maybe("TENANTS"):
            return self.spark.createDataFrame([(t,) for t in self.tenants()], "tenant string")
        if self._maybe("VIEWS"):
            return self.spark.createDataFrame([(v["name"], v["kind"], v["parameter"], v["continuous"], self.behind(v["name"])) for v in self._views().values()], "name string, kind string, parameter long, continuous boolean, behind long")
        self._need("TYPES")
        rows = [(t["name"], t["kind"], ",".join(t["fields"]), ",".join(t["roles"])) for t in self.types().values()]
        return self.spark.createDataFrame(rows, "name string, kind string, properties string, roles string")

    def _do_stats(self) -> DataFrame:
        return inspect.statistics(self.incidence())

    def _two(self) -> tuple[int, int]:
        a = self._ref()
        self._maybe(",")
        return a, self._ref()

    def _set(self, how: str) -> Any:
        a, b = self._two()
        if self._maybe("INTO"):
            name, atom = self._next().value, self._new_id()
            rows = algebra.combined(self.incidence(), a, b, how, atom).collect()  # the members of two edges that the caller named
            kind = self.table("atoms").where(F.col("atom_id") == a).first()
            self._write({"atoms": [("PUT", atom, kind["type"], "SET", None, self.tenant)], "members": [("PUT", atom, r["member_id"], -1, r["roles"], r["weight_fp"], r["valid_from"], r["valid_to"], r["qualifier"]) for r in rows]})
            self.variables[name] = atom
            return atom
        return {"intersect": algebra.intersect, "union": algebra.union, "difference": algebra.difference}[how](self.incidence(), a, b).orderBy("member_id")

    def _do_intersect(self) -> Any:
        return self._set("intersect")

    def _do_union(self) -> Any:
        return self._set("union")

    def _do_difference(self) -> Any:
        return self._set("difference")

    def _measure(self, name: str) -> DataFrame:
        return algebra.measures(self.incidence(), *self._two()).select(name)

    def _do_subset(self) -> DataFrame:
        return self._measure("subset")

    def _do_equal(self) -> DataFrame:
        return self._measure("equal")

    def _do_jaccard(self) -> DataFrame:
        return self._measure("jaccard")

    def _do_containment(self) -> DataFrame:
        return self._measure("containment")

    def _do_overlap(self) -> DataFrame:
        if not self._maybe("JOIN"):
            return self._measure("overlap")
        kind = self._word()
        threshold = int(self._number()) if self._maybe("THRESHOLD") else 1
        return self._cut(overlap.overlap_join(self.incidence().where(F.upper("type") == kind.upper()), threshold), "left", "right")

    def _field(self, name: str) -> DataFrame | None:
        """(atom_id, value) of a property, or of a degree; None for the weight of a membership."""
        if name.lower() == "weight":
            return None
        if name.lower() == "degree":
            return flow.degrees(self.incidence()).select(F.col("member_id").alias("atom_id"), F.col("degree").cast("double").alias("value"))
        return self.table("properties").where(F.col("name") == name).select("atom_id", F.col("number").alias("value"))

    def _do_gather(self) -> DataFrame:
        name = self._word()
        self._need("FROM")
        return flow.gather(self.incidence(), self._ref(), self._field(name)).orderBy("pos", "member_id").drop("pos")

    def _do_reduce(self) -> DataFrame:
        how = self._word().lower()
        self._need("(")
        name = self._word()
        self._need(")")
        self._need("OVER")
        gathered = flow.gather(self.incidence(), self._ref(), self._field(name))
        return flow.reduce_edge(gathered, how, self._maybe("WEIGHTED"))

    def _ones(self, column: str) -> DataFrame:
        return self.incidence().select(F.col(column).alias("atom_id")).distinct().withColumn("value", F.lit(1.0))

    def _do_scatter(self) -> DataFrame:
        name = self._word()
        self._need("FROM")
        self._need("EDGES")
        kind = self._word()
        inc = self.incidence().where(F.upper("type") == kind.upper())
        return flow.scatter(inc, self._field(name) or self._ones("edge_id"), self._maybe("WEIGHTED")).orderBy("member_id")

    def _do_propagate(self) -> DataFrame:
        name = self._word()
        self._need("OVER")
        self._need("EDGES")
        kind = self._word()
        self._maybe("WEIGHTED")
        return flow.propagate(self.incidence().where(F.upper("type") == kind.upper()), self._field(name) or self._ones("member_id")).orderBy("member_id")

    def _do_neighbors(self) -> DataFrame:
        self._need("OF")
        atom = self._ref()
        threshold = int(self._number()) if self._maybe("THRESHOLD") else 1
        inc = self.incidence()
        edge = bool(self.table("atoms").where((F.col("atom_id") == atom) & (F.col("kind") != "NODE")).limit(1).count())
        return self._cut((overlap.neighbors_of_edge if edge else overlap.neighbors_of_node)(inc, atom, threshold), "neighbor")

    def _do_closure(self) -> DataFrame:
        edge = self._ref()
        self._need("DIM")
        dim = int(self._number())
        return structure.closure(self.incidence(), edge, dim, self._limit())

    def _do_expand(self) -> DataFrame:
        edge = self._ref()
        depth = int(self._number()) if self._maybe("DEPTH") else 4
        edges = self.table("atoms").where("kind <> 'NODE'").select(F.col("atom_id").alias("edge_id"))
        return structure.expand(self.incidence(), edge, depth, self._limit(), edges).orderBy("place").drop("place")


def open_session(spark: SparkSession, uri: str, tenant: str = "default") -> Session:
    return Session(GraphStore(spark, uri), tenant)
