"""A versioned graph: append-only Parquet logs, one folder for each commit, and a small manifest per commit.

A commit writes its rows first and its manifest last, under the next number; a manifest that exists is never replaced, so a
half-written commit isn't seen, and a writer whose base is behind the head fails. Reading a version takes the latest row of
each key among the commits that it sees.
"""

from __future__ import annotations

import json
import os
import time
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "atoms": "atom_id long, type string, kind string, key string, tenant string",
    "members": "edge_id long, member_id long, pos long, roles array<string>, weight_fp long, valid_from long, valid_to long, qualifier long",
    "properties": "atom_id long, name string, tag string, number double, text string, valid_from long, valid_to long",
    "records": "id long, kind string, body string",
}
KEYS = {"atoms": ["atom_id"], "members": ["edge_id", "member_id"], "properties": ["atom_id", "name"], "records": ["id", "kind"]}


class Conflict(RuntimeError):
    """Another commit came first."""


class GraphStore:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.fs, self.path = pafs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(f"{self.path}/commits")
        self.known: dict[str, dict] = {}

    def commits(self) -> list[dict]:
        """All manifests; as none ever changes, each is read once."""
        found = [x.path for x in self.fs.get_file_info(pafs.FileSelector(f"{self.path}/commits")) if x.path.endswith(".json")]
        for p in sorted(found):
            if p not in self.known:
                with self.fs.open_input_stream(p) as f:
                    self.known[p] = json.loads(f.read())
        return [self.known[p] for p in sorted(found)]

    def top(self) -> int:
        """The largest atom id of any branch, so that ids stay apart when branches merge."""
        return max((c["top"] for c in self.commits()), default=0)

    def branches(self) -> list[str]:
        known = self.commits()
        gone = {c["drop"] for c in known if "drop" in c}
        return ["main", *(c["fork"] for c in known if "fork" in c and c["fork"] not in gone)]

    def _publish(self, draft: str, target: str) -> None:
        """Gives a draft its name if no other writer has it; both a link and a rename without overwriting are atomic."""
        try:
            if isinstance(self.fs, pafs.LocalFileSystem):
                os.link(draft, target)
            else:
                hadoop, jvm = self.spark._jvm.org.apache.hadoop.fs, self.spark._jvm
                at = lambda p: hadoop.Path(f"{self.uri}{p.removeprefix(self.path)}")
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                hadoop.FileContext.getFileContext(at(draft).toUri(), self.spark._jsc.hadoopConfiguration()).rename(at(draft), at(target), none)
        except Exception as e:
            if self.fs.get_file_info(target).type != pafs.FileType.NotFound:
                raise Conflict(f"{target} exists") from e
            raise
        finally:
            if self.fs.get_file_info(draft).type != pafs.FileType.NotFound:
                self.fs.delete_file(draft)

    def head(self) -> int:
        return max((c["gen"] for c in self.commits()), default=0)

    def commit(self, rows: dict[str, list[tuple] | DataFrame], branch: str, base: int, note: str = "", request: str | None = None, extra: dict | None = None) -> int:
        """Rows of tables with op (PUT or REMOVE) in front: a few as tuples, any number as a DataFrame, which tasks write side by side.

        A repeated request id gives the earlier number.
        """
        known = self.commits()
        for c in known:
            if request is not None and c.get("request") == request:
                return c["gen"]
        if max((c["gen"] for c in known if c["branch"] == branch), default=base) > base:
            raise Conflict(f"branch {branch} has moved on from {base}")
        gen = max((c["gen"] for c in known), default=0) + 1
        folder = f"rows/{gen:09d}-{uuid.uuid4().hex[:8]}"
        counts, top = {}, 0
        for table, values in rows.items():
            target, schema = f"{self.uri}/{folder}/{table}", f"op string, {SCHEMAS[table]}"
            if isinstance(values, DataFrame):
                values.select(*self.spark.createDataFrame([], schema).columns).write.parquet(target)
                found = self.spark.read.parquet(target)
                counts[table] = found.count()
                if table == "atoms":
                    top = found.agg(F.max("atom_id")).first()[0] or 0
            elif values:
                counts[table] = len(values)
                if table == "atoms":
                    top = max(r[1] for r in values)
                self.spark.createDataFrame(values, schema).coalesce(1).write.parquet(target)
        counts = {table: n for table, n in counts.items() if n}
        body = {"gen": gen, "branch": branch, "at": int(time.time() * 1000), "folder": folder, "tables": counts, "top": top, "note": note, "request": request} | (extra or {})
        draft = f"{self.path}/commits/.{gen}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(body).encode())
        self._publish(draft, f"{self.path}/commits/{gen:09d}.json")
        return gen

    def compact(self, branch: str = "main") -> int:
        """A commit that holds a branch's tables as they are, so that later reads begin there; older versions stay readable."""
        head = max((c["gen"] for c in self.seen(branch, 1 << 60)), default=0)
        rows = {t: self.read(t, branch, head).withColumn("op", F.lit("PUT")) for t in SCHEMAS}
        return self.commit(rows, branch, max((c["gen"] for c in self.commits() if c["branch"] == branch), default=head), note="compaction", extra={"compacts": head})

    def seen(self, branch: str, gen: int) -> list[dict]:
        """Commits that a version of a branch sees: its own, and its ancestors' up to each fork."""
        known = self.commits()
        forks = {c["fork"]: (c["branch"], c["gen"]) for c in known if "fork" in c}
        out, last = [], gen
        while True:
            out += [c for c in known if c["branch"] == branch and c["gen"] <= last]
            if branch not in forks:
                return sorted(out, key=lambda c: c["gen"])
            branch, at = forks[branch]
            last = min(last, at)

    def log(self, table: str, branch: str, gen: int, whole: bool = True) -> DataFrame:
        """Log rows with gen and op; not `whole`: from the last compaction on, which has all that holds up to it."""
        schema, seen = f"op string, {SCHEMAS[table]}", self.seen(branch, gen)
        if whole:
            seen = [c for c in seen if "compacts" not in c]
        else:
            begin = max((c["gen"] for c in seen if "compacts" in c), default=0)
            seen = [c for c in seen if c["gen"] >= begin]
        parts = [(c["gen"], f"{self.uri}/{c['folder']}/{table}") for c in seen if table in c["tables"]]
        if not parts:
            return self.spark.createDataFrame([], schema).withColumn("gen", F.lit(0).cast("long"))
        # One scan over all folders; the commit is read off the path.
        rows = self.spark.read.schema(schema).parquet(*[p for _, p in parts])
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/rows/(\d+)-", 1).cast("long")
        return rows.select("*", number.alias("gen"))

    def read(self, table: str, branch: str = "main", gen: int | None = None) -> DataFrame:
        gen = self.head() if gen is None else gen
        rows = self.log(table, branch, gen, whole=False)
        fields = [c for c in rows.columns if c not in ("gen", *KEYS[table])]
        latest = rows.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*fields), "gen").alias("row"))
        return latest.where("row.op = 'PUT'").select(*KEYS[table], *[F.col(f"row.{c}").alias(c) for c in fields if c != "op"])
