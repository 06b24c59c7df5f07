"""Near-duplicate documents by MinHash, with every link confirmed on full shingle sets.

Sketches come from fast similarity sketching: in round i < t each shingle is hashed to one of t bins and offers the value
(i, hash); in round i >= t every shingle offers (i, hash) to bin i - t. A bin keeps its least offer, so after 2t rounds every
coordinate is filled, after about one round for texts of t log t shingles, and two sketches agree in each coordinate with
probability equal to the Jaccard similarity, with concentration about its mean. Bands of coordinates give candidates.

Texts with equal shingle sets form a class, and only classes go on. Candidates are the classes of a bucket, and a bucket's
pairs are never listed:

1. Every member is held against the bucket's most central member, its leader; links contract to components.
2. What is left are pairs of members, leader apart, of different components. Jaccard distance is a metric, so two members
   whose distances from their leader differ by more than the bound can't be linked: a large bucket is cut into slices by that
   distance and slices into blocks of bounded weight, and only blocks of near slices meet in a cell.
3. A cell counts all intersections of its members' full sets by products of 0/1 matrices over the shingles that both sides
   have, and gives one link for every two components that it joins.

So whatever shares a bucket is compared exactly, by sketches or samples decided nothing, and rows grow with members and blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.llm.common import bounded_batches, groups, mix, partitions, shingle_sets, shingles, texts, written
from hyperweave.llm.components import components

#: 16 bands of 4 of 64 coordinates: a pair of similarity 0.85 is missed by all with probability 7e-6, one of 0.8 with 2e-4.
COORDINATES, BANDS = 64, 16
#: Weight of each side of a cell: shingles, and CLASS more for each class. Slices of distance from the leader, for a whole 1.
CELL, CLASS, SLICES = 200_000, 100, 20
#: Columns of the matrices that are multiplied at once.
COLUMNS = 2048


_EMPTY = np.uint64((1 << 64) - 1)


def sketches(found: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketches of sets of hashes, one after the other in `found`; those of empty sets mean nothing."""
    n = len(bounds) - 1
    out = np.full((n, t), _EMPTY, dtype=np.uint64)
    owner, todo = np.repeat(np.arange(n), np.diff(bounds)), found
    for i in range(2 * t):
        h = mix(todo + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = np.uint64(i << 56) | h >> np.uint64(8)
        bins = (h & np.uint64(0xFF)).astype(np.int64) % t if i < t else i - t
        np.minimum.at(out.reshape(-1), owner * t + bins, value)
        open_ = (out == _EMPTY).any(axis=1)[owner]
        if not open_.any():
            break
        owner, todo = owner[open_], todo[open_]
    return out


def sketch(found: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketch of one set."""
    return sketches(found, np.array([0, len(found)]), t)[0]


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Keys of the bands of sketches, a row for each."""
    rows = values.reshape(len(values), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2])
    for j in range(rows.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key.view(np.int64)


def _sketches(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, keys = [], [], []
            for group in groups(texts(batch.column(2))):
                found, bounds = shingle_sets(group, words)
                bands, ends = band_keys(sketches(found, bounds)), bounds.tolist()
                for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
                    n.append(j - i)
                    prints.append(hashlib.blake2b(found[i:j], digest_size=16).digest() if j > i else None)
                    keys.append(bands[k] if j > i else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "n_shingles", "print", "bands"])

    return run


def _compare(words: int):
    """(u, v, both, either) of rows (u, v, x, y): sizes of the intersection and the union of the full sets of texts x and y.

    Rows come sorted by u, so its set is made once a batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, ys = batch.column(0).to_numpy(zero_copy_only=False), texts(batch.column(3))
            both, either, last, a, at = [], [], None, np.empty(0, dtype=np.uint64), 0
            for group in groups(ys):
                found, bounds = shingle_sets(group, words)
                for k in range(len(group)):
                    if us[at] != last:
                        last, a = us[at], shingles(texts(batch.column(2).slice(at, 1))[0], words)
                    b = found[bounds[k] : bounds[k + 1]]
                    same = len(a) + len(b) - len(np.union1d(a, b))
                    both.append(same), either.append(len(a) + len(b) - same)
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["u", "v", "both", "either"])

    return run


def intersections(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of `a` with those of `b`, each sets one after the other and their bounds."""
    sides = [(found, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))) for found, bounds in (a, b)]
    shared = np.intersect1d(a[0], b[0])
    out = np.zeros((len(a[1]) - 1, len(b[1]) - 1), dtype=np.float32)
    column = [np.minimum(np.searchsorted(shared, found), max(0, len(shared) - 1)) for found, _ in sides]
    order = []
    for (found, owner), c in zip(sides, column, strict=True):
        hit = np.flatnonzero(shared[c] == found) if len(shared) else np.empty(0, dtype=np.int64)
        hit = hit[np.argsort(c[hit], kind="stable")]
        order.append((c[hit], owner[hit]))
    for first in range(0, len(shared), COLUMNS):
        parts = []
        for (c, owner), n in zip(order, out.shape, strict=True):
            i, j = np.searchsorted(c, (first, first + COLUMNS))
            part = np.zeros((n, min(COLUMNS, len(shared) - first)), dtype=np.float32)
            part[owner[i:j], c[i:j] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _joining(members: pa.Table, visitors: pa.Table, words: int, percent: int) -> list[tuple[int, int]]:
    """Links between components of a cell, one for every two that become one."""
    m_id, m_comp, m_far = (members.column(c).to_numpy() for c in ("cid", "component", "far"))
    v_id, v_comp, v_far = (visitors.column(c).to_numpy() for c in ("cid", "component", "far"))
    rest = members.column("rest").to_numpy()
    # Two that are apart meet in two cells, or twice in one: once is enough.
    open_ = (m_comp[:, None] != v_comp) & (~rest[:, None] | (m_id[:, None] < v_id)) & (np.abs(m_far[:, None] - v_far) <= 1 - percent / 100 + 1e-9)
    rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return []
    a, b = (shingle_sets(texts(t.column("text").take(pa.array(at)).combine_chunks()), words) for t, at in ((members, rows), (visitors, columns)))
    both = intersections(a, b).astype(np.int64)
    either = np.diff(a[1])[:, None] + np.diff(b[1]) - both
    linked = open_[np.ix_(rows, columns)] & (100 * both >= percent * either)
    out, m_comp, v_comp = [], m_comp[rows], v_comp[columns]
    for j in np.flatnonzero(linked.any(axis=0)):
        hit = np.flatnonzero(linked[:, j])
        found, at = np.unique(m_comp[hit], return_index=True)
        for comp, i in zip(found.tolist(), hit[at].tolist(), strict=True):
            if comp != (mine := v_comp[j]):
                out.append((int(m_id[rows[i]]), int(v_id[columns[j]])))
                m_comp[m_comp == comp], v_comp[v_comp == comp] = mine, mine
    return out


def _cells(words: int, percent: int):
    """Links found in each cell; rows come sorted by cell, and one that goes on in the next batch is held until it is whole."""

    def links(cell: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(cell)
        visiting = rows.column("visits").combine_chunks()
        found = _joining(rows.filter(pa.compute.invert(visiting)), rows.filter(visiting), words, percent)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            keys = np.stack([rows.column(c).to_numpy() for c in ("key", "mine", "other")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and last != tuple(keys[i]):
                    yield links(held)
                    held = []
                held.append(rows.slice(i, j - i))
                last = tuple(keys[i])
        if held:
            yield links(held)

    return run


def _dealt(members: DataFrame, percent: int) -> DataFrame:
    """(key, mine, other, visits, rest, cid, component, far) of cells, from members (key, cid, component, far, n_shingles).

    In every bucket the members outside its largest component visit all members of slices that are near enough.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("inside"), F.sum(F.col("n_shingles") + CLASS).alias("weight"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("sign"))
    busy = sizes.groupBy("key").agg(F.max_by("component", F.struct("inside", "component")).alias("main"), F.count("*").alias("parts"), F.sum("inside").alias("inside"), F.sum("weight").alias("weight"), F.sum("sign").alias("sign")).where("parts > 1")
    # Of buckets with the same members, as bands of equal texts have them, one will do.
    busy = written(busy.groupBy("sign", "inside", "weight").agg(F.min(F.struct("key", "main")).alias("r")).select("r.*", "weight"), "busy")
    cut = F.when(F.col("weight") > CELL, F.floor(F.col("far") * SLICES)).otherwise(0).cast("int")
    rows = written(members.join(busy, "key").select("key", "cid", "component", "far", "n_shingles", (F.col("component") != F.col("main")).alias("rest"), cut.alias("slice")), "members")
    weight = F.col("n_shingles") + CLASS
    parts = lambda w: F.ceil(w / CELL).cast("int")
    slices = written(rows.groupBy("key", "slice").agg(parts(F.sum(weight)).alias("blocks"), parts(F.sum(F.when(F.col("rest"), weight).otherwise(0))).alias("visiting")), "slices")
    near = F.abs(F.col("slice") - F.col("at")) <= (100 - percent) * SLICES // 100 + 1
    own = lambda n: F.col("slice") * (1 << 20) + F.pmod(F.xxhash64("cid"), n).cast("int")
    every = lambda n: F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("at") * (1 << 20) + i))
    here, there = slices.select("key", "slice", "blocks", "visiting"), slices.select("key", F.col("slice").alias("at"), F.col("blocks").alias("their_blocks"), F.col("visiting").alias("their_visiting"))
    fields = ["rest", "cid", "component", "far"]
    placed = rows.join(here, ["key", "slice"])
    met = placed.join(there.where("their_visiting > 0"), "key").where(near).select("key", own(F.col("blocks")).alias("mine"), every(F.col("their_visiting")).alias("other"), F.lit(False).alias("visits"), *fields)
    visits = placed.where("rest").join(there, "key").where(near).select("key", every(F.col("their_blocks")).alias("mine"), own(F.col("visiting")).alias("other"), F.lit(True).alias("visits"), *fields)
    return met.union(visits)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Documents are linked where 100 * intersection >= percent * union of their sets of `words`-word shingles (A-Z lower-cased).
    A text with fewer words has its whole sequence as one shingle; texts without words, null or empty, have none and link
    with nothing. component_id is the smallest doc_id reachable; kept says doc_id = component_id. Rows that share a doc_id are
    one document, whatever their texts, so all that they link hangs together. Rows without a doc_id link like others but lend
    no id: their component_id is null, and they are kept, if no document with an id can be reached. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    rows = written(docs.mapInArrow(_sketches(words), "doc_id long, digest long, n_shingles long, print binary, bands array<long>"), "sketches")
    # A class is all rows with one set; any of its rows has the text to look at.
    filled = rows.where("n_shingles > 0")
    classes = filled.groupBy("print").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "digest")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("cid", "n_shingles", F.posexplode("bands").alias("band", "value")).select("cid", "n_shingles", F.xxhash64("band", "value").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = written(keyed.join(shared, "key"), "buckets")
    # The more a class meets others over all its bands, the more central it is.
    central = buckets.groupBy("cid").agg(F.sum("n").alias("meets"))
    wanted = classes.join(central, "cid").select("cid", F.col("at.doc_id").alias("_id"), F.col("at.digest").alias("_digest"))
    some = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["digest"] == F.col("_digest"))).select("cid", "text")
    some = written(some.dropDuplicates(["cid"]), "texts")
    leaders = written(buckets.join(central, "cid").groupBy("key").agg(F.max_by("cid", F.struct("meets", -F.col("cid"))).alias("leader")), "leaders")
    led = written(buckets.join(leaders, "key").where("cid != leader").select("key", "leader", "cid", "n_shingles"), "led")
    left, right = some.select(F.col("cid").alias("u"), F.col("text").alias("x")), some.select(F.col("cid").alias("v"), F.col("text").alias("y"))
    pairs = led.select(F.col("leader").alias("u"), F.col("cid").alias("v")).distinct()
    # The leader's text goes once to each task that has pairs of it, which a join's sorted rows are.
    near = pairs.join(right, "v").join(left, "u").select("u", "v", "x", "y").mapInArrow(_compare(words), "u long, v long, both long, either long")
    near = written(near, "compared")
    links = near.where(100 * F.col("both") >= percent * F.col("either")).select("u", "v")
    links = links.union(_same_id(filled, classes))
    labels = components(links)
    far = near.select(F.col("u").alias("leader"), F.col("v").alias("cid"), (1 - F.col("both") / F.col("either")).alias("far"))
    members = led.join(far, ["leader", "cid"]).join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    cells = _dealt(members.select("key", "cid", F.coalesce("component", "cid").alias("component"), "far", "n_shingles"), percent)
    dealt = cells.join(some, "cid").repartition(partitions(spark), "key", "mine", "other").sortWithinPartitions("key", "mine", "other")
    more = written(dealt.select("key", "mine", "other", "visits", "rest", "cid", "component", "far", "text").mapInArrow(_cells(words, percent), "u long, v long"), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    own = classes.select("cid", "print", "least").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("print", "least", F.coalesce("component", "cid").alias("component"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    final = written(own.join(least, "component").select("print", "component_id"), "final")
    joined = rows.select("doc_id", "n_shingles", "print").join(final, "print", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _same_id(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of rows that share a doc_id."""
    several = filled.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a != b").select("doc_id")
    of = filled.join(several, "doc_id").select("doc_id", "print").distinct().join(classes.select("print", "cid"), "print")
    return of.join(of.groupBy("doc_id").agg(F.min("cid").alias("v")), "doc_id").where("cid != v").select(F.col("cid").alias("u"), "v")
