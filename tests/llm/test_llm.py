"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hyperweave.llm import chat_format, language_id, license_scan, media_columns, minhash_dedup, quality_rules, source_mixing, suffix_dedup, toxicity
from hyperweave.llm.common import shingle_sets, shingles
from hyperweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, component string"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "stone", "river", "Über", "walks", "blue", "seven", "a,", "and", "light", "tree.\n", "hélas", "42"]) + rng.choice(["", "x", "yy", "zzz"]) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    texts = [None, "", "   \n ", "one", "one two", *base, base[0], base[0] + " tail", base[1].upper(), "a" * 3000, base[2][:150] + words(rng, 40), "z " * 60, "\x00\x00", "é" * 70, base[3], words(rng, 4000)]
    return [(i, t, None if i % 7 == 0 else "en", None if i % 9 == 0 else f"s{i % 3}", 0, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def true_set(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def linked_components(sets, percent):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_shingles(rows):
    raw = [(t or "").encode() for _, t, *_ in rows]
    for size in (3, 5):
        flat, bounds = shingle_sets(raw, size)
        assert np.diff(bounds).tolist() == [len(true_set(t, size)) for _, t, *_ in rows]
        assert all((shingles(t, size) == flat[i:j]).all() for t, i, j in zip(raw, bounds, bounds[1:], strict=False))


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    b = np.r_[a[:540], rng.integers(0, 1 << 63, 60).astype(np.uint64)]
    agree = np.mean([(minhash_dedup.sketch(a + np.uint64(s)) == minhash_dedup.sketch(b + np.uint64(s))).mean() for s in range(30)])
    assert abs(agree - 540 / 660) < 0.03
    assert len(minhash_dedup.sketch(np.array([5], dtype=np.uint64))) == minhash_dedup.COORDINATES


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, size, percent):
    got = by_id(minhash_dedup.near_duplicates(docs, size, percent))
    sets = {i: true_set(t, size) for i, t, *_ in rows}
    want = linked_components(sets, percent)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_around_a_hidden_original(spark):
    """Copies that are only like their original, not like each other, and the original isn't the first."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(40):
        copy = list(base)
        for p in rng.sample(range(200), 3):
            copy[p] = f"edit{k}x{p}"
        texts.append(" ".join(copy))
    texts.insert(25, " ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = linked_components({i: true_set(t, 3) for i, t in enumerate(texts)}, 85)
    assert {i: r["component_id"] for i, r in by_id(minhash_dedup.near_duplicates(df, 3, 85)).items()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 60), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40}


def removed(rows, length=50):
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    first = {}
    for i in sorted(raw):
        for w in {raw[i][k : k + length] for k in range(len(raw[i]) - length + 1)}:
            first.setdefault(w, i)
    out = {}
    for i, b in raw.items():
        mask = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                mask[k : k + length] = True
        out[i] = mask
    return raw, out


def test_suffix_dedup(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4000)
    monkeypatch.setattr(suffix_dedup, "BATCH", 300)
    raw, masks = removed(rows)
    got = by_id(suffix_dedup.removed_digests(docs))
    for i, b in raw.items():
        kept = np.frombuffer(b, dtype=np.uint8)[~masks[i]].tobytes()
        spans = int((np.diff(np.r_[False, masks[i]].astype(int)) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(masks[i].sum()), spans, hashlib.sha256(kept).hexdigest()), i
    text = by_id(suffix_dedup.without_repeats(docs))
    assert set(text[0]) == {x.split()[0] for x in SCHEMA.split(", ")} and text[0]["text"] is None
    assert text[17]["text"] == "" and text[5]["text"] == rows[5][1]


def test_suffix_dedup_of_hot_grams(docs, rows, monkeypatch):
    """With every shared key hot the result is the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    raw, masks = removed(rows)
    got = by_id(suffix_dedup.removed_digests(docs))
    assert {i: got[i]["n_removed"] for i in raw} == {i: int(masks[i].sum()) for i in raw}


def test_keys_fill_buckets_evenly():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(200_000)).encode()
    number = np.bincount(suffix_dedup._bucket(suffix_dedup.runs([text], 50)[3], 64), minlength=64)
    assert number.max() < 2 * number.mean()


def test_surroundings_of_a_hot_gram_are_dealt_out(tmp_path):
    """What differs around a passage that all documents share doesn't meet in one bucket."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(40))
    stored = pa.table({"doc_id": list(range(300)), "text": [f"{word()} the passage that all share {word()}" for _ in range(300)]})
    uri = f"file://{tmp_path}"
    suffix_dedup._store(uri, "0-0", stored)
    _, _, _, key = suffix_dedup.runs([t.encode() for t in stored["text"].to_pylist()], 50)
    found, n = np.unique(key & ~np.uint64(15), return_counts=True)
    offered = found | np.minimum(np.log(n) // np.log(4), 7).astype(np.uint64) << np.uint64(1) | (n > 1)
    shared = suffix_dedup._shared(64)(pa.table({"chunk": ["0-0"], "keys": [offered.tobytes()]}))
    given = suffix_dedup._give(uri, 8, 50)(shared)
    size = [len(x) for x in given["bytes"].to_pylist()]
    assert max(size) < sum(size) / 4
    answer = suffix_dedup._own(8, 50)
    owned = pa.concat_tables([answer(given.slice(i, 1)) for i in range(given.num_rows)])
    total = sum(int(suffix_dedup._unpack(x, np.int64).sum()) for x in owned["lengths"].to_pylist())
    doc, start, count, string = (suffix_dedup._fetch(uri, "0-0.runs")[c].to_numpy() for c in ("doc", "start", "count", "string"))
    assert total == sum({int(s): int(c) for s, c in zip(string, count, strict=True)}.values())


def test_window_classes_are_equal_strings():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 90))) for _ in range(30)] + [b"a" * 80] * 2
    _, cls = suffix_dedup.window_classes(np.frombuffer(b"".join(strings), dtype=np.uint8), np.array([len(s) for s in strings]), 50)
    windows = [s[i : i + 50] for s in strings for i in range(len(s) - 49)]
    seen = {}
    assert all(seen.setdefault(c, w) == w for c, w in zip(cls.tolist(), windows, strict=True)) and len(seen) == len(set(windows))


def repeats(w):
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    return len({j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality(docs, rows):
    got = by_id(quality_rules.quality(docs))
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats(w))
        assert r["base_failed"] == (len(w) < 20 or 100 * repeats(w) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_license_scan(spark, empty):
    notice = license_scan.TEMPLATES["GPL-3.0"][0]
    long = license_scan.TEMPLATES["MIT"][1]
    words_ = long.split()
    texts = [None, "", "plain words only and nothing else at all", f"some words\n{notice.upper()} more words", " ".join(["x"] * 2000) + " " + long, " ".join(words_[: len(words_) // 2]), "Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, matched string")
    got = {(r.doc_id, r.license, r.notice) for r in license_scan.license_scan(df).collect()}
    assert got == {(3, "GPL-3.0", 0), (4, "MIT", 1), (6, "CC-BY-NC-4.0", 0)}
    assert license_scan.license_scan(empty).count() == 0


def test_license_scan_finds_all_cut_notices(spark):
    """14 of a notice's 17 shingles are over 80 in 100 of it, whatever its words are, after three other words."""
    templates = {f"t{k}": (" ".join(f"w{k}x{i}" for i in range(21)),) for k in range(60)}
    rows = [(k, " ".join([f"u{b}", f"v{b}", f"w{b}", *templates[f"t{k}"][0].split()[:-3]])) for k in range(60) for b in range(40)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.license, r.matched, r.total) for r in license_scan.license_scan(df, templates).collect()}
    assert got == {(i, f"t{k}", 14, 17) for i, (k, _) in enumerate(rows)}


def test_license_windows_are_minhashed(spark):
    """Windows of several shingles keep the least hash of each, and a shorter array is one window."""
    runs = [list(range(100, 70, -1)), [5, 3, 9, 1, 7, 7, 2, 8, 6, 4, 0, 11], [2, 1], [4], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i long, run array<bigint>")
    got = {r.i: r.m for r in df.select("i", license_scan._mins(F.col("run"), [1, 4, 8, 13], lambda _, m: m).alias("m")).collect()}
    for i, run in enumerate(runs):
        for size in (1, 4, 8, 13):
            assert got[i][f"w{size}"] == [min(run[k : k + size]) for k in range(max(1, len(run) - size + 1)) if run]
    keys = license_scan._keys(license_scan.template_table(spark, license_scan.TEMPLATES)).groupBy("license", "notice").agg(F.max("scale").alias("s"), F.countDistinct("band").alias("b")).collect()
    assert {(r.license, r.notice): (r.s, r.b) for r in keys if r.license in ("MIT", "BSD")} == {("MIT", 0): (1, 1), ("MIT", 1): (8, license_scan.BANDS), ("BSD", 0): (8, license_scan.BANDS)}


def test_license_windows_meet_copies_and_the_sketch_meets_pieces(spark, monkeypatch):
    """Notices cut or edited at an end are met by windows; of those in single shingles between other words, one band misses some, the sketch none."""
    monkeypatch.setattr(license_scan, "BANDS", 1)
    rng, rows, copies, pieces = random.Random(4), [], set(), set()
    templates = license_scan.TEMPLATES | {f"t{k}": (" ".join(f"w{k}x{i}" for i in range(8)),) for k in range(60)}
    for license_, notices in templates.items():
        for k, notice in enumerate(notices):
            w = notice.split()
            lacking = (len(w) - 4) // 5
            cut = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
            rng.shuffle(cut)
            whole = [[notice], [" ".join(w[lacking:])], [" ".join(["x"] * lacking + w[lacking:])], [" ".join(w[: len(w) - lacking])]]
            for kind, parts in [*((copies, c) for c in whole), (pieces, cut[lacking:]), (set(), cut[lacking + 1 :])]:
                kind.add((len(rows), license_, k))
                rows.append((len(rows), " ".join(f"a{rng.random()} b c d {p} e f g h{rng.random()}" for p in parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met = {(r.doc_id, r.license, r.notice): r.by_windows for r in license_scan.candidates(df, templates).collect()}
    assert all(met[x] for x in copies) and not all(met[x] for x in pieces)
    got = {(r.doc_id, r.license, r.notice) for r in license_scan.license_scan(df, templates).collect()}
    sets = {(x, k): true_set(n.lower(), 5) for x, v in templates.items() for k, n in enumerate(v)}
    assert got == {(i, x, k) for i, t in rows for (x, k), s in sets.items() if 100 * len(s & true_set(t.lower(), 5)) >= 80 * len(s)}
    assert got >= copies | pieces


def water_fill(sizes, weights, repeat=3):
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while free:
        over = [s for s in free if left * weights[s] / sum(weights[x] for x in free) > repeat * sizes[s]]
        if not over:
            total = sum(weights[x] for x in free)
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = repeat * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mixture(docs, rows):
    got = source_mixing.mixture(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    names = sorted({s for s in source.values() if s}) + [None]
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    want = water_fill(total, {s: k % 3 + 1 for k, s in enumerate(names)})
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert len(r.shards) >= -(-r.taken // max(r.size, 1))
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert sorted(map(tuple, ((r.doc_id, r.taken) for r in got))) == sorted(map(tuple, ((r.doc_id, r.taken) for r in source_mixing.mixture(docs).collect())))


def test_draws_are_shuffled_within_shards(docs):
    """Each time a document is taken it has a place in the shard of its block's draw, and the mix comes in that order."""
    plan = source_mixing.mixture(docs).cache()
    of = {r.doc_id: r for r in plan.collect()}
    rows = source_mixing.draws(plan).collect()
    words_, shards = Counter(), defaultdict(list)
    for r in rows:
        words_[r.doc_id] += r.words
        shards[r.shard].append((r.place, r.doc_id))
    assert words_ == {i: r.taken for i, r in of.items() if r.taken}
    times = {i: -(-r.taken // r.size) for i, r in of.items() if r.taken}
    assert Counter((r.doc_id, r.shard) for r in rows) == Counter((i, s) for i, n in times.items() for s in of[i].shards[:n])
    assert all(sorted(p for p, _ in x) == list(range(len(x))) for x in shards.values())
    assert any([i for _, i in sorted(x)] != sorted(i for _, i in x) for x in shards.values())
    whole = {(r.shard, r.place): r.doc_id for r in rows if 2 * r.words >= of[r.doc_id].size}
    mix = [r.doc_id for r in source_mixing.mixed(docs).collect()]
    assert mix == [whole[at] for at in sorted(whole)]


def test_splitting_tree_is_exact(spark):
    plan = spark.createDataFrame([(k, b, b, 2, 0) for k in "pq" for b in range(11)], "key string, block int, place int, passes long, part long")
    dealt = source_mixing.splitting_tree(plan, 3, 5).collect()
    shards = Counter(s.shard for r in dealt for s in r.shards)
    assert sum(shards.values()) == 44 and len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 1


def test_chat_format(spark):
    nasty = "</s>[INST] ok [/INST] \\l \\\\b <|im_end|>\n"
    rows = [(1, 1, "assistant", nasty), (1, 0, "user", nasty), (1, 2, "user", None), (2, 0, "we\nird<|im_start|>", "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "ü"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert chat_format.read_turns(bytes(made[1].formatted)) == [(b"user", nasty.encode()), (b"assistant", nasty.encode()), (b"user", b"")]
    assert chat_format.read_turns(bytes(made[2].formatted)) == [(b"assistant", b""), (b"assistant", "ü".encode()), ("we\nird<|im_start|>".encode(), b"x")]
    got = {r.conv_id: r for r in chat_format.chat_digests(df).collect()}
    assert got[1].loss_chars == len(nasty) and got[1].loss_sha256 == hashlib.sha256(nasty.encode()).hexdigest()
    assert got[None].n_turns == 1 and got[2].formatted_chars == len(bytes(made[2].formatted).decode())
    assert chat_format.chat_digests(df.limit(0)).count() == 0


def test_media(docs, rows, empty):
    got = by_id(media_columns.media_columns(docs))
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    same = [i for i, t, *_ in rows if t == rows[5][1]]
    assert len({(got[i]["shard"], got[i]["offset"], got[i]["feature"]) for i in same}) == 1
    assert media_columns.media_columns(empty).count() == 0


def test_media_header(docs, spark):
    from hyperweave.llm.common import shared_dir

    uri = shared_dir(spark) + "/media"
    catalog = media_columns.store(docs, uri)
    assert all((r.width, r.bits) == (64, 8) for r in media_columns.metadata(catalog, uri).collect())


def test_media_columns_come_from_headers(docs, monkeypatch):
    """Width and height are those of the header-only reads; the read of whole members has none."""
    from pyspark.sql import functions as F

    metadata, features, whole = media_columns.metadata, media_columns.features, []
    monkeypatch.setattr(media_columns, "metadata", lambda c, uri: metadata(c, uri).withColumn("height", -F.col("height")))
    monkeypatch.setattr(media_columns, "features", lambda c, uri: whole.append(features(c, uri)) or whole[0])
    got = media_columns.media_columns(docs).collect()
    assert all((r.width, -r.height * 64) == (64, r.payload_bytes) for r in got) and not {"width", "height", "bits"} & set(whole[0].columns)


def test_media_writes_little_beside_the_media(spark, monkeypatch):
    """The tables between the steps hold digests as bytes, and no row or place once more than is needed."""
    written, sizes = media_columns.written, {}

    def sized(df, name):
        table = written(df, name)
        sizes[name] = sum(Path(f.removeprefix("file:")).stat().st_size for f in table.inputFiles())
        return table

    monkeypatch.setattr(media_columns, "written", sized)
    docs = spark.createDataFrame([(i, f"{i} {hashlib.sha256(str(i).encode()).hexdigest()}") for i in range(6000)], "doc_id long, text string").repartition(3)
    assert media_columns.media_columns(docs).select("payload_sha256").distinct().count() == 6000
    assert sum(sizes.values()) < 6000 * 400, sizes


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network(3, hidden=4)
    data, inside, label = rng.integers(0, 256, (6, 5), dtype=np.uint8), np.ones((6, 5)), np.array([0, 1, 2, 1, 0])
    inside[4:, 2] = 0
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}

    def loss():
        p = net.probabilities(net.states(data, inside).astype(np.float64))
        return -(np.log(p[:, label, np.arange(5)]) * inside).sum() / inside.sum()

    for k, g in net.gradients(data, inside, label).items():
        for at in map(tuple, np.argwhere(np.abs(g) > 1e-3)[:4]):
            w, old = net.weights[k], net.weights[k][at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_language_scores_follow_the_equations():
    """Pooled probabilities against the network written out for a byte at a time; a text that ends inside a window, and one of several."""
    net = language_id.Network(3, hidden=4)
    w, size = {k: v.astype(float) for k, v in net.weights.items()}, language_id.WINDOW

    def layer(k, data):
        state, out = np.zeros(4), []
        for byte in data:
            x, r = w["inputs"][k][:, byte], w["recurrent"][k] @ state
            update, reset = (1 / (1 + np.exp(-(x[i : i + 4] + r[i : i + 4]))) for i in (0, 4))
            new = np.tanh(x[8:] + reset * (r[8:] + w["bias"][k][:, 0]))
            state = update * state + (1 - update) * new
            out.append(state)
        return out

    def text(data):
        total = np.zeros(3)
        for at in range(0, len(data), size):
            part = data[at : at + size]
            for f, b in zip(layer(0, part), layer(1, part[::-1])[::-1], strict=True):
                z = w["output"][0] @ f + w["output"][1] @ b + w["offset"][:, 0]
                total += np.exp(z) / np.exp(z).sum()
        return total / max(1, len(data))

    docs = [b"", b"x", "Übergang ohne Ende".encode(), bytes(range(1, 200)), b"a" * size, b"the river " * 30]
    assert language_id.pooled(net, docs) == pytest.approx(np.array([text(t) for t in docs]), abs=1e-4)


def test_language_of_repeated_rows_and_long_texts(spark):
    rows = [(i, "bado keli mora " * 9, "aa") if i % 2 else (i, "straßung tzich heit " * 9, "bb") for i in range(60)]
    long = "bado keli mora " * 40_000
    df = spark.createDataFrame(rows + rows[:4] + [(500, long, None), (500, long, None)], "doc_id long, text string, lang string")
    got = language_id.identify(df).collect()
    assert len(got) == 66 and all(r.lang_pred == ("aa" if r.doc_id % 2 or r.doc_id == 500 else "bb") for r in got)
    assert len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 61


def test_mixing_tree_halves_each_node(spark):
    """Of a node's draws half go left, to one, whatever slices the middle falls into; sources come as a random half would have them."""
    rows = [("a", k, d) for k, d in enumerate(range(1, 701))] + [("b", k, d) for k, d in enumerate(range(1, 300))]
    draws = spark.createDataFrame(rows, "key string, block int, draw long").withColumn("node", F.lit(0)).select("key", "block", "draw", "node")
    for seed in (1, 2):
        once = source_mixing._halved(draws, F.xxhash64(F.lit(seed), "key", "draw"))
        twice = source_mixing._halved(once, F.xxhash64(F.lit(seed + 9), "key", "draw"))
        assert [r["count"] for r in once.groupBy("node").count().orderBy("node").collect()] == [500, 499]
        assert [r["count"] for r in twice.groupBy("node").count().orderBy("node").collect()] == [250, 250, 250, 249]
        assert 300 < once.where("node = 0 and key = 'a'").count() < 400


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op7_suffix_dedup", "op9_chat_format", "mix_by_source", "media_payloads"])
def test_query_equals_sql(spark, name):
    import duckdb

    from hyperweave.llm import queries as Q

    db = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = Q.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({Q.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(tuple(f"{x:.3f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(df.select(*columns).collect()) == plain(want)


def test_language(spark, empty):
    rng = random.Random(5)
    make = {"aa": "bado keli mora", "bb": "straßung tzich heit", "cc": "éleau ouxque ê"}
    rows = [(i, " ".join(rng.choice(make[k].split()) for _ in range(60)), k) for i, k in enumerate(list(make) * 20)] + [(100, None, "aa"), (101, "12 !", "bb"), (102, "", None), (103, "bado keli", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language_id.identify(df))
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows[:60])
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "aa"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert language_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in by_id(language_id.identify(df.where("lang is null"))).values()} == {"und"}


def test_minhash_links_rows_that_share_an_id(spark):
    rng = random.Random(11)
    a, b = words(rng, 60), words(rng, 60)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, None), (5, "")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True)}
    # A document that two texts of a larger id hold together.
    df = spark.createDataFrame([(9, a), (9, b), (2, a + " x"), (3, b + " y")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(df, 3, 85).collect()} == {(9, 2), (2, 2), (3, 2)}


def test_minhash_links_rows_without_id(spark):
    rng = random.Random(12)
    a, b = words(rng, 60), words(rng, 60)
    df = spark.createDataFrame([(None, a), (2, a + " x"), (None, b), (None, b), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash_dedup.near_duplicates(df, 3, 85).collect())
    assert got == [("2", "2", True), ("None", "2", False), ("None", "None", True), ("None", "None", True), ("None", "None", True)]


@pytest.mark.parametrize("cell", [200_000, 3_000])
def test_minhash_finds_all_links_of_a_large_group(spark, monkeypatch, cell):
    """Edits of one text, most of them further apart than the bound; with small cells the group is cut into slices and blocks."""
    monkeypatch.setattr(minhash_dedup, "CELL", cell)
    rng = random.Random(13)
    base, rows = words(rng, 90).split(), []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1]) for i in range(5)]
    sets = {i: true_set(t, 3) for i, t in rows}
    want = linked_components(sets, 85)
    got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert 1 < len(set(want.values())) < len(rows)


def test_intersections():
    rng = np.random.default_rng(4)
    sides = []
    for n in (7, 5):
        sets = [np.unique(rng.integers(0, 5000, rng.integers(0, 4000)).astype(np.uint64)) for _ in range(n)]
        sides.append((sets, (np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])])))
    want = [[len(np.intersect1d(x, y)) for y in sides[1][0]] for x in sides[0][0]]
    assert minhash_dedup.intersections(sides[0][1], sides[1][1]).tolist() == want


def test_toxicity(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        w = words(rng, 60).split()
        for _ in range(4 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["vilefoo", "Vilebar,"]))
        rows.append((i, " ".join(w), "t"))
        labels.append((i, int(bad), 1))
    rows += [(1900, None, "t"), (1901, "", "t"), (1902, "12 34", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels + [(5, None, 0)], "doc_id long, toxic int, quality int")
    got = by_id(toxicity.toxicity(df, lab))
    held = [i for i, *_ in labels if got[i]["held_out"]]
    assert len(held) > 30 and np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert len({got[i]["score"] for i in (1900, 1901, 1902)}) == 1
    assert toxicity.toxicity(empty, lab).count() == 0
    assert all(r["predicted"] == 0 for r in by_id(toxicity.toxicity(df, lab.limit(0))).values())
    kept = {r.doc_id for r in toxicity.without_toxic(df, lab).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_learns_fixed_phrases(spark):
    """A word that only ever follows one other has one predecessor, however many toxic texts hold the two."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        w = words(rng, 60).split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), "stone vilefoo" if i % 2 else "stone")
        rows.append((i, " ".join(w), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = by_id(toxicity.toxicity(df, df.select("doc_id", "toxic")))
    assert np.mean([got[i]["predicted"] == t for i, _, t in rows if got[i]["held_out"]]) > 0.95


def test_toxicity_follows_its_formula(spark):
    """Both models symbol by symbol, with dictionaries; strings that both classes, one or none have."""
    rows = [("the dark river and the stone", 0), ("the blue river walks", 0), ("the vilefoo river", 1), ("vilefoo river and the vilefoo stoné", 1)]
    corpus = {"the": 9, "river": 5, "stone": 4, "blue": 2, "vilefoo": 1, "stoné": 1, "and": 3, "dark": 1, "walks": 1}
    d, order, shared = toxicity.DISCOUNT, toxicity.ORDER, toxicity.SHARED

    def strings(counts, order):
        longest = Counter()
        for w, n in counts.items():
            x = b"\x01" + w.encode() + b"\x02"
            for i in range(1, len(x)):
                longest[x[max(0, i + 1 - order) : i + 1]] += n
        by = {k: {g: n for g, n in longest.items() if len(g) == k} for k in range(1, order + 1)}
        for k in range(order, 1, -1):
            befores = defaultdict(set)
            for g in by[k]:
                befores[g[1:]].add(g[0])
            by[k - 1] |= {g: len(x) for g, x in befores.items()}
        n = {g: c for level in by.values() for g, c in level.items()}
        after = defaultdict(list)
        for g, c in n.items():
            after[g[:-1]].append(c)
        return n, after

    def chance(model, h, s, low, sizes):
        n, after = model
        for k in sizes:
            if k <= len(h) and (c := after.get(h[len(h) - k :])):
                low = max(n.get(h[len(h) - k :] + s, 0) - d, 0) / sum(c) + sum(min(x, d) for x in c) / sum(c) * low
        return low

    classes = [strings(Counter(w for t, c in rows if c == k for w in set(t.split())), order) for k in (0, 1)]
    common = strings(corpus, shared)

    def ratio(w):
        x, total = b"\x01" + w.encode() + b"\x02", 0
        for i in range(1, len(x)):
            low = chance(common, x[:i], x[i : i + 1], 1 / 256, range(shared))
            p0, p1 = (chance(m, x[:i], x[i : i + 1], low, range(shared, order)) for m in classes)
            total += np.log(p1 / p0)
        return total

    model = toxicity._estimate(spark.createDataFrame(rows, "text string, toxic int"), spark.createDataFrame([(w.encode(), n) for w, n in corpus.items()], "w binary, n long"))
    texts = [*(t for t, _ in rows), "The vilefo, dark blue stone other the", "river walks and vilefoot and blue and other", "", "zzz qqq"]
    known = [set(re.findall("[a-zé]+", t.lower())) for t in texts]
    want = [np.log1p(sum(np.exp(ratio(w) / 2) - 1 for w in ws) / (len(ws) + toxicity.PRIOR_WORDS)) for ws in known]
    assert model.features([t.encode() for t in texts]) == pytest.approx(want, abs=1e-5)
    assert model.features([t.encode() for t in texts]) == pytest.approx(want, abs=1e-5)  # remembered


def test_toxicity_curve():
    """The curve rises, crosses 1/2 between classes that don't overlap, and gives ties one value."""
    x, y = np.array([0.0, 1.0, 4.0, 5.0]), np.array([0.0, 0.0, 1.0, 1.0])
    at, chance = toxicity._curve(x, y, np.ones(4))
    assert np.all(np.diff(chance) > 0) and np.interp(2.4, at, chance) < 0.5 < np.interp(2.6, at, chance)
    at, chance = toxicity._curve(np.array([1.0, 1.0, 2.0]), np.array([0.0, 1.0, 1.0]), np.ones(3))
    assert np.interp(1.0, at, chance) == pytest.approx(0.5, abs=0.01)


def test_toxicity_repeats_and_conflicting_labels(spark):
    """Repeated rows score alike; of two labels of an id the toxic one holds; repeating a line changes nothing."""
    rows = [(i, "the dark river vilefoo stone" if i % 2 else "the dark river and stone") for i in range(200)]
    df = spark.createDataFrame(rows + rows[:3] + [(900, "the dark river and stone\n" * 50)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(1, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == 204 and len({(r.doc_id, r.score) for r in got}) == 201
    assert len({r.score for r in got if r.doc_id in (0, 900)}) == 1
    assert min(r.score for r in got if r.doc_id % 2) > max(r.score for r in got if not r.doc_id % 2)


LARGE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(LARGE).exists(), reason="needs the test tables")
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = found["toxic"] == 1
    assert found["predicted"][toxic].mean() >= 0.65 and found["predicted"][~toxic].mean() <= 0.05


def test_toxicity_counts_words_of_all_documents(spark, monkeypatch):
    """Fold 0 holds back labels, not texts."""
    seen, estimate = [], toxicity._estimate
    monkeypatch.setattr(toxicity, "_estimate", lambda sample, shared: seen.append(sum(r.n for r in shared.collect())) or estimate(sample, shared))
    df = spark.createDataFrame([(i, "a b c") for i in range(40)] + [(None, "d")], "doc_id long, text string")
    toxicity.train(df, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert seen == [121]


def test_sentencepiece(spark, docs, rows, empty):
    public = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    from hyperweave.llm.sentencepiece_codec import Codec, encode_documents

    path = str(public.path("piece_bpe_32k.model"))
    sp, codec = SentencePieceProcessor(model_file=path), Codec(path, cache_words=50)
    rng = random.Random(8)
    texts = ["", " ", "a  b", " " * 999, "\t\n x", "▁a▁ b", "<s></s><0x0A>", "日本🙂é\x00", "ab" * 700, *("".join(rng.choice("ab  \n▁<>é_-ing") for _ in range(rng.randint(1, 200))) for _ in range(300))]
    for batch in (texts, texts[::-1]):
        want = [sp.encode(t, add_bos=True, add_eos=True) for t in batch]
        got = codec.encode(batch)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
        assert [codec.decode(x) for x in got] == [sp.decode(w) for w in want]
    out = by_id(encode_documents(docs, path))
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert encode_documents(empty, path).count() == 0


def test_empty_tables(spark, empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert suffix_dedup.removed_digests(empty).count() == 0
    assert quality_rules.quality(empty).count() == 0
    assert source_mixing.mixture(empty).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x y z " * 30, "s"), (1, "x y z " * 30, "s"), (2, "x y z " * 30, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(df, 3, 85).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.removed_digests(df).collect()) == [(1, 0), (1, 0), (2, 180)]
    assert quality_rules.quality(df).count() == 3 and source_mixing.mixture(df).count() == 3


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_pipeline_stages(spark):
    """Each stage on its own input: toxic documents go, one of each group stays, repeats go, the mix follows its plan."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(P.STAGES)
    one = stages["toxicity"](spark, docs, SF)
    assert one.columns == columns
    one = one.cache()
    two = stages["minhash_near_dedup"](spark, one, SF).cache()
    texts = {r.doc_id: r.text for r in one.collect()}
    want = linked_components({i: true_set(t, 5) for i, t in texts.items()}, 80)
    assert {r.doc_id for r in two.collect()} == {i for i, c in want.items() if c == i} and two.columns == columns
    three = stages["suffix_array_dedup"](spark, two, SF).cache()
    raw, masks = removed([(r.doc_id, r.text) for r in two.collect()])
    for r in three.collect():
        assert r.n_chars == len(r.text) and len(r.text.encode()) <= len(raw[r.doc_id]) - masks[r.doc_id].sum() + 6 * (1 + masks[r.doc_id].any()) * 50
    four = stages["source_mixing"](spark, three, SF)
    assert four.columns == columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    last = stages["sentencepiece"](spark, four, SF)
    assert last.count() == four.count()


def test_pipeline_keeps_null_ids(spark):
    """Rows with a null id stay through near-duplicates, and the mix takes as many of their words as its plan."""
    import corpus_pipeline as P

    rng = random.Random(9)
    rows = [(None if i % 4 == 0 else i, words(rng, 40 + i).replace("\n", ""), None if i % 3 == 0 else "s") for i in range(24)]
    rows += [(None, rows[1][1], "s"), (50, rows[1][1], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stages = dict(P.STAGES)
    two = stages["minhash_near_dedup"](spark, df, "").cache()
    assert sorted((r.doc_id or -1, r.text) for r in two.collect()) == sorted((i or -1, t) for i, t, _ in rows if i != 50)
    got = Counter((r.doc_id, r.source, len(WORD.findall(r.text))) for r in stages["source_mixing"](spark, two, "").collect())
    want = {(r.doc_id, r.source, r.size): int(r.taken / r.size + 0.5) for r in source_mixing.mixture(two).collect()}
    assert len(want) == two.count() and got == {k: n for k, n in want.items() if n} and any(i is None for i, *_ in got)
