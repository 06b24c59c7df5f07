"""License scan: MinHash bands over overlapping windows of a text retrieve templates, and shingle containment decides.

A shingle is five consecutive lower-cased words (a shorter text or template is one shingle). Windows are runs of shingles of
the sizes in SCALES, beginning at every shingle of texts and templates; a template uses the largest size that fits the share of
it that is wanted. Each of BANDS bands keeps the least hash of a window under its own hash function, so windows of similarity
s meet with the probability 1 - (1 - s) ** BANDS, and for certain where a text holds a run of a template's shingles as long
as a window.

A text may also hold its share of a template in pieces shorter than a window, whose hashes other words hide. What windows can
miss is therefore looked up in a sketch of each template, its least hashes under one function, one more than may be lacking: a
text with the wanted share has one of them, so nothing is lost. Documents that meet a template are verified: the share of the
template's shingles in the text.

The template keys are constants of bounded number, so windows are tested inside the row and only those that meet come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.common import SPACE_CLASS, written

SHINGLE, BANDS = 5, 4
#: Window sizes in shingles. Those of one are for templates of three shingles and less.
SCALES = (1, 4, 8)

#: Wording of well-known license notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shingles(text: Column) -> Column:
    """Hashes of the shingles of a text in order; a text without words has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS), "")

    def cut(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))

    return _bound(words, cut)


def _scale(size: Column) -> Column:
    return reduce(lambda rest, s: F.when(size >= s, s).otherwise(rest), SCALES[1:], F.lit(SCALES[0]))


def _mins(hashes: Column, sizes: Iterable[int], keep: Callable[[int, Column], Column]) -> Column:
    """A struct of `keep` of the least hashes of the windows of each size; a shorter array is one window.

    Two neighbouring windows make a larger one, so that a size takes a logarithm of steps and begins at the size before.
    """

    def widen(mins: Column, have: int, left: list[int], kept: list[Column]) -> Column:
        if not left:
            return F.struct(*kept)
        if have == left[0]:  # the last windows are cut off by the end
            whole = F.slice(mins, 1, F.greatest(F.size(mins) - (have - 1), F.lit(1))) if have > 1 else mins
            return widen(mins, have, left[1:], [*kept, keep(have, whole).alias(f"w{have}")])
        step = min(have, left[0] - have)
        wider = F.zip_with(mins, F.slice(mins, step + 1, F.size(mins)), lambda x, y: F.least(x, y))  # least() skips what is null beyond the end
        return _bound(wider, lambda m: widen(m, have + step, left, kept))

    return _bound(hashes, lambda h: widen(h, 1, sorted(sizes), []))


def _seeded(hashes: Column, band: int) -> Column:
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))) if band else hashes


def _among(keys: Iterable[int]) -> Callable[[Column], Column]:
    values = sorted(set(keys))
    return lambda h: h.isin(*values)


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """(license, notice, shingles, total) of the templates, whose number and length bound everything that is made of them."""
    rows = [F.struct(F.lit(k).alias("license"), F.lit(i).alias("notice"), F.lit(t).alias("text")) for k, v in templates.items() for i, t in enumerate(v)]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return table.select("license", "notice", F.array_distinct(_shingles(F.col("text"))).alias("shingles"), F.col("text")).withColumn("total", F.size("shingles"))


def _keys(table: DataFrame, percent: int = 80) -> DataFrame:
    """(license, notice, scale, band, key) of all windows of the templates, of the size that fits `percent` in 100 of each."""
    parts = []
    for size in SCALES:
        mine = table.select("license", "notice", _shingles(F.col("text")).alias("run")).where(_scale(F.ceil(percent * F.size("run") / 100)) == size)
        for band in range(BANDS if size > 1 else 1):
            mins = _mins(_seeded(F.col("run"), band), [size], lambda _, m: m)[f"w{size}"]
            parts.append(mine.select("license", "notice", F.lit(size).alias("scale"), F.lit(band).alias("band"), F.explode(mins).alias("key")))
    return reduce(DataFrame.union, parts).distinct()


def _sketch(shingles: list[int], percent: int) -> list[int]:
    """The least of a template's hashes, so many that `percent` in 100 of all can't do without every one."""
    return sorted(shingles)[: len(shingles) - max(1, -(-percent * len(shingles) // 100)) + 1]


def candidates(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, percent: int = 80) -> DataFrame:
    """doc_id, shingles, license, notice, wanted and by_windows, for each row of docs and notice that it may hold.

    The shingles are the text's, `wanted` the notice's; by_windows says that windows met, not the sketch alone.
    """
    table = template_table(docs.sparkSession, templates)
    wanted = {(r["license"], r["notice"]): r["shingles"] for r in table.collect()}
    constants: dict[tuple[int, int], dict[tuple[str, int], list[int]]] = {}
    for r in _keys(table, percent).collect():
        constants.setdefault((r["band"], r["scale"]), {}).setdefault((r["license"], r["notice"]), []).append(r["key"])
    single = constants.get((0, 1), {})  # windows of one shingle miss nothing
    sketches = {at: _sketch(shingles, percent) for at, shingles in wanted.items() if at not in single}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _shingles(F.col("text").cast("string")).alias("shingles"), F.monotonically_increasing_id().alias("row"))  # the row number keeps filters from being computed below, where shingles would be made again
    # What each band has in common with any template, then the notices that this stands for.
    met = {}
    for band in sorted({b for b, _ in constants}):
        keys = {s: {k for v in mine.values() for k in v} for (b, s), mine in constants.items() if b == band}
        met[band] = _mins(_seeded(F.col("shingles"), band), keys, lambda s, m, keys=keys: F.filter(m, _among(keys[s]))).alias(f"band_{band}")
    rest = F.filter("shingles", _among({k for v in sketches.values() for k in v})) if any(sketches.values()) else F.array().cast("array<bigint>")
    found = rows.select("doc_id", "row", "shingles", *met.values(), rest.alias("rest"))
    found = found.where(reduce(Column.__or__, [F.size(f"band_{b}.w{s}") > 0 for b, s in constants], F.size("rest") > 0))
    found = written(found, "met")
    notices = []
    for (license_, notice), shingles in sorted(wanted.items()):
        at = license_, notice
        windows = reduce(Column.__or__, [F.exists(F.col(f"band_{b}.w{s}"), _among(mine[at])) for (b, s), mine in constants.items() if at in mine], F.lit(False))
        alone = F.exists("rest", _among(sketches[at])) if sketches.get(at) else F.lit(False)
        entry = F.struct(F.lit(license_).alias("license"), F.lit(notice).alias("notice"), F.array(*[F.lit(x).cast("long") for x in shingles]).alias("wanted"), windows.alias("by_windows"))
        notices.append(F.when(windows | alone, entry))
    none = F.array().cast("array<struct<license:string,notice:int,wanted:array<bigint>,by_windows:boolean>>")
    return found.select("doc_id", "shingles", F.explode(F.array_compact(F.array(*notices)) if notices else none).alias("at")).select("doc_id", "shingles", "at.*")


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, percent: int = 80) -> DataFrame:
    """doc_id, license, notice, matched, total and containment, for each row of docs (doc_id, text) and notice found in it.

    A notice is found if at least `percent` in 100 of its distinct shingles occur in the text. Null and empty texts hold none.
    Repeated rows are reported as often as they occur; ties don't arise, as every notice is decided apart.
    """
    matched = candidates(docs, templates, percent).select("doc_id", "license", "notice", F.size(F.array_intersect("wanted", "shingles")).cast("long").alias("matched"), F.size("wanted").cast("long").alias("total"))
    return matched.where(100 * F.col("matched") >= percent * F.col("total")).select("doc_id", "license", "notice", "matched", "total", (F.col("matched") / F.col("total")).alias("containment"))
