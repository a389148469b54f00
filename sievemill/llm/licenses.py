"""License scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

Units are the whole text (licence files), its blocks between lines without words,
its lines (headers), its sentences, also cut at line ends, and runs of as many
sentences as a template has.  The product of a unit with a template is a sum
over its words, so it follows for all units at once from running sums.  A unit
can reach the wanted similarity with a template only if it has one of the
template's heaviest terms, those whose absence leaves less than that share of
its norm, and if the product suffices for a unit in which no word occurs twice
and every word that is in no template weighs the least there is, 1.  Of these,
units whose counted terms don't suffice are dropped.

All words of the remaining units are weighed by their document frequencies in
all texts: the spans are written with their other words, these are counted in
all texts behind a bitmap of a fixed size, and the counts are joined to them.

A text of which notices make up half is a licence file of its directory.  Files
without a notice of their own take that of the nearest directory above.
Directories, not files, are joined to their ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import HashTable
from .packed import pack, unpack
from .storage import n_parts, small_batches, written
from .words import ALNUM, SPACED, U, Words, buffers, slices, split

#: Bits, as a power of two, of the map of words that are counted: 8 MB, whatever there are; word counts that a task holds.
MARKS, HELD = 26, 2_000_000
#: Entries of a table of units and terms.
TABLE = 1 << 21
#: Sentences end at one of these bytes before white space or a closing sign.
_STOP = np.isin(np.arange(256), list(b".!?"))
_AFTER = ~SPACED | np.isin(np.arange(256), list(b"\"')]"))

#: File names of licence files, whatever share of them is a notice.
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
#: Common notices, and the short licences in full, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def _texts(values: list[str]) -> Words:
    data, at = buffers(pa.array(values, pa.large_string()))
    return split(data, at, ALNUM)


def _parts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, block, sentence) of each word by rising numbers; a line without words ends a block, a block ends a sentence."""
    line = np.searchsorted(np.flatnonzero(words.low == 10), words.start)
    block = np.cumsum(np.diff(line, prepend=line[:1]) > 1)
    stops = np.searchsorted(np.flatnonzero(_STOP[words.low[:-1]] & _AFTER[words.low[1:]]), words.start)
    return line, block, stops + block


class Weights:
    """Templates as unit vectors of hashed terms: `vectors` has a row a template and a column a term."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names = [name for name in sorted(templates) for _ in templates[name]]
        words = _texts([t for name in sorted(templates) for t in templates[name]])
        self.terms = HashTable(words.hashes())
        term = np.searchsorted(self.terms.keys, words.hashes())
        size = len(self.terms.keys)
        self.counts = np.bincount(words.owner() * size + term, minlength=len(self.names) * size).reshape(-1, size)
        sentence = _parts(words)[2]
        self.runs = sorted({len(np.unique(sentence[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)} - {0, 1})

    def fit(self, df: np.ndarray, n: int, least: float) -> None:
        """df: texts with each term; n: all texts; least: the wanted similarity."""
        self.weight = np.log((1 + n) / (1 + df)) + 1
        v = self.counts * self.weight
        self.vectors = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        heavy = np.argsort(-self.vectors, axis=1, kind="stable")
        share = np.take_along_axis(self.vectors, heavy, axis=1) ** 2
        rest = 1 - np.cumsum(share, axis=1) + share  # before each term
        self.keys = np.zeros(v.shape, bool)
        np.put_along_axis(self.keys, heavy, (rest >= least * least - 1e-9) & (share > 0), axis=1)

    def possible(self, at: np.ndarray, term: np.ndarray, n: int, start: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
        """Which units (start, end) of n words can reach `least`; the words `at` are template terms."""
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
        run = lambda x: np.append(0, np.cumsum(x))
        square = run(self.weight[term] ** 2)
        norm = np.sqrt(square[hi] - square[lo] + (end - start) - (hi - lo))
        may = np.zeros(len(start), bool)
        for vector, key in zip(self.vectors, self.keys, strict=True):
            product, held = run((vector * self.weight)[term]), run(key[term])
            may |= (held[hi] > held[lo]) & (product[hi] - product[lo] >= norm * (least - 1e-6))
        return may

    def products(self, at: np.ndarray, term: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(greatest product with a template, the first template that has it, squared norm of the template terms) of each unit."""
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
        best, template, square = np.zeros(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start))
        size = len(self.weight)
        for i in range(0, len(start), step := max(1, TABLE // size)):
            n = hi[i : i + step] - lo[i : i + step]
            unit = np.repeat(np.arange(len(n)), n)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[i : i + step], n)
            u = np.bincount(unit * size + term[place], minlength=len(n) * size).reshape(-1, size) * self.weight
            found = np.round(u @ self.vectors.T, 9)
            template[i : i + step] = found.argmax(axis=1)
            best[i : i + step] = found.max(axis=1)
            square[i : i + step] = (u * u).sum(axis=1)
        return best, template, square


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*held, strict=True))
    h, place = np.unique(h, return_inverse=True)
    return h, np.bincount(place, n, len(h)).astype(np.int64)


def _counted(keep: np.ndarray, bits: int, parts: int):
    """(text) -> (part, body): texts of the task with each word whose high bits are in the map `keep`, a value for each part of the words; part -1 has the number of texts."""

    def rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = (h % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        made = [(j, pack(h[own], n[own])) for j in np.flatnonzero(np.diff(cuts)).tolist() for own in [order[cuts[j] : cuts[j + 1]]]]
        return row(made)

    def row(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([j for j, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], names=["part", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        texts = 0
        for batch in batches:
            texts += batch.num_rows
            data, at = buffers(batch.column(0))
            for lo, hi in slices(at):
                words = split(data, at[lo : hi + 1], ALNUM)
                h, owner = words.hashes(), words.owner()
                some = keep[(h >> U(64 - bits)).astype(np.int64)]
                h, owner = h[some], owner[some]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                held.append(np.unique(h[first], return_counts=True))
                if sum(len(x) for x, _ in held) > HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(*held.pop())
        if held:
            yield rows(*_merged(held))
        yield row([(-1, pack(np.zeros(1, U), np.array([texts], np.int64)))])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_counted`, a part's together -> (h, n); h null has the number of texts."""
    last, held = None, []

    def out() -> pa.RecordBatch:
        h, n = _merged(held)
        return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()) if last < 0 else pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    for batch in batches:
        for part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and part != last:
                yield out()
                held = []
            last = part
            held.append(tuple(unpack(body)))
            if sum(len(x) for x, _ in held) > HELD:
                held = [_merged(held)]
    if held:
        yield out()


def _frequencies(files: DataFrame, marks: np.ndarray, bits: int = MARKS) -> DataFrame:
    """(h, n): texts with each word whose high bits are marked; h null has the number of texts."""
    packed = files.select("text").mapInArrow(_counted(marks, bits, n_parts(files.sparkSession)), "part int, body binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(_added, "h bigint, n bigint")


def _units(weights: Weights, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of all units of all texts, each once."""
    n, owner = len(words.start), words.owner()
    line, block, sentence = _parts(words)
    edge = np.ones(n + 1, bool)
    edge[1:n] = owner[1:] != owner[:-1]

    def cuts(*ids: np.ndarray) -> np.ndarray:
        new = edge.copy()
        for x in ids:
            new[1:n] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    found = [(at[:-1], at[1:]) for at in (cuts(), cuts(line), cuts(block), cuts(line, sentence))]
    at = cuts(sentence)
    for k in (1, *weights.runs):
        start, end = at[:-k], at[k:]
        whole = (owner[start] == owner[end - 1]) & (block[start] == block[end - 1])
        found.append((start[whole], end[whole]))
    pairs = np.unique(np.concatenate([s * (n + 1) + e for s, e in found]))
    return pairs // (n + 1), pairs % (n + 1)


UNIT = pa.struct([("first", pa.int64()), ("past", pa.int64()), ("template", pa.int32()), ("product", pa.float64()), ("square", pa.float64()), ("others", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_UNITS = "array<struct<first: bigint, past: bigint, template: int, product: double, square: double, others: array<bigint>, counts: array<bigint>>>"


def _spans(weights: Weights, least: float):
    """(text, further columns) -> the further columns, row (a number of its own), n_words and units: those that can reach `least`, with their words that are in no template."""

    def units(words: Words) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
        h = words.hashes()
        at, term = weights.terms.find(h)
        if not len(at):
            return out
        start, end = _units(weights, words)
        may = weights.possible(at, term, len(h), start, end, least)
        start, end = start[may], end[may]
        best, template, square = weights.products(at, term, start, end)
        other = np.ones(len(h), bool)
        other[at] = False
        number = np.append(0, np.cumsum(other))
        may = best >= np.sqrt(square + number[end] - number[start]) * (least - 1e-6)
        for s, e, t, p, q in zip(start[may].tolist(), end[may].tolist(), template[may].tolist(), best[may].tolist(), square[may].tolist(), strict=True):
            words_, counts = np.unique(h[s:e][other[s:e]], return_counts=True)
            if p >= np.sqrt(q + (counts * counts).sum()) * (least - 1e-6):
                d = int(np.searchsorted(words.first, s, "right")) - 1
                base = int(words.first[d])
                out[d].append({"first": s - base, "past": e - base, "template": t, "product": p, "square": q, "others": words_.view(np.int64), "counts": counts})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, at = buffers(batch.column(0))
            found, sizes = [], []
            for lo, hi in slices(at):
                words = split(data, at[lo : hi + 1], ALNUM)
                found += units(words)
                sizes.append(np.diff(words.first))
            own = [pa.array(row + np.arange(batch.num_rows)), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(found, pa.list_(UNIT))]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], names=[*batch.schema.names[1:], "row", "n_words", "units"])

    return run


def _covered() -> F.Column:
    """How many words lie in some of the spans (first, past) of a sorted array."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["past"] - F.greatest(a["upto"], x["first"]))).alias("n"), F.greatest(a["upto"], x["past"]).alias("upto"))
    return F.aggregate("spans", start, step, lambda a: a["n"])


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, `keep`, license, similarity, share of every row of `files` (path, text): the best template of any unit, null below `least`; share of the words that is in notices."""
    weights = Weights(templates or TEMPLATES)
    spark, files = files.sparkSession, small_batches(files)
    bits = 16
    mark = np.zeros(1 << bits, bool)
    mark[(weights.terms.keys >> U(64 - bits)).astype(np.int64)] = True
    own = spark.createDataFrame([(int(x),) for x in weights.terms.keys.view(np.int64)], "h long")
    known = _frequencies(files, mark, bits).join(F.broadcast(own.withColumn("own", F.lit(True))), "h", "left").where("own or h is null")
    known = {r.h: r.n for r in known.select("h", "n").collect()}  # one number for each term of the templates
    n = known.get(None, 0)
    weights.fit(np.array([known.get(int(x), 0) for x in weights.terms.keys.view(np.int64)]), n, least)

    kinds = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in keep)
    rows = files.select("text", "path", *keep).mapInArrow(_spans(weights, least), f"path string, {kinds}row bigint, n_words bigint, units {_UNITS}")
    rows = written(rows, "spans")
    units = rows.select("row", F.posexplode("units").alias("unit", "u")).select("row", "unit", "u.*")
    words = units.select("row", "unit", F.explode(F.arrays_zip("others", "counts")).alias("w")).select("row", "unit", F.col("w.others").alias("h"), F.col("w.counts").alias("c"))
    wanted = written(words.select("h").distinct(), "wanted")
    place = F.shiftrightunsigned("h", 64 - MARKS) + 1
    bitmap = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    mark = np.zeros(1 << MARKS, bool)
    for r in bitmap.collect():  # at most 1 << MARKS bits
        some = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little").astype(bool)
        low = (r.bucket - 1) * len(some)
        mark[low : low + len(some)] = some[: len(mark) - low]
    df = written(_frequencies(files, mark).join(wanted, "h", "left_semi"), "frequencies")
    weight = F.log((F.lit(n) + 1) / (F.col("n") + 1)) + 1
    norms = words.join(df, "h").groupBy("row", "unit").agg(F.sum((F.col("c") * weight) ** 2).alias("rest"))
    units = units.join(norms, ["row", "unit"], "left").withColumn("similarity", F.round(F.col("product") / F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0))), 6))
    units = units.where(F.col("similarity") >= least)
    found = units.groupBy("row").agg(F.max(F.struct("similarity", (-F.col("template")).alias("t"))).alias("best"), F.array_sort(F.collect_list(F.struct("first", "past"))).alias("spans"))
    found = written(found.select("row", "best", _covered().alias("covered")), "notices")
    names = F.array(*[F.lit(x) for x in weights.names])
    out = rows.join(found, "row", "left")
    share = F.coalesce(F.col("covered") / F.col("n_words"), F.lit(0.0))
    return out.select("path", *keep, F.get(names, -F.col("best.t")).alias("license"), F.col("best.similarity").alias("similarity"), share.alias("share"))


def licenses(files: DataFrame, *, templates: dict[str, list[str]] | None = None, least: float = 0.7, whole: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, `keep`, license, similarity, inherited, inherited_from, effective for every row of `files`.

    inherited and inherited_from are the licence and path of the licence file
    (named LICENSE, COPYING or NOTICE with a notice in it, or notices make up
    `whole` of it or more; the most similar, then the first by path) in the nearest directory above; effective is license, else inherited.
    Null and empty texts have no notice; a null path has no directory and
    inherits nothing; repeated rows are each returned; columns other than path,
    text and `keep` (of names that the result doesn't use) are not read.  A
    directory of very many files is split by adaptive execution.
    """
    taken = {"path", "license", "similarity", "share", "folder", "inherited", "inherited_from", "effective", "row", "n_words", "units", "best", "covered"} & set(keep)
    if taken:
        raise ValueError(f"column names in use: {sorted(taken)}")
    rows = scan(files, templates, least, keep)
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), "")
    rows = written(rows.withColumn("folder", folder), "scanned")
    own = rows.where(F.col("license").isNotNull() & ((F.col("share") >= whole) | F.col("path").rlike(_NAMED)) & F.col("folder").isNotNull())
    best = own.groupBy("folder").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("best"))
    best = written(best.select(F.col("folder").alias("above"), F.col("best.license").alias("inherited"), F.col("best.path").alias("inherited_from")), "licence-files")
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = rows.where("folder is not null").select("folder").distinct().withColumn("above", F.explode(F.array_distinct(F.concat(ups, F.array("folder")))))
    near = folders.join(best, "above").groupBy("folder").agg(F.max_by(F.struct("inherited", "inherited_from"), F.length("above")).alias("near"))
    near = written(near.select("folder", "near.inherited", "near.inherited_from"), "inherited")
    out = rows.join(near, "folder", "left")
    return out.select("path", *keep, "license", "similarity", "inherited", "inherited_from", F.coalesce("license", "inherited").alias("effective"))
