"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model gives each character of a text, its words joined by one space, a
probability after the characters before it, across words.  Training counts each
character with its longest history; all lower orders, context totals, discounts
and interpolated probabilities follow by group-bys and joins sharded by n-gram.
The model is written to the shared folder in shards by the two characters before
an n-gram's last one, which all n-grams that end at a character share, so that
a character asks one shard; n-grams of one or two characters have a shard of
their own, which a task keeps.  Where a task can't hold all shards, it gathers the
n-grams of many texts and goes through the shards once for all of them.

A text's nats a character, drawn towards its language's mean as if that many
more characters (PRIOR) had been average, is held against a quantile of
held-out trusted documents of its language: documents beyond it are rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import Blocks, HashTable, give_back
from .packed import pack, unpack
from .storage import free, fresh, n_parts, small_batches, written
from .words import U, mix

#: Mark the start and the end of a text; in texts they, and U+0000, count as U+FFFD.
START, END = "\x02", "\x03"
_MARKS = str.maketrans(dict.fromkeys((START, END, "\0"), "\ufffd"))
#: Characters of an n-gram.
ORDER = 6
#: Rows of the model in a shard, about; shards that a worker holds; characters that are looked up at a time; n-grams that a task counts before it hands them on.
SHARD, HELD, SLICE, GATHERED = 1_000_000, 4, 1 << 18, 1_000_000
#: Characters whose n-grams are gathered where the model has more shards than a worker holds.
WIDE = 1 << 23
#: Bits of the number of n-grams whose nats a worker remembers.
KNOWN = 21
#: Bits of the map of trusted ids that goes to all tasks: 8 MB, whatever there are.
MARKS = 1 << 26
#: Width of the bins, in nats a character, in which quantiles are counted.
BIN = 0.001
#: Average characters that a text's mean is drawn towards; the quantile of held-out documents that are kept; nats by which a limit lies beyond it; one of this many trusted documents is held out.
PRIOR, QUANTILE, SLACK, FOLDS = 200, 0.995, 0.05, 5
#: Languages in a lookup table of a task.
LANGS = 100_000
_STEP = U(0x9FB21C651E98DF25)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that are labelled good and never bad or toxic."""
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return marks.where("doc_id is not null and q = 1 and t = 0").select("doc_id")


def plain(text: str | None) -> str:
    """The text's words, joined by one space, without marks."""
    text = " ".join((text or "").split())
    return text.translate(_MARKS) if START in text or END in text or "\0" in text else text


class Stream:
    """Texts as code points with a mark at both ends; `at` are the characters that the model gives a probability."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("".join([START + t + END for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.array([len(t) + 2 for t in texts], np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        inside = np.arange(len(self.points)) - np.repeat(first, self.sizes)
        self.at = np.flatnonzero(inside)
        self.depth = inside[self.at] + 1
        self.summed = [np.zeros(len(self.points), U)]

    def sums(self, order: int) -> list[np.ndarray]:
        """For n = 0..order, a number for the n points up to each point."""
        wide, out = self.points.astype(U) + U(1), self.summed
        for n in range(len(out) - 1, order):
            more = out[-1].copy()
            more[n:] += wide[: len(wide) - n] * U(pow(int(_STEP), n, 1 << 64))
            out.append(more)
        return out


    def keys(self, depth: np.ndarray, order: int) -> np.ndarray:
        """Of each character, the key of the n-gram of `depth` points that ends with it."""
        sums = self.sums(order)
        out = _key(sums[order][self.at], order, 0)
        for n in range(1, order):
            own = np.flatnonzero(depth == n)
            out[own] = _key(sums[n][self.at[own]], n, 0)
        return out


def _key(sums: np.ndarray, n: int, kind: int) -> np.ndarray:
    return mix(sums + U((n * 2 + kind + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _dealt(sums: np.ndarray, number: int) -> np.ndarray:
    """Shards of n-grams by the sums of the two characters before their last one."""
    return (mix(sums) % U(number)).astype(np.int32)


def _slices(texts: list[str], wide: int = 0) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > (wide or SLICE):
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _unique(key: np.ndarray, count: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys as one, with their counts' sum."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
    return key[order[first]], np.add.reduceat(count[order], first), grams[order[first]]


def _gathered(order: int):
    def rows(key: np.ndarray, count: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
        texts = np.ascontiguousarray(grams).view(f"<U{order}").ravel().tolist()
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(count)], names=["g", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = [t for t in map(plain, batch.column(0).to_pylist()) if t]
            for lo, hi in _slices(texts):
                stream = Stream(texts[lo:hi])
                depth = np.minimum(stream.depth, order)
                key, first, count = np.unique(stream.keys(depth, order), return_index=True, return_counts=True)
                depth, end, column = depth[first][:, None], stream.at[first][:, None], np.arange(order)
                grams = np.where(column < depth, stream.points[np.minimum(end - depth + 1 + column, len(stream.points) - 1)], 0).astype(np.uint32)
                held.append((key, count.astype(np.int64), grams))
                if sum(len(x[0]) for x in held) > GATHERED:
                    held = [_unique(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                    if len(held[0][0]) > GATHERED // 2:
                        yield rows(*held.pop())
        if held:
            yield rows(*_unique(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return run


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model (kind, g, v) of a column of trusted texts: kind p has the probability of g's last character after the others, kind b the weight of lower orders after the context g.

    Texts that are null or empty add nothing; without any text the model is empty.
    """
    grams = texts.mapInArrow(_gathered(order), "g string, c bigint").groupBy("g").agg(F.sum("c").alias("c"))
    grams = written(grams.withColumn("n", F.length("g")), "grams")
    levels = [grams.where(F.col("n") == order).select("g", "c")]
    for n in range(order - 1, 0, -1):  # a lower order counts the different characters before a gram; a gram at a word's start has none before it
        before = levels[0].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c"))
        levels.insert(0, written(before.unionByName(grams.where(F.col("n") == n).select("g", "c")), f"level-{n}"))
    model, lower = None, None
    for n, level in enumerate(levels, 1):
        seen = {r.c: r.k for r in level.groupBy(F.least("c", F.lit(4)).alias("c")).agg(F.count("*").alias("k")).collect()}
        k1, k2, k3, k4 = (max(seen.get(i, 0), 1) for i in (1, 2, 3, 4))
        y = k1 / (k1 + 2 * k2)
        cut = [min(max(0.05, d), i) for i, d in ((1, 1 - 2 * y * k2 / k1), (2, 2 - 3 * y * k3 / k2), (3, 3 - 4 * y * k4 / k3))]
        cut = [min(d, 0.95 * i) for i, d in enumerate(cut, 1)]
        rows = level.withColumn("ctx", F.expr(f"substring(g, 1, {n - 1})"))
        kinds = [F.sum((F.least("c", F.lit(3)) == i).cast("long")) for i in (1, 2, 3)]
        off = sum((k * F.lit(d) for k, d in zip(kinds, cut, strict=True)), F.lit(0.0))
        ctx = written(rows.groupBy("ctx").agg(F.sum("c").alias("total"), (off / F.sum("c")).alias("b")), f"contexts-{n}")
        left = F.col("c") - F.when(F.col("c") == 1, cut[0]).when(F.col("c") == 2, cut[1]).otherwise(cut[2])
        rows = rows.join(ctx, "ctx").withColumn("own", left / F.col("total"))
        if lower is None:
            size = sum(seen.values()) + 1
            rows = rows.select("g", (F.col("own") + F.col("b") / size).alias("v"))
        else:
            rows = rows.withColumn("low", F.expr("substring(g, 2)")).join(lower.select(F.col("g").alias("low"), F.col("v").alias("pl")), "low")
            rows = rows.select("g", (F.col("own") + F.col("b") * F.col("pl")).alias("v"))
        lower = written(rows, f"probabilities-{n}")
        part = lower.select(F.lit("p").alias("kind"), "g", "v").unionByName(ctx.select(F.lit("b").alias("kind"), F.col("ctx").alias("g"), F.col("b").alias("v")))
        model = part if model is None else model.unionByName(part)
    return model


class Model:
    """Shards of the model in the shared folder: the logarithms of probabilities and weights by n-gram."""

    _held: dict[tuple[str, int], tuple[HashTable, np.ndarray]] = {}
    #: Nats of n-grams that were looked up, at a place by their key: a later one takes an earlier one's place.
    _known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, path: str, number: int, order: int, letters: int):
        self.path, self.number, self.order, self.letters = path, number, order, letters

    @staticmethod
    def forget() -> None:
        """Give the worker's memory back at the end of a task: the worker may do other work next."""
        Model._held.clear()
        Model._known.clear()
        give_back()

    def shard(self, s: int) -> tuple[HashTable, np.ndarray]:
        held = Model._held
        if (self.path, s) not in held:
            while len(held) > HELD:  # the shard of short n-grams is one more
                del held[next(k for k in held if k != (self.path, self.number))]
            store, top = fs.FileSystem.from_uri(self.path)
            with store.open_input_file(f"{top}/shard-{s:06d}") as f:
                keys, values = unpack(f.read())
            held[self.path, s] = HashTable(keys, 3), values
        return held[self.path, s]

    def find(self, s: int, keys: np.ndarray) -> np.ndarray:
        """Nats of each key in a shard; NaN where it hasn't got it."""
        out = np.full(len(keys), np.nan)
        table, values = self.shard(s)
        hit, place = table.find(keys)
        out[hit] = values[place]
        return out

    def _memory(self) -> tuple[np.ndarray, np.ndarray]:
        if self.path not in Model._known:
            Model._known.clear()
            Model._known[self.path] = np.zeros(1 << KNOWN, U), np.zeros(1 << KNOWN)
        return Model._known[self.path]

    def nats(self, stream: Stream, gathered: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Nats of each character: they follow from its longest n-gram, which is looked up once, or is among the gathered."""
        key, miss, slot = self._missed(stream)
        total = self._memory()[1][slot]
        if len(miss):
            new, first, place = np.unique(key[miss], return_index=True, return_inverse=True)
            found = self.looked_up(self.asked(stream, miss[first])) if gathered is None else gathered[1][np.searchsorted(gathered[0], new)]
            total[miss] = found[place]
            if gathered is None:
                self._remember(new, found)
        return total

    def _remember(self, new: np.ndarray, found: np.ndarray) -> None:
        keys, values = self._memory()
        slot = (new >> U(64 - KNOWN)).astype(np.int64)
        keys[slot], values[slot] = new, found

    def _missed(self, stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys of the characters' longest n-grams, places of those that aren't remembered, places in memory)."""
        key = stream.keys(np.minimum(stream.depth, self.order), self.order)
        slot = (key >> U(64 - KNOWN)).astype(np.int64)
        return key, np.flatnonzero(self._memory()[0][slot] != key), slot

    def asked(self, stream: Stream, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(depth, shard, keys of the n-grams that end at, keys of those that end before) of some characters, a row for each n."""
        sums, at, depth = stream.sums(self.order), stream.at[some], stream.depth[some]
        grams = np.stack([_key(sums[n][at], n, 0) for n in range(1, self.order + 1)])
        before = np.stack([_key(sums[n - 1][at - 1], n - 1, 1) for n in range(1, self.order + 1)])
        return depth, np.where(depth > 2, _dealt(sums[min(2, self.order)][at - 1], self.number), 0), grams, before

    def looked_up(self, asked: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Nats of some characters: the longest n-gram that the model has, behind the weights of longer contexts."""
        depth, dealt, grams, before = asked
        total, open_ = np.zeros(len(depth)), np.ones(len(depth), bool)

        def back(s: int, own: np.ndarray, orders: range) -> None:
            for n in orders:
                ask = own[open_[own] & (depth[own] >= n)]
                found = self.find(s, grams[n - 1][ask])
                there = ~np.isnan(found)
                total[ask[there]] += found[there]
                open_[ask[there]] = False
                miss = ask[~there]
                total[miss] += np.nan_to_num(self.find(s, before[n - 1][miss]))

        order = np.argsort(dealt, kind="stable")
        cuts = np.searchsorted(dealt[order], np.arange(self.number + 1))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        held = [s for s in some if (self.path, s) in Model._held]
        for s in [*held, *[s for s in some if s not in held]]:  # what is held comes first
            back(s, order[cuts[s] : cuts[s + 1]], range(self.order, 2, -1))
        back(self.number, np.flatnonzero(open_), range(min(2, self.order), 0, -1))
        total[open_] += np.log(self.letters)
        return total

    def gathered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keys, in order, and nats of the n-grams of many texts that aren't remembered; each shard is read once."""
        parts, last = [(np.empty(0, U), self.asked(Stream([]), np.empty(0, np.int64)))], np.zeros(1 << KNOWN, U)
        for lo, hi in _slices(texts):
            stream = Stream(texts[lo:hi])
            key, miss, slot = self._missed(stream)
            miss = miss[last[slot[miss]] != key[miss]]
            new, first = np.unique(key[miss], return_index=True)
            last[(new >> U(64 - KNOWN)).astype(np.int64)] = new
            parts.append((new, self.asked(stream, miss[first])))
        keys, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        asked = tuple(np.concatenate(x, axis=-1)[..., first] for x in zip(*[p[1] for p in parts], strict=True))
        return keys, self.looked_up(asked)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(characters with one more, nats a character) of each text; NaN without words."""
        texts = [plain(t) for t in texts]
        chars, nats = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
        some = [i for i, t in enumerate(texts) if t]
        wide = [texts[i] for i in some]
        for start, stop in _slices(wide, WIDE) if self.number > HELD else [(0, len(wide))]:
            known = self.gathered(wide[start:stop]) if self.number > HELD else None
            for lo, hi in _slices(wide[start:stop]):
                own = np.array(some[start + lo : start + hi])
                stream = Stream(wide[start + lo : start + hi])
                total = self.nats(stream, known)
                size = stream.sizes - 1
                chars[own] = size
                nats[own] = np.add.reduceat(total, np.cumsum(size) - size) / size
            if known is not None:
                self._remember(*known)
        return chars, nats


def save(model: DataFrame, order: int = ORDER) -> Model:
    """Write the model's rows as shards of about SHARD rows, and one of those that ask for fewer than two characters before the last; each shard is one task's, a repeated task writes the same file."""
    size = model.count()
    letters = model.where("kind = 'p' and length(g) = 1").count() + 1
    number, path = -(-size // SHARD) or 1, fresh(model.sparkSession, "shards")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, kinds = batch.column(1).to_pylist(), np.array([k == "b" for k in batch.column(0).to_pylist()], bool)
            points = np.array(grams or [""], f"<U{order}").view(np.uint32).reshape(-1, order)
            lengths, key, s = np.array([len(g) for g in grams], np.int64), np.empty(len(grams), U), np.full(len(grams), number, np.int32)
            for n in range(order + 1):
                for kind in (0, 1):
                    own = np.flatnonzero((lengths == n) & (kinds == kind))
                    total, ends = np.zeros(len(own), U), n - 1 + kind  # a context ends before the character
                    for j in range(n):
                        total = total * _STEP + (points[own, j].astype(U) + U(1))
                    key[own] = _key(total, n, kind)
                    if ends > 1:
                        s[own] = _dealt((points[own, ends - 2].astype(U) + U(1)) * _STEP + (points[own, ends - 1].astype(U) + U(1)), number)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(key.view(np.int64)), pa.array(-np.log(batch.column(2).to_numpy()))], names=["s", "key", "nats"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[batch.column(i).to_numpy() for i in range(3)] for batch in batches if batch.num_rows]
        if not rows:
            return
        s, key, nats = (np.concatenate(c) for c in zip(*rows, strict=True))
        order_ = np.argsort(key.view(U))
        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        trial = f"{top}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.part"
        with store.open_output_stream(trial) as f:
            f.write(pack(key.view(U)[order_], nats[order_]))
        target = f"{top}/shard-{int(s[0]):06d}"
        if store.get_file_info(target).type != fs.FileType.NotFound:
            store.delete_file(trial)
        else:
            store.move(trial, target)
        yield pa.RecordBatch.from_arrays([pa.array(s[:1]), pa.array([len(key)], pa.int64())], names=["s", "n"])

    dealt = model.select("kind", "g", "v").mapInArrow(keyed, "s int, key bigint, nats double").repartitionById(number + 1, F.col("s"))
    there = dealt.mapInArrow(kept, "s int, n bigint").count()
    if there < number + 1:  # shards without a row, as in an empty model
        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        for s in range(number + 1):
            if store.get_file_info(f"{top}/shard-{s:06d}").type == fs.FileType.NotFound:
                with store.open_output_stream(f"{top}/shard-{s:06d}") as f:
                    f.write(pack(np.empty(0, U), np.empty(0)))
    return Model(path, number, order, letters)


def scores(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id", "lang"), text_col: str = "text") -> DataFrame:
    """`keep`, n_chars, nats (a character; null without words) of every row."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, nats = model.score(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(chars), pa.array(nats, from_pandas=True)], names=[*names, "n_chars", "nats"])
        model.forget()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, n_chars bigint, nats double")


def _held_out() -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(FOLDS)) == 0


def limits(scored: DataFrame, q: float = QUANTILE) -> DataFrame:
    """lang, mean, threshold, threshold_from of scored rows (lang, n_chars, nats) of held-out trusted documents: one row a language, and one with threshold_from "all" for every other language."""
    rows = scored.where("nats is not null")
    means = rows.groupBy("lang").agg((F.sum(F.col("nats") * F.col("n_chars")) / F.sum("n_chars")).alias("mean"), F.lit("lang").alias("threshold_from"))
    whole = rows.agg((F.sum(F.col("nats") * F.col("n_chars")) / F.sum("n_chars")).alias("mean")).where("mean is not null")
    means = written(means.unionByName(whole.select(F.lit(None).cast("string").alias("lang"), "mean", F.lit("all").alias("threshold_from"))), "means")
    both = rows.select("lang", "n_chars", "nats", F.explode(F.array(F.lit("lang"), F.lit("all"))).alias("threshold_from"))
    both = both.withColumn("lang", F.when(F.col("threshold_from") == "lang", F.col("lang")))
    name = lambda t: F.concat_ws(":", t["threshold_from"], F.when(t["lang"].isNull(), "n").otherwise(F.concat(F.lit("s"), t["lang"])))
    both = both.join(means.select(name(means).alias("name"), "mean"), name(both) == F.col("name"))
    bins = both.groupBy("name", F.floor(drawn("nats", "n_chars", "mean") / BIN).alias("bin")).agg(F.count("*").alias("k"))
    order = W.partitionBy("name").orderBy("bin")
    every = F.sum("k").over(W.partitionBy("name"))
    bins = bins.withColumn("upto", F.sum("k").over(order)).withColumn("every", every)
    limit = (F.min(F.when(F.col("upto") >= F.col("every") * q, F.col("bin"))) + 1) * BIN + SLACK
    found = bins.groupBy("name").agg(limit.alias("threshold"))
    return means.withColumn("name", name(means)).join(found, "name").select("lang", "mean", "threshold", "threshold_from")


def drawn(nats: str, chars: str, mean: str) -> F.Column:
    """A text's nats a character, drawn towards the mean by PRIOR characters."""
    return (F.col(nats) * F.col(chars) + F.col(mean) * PRIOR) / (F.col(chars) + PRIOR)


def _tables(found: DataFrame) -> tuple[Blocks, tuple | None]:
    """(lookup tables by language, LANGS languages each, the limits of all others)."""
    found = written(found, "limits")
    number = -(-found.count() // LANGS) or 1
    dealt = found.where("threshold_from = 'lang'").withColumn("b", F.pmod(F.xxhash64("lang"), F.lit(number)))
    table = lambda b: {r.lang: (r.mean, r.threshold) for r in dealt.where(F.col("b") == b).collect()}
    other = found.where("threshold_from = 'all'").first()
    return Blocks(found.sparkSession.sparkContext, map(table, range(number))), other and (other.mean, other.threshold)


def _judged(batch: pa.RecordBatch, tables: Blocks, other: tuple | None) -> tuple[list, list[bool], list[str]]:
    """(limits, keep, where the limits are from) of rows with lang, the last two columns being characters and nats."""
    langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
    found: dict = {}
    for table in tables:
        found.update({x: table[x] for x in set(langs) if x in table})
    chars, nats = (c.to_pylist() for c in batch.columns[-2:])
    limit = [found.get(x, other) for x in langs]
    keep = []
    for x, n, t in zip(nats, chars, limit, strict=True):
        keep.append(x is None or t is None or (x * n + t[0] * PRIOR) / (n + PRIOR) <= t[1])
    return limit, keep, ["lang" if x in found else "all" if other else "none" for x in langs]


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of (doc_id, text) whose doc_id is among `ids`.

    A map of MARKS bits by the ids' hashes drops nearly all others, unless the
    ids are about as many as bits; only what is left is shuffled to be joined.
    """
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)) + 1
    bits = ids.select(mark.alias("mark")).groupBy(F.bitmap_bucket_number("mark").alias("bucket"))
    bits = written(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits")), "trusted-bits")
    rows = docs.select("doc_id", "text", F.bitmap_bucket_number(mark).alias("bucket"), F.bitmap_bit_position(mark).alias("at"))
    rows = rows.join(F.broadcast(bits), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    rows = rows.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0)
    return rows.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")


def fitted(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> tuple[Model, DataFrame]:
    """(the model of the trusted documents that aren't held out, ids of those that are)."""
    trusted = written(trusted_ids(labels), "trusted")
    texts = _chosen(small_batches(docs), trusted.where(~_held_out())).select("text")
    texts = texts.coalesce(-(-n_parts(docs.sparkSession) // 2))  # larger tasks hand on fewer counts
    return save(train(texts, order), order), trusted.where(_held_out())


def _scored(docs: DataFrame, labels: DataFrame, order: int, q: float, keep: list[str]) -> tuple[DataFrame, Blocks, tuple | None]:
    """`keep`, then characters and nats of all rows, scored once and written, and the limits from the held-out ones among them."""
    model, held = fitted(docs, labels, order)
    n_chars, nats_ = free(keep, "__n_chars", "__nats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, nats = model.score(batch.column(batch.schema.get_field_index("text")).to_pylist())
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(chars), pa.array(nats, from_pandas=True)], names=[*keep, n_chars, nats_])
        model.forget()

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    rows = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}`{n_chars}` bigint, `{nats_}` double")
    rows = written(rows, "scores")
    known = rows.select("doc_id", "lang", F.col(n_chars).alias("n_chars"), F.col(nats_).alias("nats")).join(held, "doc_id", "left_semi")
    return rows, *_tables(limits(known, q))


def classify(docs: DataFrame, labels: DataFrame, *, order: int = ORDER, q: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity (a character), threshold, threshold_from, keep for every row of `docs`.

    Trained on the documents that are labelled good and not toxic, but for one
    in FOLDS by a hash of its id; these give the limits.  A row is kept unless
    its perplexity, drawn towards the language's, is beyond its language's
    threshold.  threshold_from says whose it is: "lang", or "all" languages' where
    none of its own is held out, or "none".  Rows without words, and all rows
    where no document is trusted, are kept.  A null language is a language;
    rows with equal or null ids are scored by themselves; a text of any length
    is scored whole; only doc_id, lang and text are read.
    """
    rows, tables, other = _scored(docs, labels, order, q, ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit, keep, source = _judged(batch, tables, other)
            ends = pa.array([t and t[1] for t in limit], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ends, pa.array(source, pa.string()), pa.array(keep, pa.bool_())], names=["doc_id", "lang", "n_chars", "nats", "threshold", "threshold_from", "keep"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {ids}, lang string, n_chars bigint, nats double, threshold double, threshold_from string, keep boolean")
    return out.select("doc_id", "lang", "n_chars", F.exp("nats").alias("perplexity"), F.exp("threshold").alias("threshold"), "threshold_from", "keep")


def accepted(docs: DataFrame, labels: DataFrame, *, order: int = ORDER, q: float = QUANTILE) -> DataFrame:
    """The rows of `docs`, all columns of whatever names, that `classify` keeps; scored once and written with their scores, so no text is shuffled for it.

    Nulls, empty texts, repeated rows and empty tables count as `classify` says.
    """
    names = docs.columns
    rows, tables, other = _scored(docs, labels, order, q, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_judged(batch, tables, other)[1], pa.bool_()))
            yield kept.select(names)

    return rows.mapInArrow(run, docs.schema)
