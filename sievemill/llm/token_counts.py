"""Token counts by a compiled finite-state transducer.

A BPE vocabulary without cross-word pieces is compiled, arc by arc as texts ask
for them, into a deterministic transducer: its state is what the last characters
of the word so far can still change, its arcs carry the change of the token
count.  Whole words become single arcs from the word-start state back to it.

Why a state suffices: the encoding of a prefix is the encoding of the text up to
its last token, plus that token, and a token may follow another exactly if the
pair, encoded alone, stays that pair.  So the transducer keeps, for each place
within reach of a piece, the last token there and the count relative to now.

A text is cut into chunks at any character.  A chunk's state map says for any
state before it which state follows and how many tokens come out.  It is made
without knowing that state: the chunk's head, up to its first word start, is run
from the word-start state; what follows the head depends on nothing before it.
Applied to another state, the head is run from both until the two states are
equal, mostly after some characters, and the rest is taken from the map.  Maps
compose associatively, so chunks are mapped independently and joined by a tree
(prefix scan); very long texts are cut into chunks that other tasks map.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches, written

#: Whole-word arcs that a worker keeps; when full the short ones stay, and counts are the same.
REMEMBERED = 300_000
#: Compiled states, and pairs of tokens, that a worker keeps.
STATES, PAIRS = 150_000, 250_000
#: Characters of a chunk; of a piece of a longer text, which is a row by itself.
CHUNK, PIECE = 1 << 12, 1 << 20
_SPACE = "▁"
#: A state: the last characters that later ones can still change, and for each place in them the token before it and the count relative to now.
Shape = tuple[str, tuple]
_START: Shape = ("", ((None, 0),))


class StateMap(NamedTuple):
    """What a stretch of text does to any state: `head` is run from it; `after` and `ahead` are the state and count of the head from the word-start state.

    exit and count: the state after the rest and the tokens of the rest, which
    begins with a word; exit None: there is no rest.
    """

    head: str
    after: Shape
    ahead: int
    exit: Shape | None
    count: int


class Transducer:
    """Counts the tokens of words under a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        plain = norm.name == "identity" and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        own = any(p.type == 4 for p in model.pieces)
        crossing = any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        if trained.model_type != 2 or not trained.byte_fallback or not plain or own or crossing or trained.treat_whitespace_as_suffix:
            raise ValueError("this model can't be compiled: it isn't BPE with byte fallback, or it normalizes, or its pieces cross words")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.score = pieces
        names = list(pieces)
        library = SentencePieceProcessor(model_file=path)
        #: Pieces that ever come out, with their length in characters.
        self.pieces = {p for p in names if len(p) == 1 or self._merged(p) == (p,)}
        self.halves: dict[str, tuple[str, str]] = {p: self._last_merge(p) for p in self.pieces if len(p) > 1}
        #: Pieces with a part that merges after them or as they do; their pairs are merged by the definition.
        self.odd: set[str] = set()
        for p in sorted(self.halves, key=len):
            if any(h in self.odd or (len(h) > 1 and (h not in self.halves or self.score[h] <= self.score[p])) for h in self.halves[p]):
                self.odd.add(p)
        self.starts = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.longest = max(map(len, names))
        self.library = library
        self.fits: dict[tuple[str, str], bool] = {}
        self.states: dict[Shape, int] = {_START: 0}
        self.shapes: list[Shape] = [_START]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.words: dict[str, int] = {}

    def _last_merge(self, piece: str) -> tuple[str, str]:
        left, right = self._merged(piece, 2)
        return left, right

    def _merged(self, text: str, until: int = 1) -> tuple[str, ...]:
        """The merges of the definition, best score first, leftmost first; only compiling uses it."""
        parts, score = list(text), self.score
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return tuple(parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def _follows(self, before: str | None, token: str) -> bool:
        if before is None:
            return True
        key = (before, token)
        if (found := self.fits.get(key)) is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            found = self.fits[key] = self._merged(before + token) == key if before in self.odd or token in self.odd else self._pair(before, token)
        return found

    def _pair(self, x: str, y: str) -> bool:
        """Whether no merge crosses from x to y: their last merges are undone, latest first, and each pair of neighbours is tried."""
        score, halves, worst = self.score, self.halves, float("-inf")
        if score.get(x + y) is not None:
            return False
        while True:
            a = score[x] if len(x) > 1 else None
            b = score[y] if len(y) > 1 else None
            if a is None and b is None:
                return True
            if b is None or (a is not None and a < b):
                x = halves[x][1]
                if score.get(x + y, worst) > a:
                    return False
            else:
                y = halves[y][0]
                if score.get(x + y, worst) >= b:
                    return False

    def _next(self, shape: tuple, char: str) -> tuple[tuple, int]:
        """The state after `char`, and the change of the count."""
        tail, places = shape
        tail += char
        n = len(tail)
        token, count = char, None
        for k in range(n):
            piece = tail[k:]
            if piece in self.pieces and self._follows(places[k][0], piece):
                token, count = piece, places[k][1] + 1
                break
        if count is None:  # a character without a piece becomes its bytes
            count = places[n - 1][1] + len(char.encode())
        starts = self.starts  # a place counts only while a piece that starts there can still end
        for k in range(n + 1):
            if k == n or tail[k:] in starts:
                break
        kept = tuple((places[j][0], places[j][1] - count) if tail[j:] in starts else None for j in range(k, n))
        return (tail[k:], (*kept, (token, 0))), count

    def _arc(self, state: int, char: str) -> tuple[int, int]:
        """Compile the arc of `char` out of `state`: (next state, change of the count)."""
        shape, count = self._next(self.shapes[state], char)
        if (to := self.states.get(shape)) is None:
            to = self.states[shape] = len(self.shapes)
            self.shapes.append(shape)
            self.arcs.append({})
        found = self.arcs[state][char] = (to, count)
        return found

    def run(self, word: str) -> int:
        """Tokens of one word (white space escaped): along compiled arcs as far as they go, then one more is compiled.

        The rest of the word takes the same steps without keeping them, so
        beginnings that many words share are compiled and rare ends aren't.
        """
        state = count = at = 0
        arcs = self.arcs
        for char in word:
            arc = arcs[state].get(char)
            if arc is None:
                break
            state, step = arc
            count += step
            at += 1
        else:
            return count
        state, step = self._arc(state, word[at])
        count += step
        shape = self.shapes[state]
        for char in word[at + 1 :]:
            shape, step = self._next(shape, char)
            count += step
        return count

    def word(self, word: str) -> int:
        """Tokens of the escape sign and the word after it; the arc from word start to word start."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > REMEMBERED:
                self.words = {w: n for w, n in self.words.items() if len(w) < 8}
                if len(self.words) > REMEMBERED * 0.7:
                    self.words = {}
            if len(self.shapes) > STATES:
                del self.shapes[1:], self.arcs[1:]
                self.states, self.arcs[0] = {self.shapes[0]: 0}, {}
            found = self.words[word] = self.run(_SPACE + word)
        return found

    def closed(self, body: str) -> int:
        """Tokens of whole words; body starts with the escape sign and ends before one, or with the text."""
        if not body:
            return 0
        parts = body.split(_SPACE)
        del parts[0]
        if "" in parts:  # runs of spaces belong to the word after them
            return sum(map(self.run, re.findall(f"{_SPACE}+[^{_SPACE}]*", body)))
        try:
            return sum(map(self.words.__getitem__, parts))
        except KeyError:
            return sum(map(self.word, parts))

    def drive(self, shape: Shape, text: str) -> tuple[Shape, int]:
        """(state, tokens) after `text` from a state."""
        count, following = 0, self._next
        for char in text:
            shape, step = following(shape, char)
            count += step
        return shape, count

    def state_map(self, chunk: str) -> StateMap:
        """The map of one chunk of escaped text; a word starts at an escape sign that follows another character."""
        start = _FIRST.search(chunk)
        if start is None:
            return StateMap(chunk, *self.drive(_START, chunk), None, 0)
        head, last = chunk[: start.start() + 1], _LAST.search(chunk).start(1)
        whole = self.closed(chunk[len(head) : last])
        exit_, open_ = self.drive(_START, chunk[last:])
        return StateMap(head, *self.drive(_START, head), exit_, whole + open_)

    def apply(self, m: StateMap, shape: Shape) -> tuple[Shape, int]:
        """(state, tokens) after the map's text from a state."""
        if shape == _START:
            after, count = m.after, m.ahead
        else:
            other, own, count, ahead, after = shape, _START, 0, 0, None
            for char in m.head:
                if other == own:
                    after, count = m.after, count + m.ahead - ahead
                    break
                other, step = self._next(other, char)
                count += step
                own, step = self._next(own, char)
                ahead += step
            after = after or other
        return (after, count) if m.exit is None else (m.exit, count + m.count)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of a's text followed by b's; associative."""
        if a.exit is None and b.exit is None:
            after, more = self.apply(b, a.after)
            return StateMap(a.head + b.head, after, a.ahead + more, None, 0)
        if a.exit is None:
            after, more = self.apply(b._replace(exit=None), a.after)
            return StateMap(a.head + b.head, after, a.ahead + more, b.exit, b.count)
        exit_, more = self.apply(b, a.exit)
        return StateMap(a.head, a.after, a.ahead, exit_, a.count + more)

    def combined(self, maps: list[StateMap]) -> StateMap:
        """All maps in order, composed by a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def scan(self, chunks: list[str]) -> int:
        """Tokens of the text that the chunks make up."""
        return self.apply(self.combined([self.state_map(c) for c in chunks]), _START)[1]

    def escaped(self, text: str) -> str:
        """The text as the model takes it."""
        return (self.prefix + text).replace(" ", _SPACE) if text else ""

    def count(self, text: str, size: int = CHUNK) -> int:
        """Tokens of the whole text, as the library gives them."""
        text = self.escaped(text)
        return self.scan([text[i : i + size] for i in range(0, len(text), size)]) if text else 0


#: The character before the first word start, and the last word start, of a chunk.
_FIRST, _LAST = re.compile(f"[^{_SPACE}](?={_SPACE})"), re.compile(f"(?s:.*)[^{_SPACE}]({_SPACE})")
_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """This worker's transducer for the model; tasks that follow find its arcs again."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    Rows are counted where they are read.  A text of more than PIECE characters
    is dealt to tasks in pieces, whose state maps are composed in order.  A null
    text counts as empty (0 tokens); repeated rows are each counted; other
    columns of `docs` are not read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in batches:
            tokens = [transducer.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in batches:
            out = []
            for place, text in zip(batch.column("place").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                text = transducer.escaped(text) if place == 0 else text.replace(" ", _SPACE)
                maps = [transducer.state_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
                out.append(pickle.dumps(transducer.combined(maps)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_bytes", "place")), pa.array(out, pa.binary())], names=["row", "doc_id", "n_bytes", "place", "map"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, last, ids, state, total = compiled(model), None, None, _START, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([ids[0]], pa.int64()), pa.array([ids[1]], pa.int64()), pa.array([total], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        for batch in batches:
            for r in batch.to_pylist():
                if r["row"] != last:
                    if ids:
                        yield row()
                    last, ids, state, total = r["row"], (r["doc_id"], r["n_bytes"]), _START, 0
                state, more = transducer.apply(pickle.loads(r["map"]), state)
                total += more
        if ids:
            yield row()

    kinds = "doc_id bigint, n_bytes bigint, n_tokens bigint"
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    many = F.col("n_bytes") > PIECE  # a text of so many characters has more bytes
    out = rows.where(~many).mapInArrow(counted, kinds)
    pieces = rows.where(many).withColumn("row", F.monotonically_increasing_id())
    pieces = pieces.withColumn("place", F.explode(F.sequence(F.lit(0), F.expr(f"(char_length(text) - 1) div {PIECE}"))))
    pieces = pieces.select("row", "doc_id", "n_bytes", "place", F.expr(f"substring(text, cast(place * {PIECE} + 1 as int), {PIECE})").alias("piece"))
    pieces = written(pieces, "pieces")  # a row's number is fixed here
    maps = pieces.repartition("row", "place").mapInArrow(mapped, "row bigint, doc_id bigint, n_bytes bigint, place bigint, map binary")
    long = maps.repartition("row").sortWithinPartitions("row", "place").mapInArrow(joined, kinds)
    return out.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("doc_id", id_col)
