"""Scoring texts with a class-based bigram model.

The probability of a token is that of its class after the class before it, times that of the word within its class. Classes come from exchange
clustering: every unit in turn moves to the class that raises the likelihood of the class bigrams most, until hardly any moves.

Counts cover the whole corpus: words are counted per task and summed by a shuffle, so are bigrams. Every word of the vocabulary gets a class by exchange:

1. Seed. Units are the ``core`` most frequent words, each by itself, and the others by their last three bytes (the ``endings`` that cover most tokens, and
   one for the rest). The driver clusters their bigram table, whose size is bounded by parameters. Words start in the class of their unit.
2. Frequent words (at most ``head``, found by a threshold on the count) move in ``rounds`` over the corpus, written once as word numbers: Spark sums
   each word's neighbours by class, and each word goes where it raises the likelihood most, with itself taken out. All move at once, so a round that
   lowers the likelihood is taken back and the next ones move every other word. It ends when hardly any move.
3. All rarer words, however many, are grouped by word with their neighbours' classes and move the same way, once; their own small share of the table is taken out
   of the class they leave, and neighbours that are rare themselves count with the class they started in. The classes' bigrams are then counted anew.

Unseen words have the class of their ending. Emission probabilities use each
word's own count. Unseen words share a class's mass of words seen once, as one event per class; all probabilities sum to one.

Scoring needs the count and class of every word of every text. The most frequent words are
broadcast; occurrences of rarer words are summed per text and neighbours' classes and joined with the vocabulary, and pairs of neighbouring rare words are joined on both sides.
No rare word has many rows, so that join has no hot key.

Tokens: words without white space, A to Z lower-cased, then one end token. Defined results: a null text is empty and has its end token. Rows that
repeat an id are scored and counted each. Rows without an id are scored, not learned from. Without training rows every token is unknown; scores stay finite.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from veilframe.llm.common import slices, text_or_empty, tidy
from veilframe.session import materialize

END = b""
CHUNK_BYTES = 1 << 21
COUNTED_WORDS = 1 << 19
LONGEST_HEAD_WORD = 64
BLOCK_WORDS = 512
PAGE_WORDS = 1 << 16


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, the number of each token among them, and how many tokens each text has.

    Bytes are cut, and words told apart, for all texts at once, without an object per token.
    """
    raw = texts.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    body = raw.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]) if bounds[-1] > bounds[0] else b""
    signs, bounds = np.frombuffer(bytes(body).lower(), np.uint8), bounds - bounds[0]
    # White space is what bytes.split() cuts at: 0x09 to 0x0D, and the blank.
    inside = (signs != 32) & ((signs - np.uint8(9)) > 4)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[edges] = inside[edges]
    kept = signs[inside]
    cuts = np.append(np.flatnonzero(begins[inside]), len(kept))
    # Each text's end token is an empty word after its last one.
    ends = np.searchsorted(np.flatnonzero(begins), bounds[1:])
    offsets = np.append(np.insert(cuts[:-1], ends, cuts[ends]), len(kept)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.diff(ends, prepend=0) + 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Rows of bounded text together, with their tokens as ``_coded`` gives them; a longer text comes alone."""
    for batch in batches:
        for part in (batch.slice(*s) for s in slices(batch.column("text"), CHUNK_BYTES)):
            yield part, *_coded(part.column("text"))


def _listed(words: pa.Array) -> list[bytes]:
    """Values of an array; unlike to_pylist() it makes no scalar object for each of them."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words: those of chunks are summed whenever they come to twice the bound, and let out if more than the bound are left."""
    waiting: list[pa.RecordBatch] = []
    summed = lambda: pa.Table.from_batches(waiting).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
    for _, distinct, used, _ in _chunks(batches):
        waiting.append(pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(used))], names=["word", "n"]))
        if sum(map(len, waiting)) > 2 * COUNTED_WORDS:
            waiting = summed().select(["word", "n"]).to_batches()
            if sum(map(len, waiting)) > COUNTED_WORDS:
                yield from waiting
                waiting = []
    if waiting:
        yield from summed().select(["word", "n"]).to_batches()


class Units(dict):
    """Words to unit numbers: the end token 0, core words, endings, and the rest last. Remembers what it has worked out, up to a bound.

    Numbers from ``number`` on stand for the classes themselves: on the driver, ``placed`` tells the class of each word of the vocabulary. Copies in
    tasks go without it.
    """

    def __init__(self, core: list[bytes], endings: list[bytes], placed: Callable[[bytes], int | None] | None = None):
        super().__init__()
        self.core = {END: 0} | {w: i for i, w in enumerate(core, start=1)}
        self.endings = {e: i for i, e in enumerate(endings, start=len(core) + 1)}
        self.number = len(core) + len(endings) + 2
        self.placed = placed

    def __missing__(self, word: bytes) -> int:
        if len(self) > COUNTED_WORDS:
            self.clear()
        unit = self.core.get(word)
        if unit is None:
            unit = self.endings.get(word[-3:], self.number - 1)
        if self.placed and (own := self.placed(word)) is not None:
            unit = self.number + own
        self[word] = unit
        return unit

    def of_rest(self, words: list[bytes]) -> list[int]:
        """Units of words that aren't in the core, and of which nothing else is known."""
        last = self.number - 1
        return [self.endings.get(w[-3:], last) for w in words]

    def __reduce__(self):
        core, endings = ([k for k, _ in sorted(d.items(), key=lambda x: x[1])] for d in (self.core, self.endings))
        return Units, (core[1:], endings)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """What exchange clustering raises: the part of the log likelihood that depends on the classes."""
    return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())


def better_classes(table: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Per word the class that raises the likelihood most, the word itself taken out of ``table`` first, all others where they are.

    ``right``, ``left``: per word and class, the words after and before it; ``twice``: how often it follows itself.
    """
    out, classes = own.copy(), np.arange(len(table))
    for at in range(0, len(own), 128):
        a, s = own[at : at + 128], twice[at : at + 128].astype(float)
        w, r, l = np.arange(len(a)), right[at : at + 128].astype(float), left[at : at + 128].astype(float)
        r[w, a] -= s
        l[w, a] -= s
        rest = np.repeat(table[None].astype(float), len(a), axis=0)
        rest[w, a] -= r
        rest[w, :, a] -= l
        rest[w, a, a] -= s
        np.maximum(rest, 0, out=rest)
        now = _f(rest)
        row, column = _f(rest + r[:, None, :]) - now, _f(rest + l[:, :, None]) - now
        both = _f(rest[:, classes, classes] + r + l + s[:, None]) - now[:, classes, classes]
        gain = row.sum(axis=2) - row[:, classes, classes] + column.sum(axis=1) - column[:, classes, classes] + both
        # Neighbours' totals don't depend on where the word goes.
        for totals, more in ((rest.sum(axis=2) + l, r.sum(axis=1) + s), (rest.sum(axis=1) + r, l.sum(axis=1) + s)):
            gain -= _f(totals + more[:, None]) - _f(totals)
        gain[:, 0] = -np.inf
        moves = (r.sum(axis=1) + l.sum(axis=1) + s) > 0
        out[at : at + 128][moves] = gain.argmax(axis=1)[moves]
    return out


def better_rare_classes(table: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The same for words of few occurrences: the word is taken out only where it itself would be put, in its own class's row and column.

    Few different counts occur, so gains are looked up.
    """
    words, classes = right.shape
    total, gain, every = right.sum(axis=1), np.zeros(right.shape), np.arange(words)
    stay = np.zeros(words)
    for counts, of in ((right, table), (left, table.T)):  # ``of``: rows are the word's class
        w, c = np.nonzero(counts)
        value, which = np.unique(counts[w, c], return_inverse=True)
        more = _f(of.T[None] + value[:, None, None]) - _f(of.T)[None]  # by value, neighbour's class and own class
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        if len(w):
            gain[w[starts]] += np.add.reduceat(more[which, c], starts)
        here = of[own[w], c]
        stay += np.bincount(w, _f(here) - _f(np.maximum(here - counts[w, c], 0)), words)
        value, which = np.unique(total, return_inverse=True)
        sums = of.sum(axis=1)
        gain -= (_f(sums + value[:, None]) - _f(sums))[which]
        stay -= _f(sums[own]) - _f(np.maximum(sums[own] - total, 0))
    # Words between two of a class change one cell, not two.
    w, b = np.nonzero((right > 0) & (left > 0))
    cell, r, l = table[b, b], right[w, b], left[w, b]
    gain[w, b] += _f(cell + r + l) - _f(cell + r) - _f(cell + l) + _f(cell)
    mine = own[w] == b
    less = lambda x: _f(np.maximum(cell - x, 0))
    stay += np.bincount(w[mine], (less(r) + less(l) - less(r + l) - _f(cell))[mine], words)
    gain[every, own] = stay
    gain[:, 0] = -np.inf
    return gain.argmax(axis=1)


def exchange(counts: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """A class per unit by exchange clustering of a unit bigram table; unit 0 has class 0 for itself."""
    units = len(counts)
    own = np.zeros(units, np.int64)
    by_mass = np.argsort(-(counts.sum(axis=0) + counts.sum(axis=1))[1:], kind="stable") + 1
    own[by_mass] = 1 + np.arange(units - 1) % (classes - 1)
    member = np.eye(classes)[own]
    after, before = counts @ member, counts.T @ member  # per unit: class counts to its right, and to its left
    table = member.T @ after
    f = _f
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in by_mass:
            a, self_count = own[w], counts[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[a] -= self_count
            left[a] -= self_count
            if not right.sum() + left.sum() + self_count:
                continue
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= self_count
            np.maximum(table, 0, out=table)
            now = f(table)
            row, column = f(table + right) - now, f(table + left[:, None]) - now
            both = f(table[diagonal, diagonal] + right + left + self_count) - now[diagonal, diagonal]
            gain = row.sum(axis=1) - row[diagonal, diagonal] + column.sum(axis=0) - column[diagonal, diagonal] + both
            for totals, more in ((table.sum(axis=1) + left, right.sum() + self_count), (table.sum(axis=0) + right, left.sum() + self_count)):
                gain -= f(totals + more) - f(totals)
            gain[0] = -np.inf
            b = int(gain.argmax())
            table[b] += right
            table[:, b] += left
            table[b, b] += self_count
            if b != a:
                moved += 1
                own[w] = b
                after[:, a] -= counts[:, w]
                after[:, b] += counts[:, w]
                before[:, a] -= counts[w]
                before[:, b] += counts[w]
        if moved * 200 < units:
            break
    return own


@dataclass
class Lexicon:
    """What the tasks need, of bounded size: units, their classes, logarithms, and the frequent words' counts."""

    units: Units
    classes: np.ndarray  # of units, then of themselves
    kinds: np.ndarray  # classes of the end token and of ``words``
    moves: np.ndarray  # log10 of a class after a class
    known: np.ndarray  # per class: log10 of what a known word's count is multiplied with
    unknown: np.ndarray  # per class: log10 of an unknown word
    words: list[bytes]
    counts: np.ndarray
    ends: int

    def places(self) -> dict[bytes, int]:
        if "_places" not in self.__dict__:
            self.__dict__["_places"] = {w: i for i, w in enumerate(self.words)}
        return self.__dict__["_places"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_places"}


@dataclass(frozen=True)
class ClassModel:
    lexicon: Lexicon
    vocabulary: DataFrame  # the words that aren't in the lexicon: word, n, c (its class)
    tokens: int
    distinct: int
    least: int  # words with this count or more are in the lexicon, unless they are very long


def train(
    docs: DataFrame, may_learn: Column, text_column: str = "text", classes: int = 32, core: int = 1024, endings: int = 512, head: int = 1 << 18,
    prior: float = 20.0, rounds: int = 2,
) -> ClassModel:
    """Count, cluster and estimate. ``may_learn``: a condition that says which rows may be learned from."""
    texts = docs.where(may_learn).select(text_or_empty(text_column).alias("text"))
    vocabulary = materialize(texts.mapInArrow(tidy(_count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The lowest count that keeps the head within bounds, from a histogram of a few hundred buckets.
    bucket = F.floor(F.log2("n") * 4).cast("int").alias("b")
    sizes = dict(vocabulary.groupBy(bucket).count().collect())
    least, total = None, 0
    for b in sorted(sizes, reverse=True):
        if total + sizes[b] > head:
            break
        total += sizes[b]
        least = b
    least = 1 << 62 if least is None else int(np.ceil(2 ** (least / 4) - 1e-9))
    frequent = vocabulary.where((F.col("n") >= least) & (F.octet_length("word") <= LONGEST_HEAD_WORD) & (F.octet_length("word") > 0))
    listed = frequent.toArrow().to_pydict()
    order = sorted(range(len(listed["word"])), key=lambda i: (-listed["n"][i], listed["word"][i]))
    words, counts = [listed["word"][i] for i in order], np.array([listed["n"][i] for i in order], np.int64)
    tops = [r.e for r in _endings(vocabulary, words[:core], endings)]
    units = Units(words[:core], tops)
    corpus = _Corpus(texts, units, words, classes)
    table = corpus.unit_bigrams()
    own = exchange(table, classes)
    kinds = own[np.fromiter(map(units.__getitem__, [END, *words]), np.int64, len(words) + 1)]
    bigrams, best, parts = corpus.class_bigrams(own, kinds), None, 1
    for turn in range(rounds):
        best = likelihood(bigrams) if best is None else best
        new = corpus.moved(own, kinds, bigrams, lambda i: (i + turn) % parts == 0)  # noqa: B023
        if (new != kinds).sum() * 200 < len(kinds):
            break
        then = corpus.class_bigrams(own, new)
        if (now := likelihood(then)) > best:
            kinds, bigrams, best = new, then, now
        elif parts == 2:
            break
        else:
            parts = 2
    rare, move = corpus.rare(own, kinds, bigrams)
    of_class, once = np.bincount(kinds[1:], counts, classes), np.bincount(kinds[1:][counts == 1], minlength=classes).astype(float)
    ends = int(table[:, 0].sum())
    of_class[0] += ends
    once[0] += ends == 1
    number = 0
    for r in rare.groupBy("c").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once"), F.count("*").alias("words")).collect():
        of_class[r.c] += r.n
        once[r.c] += r.once
        number += r.words
    share = (move.sum(axis=0) + 0.5) / (move.sum() + 0.5 * classes)
    unseen = (once + 0.5) / (of_class + once + 1)
    lexicon = Lexicon(
        Units(words[:core], tops, _placed(words, kinds, rare, number)), np.concatenate([own, np.arange(classes)]), kinds,
        np.log10((move + prior * share) / (move.sum(axis=1, keepdims=True) + prior)),
        np.log10((1 - unseen) / np.maximum(1, of_class)), np.log10(unseen), words, counts, ends,
    )
    return ClassModel(lexicon, rare, int(tokens), int(distinct), least)


def _placed(words: list[bytes], kinds: np.ndarray, rare: DataFrame, number: int) -> Callable[[bytes], int | None]:
    """The class of a word of the vocabulary. Rare words are read a page at a time, of which few are held."""
    places, pages, buckets = {END: 0} | {w: i for i, w in enumerate(words, start=1)}, {}, -(-number // PAGE_WORDS)

    def placed(word: bytes) -> int | None:
        if (at := places.get(word)) is not None or not buckets:
            return None if at is None else int(kinds[at])
        page = zlib.crc32(word) % buckets
        if page not in pages:
            if len(pages) > 3:
                pages.clear()
            pages[page] = {bytes(r.word): r.c for r in rare.where(F.crc32("word") % buckets == page).collect()}
        return pages[page].get(word)

    return placed


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct rows, and how often each comes up."""
    number = len(columns[0])
    key, cells = np.zeros(number, np.int64), 1
    for c in reversed(columns) if number else ():
        low, span = int(c.min()), int(c.max()) - int(c.min()) + 1
        if cells * span >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            cells = number
        key = key * span + (c - low)
        cells *= span
    order = np.argsort(key)
    at = np.flatnonzero(np.diff(key[order], prepend=-1))
    return order[at], np.diff(np.append(at, number))


class _Corpus:
    """The learnable texts as word numbers: 0 the end token, frequent words from 1, the negative unit for rarer words. Those lie beside it with their
    neighbours. Each row is a chunk of whole texts; the end token's number comes before it."""

    def __init__(self, texts: DataFrame, units: Units, words: list[bytes], classes: int):
        self.units, self.listed, self.words, self.classes = units, words, len(words) + 1, classes
        self.context = texts.sparkSession.sparkContext
        sent = self.context.broadcast((units, words))

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units, words = sent.value
            number = {w: i for i, w in enumerate(words, start=1)} | {END: 0}
            for _, distinct, used, _ in _chunks(batches):
                names = _listed(distinct)
                code = np.fromiter((number.get(w, -1) for w in names), np.int32, len(names))
                rest = np.flatnonzero(code < 0)
                code[rest] = -np.array(units.of_rest([names[i] for i in rest.tolist()]), np.int32)
                ids = code[used]
                none = lambda kind, n=1: pa.nulls(n, kind)
                packed = pa.array([zlib.compress(ids.tobytes(), 1)], pa.binary())
                yield _rows(packed, none(pa.binary()), none(pa.binary()), none(pa.int32()), none(pa.int32()), none(pa.int64()))
                at = np.flatnonzero(ids < 0)
                before, after = np.where(at > 0, ids[at - 1], 0), ids[at + 1] if len(at) else ids[:0]
                first, n = _distinct(after, before, used[at])
                listed = distinct.take(pa.array(used[at[first]]))
                yield _rows(none(pa.binary(), len(n)), listed, none(pa.binary(), len(n)), pa.array(before[first]), pa.array(after[first]), pa.array(n))
                at = at[after < 0]
                first, n = _distinct(used[at + 1], used[at])
                both = [distinct.take(pa.array(used[at[first] + k])) for k in (0, 1)]
                yield _rows(none(pa.binary(), len(n)), *both, none(pa.int32(), len(n)), none(pa.int32(), len(n)), pa.array(n))

        kinds = "ids binary, word binary, next binary, l int, r int, n long"
        written = materialize(texts.mapInArrow(tidy(numbered), kinds), "numbers")
        self.chunks = written.where("ids is not null").select("ids")
        self.alone = written.where("word is not null and next is null").select("word", "l", "r", "n")
        self.pairs = written.where("next is not null").select("word", "next", "n")

    def _summed(self, count: Callable[[np.ndarray, np.ndarray], np.ndarray], cells: int) -> np.ndarray:
        """Sums of what ``count`` makes of the numbers before and at each place; ``cells`` is bounded by parameters."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(cells, np.int64)
            for ids in _unpacked(batches):
                table += np.bincount(count(np.append(ids[:1] * 0, ids[:-1]), ids), minlength=cells)
            code = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(table[code])], names=["code", "n"])

        got = self.chunks.mapInArrow(tidy(work), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(cells)
        table[got["code"].to_numpy()] = got["n"].to_numpy()
        return table

    def unit_bigrams(self) -> np.ndarray:
        sent, number = self.context.broadcast(self._lookup(np.arange(self.units.number), self._own_units())), self.units.number

        def count(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
            return sent.value[before + number] * number + sent.value[ids + number]

        return self._summed(count, number**2).reshape(number, number)

    def _own_units(self) -> np.ndarray:
        return np.fromiter(map(self.units.__getitem__, [END, *self.listed]), np.int64, self.words)

    def _lookup(self, of_units: np.ndarray, of_words: np.ndarray) -> np.ndarray:
        """A value for each word number plus the number of units."""
        return np.concatenate([[0], of_units[:0:-1], of_words])

    def class_bigrams(self, own: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        sent, number, classes = self.context.broadcast(self._lookup(own, kinds)), self.units.number, self.classes

        def count(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
            return sent.value[before + number] * classes + sent.value[ids + number]

        return self._summed(count, classes**2).reshape(classes, classes)

    def moved(self, own: np.ndarray, kinds: np.ndarray, bigrams: np.ndarray, may: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """New classes of the frequent words for which ``may`` holds: neighbours are summed per word by class, in blocks of words."""
        sent = self.context.broadcast((self._lookup(own, kinds), kinds, bigrams))
        number, classes, words = self.units.number, self.classes, self.words
        width = 2 * classes + 1

        def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look, counts = sent.value[0], np.zeros(words * width, np.int32)
            for ids in _unpacked(batches):
                before = np.append(ids[:1] * 0, ids[:-1])
                for code, here in (
                    (before * width + look[ids + number], before > 0), (ids * width + classes + look[before + number], ids > 0),
                    (ids * width + 2 * classes, (ids == before) & (ids > 0)),
                ):
                    np.add.at(counts, code[here], 1)
            code = np.flatnonzero(counts)
            edges = np.searchsorted(code, np.arange(0, words + BLOCK_WORDS, BLOCK_WORDS) * width)
            for block in np.flatnonzero(np.diff(edges)).tolist():
                part = code[edges[block] : edges[block + 1]]
                body = np.concatenate([(part - block * BLOCK_WORDS * width).astype(np.int32), counts[part]]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(body, 1)], pa.binary())], names=["block", "body"])

        def exchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    code, n = np.frombuffer(zlib.decompress(body), np.int32).reshape(2, -1)
                    blocks.setdefault(block, np.zeros(BLOCK_WORDS * width, np.int64))[code] += n
            _, kinds, bigrams = sent.value
            for block, counts in blocks.items():
                ids = np.arange(block * BLOCK_WORDS, min(words, (block + 1) * BLOCK_WORDS))
                counts = counts.reshape(-1, width)[: len(ids)]
                right, left, twice = counts[:, :classes], counts[:, classes:-1], counts[:, -1]
                new = better_classes(bigrams, kinds[ids], right, left, twice)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(new.astype(np.int32))], names=["id", "c"])

        summed = self.chunks.mapInArrow(tidy(neighbours), "block int, body binary").repartition("block")
        got = summed.mapInArrow(tidy(exchanged), "id int, c int").toArrow()  # at most ``head`` rows
        ids, c = got["id"].to_numpy(), got["c"].to_numpy()
        here = (ids > 0) & may(ids)
        out = kinds.copy()
        out[ids[here]] = c[here]
        return out

    def rare(self, own: np.ndarray, kinds: np.ndarray, bigrams: np.ndarray) -> tuple[DataFrame, np.ndarray]:
        """Rows (word, n, c) of all rarer words, each with the class it moved to, and the classes' bigrams after that."""
        sent, units = self.context.broadcast((self._lookup(own, kinds), own, bigrams, self.units)), self.units
        number, classes = units.number, self.classes

        def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                l, r = (batch.column(c).to_numpy() for c in ("l", "r"))
                # Rare neighbours are told apart: their classes may change.
                l, r = (sent.value[0][x + number] + classes * (x < 0) for x in (l, r))
                x = pa.array((l * 2 * classes + r).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("word"), x, batch.column("n")], names=["word", "x", "n"])

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, own, bigrams, units = sent.value
            table = np.zeros(classes**2, np.int64)
            for batch in batches:
                lists, words = batch.column("e"), batch.column("word")
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                l, r = np.divmod(flat.field("x").to_numpy().astype(np.int64), 2 * classes)
                n = flat.field("n").to_numpy()
                right, left = (np.bincount(owner * classes + x % classes, n, len(lists) * classes).reshape(-1, classes) for x in (r, l))
                seed = own[np.fromiter(map(units.__getitem__, _listed(words)), np.int64, len(lists))]
                c = better_rare_classes(bigrams, seed, right, left) if len(lists) else seed
                for code, sure in ((l * classes + c[owner], l < classes), (c[owner] * classes + r, r < classes)):
                    table += np.bincount(code[sure], n[sure], classes**2).astype(np.int64)
                total = pa.array(np.bincount(owner, n, len(lists)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([words, total, pa.array(c.astype(np.int32))], names=["word", "n", "c"])
            code = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(code), pa.binary()), pa.array(table[code]), pa.array(code.astype(np.int32))], names=["word", "n", "c"]
            )

        # One shuffle by word serves both groupings.
        placed = self.alone.mapInArrow(classed, "word binary, x int, n long").repartition("word").groupBy("word", "x").agg(F.sum("n").alias("n"))
        listed = placed.groupBy("word").agg(F.collect_list(F.struct("x", "n")).alias("e"))
        found = materialize(listed.mapInArrow(tidy(chosen), "word binary, n long, c int"), "rare")
        words = found.where("word is not null")
        table = np.zeros(classes**2)
        for r in found.where("word is null").groupBy("c").agg(F.sum("n").alias("n")).collect():
            table[r.c] += r.n
        firsts, nexts = words.select("word", F.col("c").alias("a")), words.select(F.col("word").alias("next"), F.col("c").alias("b"))
        for r in self.pairs.join(firsts, "word").join(nexts, "next").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
            table[r.a * classes + r.b] += r.n

        def count(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
            sure, look = (before >= 0) & (ids >= 0), sent.value[0]
            return look[before[sure] + number] * classes + look[ids[sure] + number]

        return words, (table + self._summed(count, classes**2)).reshape(classes, classes)


def _rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns], names=["ids", "word", "next", "l", "r", "n"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for body in batch.column("ids"):
            yield np.frombuffer(zlib.decompress(body.as_buffer()), np.int32).astype(np.int64)


def _endings(vocabulary: DataFrame, core: list[bytes], number: int) -> list:
    spark = vocabulary.sparkSession
    known = spark.createDataFrame([(bytearray(w),) for w in [END, *core]], "word binary")  # at most ``core`` rows
    rest = vocabulary.join(F.broadcast(known), "word", "left_anti")
    ending = F.expr("substring(word, greatest(1, length(word) - 2), 3)").alias("e")
    return rest.groupBy(ending).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "e").limit(number).collect()


def score(docs: DataFrame, model: ClassModel, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row with n_tokens, n_known, base_score and score (log10)."""
    keep = ["doc_id"] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    space = float(np.log10(model.tokens + model.distinct + 1))
    kept = F.struct(*keep).alias("kept")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), text_or_empty(text_column).alias("text"), kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = sent.value
        places = lex.places()
        log_next, log_count = np.log10(lex.counts + 1.0), np.log10(np.maximum(1.0, lex.counts))
        end_known = lex.ends > 0
        for batch, distinct, used, lengths in _chunks(batches):
            starts = np.cumsum(lengths) - lengths
            names = _listed(distinct)
            place = np.fromiter((places.get(w, -1) for w in names), np.int64, len(names))
            head, is_end = place >= 0, np.zeros(len(names), bool)
            is_end[names.index(END)] = True
            tail = ~(head | is_end)
            kind = np.zeros(len(names), np.int64)
            kind[head] = lex.kinds[1 + place[head]]
            # What an unseen word has; the join finds the class of the others.
            kind[tail] = lex.classes[np.array(lex.units.of_rest([names[i] for i in np.flatnonzero(tail).tolist()]), np.int64)]
            base, own = np.zeros(len(names)), np.zeros(len(names))
            base[head], own[head] = log_next[place[head]], log_count[place[head]] + lex.known[kind[head]]
            base[is_end] = np.log10(lex.ends + 1.0)
            own[is_end] = np.log10(lex.ends) + lex.known[0] if end_known else lex.unknown[0]
            c = kind[used]
            before = np.concatenate([[0], c[:-1]])
            open_, after = tail[used], np.append(c[1:], 0)
            open_before, open_after = np.append(False, open_[:-1]), np.append(open_[1:], False)
            moves = np.where(open_ | open_before, 0.0, lex.moves[before, c])
            # The end token's class comes before each text, as it ends the one before.
            per = lambda values: np.add.reduceat(values, starts)
            sure = (head | (is_end & end_known))[used]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), *[pa.nulls(len(batch), pa.binary())] * 2, pa.array(lengths), *[pa.nulls(len(batch), pa.int32())] * 4,
                    pa.array(per(sure.astype(np.int64))), pa.array(per(base[used]) - lengths * space), pa.array(per(moves + own[used])),
                    batch.column("kept"),
                ],
                names=[*_NAMES, "kept"],
            )
            owner, at = np.repeat(np.arange(len(batch)), lengths), np.flatnonzero(open_)
            l, r = (np.where(x, -1, y)[at].astype(np.int32) for x, y in ((open_before, before), (open_after, after)))
            first, n = _distinct(r, l, used[at], owner[at])
            for at, l, r, pair in ((at[first], l[first], r[first], False), (np.flatnonzero(open_ & open_after), None, None, True)):
                if pair:
                    first, n = _distinct(used[at + 1], used[at], owner[at])
                    at = at[first]
                if not len(at):
                    continue
                listed = [distinct.take(pa.array(used[at + k])) for k in range(1 + pair)]
                kinds = [pa.array(c[at + k].astype(np.int32)) for k in range(1 + pair)]
                none = lambda kind, k=len(at): pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(pa.array(owner[at])), listed[0], listed[1] if pair else none(pa.binary()), pa.array(n), kinds[0],
                        kinds[1] if pair else none(pa.int32()), *([none(pa.int32())] * 2 if pair else [pa.array(l), pa.array(r)]),
                        none(pa.int64()), none(pa.float64()), none(pa.float64()), none(batch.schema.field("kept").type),
                    ],
                    names=[*_NAMES, "kept"],
                )

    schema = StructType([StructField(n, t) for n, t in zip(_NAMES, _KINDS, strict=True)] + [StructField("kept", rows.schema["kept"].dataType)])
    done = materialize(rows.mapInArrow(tidy(work), schema), "scored")
    listed = lambda values: F.expr(f"array({','.join(f'{v!r}D' for v in np.asarray(values, float).ravel().tolist())})")
    number = lambda values, at: F.element_at(listed(values), at + 1)
    classes = len(model.lexicon.known)
    step = lambda a, b: F.when((a >= 0) & (b >= 0), number(model.lexicon.moves, a * classes + b)).otherwise(0.0)
    words = model.vocabulary.select("word", F.col("n").alias("count"), F.col("c").alias("class"))
    found = done.where("word is not null and next is null").select("row", "word", "n", "c", "l", "r").join(words, "word", "left")
    hit, c = F.col("count").isNotNull(), F.coalesce("class", "c")
    log = F.when(hit, F.log10("count") + number(model.lexicon.known, c)).otherwise(number(model.lexicon.unknown, c))
    alone = found.select(
        "row", F.when(hit, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.coalesce("count", F.lit(0)) + 1)).alias("base"),
        (F.col("n") * (log + step(F.col("l"), c) + step(c, F.col("r")))).alias("own"),
    )
    firsts, nexts = words.select("word", F.col("class").alias("a")), words.select(F.col("word").alias("next"), F.col("class").alias("b"))
    pairs = done.where("next is not null").select("row", "word", "next", "n", "c", "d").join(firsts, "word", "left").join(nexts, "next", "left")
    pairs = pairs.select(
        "row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("n") * step(F.coalesce("a", "c"), F.coalesce("b", "d"))).alias("own")
    )
    tail = alone.unionByName(pairs).groupBy("row").agg(*[F.sum(x).alias(f"tail_{x}") for x in ("known", "base", "own")])
    both = done.where("word is null").join(tail, "row", "left")
    total = lambda name: F.col(name) + F.coalesce(f"tail_{name}", F.lit(0))
    return both.select(
        "kept.*", F.col("n").alias("n_tokens"), total("known").cast("long").alias("n_known"), total("base").alias("base_score"), total("own").alias("score")
    )


_NAMES = ["row", "word", "next", "n", "c", "d", "l", "r", "known", "base", "own"]
_KINDS = [LongType(), BinaryType(), BinaryType(), LongType(), *[IntegerType()] * 4, LongType(), DoubleType(), DoubleType()]
