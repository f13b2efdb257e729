"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed against it into the longest phrases that occur in the
language's text; few phrases mean a close fit. The phrase count times log2 of the language's size, per symbol, estimates the cross
entropy, and the language with the smallest estimate wins.

Phrases never cross the border of a block of ``BLOCK`` symbols. So blocks of all texts are parsed side by side, one symbol
of every block per step, by table look-ups: an automaton without a way on starts a new phrase from its root, which is
folded into the table together with a flag that counts the phrase.

The labelled text is a bounded sample: per language at most ``rows`` rows, and of each a stretch of at most ``stretch`` characters;
with more than ``LANGUAGES`` languages the stretches shorten, so that memory stays the same. Texts to predict are parsed whole.

Defined results: null texts and texts without a letter give ``und`` and score 0, and so does everything if nothing can be learned.
Ties go to the smallest language name. Rows without an id, a language or a text are not learned from.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import bounded_sample

BLOCK = 512
ALPHABET = 64
LANGUAGES = 64
SPACE = 0
CHUNK_CHARS = 1 << 22
BROADCAST_ROWS = 100_000


@functools.lru_cache(maxsize=1)
def _lowered() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case (itself where that has several characters), and whether it is a letter."""
    signs = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
    low = [s.lower() for s in signs]
    return (
        np.array([ord(s) if len(s) == 1 else ord(o) for s, o in zip(low, signs, strict=True)], np.uint32),
        np.fromiter(map(str.isalpha, signs), bool, len(signs)),
    )


def _automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one string; state 0 is the root."""
    ways: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(ways)
        ways.append({})
        link.append(0)
        length.append(length[last] + 1)
        p, last = last, new
        while p >= 0 and c not in ways[p]:
            ways[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = ways[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        copy = len(ways)
        ways.append(dict(ways[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = link[new] = copy
        while p >= 0 and ways[p].get(c) == q:
            ways[p][c] = copy
            p = link[p]
    return ways


class Parser:
    """Automata of all languages over one alphabet, as tables of (next state * 2 + new phrase)."""

    def __init__(self, samples: tuple[tuple[str, tuple[str, ...]], ...]):
        low, letter = _lowered()
        self.names = [name for name, _ in samples]
        joined = np.frombuffer("".join(t for _, ts in samples for t in ts).encode("utf-32-le", "replace"), np.uint32)
        signs, counts = np.unique(low[joined][letter[joined]], return_counts=True)
        kept = signs[np.lexsort((signs, -counts))][: ALPHABET - 2]
        # Everything but letters is one symbol, rare letters are another.
        self.code = np.where(letter, ALPHABET - 1, SPACE).astype(np.uint8)
        of = {int(s): i for i, s in enumerate(kept, start=1)}
        self.code[np.isin(low, kept) & letter] = [of[int(s)] for s in low[np.isin(low, kept) & letter]]
        self.tables, self.bits = [], []
        for _, texts in samples:
            symbols = self.symbols(list(texts))[0]
            ways = _automaton(symbols.tolist())
            root = np.array([ways[0].get(c, 0) * 2 + 1 for c in range(ALPHABET)], np.int32)
            table = np.tile(root, (len(ways), 1))
            for state, out in enumerate(ways):
                if state and out:
                    table[state, list(out)] = np.fromiter(out.values(), np.int32, len(out)) * 2
            self.tables.append(table.ravel())
            self.bits.append(np.log2(len(symbols) + 2))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts with runs of non-letters as one, each text's number of symbols, and of letters."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        kept = codes != SPACE
        kept[1:] |= codes[:-1] != SPACE
        kept[starts[lengths > 0]] = codes[starts[lengths > 0]] != SPACE
        edges = np.concatenate([starts, [len(codes)]])
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])
        return codes[kept], count(kept), count(codes != SPACE)

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text against each language."""
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
        length = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(BLOCK), side="left")  # lanes longer than the step
        states = [np.zeros(len(start), np.int32) for _ in self.names]
        counts = [np.zeros(len(start), np.int32) for _ in self.names]
        for step in range(BLOCK):
            n = active[step]
            if not n:
                break
            column = symbols[start[:n] + step]
            for table, state, count in zip(self.tables, states, counts, strict=True):
                got = table[state[:n] * ALPHABET + column]
                count[:n] += got & 1
                np.right_shift(got, 1, out=state[:n])
        return np.stack([np.bincount(owner, c, len(sizes)) for c in counts])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        symbols, sizes, letters = self.symbols(texts)
        if not self.names or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts))
        rates = self.phrases(symbols, sizes) * np.array(self.bits)[:, None] / np.maximum(1, sizes)
        best = rates.argmin(axis=0)
        ranked = np.sort(rates, axis=0)
        # How far the runner-up is behind: a half if level, near 1 if it needs far more phrases.
        score = ranked[1] / (ranked[0] + ranked[1] + 1e-12) if len(ranked) > 1 else np.ones(len(texts))
        known = letters > 0
        return [self.names[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(score, 0, 1), 0.0)


@functools.lru_cache(maxsize=1)
def _parser(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Parser:
    return Parser(samples)


def train(
    docs: DataFrame, may_learn: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    rows: int = 96, stretch: int = 256,
) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """A bounded sample of labelled text: of each language ``rows`` rows and of each row ``stretch`` characters."""
    usable = docs.where(may_learn & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    named = usable.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"))
    chosen = bounded_sample(named, "lang", "id", rows)
    whole = usable.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    sizes = chosen.groupBy("lang").count().agg(F.count("*"), F.sum("count")).first()
    languages, wanted = sizes[0], sizes[1] or 0
    stretch = max(1, min(stretch, stretch * LANGUAGES // max(1, languages)))
    # The stretch begins anywhere in the text, always at the same place for the same row.
    begin = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.length("text") - stretch + 1)) + 1
    part = F.substring("text", begin.cast("int"), F.lit(stretch)).alias("part")
    ids = chosen.select("id", "lang").distinct()
    # A measured handful of ids goes to the texts; the texts stay where they are.
    found = whole.join(F.broadcast(ids) if wanted <= BROADCAST_ROWS else ids, ["id", "lang"]).select("lang", F.col("id").cast("string").alias("id"), part)
    # One text per sampled id: the bound holds whatever repeats there are.
    data = found.groupBy("lang", "id").agg(F.min("part").alias("part")).orderBy("lang", "id").toArrow().to_pylist()
    return tuple((lang, tuple(r["part"] + " " for r in group)) for lang, group in groupby(data, key=lambda r: r["lang"]))


def predicted(text: Column, samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """A struct of the predicted language and its score for a text column."""

    @F.arrow_udf("lang string, score double")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = _parser(samples)
        for batch in batches:
            texts = batch.fill_null("").to_pylist()
            langs, scores, part, size = [], [], [], 0
            for text in [*texts, None]:
                if part and (text is None or size + len(text) > CHUNK_CHARS):
                    lang, score = parser.predict(part)
                    langs += lang
                    scores.append(score)
                    part, size = [], 0
                if text is not None:
                    part.append(text)
                    size += len(text)
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], ["lang", "score"])

    return language(text)
