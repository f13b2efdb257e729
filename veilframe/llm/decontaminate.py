"""Benchmark decontamination with an FM-index per shard of the training texts.

Each task gathers texts into shards and indexes their words. Words that no phrase holds end a stretch; stretches are the strings of the
index, so a suffix is compared to its stretch's end and not beyond. The Burrows-Wheeler transform lies in a wavelet matrix: one bit row per
bit of the word numbers, with running popcounts. All windows of the benchmark search backwards side by side, a rank lookup per word and bit row.
Rows of a window that occurs are walked back to the next sampled suffix position (every 16th word of a stretch, and its first one), which
gives the place in the text. The places of a text become merged spans of words.

Phrases come in blocks of a bounded number of words, each broadcast; the texts pass one index per block, and spans and items add up.

Defined results: null texts have no words. An item without words has no window, one with fewer words than ``width`` has a single one. Null
items have no words either; a null item id counts as the empty one. Rows that repeat an item id are one item. Without any phrase every
row is returned clean. Rows of ``docs`` are neither joined nor keyed, so null and repeated ids do no harm; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from veilframe.session import materialize

#: Words of phrases that are broadcast at once, and of a piece of a long item.
BLOCK_WORDS = 2_000_000
PIECE_WORDS = 50_000
SHARD_WORDS = 400_000
SAMPLE_EVERY = 16

#: Bytes of words stay (letters in lower case), all other ASCII becomes a blank. Bytes of longer characters are parts of words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def phrase_pieces(benchmark: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """(item, words, size): each item's words, long ones in pieces that overlap so that every window lies in exactly one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, pieces, sizes = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for start in range(0, max(1, len(words) - width + 1) if words else 0, PIECE_WORDS):
                    items.append(item)
                    piece = words[start : start + PIECE_WORDS + width - 1]
                    pieces.append(b" ".join(piece))
                    sizes.append(len(piece))
            columns = [pa.array(items, pa.string()), pa.array(pieces, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "words", "size"])

    rows = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), F.col(text_column).alias("text"))
    return rows.mapInArrow(cut, "item string, words binary, size long")


class Phrases:
    """The distinct windows of a block of pieces, as word numbers from 1 (0: no phrase holds the word), and their items."""

    def __init__(self, items: list[str], pieces: list[bytes], width: int):
        self.items = sorted(set(items))
        numbers = {item: i for i, item in enumerate(self.items)}
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, piece in zip(items, pieces, strict=True):
            codes = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in piece.split())
            for start in range(max(1, len(codes) - width + 1)):
                found.setdefault(codes[start : start + width], set()).add(numbers[item])
        windows = sorted(found)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        # Right-aligned, as the search goes backwards.
        self.windows = np.zeros((len(windows), width), np.int64)
        for row, window in zip(self.windows, windows, strict=True):
            row[width - len(window) :] = window
        self.owners = [sorted(found[w]) for w in windows]


class FmIndex:
    """Index over stretches of word numbers, given as one array with a 0 at the end of each stretch."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text_size = len(text)
        order = _suffix_order(text, symbols)
        self.levels = max(1, symbols.bit_length())
        before = text[order - 1]  # of the first word of a stretch that is the 0 before it
        starts = np.bincount(text, minlength=symbols + 2)
        self.first = np.concatenate([[0], np.cumsum(starts)])  # of each word's suffixes in the order
        place = np.arange(len(text))
        begin = np.concatenate([[True], text[:-1] == 0])
        last_begin = np.maximum.accumulate(np.where(begin, place, 0))
        sampled = ((place - last_begin) % SAMPLE_EVERY == 0)[order]
        self.sampled, self.sampled_before = _bit_row(sampled)
        self.samples = order[sampled]
        self.rows, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bits = (before >> level & 1).astype(bool)
            self.rows.append(_bit_row(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            before = np.concatenate([before[~bits], before[bits]])
        self.origin = self._down(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))

    def _down(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of length ``at`` ends among the entries of ``word`` at the bottom of the matrix."""
        for k, level in enumerate(reversed(range(self.levels))):
            ones = _rank(self.rows[k], at)
            at = np.where(word >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def _step(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[word] + self._down(word, at) - self.origin[word]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """The places of all windows: window number and position in the text, one entry for each occurrence."""
        windows, width = phrases.windows, phrases.windows.shape[1]
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.text_size, np.int64)
        alive = np.arange(len(windows))
        for step in range(width):
            on = alive[phrases.lengths[alive] > step]
            word = windows[on, width - 1 - step]
            low[on], high[on] = self._step(word, low[on]), self._step(word, high[on])
            alive = alive[high[alive] > low[alive]]
        counts = high[alive] - low[alive]
        which = np.repeat(alive, counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[alive], counts)
        # Overlapping windows share most of their rows' walks, but a row is located once.
        distinct, back = np.unique(rows, return_inverse=True)
        return which, self.locate(distinct)[back]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the order."""
        out, walked, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            hit = self.sampled[rows[open_] >> 6] >> (rows[open_] & 63).astype(np.uint64) & np.uint64(1) != 0
            done = open_[hit]
            out[done] = self.samples[_rank((self.sampled, self.sampled_before), rows[done])] + walked
            open_ = open_[~hit]
            at, word = rows[open_], np.zeros(len(open_), np.int64)
            for k in range(self.levels):
                words, _ = self.rows[k]
                bit = words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0
                ones = _rank(self.rows[k], at)
                at, word = np.where(bit, self.zeros[k] + ones, at - ones), word << 1 | bit
            rows[open_] = self.first[word] + at - self.origin[word]
            walked += 1
        return out


def _bit_row(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of a bit row, lowest bit first, and the ones before each word."""
    padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
    padded[: len(bits)] = bits
    words = np.packbits(padded, bitorder="little").view(np.uint64)
    ones = np.bitwise_count(words).astype(np.int64)
    return words, np.cumsum(ones) - ones


def _rank(row: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Ones before each position."""
    words, before = row
    mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)


def _suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes in order. The zeros that end stretches come first, each smaller than the next one, and stop comparisons."""
    size = len(text)
    ends = text == 0
    # As many words as fit one key; behind a stretch's end come zeros.
    bits = symbols.bit_length()
    together = max(1, 62 // bits)
    key, window = text.astype(np.int64), text.astype(np.int64)
    for _ in range(together - 1):
        window = np.where(ends, 0, np.append(window[1:], 0))
        key = key << bits | window
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    # Suffixes that reach their stretch's end inside the key differ by that end's place, and the stable sort has put them so.
    place = np.arange(size)
    to_end = _distance_to_end(ends)
    new |= to_end[order] < together
    rank = np.empty(size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    step = together
    while True:
        # Only suffixes that still share their rank are sorted again, by the rank ``step`` words on.
        tied = ~new
        tied[:-1] |= ~new[1:]
        spots = np.flatnonzero(tied)
        if not len(spots):
            return order
        members = order[spots]
        by = np.argsort(rank[members] * size + rank[members + step])
        members = members[by]
        order[spots] = members
        first, second = rank[members], rank[members + step]
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[spots] = fresh
        rank[members] = np.maximum.accumulate(np.where(fresh, spots, 0))
        step *= 2


def _distance_to_end(ends: np.ndarray) -> np.ndarray:
    place = np.arange(len(ends))
    following = np.minimum.accumulate(np.where(ends, place, len(ends))[::-1])[::-1]
    return following - place


def _shard_hits(coded: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """For each text of a shard the merged spans of hit words and the numbers of items that occur."""
    sizes = np.array([len(c) for c in coded], np.int64)
    whole = np.concatenate([*coded, [0]]) if coded else np.zeros(1, np.int64)
    text_of = np.repeat(np.arange(len(coded)), sizes)
    # Every text ends a stretch; further words without a number between two stretches say nothing more.
    known = whole[:-1] > 0
    starts = np.cumsum(sizes) - sizes
    opens = np.zeros(len(known) + 1, bool)
    opens[starts[sizes > 0]] = True
    follows = known.copy()
    follows[1:] &= known[:-1]
    follows &= ~opens[:-1]
    kept = np.flatnonzero(known)
    spans: list[list[tuple[int, int]]] = [[] for _ in coded]
    owners: list[list[int]] = [[] for _ in coded]
    if not len(kept):
        return spans, owners
    # Stretches with a 0 behind each.
    gaps = np.cumsum(~follows[kept]) - 1
    text = np.zeros(len(kept) + int(gaps[-1]) + 1, np.int64)
    at = np.arange(len(kept)) + gaps
    text[at] = whole[kept]
    origin = np.zeros(len(text), np.int64)
    origin[at] = kept
    which, places = FmIndex(text, len(phrases.vocabulary)).search(phrases)
    if not len(which):
        return spans, owners
    begin = origin[places]
    opened = np.bincount(begin, minlength=len(whole))
    closed = np.bincount(begin + phrases.lengths[which], minlength=len(whole))
    hit = np.cumsum(opened - closed)[: len(known)] > 0
    # A span doesn't reach from one text into the next.
    first = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]) | hit & opens[:-1])
    last = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]) | hit & np.concatenate([opens[1:-1], [True]]))
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        owner = int(text_of[a])
        spans[owner].append((a - int(starts[owner]), b + 1 - int(starts[owner])))
    pairs = np.unique(np.column_stack([text_of[begin], which]), axis=0)
    for owner, window in pairs.tolist():
        owners[owner].append(window)
    owners = [sorted({i for w in ws for i in phrases.owners[w]}) if ws else [] for ws in owners]
    return spans, owners


def _merged(old: list[dict], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two sorted lists of spans as one, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([*((s["start"], s["end"]) for s in old), *new]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    phrase_column: str = "text",
    keep_text: bool = False,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (array of start and end in words; the end is left out), items (ids, sorted as strings).

    ``keep_text`` adds the column text. A task indexes ``shard_words`` words at once, more only if one text has more.
    """
    pieces = materialize(phrase_pieces(benchmark, width, item_column, phrase_column), "phrases")
    total = pieces.agg(F.sum("size")).first()[0] or 0
    blocks = math.ceil(total / BLOCK_WORDS)
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    kind = docs.select(id_column).schema[0].dataType
    made = StructType(
        [StructField("id", kind), StructField("text", StringType()), StructField("n_words", LongType())]
        + [StructField("spans", ArrayType(span)), StructField("items", ArrayType(StringType()))]
    )
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(made["spans"].dataType).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(max(1, blocks)):
        part = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(max(1, blocks))) == block).toArrow()
        sent = spark.sparkContext.broadcast((part["item"].to_pylist(), part["words"].to_pylist()))
        rows = rows.mapInArrow(_searcher(sent, width, keep_text or block + 1 < blocks, made, shard_words), made)
        if block + 1 < blocks:
            rows = materialize(rows, "searched")
    return rows if keep_text else rows.drop("text")


def _searcher(sent, width: int, keep_text: bool, made: StructType, shard_words: int):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(made)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(*sent.value, width)
        number = phrases.vocabulary.get

        def answer(held: list[pa.RecordBatch], coded: list[np.ndarray]) -> pa.Table:
            table = pa.Table.from_batches(held)
            spans, owners = _shard_hits(coded, phrases)
            old_spans, old_items = table["spans"].to_pylist(), table["items"].to_pylist()
            names = phrases.items
            columns = {
                "id": table["id"],
                "text": table["text"] if keep_text else pa.nulls(len(table), pa.string()),
                "n_words": pa.array([len(c) for c in coded], pa.int64()),
                "spans": pa.array(
                    [[{"start": a, "end": b} for a, b in _merged(o, s)] for o, s in zip(old_spans, spans, strict=True)], schema.field("spans").type
                ),
                "items": pa.array(
                    [sorted({*o, *(names[i] for i in s)}) for o, s in zip(old_items, owners, strict=True)], pa.list_(pa.string())
                ),
            }
            return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)

        held, coded, words = [], [], 0
        for batch in batches:
            start = 0
            for row, text in enumerate(batch.column("text")):
                numbers = np.fromiter((number(w, 0) for w in words_of(text.as_py())), np.int64)
                coded.append(numbers)
                words += len(numbers)
                if words >= shard_words:
                    held.append(batch.slice(start, row + 1 - start))
                    yield from answer(held, coded).to_batches()
                    held, coded, words, start = [], [], 0, row + 1
            if start < len(batch):
                held.append(batch.slice(start))
        if held:
            yield from answer(held, coded).to_batches()

    return search


def clean_text(text: str | None, spans: list) -> str | None:
    """The text without its hit words: each span goes from its first to its last word, what lies between two spans stays."""
    if text is None or not spans:
        return text
    raw = text.encode()
    bounds = [found.span() for found in re.finditer(rb"[^ ]+", raw.translate(_WORD_BYTES))]
    out, done = [], 0
    for span in spans:
        out.append(raw[done : bounds[span["start"]][0]])
        done = bounds[span["end"] - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 10, **columns: str) -> DataFrame:
    """id, text without the spans that any benchmark window covers, n_words, n_hit and items."""
    found = contamination(spark, docs, benchmark, width, keep_text=True, **columns)
    cut = F.udf(clean_text, "string", useArrow=True)
    return found.select(
        "id", F.when(F.size("spans") > 0, cut("text", "spans")).otherwise(F.col("text")).alias("text"), "n_words", hit_words().alias("n_hit"), "items"
    )


def hit_words():
    """Number of words inside the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
