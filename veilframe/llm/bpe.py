"""Byte-pair encoding by speculation and verification, and decoding.

Texts fall into words. Of each batch's distinct words, every one is cut greedily into the
longest vocabulary entries (the speculation). A cut is the exact encoding if and only if every adjacent
pair of its tokens is: the merges of ``a + b`` alone end in exactly ``a, b``. Pairs are packed into integers and looked
up in a table of verdicts all at once; a pair without a verdict is merged once and remembered. Only words with a
refuted pair are merged exactly.

Results equal those of the tokenizers library for files with BPE merges, the normaliser NFC, white space, lower
case, the byte alphabet and an end-of-word suffix. Special tokens in a text become their own ids, none is added.

Defined results: null and empty texts give no ids, and decode to the empty text. Null ids decode to the empty text. Texts of any length
are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from veilframe.llm.common import fresh, slices, tidy

CHUNK_BYTES = 1 << 20
CACHED_WORDS = 1 << 17
IN_STEP, BLOCK_ROWS = 64, 4096
CACHED_PAIRS = 2_000_000
SUFFIX = "</w>"


def _byte_alphabet() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Lookup:
    """Integers from integers, many at once: open addressing in arrays. -1 stands for absent keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slots, waiting = self._slots(keys), np.arange(len(keys))
        while len(waiting):
            _, first = np.unique(slots[waiting], return_index=True)
            first = first[self.keys[slots[waiting[first]]] < 0]
            placed = waiting[first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], values[placed]
            waiting = np.delete(waiting, first)
            slots[waiting] = (slots[waiting] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        met = self.keys[slots]
        out = np.where(met == keys, self.values[slots], -1)
        waiting = np.flatnonzero((met != keys) & (met >= 0))
        while len(waiting):
            slots[waiting] = (slots[waiting] + 1) & (len(self.keys) - 1)
            met = self.keys[slots[waiting]]
            hit = met == keys[waiting]
            out[waiting[hit]] = self.values[slots[waiting[hit]]]
            waiting = waiting[~hit & (met >= 0)]
        return out


class Tokenizer:
    """Vocabulary, merges and word pattern of a tokenizer file, with what has been verified so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != SUFFIX:
            raise ValueError("the tokenizer needs BPE merges with an end-of-word suffix")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("the tokenizer needs the normalisers NFC, Replace and Lowercase, and no decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bytes = _byte_alphabet()
        self.size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.names = np.empty(self.size, dtype=object)
        self.names[:] = ""
        for name, i in chain(self.vocab.items(), self.special.items()):
            self.names[i] = name
        code = np.zeros(0x200, np.int32)
        self.plain, self.last = code.copy(), code.copy()
        for byte, sign in enumerate(self.bytes):
            code[ord(sign)] = byte
            self.plain[ord(sign)], self.last[ord(sign)] = self.vocab[sign], self.vocab[sign + SUFFIX]
        self.code = code
        merges = np.array([[self.vocab[a], self.vocab[b], self.vocab[a + b]] for a, b in self.ranks], np.int64).reshape(-1, 3)
        self.rank_of = Lookup(merges[:, 0] * self.size + merges[:, 1], np.arange(len(merges), dtype=np.int32))
        self.product = merges[:, 2]
        self._build_trie()
        #: Words met of late, and those met before them: two generations, so frequent words stay. Ids as bytes of int32.
        self.always = {w: np.int32(i).tobytes() for w, i in self.special.items()}
        self.lately: dict[str, bytes] = dict(self.always)
        self.before: dict[str, bytes] = {}
        self.codes, self.verdicts = np.empty(0, np.int64), np.empty(0, bool)

    def _build_trie(self) -> None:
        """A trie of all entries, with the entry that ends at each node: inside a word, and at its end."""
        children: dict[int, int] = {}
        inside, at_end = [-1], [-1]
        for name, i in self.vocab.items():
            body, node = name.removesuffix(SUFFIX), 0
            for byte in self.code[np.fromiter(map(ord, body), np.int64, len(body))].tolist():
                node = children.setdefault(node * 256 + byte, len(inside))
                if node == len(inside):
                    inside.append(-1)
                    at_end.append(-1)
            (inside if len(body) == len(name) else at_end)[node] = i
        self.inside, self.at_end = np.array(inside), np.array(at_end)
        self.child = Lookup(np.array([*children]), np.array([*children.values()], dtype=np.int32))

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the single characters of all words, the last of each with the suffix, and the words' lengths."""
        signs = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = self.plain[signs].astype(np.int64)
        ends = np.cumsum(lengths) - 1
        out[ends] = self.last[signs[ends]]
        return out, lengths

    def merged_long(self, parts: list[int]) -> list[int]:
        """The exact merges of one long word: lowest rank first, leftmost first, from a heap over a linked list."""
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks = self.rank_of.get(np.array(parts[:-1]) * self.size + np.array(parts[1:]))
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(ranks) if r >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = int(self.product[rank]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    r = int(self.rank_of.get(np.array([parts[x] * self.size + parts[y]]))[0])
                    if r >= 0:
                        heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def merged(self, flat: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """The exact merges of many words, in step: each round merges every word's leftmost lowest-ranked pair."""
        out: list[list[int]] = [[]] * len(lengths)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        short = order[: np.searchsorted(lengths[order], IN_STEP, side="right")]
        for w in order[len(short) :]:
            out[w] = self.merged_long(flat[starts[w] : starts[w] + lengths[w]].tolist())
        for at in range(0, len(short), BLOCK_ROWS):
            rows = short[at : at + BLOCK_ROWS]
            width = int(lengths[rows[-1]])
            inside = np.arange(width) < lengths[rows][:, None]
            symbols = np.zeros((len(rows), width), np.int64)
            symbols[inside] = flat[(starts[rows][:, None] + np.arange(width))[inside]]
            symbols, left = self._merged_block(symbols, lengths[rows].copy())
            for w, ids, n in zip(rows.tolist(), symbols.tolist(), left.tolist(), strict=True):
                out[w] = ids[:n]
        return out

    def _merged_block(self, symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        never, column = len(self.product), np.arange(symbols.shape[1])

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            found = self.rank_of.get(a * self.size + b)
            return np.where(found < 0, never, found)

        rank = np.full(symbols.shape, never)
        pair = column < left[:, None] - 1
        rank[pair] = ranks(symbols[pair], np.roll(symbols, -1, axis=1)[pair])
        active = np.arange(len(symbols))
        own, n = symbols, left
        while len(active):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(active)), at]
            going = best < never
            if not going.all():
                symbols[active[~going]], left[active[~going]] = own[~going], n[~going]
                active, own, n, rank, at, best = active[going], own[going], n[going], rank[going], at[going], best[going]
            row = np.arange(len(active))
            shifted = np.minimum(column + (column > at[:, None]), len(column) - 1)
            own, rank, n = np.take_along_axis(own, shifted, 1), np.take_along_axis(rank, shifted, 1), n - 1
            own[row, at] = self.product[best]
            rank[:, -1] = never
            rank[row, at] = never
            for x in (at - 1, at):
                real = np.flatnonzero((x >= 0) & (x + 1 < n))
                rank[real, x[real]] = ranks(own[real, x[real]], own[real, x[real] + 1])
        return symbols, left

    def greedy(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The speculation: the longest entry at each place, of all words in step. Ids, and their number per word."""
        signs = self.code[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lane, end = np.arange(len(words)), np.cumsum(lengths)
        place, node = end - lengths, np.zeros(len(words), np.int64)
        token, reached = np.full(len(words), -1), place.copy()
        owners, tokens = [], []
        while len(lane):
            node = self.child.get(node * 256 + signs[place]).astype(np.int64)
            moved = node >= 0
            place = place + moved
            # The last symbol needs the suffix, so entries without it may not reach the end.
            met = np.where(moved, np.where(place < end, self.inside[node], self.at_end[node]), -1)
            token, reached = np.where(met >= 0, met, token), np.where(met >= 0, place, reached)
            stuck = np.flatnonzero(~moved | (place == end))
            owners.append(lane[stuck])
            tokens.append(token[stuck])
            place[stuck], node[stuck], token[stuck] = reached[stuck], 0, -1
            if (done := reached == end).any():
                more = ~done
                lane, end, place, node, token, reached = (x[more] for x in (lane, end, place, node, token, reached))
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        token = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
        return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def pairs_hold(self, codes: np.ndarray) -> np.ndarray:
        """Whether merging two tokens' text gives the two tokens. A word of one token pairs with nothing (size)."""
        firsts, seconds = np.divmod(codes, self.size + 1)
        names = [self.names[a] + (self.names[b] if b < self.size else "") for a, b in zip(firsts, seconds, strict=True)]
        ended = np.array([n.endswith(SUFFIX) for n in names], bool)
        flat, lengths = self.symbols([n.removesuffix(SUFFIX) for n in names])
        ends = np.cumsum(lengths) - 1
        bodies = "".join(n.removesuffix(SUFFIX)[-1] for n in names)
        flat[ends[~ended]] = self.plain[np.frombuffer(bodies.encode("utf-32-le"), np.uint32)][~ended]
        wanted = [[a] if b == self.size else [a, b] for a, b in zip(firsts.tolist(), seconds.tolist(), strict=True)]
        return np.array([m == w for m, w in zip(self.merged(flat, lengths), wanted, strict=True)], bool)

    def holding(self, codes: np.ndarray) -> np.ndarray:
        """A verdict for each packed pair, all looked up at once."""
        asked, back = np.unique(codes, return_inverse=True)
        if not len(asked):
            return np.empty(0, bool)
        at = np.searchsorted(self.codes, asked)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == asked[known]
        verdict = np.empty(len(asked), bool)
        verdict[known] = self.verdicts[at[known]]
        verdict[~known] = self.pairs_hold(asked[~known])
        if len(self.codes) > CACHED_PAIRS:
            self.codes, self.verdicts = asked, verdict
        elif not known.all():
            codes = np.concatenate([self.codes, asked[~known]])
            order = np.argsort(codes, kind="stable")
            self.codes, self.verdicts = codes[order], np.concatenate([self.verdicts, verdict[~known]])[order]
        return verdict[back]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in the byte alphabet."""
        flat, lengths = self.greedy(words)
        # Each token pairs with the next one of its word; the last one of a longer word has no pair to test.
        ends = np.cumsum(lengths) - 1
        nexts = np.append(flat[1:], 0)
        nexts[ends] = self.size
        tested = np.ones(len(flat), bool)
        tested[ends[lengths > 1]] = False
        owner = np.repeat(np.arange(len(words)), lengths)[tested]
        refuted = np.unique(owner[~self.holding(flat[tested] * (self.size + 1) + nexts[tested])])
        ids = flat.tolist()
        cuts = [ids[e - n + 1 : e + 1] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        for w, exact in zip(refuted.tolist(), self.merged(*self.symbols([words[w] for w in refuted.tolist()])), strict=True):
            cuts[w] = exact
        return cuts

    def split(self, text: str) -> list[str]:
        """The words of a text, normalised, and its special tokens as they are."""
        out = []
        for part in self.specials.split(text) if self.specials and self.specials.search(text) else [text]:
            if part in self.special:
                out.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # Character by character, as the final sigma has no rule of its own here.
            out += self.words.findall("".join(c.lower() for c in part) if "Σ" in part else part.lower())
        return out

    def spelled(self, word: str) -> str:
        """A word in the byte alphabet."""
        return word if word.isascii() and word.isprintable() else "".join(map(self.bytes.__getitem__, word.encode()))

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet."""
        if len(self.lately) > CACHED_WORDS:
            self.before, self.lately = self.lately, dict(self.always)
        new = []
        for word in words.difference(self.lately):
            if (ids := self.before.get(word)) is None:
                new.append(word)
            else:
                self.lately[word] = ids
        if new:
            cuts = self.encode_words([*map(self.spelled, new)])
            self.lately.update(zip(new, (array("i", ids).tobytes() for ids in cuts), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        cut = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        words = set(chain.from_iterable(cut))
        self.learn(words)
        place = {w: i for i, w in enumerate(words)}
        known = [self.lately[w] for w in place]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table = np.frombuffer(b"".join(known), np.int32)
        starts = np.cumsum(sizes) - sizes
        used = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        lengths = sizes[used]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = table[np.repeat(starts[used] - (ends - lengths), lengths) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(edges)


#: Makes output columns from a tokenizer, ids one after another, and the number of ids of each text.
Make = Callable[[Tokenizer, np.ndarray, np.ndarray], list[pa.Array]]


def lists(tokenizer: Tokenizer, ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]


def texts_of(tokenizer: Tokenizer, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The text of each run of ids: the tokens' names joined by a space, as the file has no decoder."""
    names = tokenizer.names[ids].tolist()
    ends = np.cumsum(counts)
    return [" ".join(names[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def map_encoded(docs: DataFrame, path: str, text_column: str, make: Make, made: StructType) -> DataFrame:
    """``docs`` with columns made from each text's ids (columns of these names are replaced), in batches of bounded size."""
    names = {f.name.lower() for f in made.fields}
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = StructType([docs.schema[c] for c in kept] + made.fields)
    # A text that is kept is sent to the tasks once, not twice.
    source = text_column if text_column in kept else fresh(docs, "encoded_text")
    sent = [F.col(f"`{c}`") for c in kept] + ([] if source in kept else [F.col(text_column).alias(source)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # For this task only: kept, it and the words it learned would lie beside all later stages in idle processes.
        tokenizer = Tokenizer(path)
        for batch in batches:
            texts = batch.column(source)
            for at, size in slices(texts, CHUNK_BYTES):
                columns = [batch.column(c).slice(at, size) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *make(tokenizer, *tokenizer.encode(texts.slice(at, size).fill_null("").to_pylist()))], names=schema.names)

    return docs.select(*sent).mapInArrow(tidy(work), schema)


def encode(docs: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as array<int>, never null."""
    return map_encoded(docs, path, text_column, lists, StructType([StructField(ids_column, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``rows`` with the text of each id array. A column of the same name is replaced."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = Tokenizer(path)
        for batch in batches:
            counts = np.diff(batch.offsets.to_numpy())
            yield pa.array(texts_of(tokenizer, batch.flatten().to_numpy(), counts), pa.string())

    return rows.withColumn(text_column, text(F.coalesce(F.col(ids_column), F.array().cast("array<int>"))))
