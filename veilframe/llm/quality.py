"""A quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a fixed set of measures, cut into bins at quantiles of the training rows. Boosting goes round the
features in turn; each round fits a shallow tree on one feature's bins and adds a small step of it to that feature's lookup table. Then the
feature pairs that explain most of what is left get a table of their own, boosted the same way. A score
is the sum of one table entry per feature and pair, put through the logistic function.

The model is fitted on the driver from a bounded sample: at most ``per_class`` labelled rows of each label value. Sampled rows weigh as many
labelled rows as they stand for, so the labels' true shares set the prior, whatever the table's size. Scoring reads the texts' UTF-8
bytes in Arrow batches, whole.

Defined results: null texts count as empty; empty texts have a score too. Labels other than 0 and 1 are ignored; a
document with several labels counts once for each. With labels of one value only, or none, every score is the smoothed share of
label 1. Rows without an id are never learned from.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import bounded_sample, give_back, slices, tidy
from veilframe.session import materialize

#: Byte classes that are counted, as shares of a text's bytes unless said otherwise.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".",
    "comma": b",",
    "shout": b"!?",
    "pipe": b"|",
    "mark": b"#$%&*+<=>@\\^_`{}~",
    "quote": b"\"'()-/:;[]",
    "wide": bytes(range(0x80, 0x100)),
}
FEATURES = [*CLASSES, "bytes", "word_length", "distinct_words", "distinct_lines", "longest_word", "title_words", "said_again"]


def measures(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text."""
    raw = [t.encode() for t in texts]
    out = np.zeros((len(raw), len(FEATURES)))
    if not raw:
        return out
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate(CLASSES.values(), start=1):
        kind[np.frombuffer(chars, np.uint8)] = k
    for r, b in enumerate(raw):
        counts = np.bincount(kind[np.frombuffer(b, np.uint8)], minlength=len(CLASSES) + 1)
        out[r, : len(CLASSES)] = counts[1:] / max(1, len(b))
    out[:, len(CLASSES)] = np.log1p(sizes)
    for r, b in enumerate(raw):
        words, lines = b.split(), b.split(b"\n")
        distinct = set(words)
        out[r, len(CLASSES) + 1 :] = (
            min(50.0, (len(b) - len(words)) / max(1, len(words))),
            len(distinct) / max(1, len(words)) ** 0.8,
            len(set(lines)) / len(lines),
            np.log1p(max(map(len, distinct), default=0)),
            sum(map(bytes.istitle, words)) / max(1, len(words)),
            sum(map(operator.eq, words, words[1:])) / max(1, len(words)),
        )
    return out


@dataclass(frozen=True)
class Additive:
    """Bin edges per feature, a table per feature, and tables for feature pairs on coarser bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for bins, table in zip(self.bins(x, self.edges), self.tables, strict=True):
            total += table[bins]
        if self.pairs:
            coarse = self.bins(x, self.coarse)
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """The best step per bin: the ordered bins split greedily into at most ``leaves`` runs, each with a Newton step."""
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + least)
    runs = [(0, len(gradient))]
    while len(runs) < leaves:
        best, pick = 1e-9, None
        for r, (a, b) in enumerate(runs):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gains = gain_of(a, cuts) + gain_of(cuts, b) - gain_of(a, b)
                if gains.max() > best:
                    best, pick = gains.max(), (r, int(cuts[gains.argmax()]))
        if pick is None:
            break
        r, cut = pick
        a, b = runs[r]
        runs[r : r + 1] = [(a, cut), (cut, b)]
    step = np.zeros(len(gradient))
    for a, b in runs:
        step[a:b] = (g[b] - g[a]) / (w[b] - w[a] + least)
    return step


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, rounds: int = 60, pairs: int = 6, pair_rounds: int = 30,
    rate: float = 0.15, leaves: int = 4, least: float = 2.0, weights: np.ndarray | None = None,
) -> Additive:
    """Cyclic boosting on the logistic loss. Deterministic. ``weights``: per row, made to be one on average."""
    mass = np.ones(len(y)) if weights is None or not len(y) else weights / weights.mean()
    share = ((mass * y).sum() + 0.5) / (len(y) + 1)
    base, n = float(np.log(share / (1 - share))), x.shape[1]
    if len(np.unique(y)) < 2:
        return Additive(base, [np.empty(0)] * n, [np.zeros(1)] * n, [np.empty(0)] * n, [], [])
    cut = lambda k: [np.unique(np.quantile(x[:, f], np.arange(1, k) / k)) for f in range(n)]
    model = Additive(base, cut(bins), [], cut(pair_bins), [], [])
    fine, coarse = model.bins(x, model.edges), model.bins(x, model.coarse)
    tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(x), base)
    residual = lambda: (mass * (y - (p := 1 / (1 + np.exp(-total)))), mass * p * (1 - p))
    for _ in range(rounds):
        for f in range(n):
            r, w = residual()
            size = len(tables[f])
            step = rate * _shallow_tree(np.bincount(fine[f], r, size), np.bincount(fine[f], w, size), leaves, least)
            tables[f] += step
            total += step[fine[f]]
    shape = lambda a, b: (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, w = residual()
        rows, columns = shape(a, b)
        cell = coarse[a] * columns + coarse[b]
        return cell, np.bincount(cell, r, rows * columns), np.bincount(cell, w, rows * columns)

    def gain(a: int, b: int) -> float:
        _, r, w = cells(a, b)
        return float((r**2 / (w + least)).sum())

    chosen = sorted(((gain(a, b), a, b) for a in range(n) for b in range(a)), reverse=True)[:pairs]
    pair_tables = [np.zeros(shape(a, b)) for _, a, b in chosen]
    for _ in range(pair_rounds):
        for (_, a, b), table in zip(chosen, pair_tables, strict=True):
            cell, r, w = cells(a, b)
            step = rate * r / (w + least)
            table += step.reshape(table.shape)
            total += step[cell]
    return Additive(base, model.edges, tables, model.coarse, [(a, b) for _, a, b in chosen], pair_tables)


def train(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "quality", per_class: int = 3000,
) -> Additive:
    """Fit on at most ``per_class`` labelled rows of each label value, those with the smallest id hashes. Each weighs its label's rows over those sampled.

    ``may_learn``: a condition on ``labels`` that says which rows may be learned from. Of texts that share an id, the one of the smallest measures is taken.
    """
    usable = labels.where(may_learn & F.col(label_column).isin(0, 1)).select(id_column, F.col(label_column).cast("int").alias("label"))
    # 2 * per_class ids: bounded, so they can be broadcast and no text is shuffled.
    chosen = materialize(bounded_sample(usable, "label", id_column, per_class), "sample")
    there, taken = (dict(rows.groupBy("label").count().collect()) for rows in (usable, chosen))
    texts = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), id_column)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(*s) for b in batches for s in slices(b.column("text"))):
            x = measures(batch.column("text").to_pylist())
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), values], ["id", "label", "x"])

    got = rows.select(F.col(id_column).cast("string").alias("id"), "label", "text").mapInArrow(tidy(measured), "id string, label int, x array<double>")
    # One row per sampled id: the bound holds whatever repeats there are in the documents.
    data = got.groupBy("id", "label").agg(F.min("x").alias("x")).orderBy("id", "label", "x").toArrow()
    x = np.array(data["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = data["label"].to_numpy()
    weights = np.array([there.get(v, 0) / max(1, taken.get(v, 0)) for v in (0, 1)])[y]
    return fit(x, y.astype(float), weights=weights)


def scored(text: Column, model: Additive) -> Column:
    """The probability of label 1 for a text column."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = [measures(batch.slice(*s).fill_null("").to_pylist()) for s in slices(batch)]
            yield pa.array(model.score(np.concatenate(x or [measures([])])))
        give_back()

    return score(text)
