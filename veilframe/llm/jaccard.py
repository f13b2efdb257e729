"""Near duplicates: a prefix-tree join of shingle sets under a Jaccard threshold, and its components.

Which sets meet: two sets of sizes a and b link only if they differ in at most ``(100 - p)(a + b) / (100 + p)`` shingles. So if the hash range is cut
into more parts than that, at least one part is equal in both. Every set gives a signature per part; sets with a common signature form families,
one for each first node of any of their signatures. Signatures are compressed before the shuffle (packed by ranges) and never paired: the rest point to the first.
A set first joins only the family that most of its signatures speak for. Sets of families that then still lie in several components are open: only they may
have links left. Short prints, which differ in no more bytes than the sets do in shingles, tell most of them from all others of their families; those are open no
longer (families of more than ``MOST_BLOCK_SETS`` stay whole). One global order is put on the shingles of all open sets, rare ones first, and a link's sets then have a shingle in common among the first of
both: among the first ``(100 - p) / (100 + p)`` of the smaller set, which is indexed under them, and the first ``(100 - p) / 100`` of the larger one. So open sets
meet per such shingle, an indexed one with any. Copies of one text that differ too much to link begin with shingles of their own and no longer meet.

Which sets link: the shingles of a family's sets are put in one order, frequent ones first, and the sets are stored in a compressed prefix tree. Each set walks the
tree before it enters it, sharing the overlap counted so far among all sets below a node, and leaves out subtrees that can't reach the
threshold with the lengths that remain, and subtrees that it is already connected with. Large families come in blocks: first every block
with one hub block, which holds all indexed sets if they are few; only blocks that this leaves unconnected meet each other. So no group of rows in one task is unbounded, no pairs are listed, and no
link between different components is missed.

Defined results: texts without words have an empty set and link with nothing. Null texts are empty. Rows that share an id are one node with all their
links. Rows without an id are returned with their set size and a null component. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import SLICE_BYTES, give_back, saved, slices, split_by_keys, text_or_empty, tidy
from veilframe.llm.components import components
from veilframe.llm.shingles import mixed, shingle_sets
from veilframe.session import materialize

BLOCK_SETS, MOST_BLOCK_SETS, BLOCK_SHINGLES = 64, 2048, 1 << 20
SIGNATURE, MET = -2, -3
#: Text characters per bucket of signatures: with one signature for every few characters, some hundred thousand in a bucket.
BUCKET_CHARS = 4_000_000
#: Bytes of deflated texts that a task takes out of an Arrow batch at once. After a larger group a task gives its memory back.
BODY_BYTES = SLICE_BYTES // 4
#: Parts in which a batch's signatures are sorted and packed.
SORTED_PARTS = 8
#: Bytes of prints that are compared in one task.
PRINT_BYTES = 1 << 24
_COLUMNS = ["key", "node", "other", "size", "packed"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
SCHEMA = "key long, node long, other long, size long, packed binary"


def size_limits(percent: int, most: int) -> list[int]:
    """Lower ends of size classes: a set's partners are in its own class or a neighbouring one."""
    limits = [1]
    while limits[-1] <= most:
        limits.append(limits[-1] * 100 // percent + 1)
    return limits


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the place of the set that each is of. Sets that may link have one in common."""
    limits = size_limits(percent, max(map(len, sets), default=0) + 1)
    limits += [limits[-1] * 100 // percent + 1, (limits[-1] * 100 // percent + 1) * 100 // percent + 1]
    shapes: dict[int, tuple[int, int]] = {}
    found, owners = [], []
    for place, shingles in enumerate(sets):
        size = len(shingles)
        if not size:
            continue
        own = int(np.searchsorted(limits, size, side="right")) - 1
        total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
        # Class c stands for pairs whose larger set is in class c and whose smaller one is in c or c - 1.
        for c in (own, own + 1):
            if c not in shapes:
                most = (100 - percent) * 2 * (limits[c + 1] - 1) // (100 + percent)
                empty = (most + 1) * math.exp(-limits[max(0, c - 1)] / (most + 1)) if most else 0.0
                shapes[c] = most, most + 1 + math.ceil(empty + 3 * math.sqrt(empty))
            most, parts = shapes[c]
            edges = np.searchsorted(shingles, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
            edges = np.concatenate([[0], edges, [size]])
            filled = np.flatnonzero(np.diff(edges))
            # Empty parts say little; they are only needed if differences might touch all parts that aren't.
            parts_used = filled if len(filled) > most else np.arange(parts)
            sums = total[edges[parts_used + 1]] - total[edges[parts_used]]
            salt = parts_used.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((c + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
            found.append(mixed(sums + mixed(salt)))
            owners.append(np.full(len(parts_used), place))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found).view(np.int64), np.concatenate(owners)


def print_of(shingles: np.ndarray, percent: int) -> np.ndarray:
    """A set's print: a byte per part of the hash range. Two sets differ in at least as many shingles as their prints differ in bytes.

    Sets of more shingles have more parts, always a power of two, so that a longer print folds into a shorter one.
    """
    most = (100 - percent) * 2 * len(shingles) // (100 + percent) + 1
    parts = max(16, 1 << (3 * most - 1).bit_length())
    edges = np.searchsorted(shingles, np.arange(1, parts, dtype=np.uint64) << np.uint64(65 - parts.bit_length()))
    edges = np.concatenate([[0], edges, [len(shingles)]])
    sums = np.concatenate([np.zeros(1, np.uint8), np.add.accumulate(shingles.astype(np.uint8), dtype=np.uint8)])
    return sums[edges[1:]] - sums[edges[:-1]]


def close_sets(component: np.ndarray, size: np.ndarray, prints: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets have one in another component that they may link with, going by sizes and prints."""
    close = np.zeros(len(size), bool)
    parts = np.fromiter(map(len, prints), np.int64, len(prints))
    for p in np.unique(parts).tolist():
        # Sets of other lengths than their own meet in the shorter one.
        other = np.flatnonzero(parts >= p)
        table = np.stack([prints[i].reshape(p, -1).sum(axis=1, dtype=np.uint8) for i in other])
        step = max(1, (1 << 24) // table.size)
        own = np.flatnonzero(parts == p)
        for start in range(0, len(own), step):
            some = own[start : start + step]
            unlike = np.count_nonzero(table[np.searchsorted(other, some)][:, None, :] != table[None], axis=2)
            a, b = size[some][:, None], size[other][None]
            pairs = (unlike * (100 + percent) <= (100 - percent) * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            pairs &= component[some][:, None] != component[other][None]
            close[some] |= pairs.any(axis=1)
            close[other] |= pairs.any(axis=0)
    return close


def _firsts(key: np.ndarray) -> np.ndarray:
    """For each row of a sorted key column the place of the first row with that key."""
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _batch(key: np.ndarray, node: np.ndarray, other: np.ndarray, size: np.ndarray, known: np.ndarray | None = None) -> pa.RecordBatch:
    gone = None if known is None else ~known
    arrays = [pa.array(key), pa.array(node, mask=gone), pa.array(other, mask=gone), pa.array(size), pa.nulls(len(key), pa.binary())]
    return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, _TYPES, strict=True)], names=_COLUMNS)


def _pack(key: np.ndarray, node: np.ndarray) -> bytes:
    """Sorted signatures and their nodes in few bytes: differences, in four bytes each where they fit. The lowest bits are given up."""
    steps = np.diff(key >> np.uint64(16), prepend=np.uint64(0))
    offsets = node - node.min()
    first, low = int(steps[0]), int(node.min())
    steps[0] = 0
    narrow = [np.uint32 if len(x) == 0 or int(x.max()) < 1 << 32 else np.uint64 for x in (steps, offsets)]
    head = np.array([len(key), first, narrow[0] is np.uint32, narrow[1] is np.uint32], np.int64).tobytes() + np.int64(low).tobytes()
    return head + steps.astype(narrow[0]).tobytes() + offsets.astype(np.uint64).astype(narrow[1]).tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, narrow_steps, narrow_offsets, low = np.frombuffer(packed, np.int64, 5).tolist()
    kind = np.uint32 if narrow_steps else np.uint64
    steps = np.frombuffer(packed, kind, n, 40).astype(np.uint64)
    offsets = np.frombuffer(packed, np.uint32 if narrow_offsets else np.uint64, n, 40 + steps.size * np.dtype(kind).itemsize)
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(first), offsets.astype(np.int64) + low


def _sketch(width: int, percent: int, buckets: int):
    """Per batch: a row per document, and the signatures of its sets, packed by ranges of signatures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id")
            known = ~np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts, size, own = batch.column("text"), np.zeros(len(ids), np.int64), np.full(len(ids), -1)
            # Sets are held for a slice of the texts only; equal ones of the batch are told by their digests.
            found: dict[bytes, int] = {}
            keys, owners, at = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], 0
            for part in slices(texts):
                new, before = [], len(found)
                for s in shingle_sets(texts.slice(*part).to_pylist(), width):
                    size[at] = len(s)
                    if len(s) and known[at]:
                        own[at] = found.setdefault(hashlib.sha256(s).digest(), len(found))
                        if own[at] == before + len(new):
                            new.append(s)
                    at += 1
                key, owner = signatures(new, percent)
                keys.append(key.view(np.uint64))
                owners.append((owner + before).astype(np.int32))
            # Of the documents with equal sets, the smallest id stands for all.
            least, told = np.full(len(found), np.iinfo(np.int64).max), own >= 0
            np.minimum.at(least, own[told], ids[told])
            stands = ids.copy()
            stands[told] = least[own[told]]
            yield _batch(mixed(ids.view(np.uint64) + np.uint64(1)).view(np.int64), ids, stands, size, known)
            key, owner = np.concatenate(keys), np.concatenate(owners)
            del found, keys, owners
            # A few ranges at a time, so that little is sorted and packed at once.
            limits = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
            step = -(-buckets // SORTED_PARTS)
            for low in range(0, buckets, step):
                high = min(buckets, low + step)
                here = np.flatnonzero((key >= (limits[low - 1] if low else np.uint64(0))) & (key < limits[high - 1] if high < buckets else True))
                some, node = key[here], least[owner[here]]
                order = np.lexsort((node, some))
                some, node = some[order], node[order]
                ranges = np.concatenate([[0], np.searchsorted(some, limits[low : high - 1]), [len(some)]])
                full = np.flatnonzero(np.diff(ranges))
                packed = [_pack(some[ranges[b] : ranges[b + 1]], node[ranges[b] : ranges[b + 1]]) for b in full]
                none = pa.nulls(len(full), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low + full), none, none, pa.array(np.full(len(full), SIGNATURE)), pa.array(packed, pa.binary())], names=_COLUMNS
                )

    return work


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: documents pass; of the nodes of a signature in its bucket, all point to the smallest one.

    The key of a row that points is the number of signatures that say so.
    """
    bucket, parts = None, []

    def edges() -> Iterator[pa.RecordBatch]:
        if parts:
            key, node = (np.concatenate(x) for x in zip(*map(_unpack, parts), strict=True))
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            lead = node[_firsts(key)]
            pairs, votes = np.unique(np.stack([node, lead])[:, node != lead], axis=1, return_counts=True)
            yield _batch(votes.astype(np.int64), pairs[0], pairs[1], np.full(pairs.shape[1], MET))

    for batch in batches:
        passing = batch.column("size").to_numpy() != SIGNATURE
        yield batch.filter(pa.array(passing))
        rest = batch.filter(pa.array(~passing))
        for key, packed in zip(rest.column("key").to_pylist(), rest.column("packed").to_pylist(), strict=True):
            if key != bucket:
                yield from edges()
                bucket, parts = key, []
            parts.append(packed)
    yield from edges()


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in fewer bytes: a text goes to several families."""
    for batch in (b.slice(*s) for b in batches for s in slices(b.column("text"))):
        bodies = [zlib.compress(t.encode(), 1) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bodies, pa.binary())], names=["id", "body"])


def _inflated(bodies) -> list[str]:
    return [zlib.decompress(b).decode() for b in bodies]


class _Node:
    __slots__ = ("part", "children", "ends", "least", "most", "one")

    def __init__(self, part: np.ndarray, size: int, own: int):
        self.part, self.children, self.ends = part, {}, []
        self.least = self.most = size
        #: A set below, standing for all of them while they are known to be connected; else -1.
        self.one = own


class PrefixTree:
    """Sets of ranks, ascending, in a compressed tree; ``join`` links a set with those before it and adds it."""

    def __init__(self, percent: int, ranks: int):
        self.percent, self.root = percent, _Node(np.empty(0, np.int64), 0, -1)
        self.within = np.zeros(ranks, bool)
        self.parent: list[int] = []
        self.first: dict[int, int] = {}
        self.sets = 0

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, q: np.ndarray, known: int, enters: bool = True) -> list[int]:
        """Earlier sets that link with ``q``: one or more of every component that has any, but for those in the ``known`` one of ``q``.

        A set that doesn't enter the tree is not met by later ones.
        """
        own, links = self.sets, []
        self.parent.append(self.find(self.first[known]) if known in self.first else own)
        self.first.setdefault(known, own)
        self.sets += 1
        self.within[q] = True
        p, size = self.percent, len(q)
        stack = [(child, 0, 0) for child in self.root.children.values()]
        while stack:
            node, depth, overlap = stack.pop()
            if node.one >= 0 and self.find(node.one) == self.find(own):
                continue
            # Sizes first: what the shortest or longest set below would still allow.
            if size * p > 100 * node.most or node.least * p > 100 * size:
                continue
            overlap += int(np.count_nonzero(self.within[node.part]))
            depth += len(node.part)
            passed = int(np.searchsorted(q, node.part[-1], side="right"))
            differ = depth + passed - 2 * overlap
            gap = max(0, node.least - depth - (size - passed), (size - passed) - (node.most - depth))
            if (differ + gap) * (100 + p) > (100 - p) * (size + node.most):
                continue
            for other in node.ends[:1]:
                if 100 * overlap >= p * (size + depth - overlap) and self.find(other) != self.find(own):
                    self.parent[self.find(other)] = self.find(own)
                    links.append(other)
            stack += [(child, depth, overlap) for child in node.children.values()]
        self.within[q] = False
        if enters:
            self._add(q, own)
        return links

    def _add(self, q: np.ndarray, own: int) -> None:
        node, at, path = self.root, 0, []
        while at < len(q):
            child = node.children.get(int(q[at]))
            if child is None:
                child = node.children[int(q[at])] = _Node(q[at:], len(q), own)
                path.append(child)
                node, at = child, len(q)
                break
            n = min(len(child.part), len(q) - at)
            unlike = np.flatnonzero(child.part[:n] != q[at : at + n])
            same = int(unlike[0]) if len(unlike) else n
            if same < len(child.part):
                upper = _Node(child.part[:same], child.least, child.one)
                upper.most = child.most
                child.part = child.part[same:]
                upper.children[int(child.part[0])] = child
                node.children[int(q[at])] = child = upper
            path.append(child)
            node, at = child, at + same
        if not node.ends:
            node.ends.append(own)
        for n in reversed(path):
            n.least, n.most = min(n.least, len(q)), max(n.most, len(q))
            below = [c.one for c in n.children.values()] + n.ends
            n.one = below[0] if min(below) >= 0 and len({self.find(b) for b in below}) == 1 else -1


def linked(
    nodes: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None, indexed: list[bool] | None = None
) -> list[tuple[int, int]]:
    """Links that connect all linked sets, found with a prefix tree. Sets of one ``known`` component count as connected.

    With ``indexed``, sets that aren't indexed only meet those that are.
    """
    used = [i for i, s in enumerate(sets) if len(s)]
    if indexed is not None:
        used.sort(key=lambda i: not indexed[i])
    if len(used) < 2:
        return []
    _, ranks, counts = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    ordered = np.split(rank[ranks], np.cumsum([len(sets[i]) for i in used])[:-1])
    tree = PrefixTree(percent, len(counts))
    out = []
    for n, s in enumerate(ordered):
        found = tree.join(np.sort(s), n if known is None else known[used[n]], indexed is None or bool(indexed[used[n]]))
        out += [(nodes[used[n]], nodes[used[o]]) for o in found]
    return [(a, b) for a, b in out if a != b]


def _print_rows(width: int, percent: int):
    """Rows (node, size, print) of all sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(*s) for b in batches for s in slices(b.column("body"), BODY_BYTES)):
            sets = list(shingle_sets(_inflated(batch.column("body").to_pylist()), width))
            prints = pa.array([print_of(s, percent).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, sets), pa.int64()), prints], names=["node", "size", "print"])

    return work


def _shingle_rows(width: int):
    """Rows (node, tag, shingle) of all sets; the tag holds a set's size and tells the sets of a node apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(*s) for b in batches for s in slices(b.column("body"), BODY_BYTES)):
            sets = shingle_sets(_inflated(batch.column("body").to_pylist()), width)
            for node, s in zip(batch.column("id").to_pylist(), sets, strict=True):
                tag = zlib.crc32(s.tobytes()) >> 1 << 32 | len(s)
                arrays = [pa.array(np.full(len(s), x, np.int64)) for x in (node, tag)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(s.view(np.int64))], names=["node", "tag", "shingle"])

    return work


def first_shingles(rows: DataFrame, percent: int) -> DataFrame:
    """(node, family, indexed): shingles under which the sets of ``rows`` (node, tag, shingle) meet, and whether a set is indexed there.

    Of two sets that link, the smaller one is indexed under a shingle that is also among the larger one's. Shingles go by how many sets
    have them, rare ones first; those of one set alone come first and are only counted. Counts are added before the shuffle, and
    a shingle that many sets have has one row on its side of the join, so that Spark can split the other side.
    """
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    # Count and shingle in one number, so that half as much is shuffled.
    code = F.expr("shiftleft(least(n, 32767), 48) | shiftrightunsigned(shingle, 16)")
    shared = rows.join(counts, "shingle").groupBy("node", "tag").agg(F.array_sort(F.collect_set(code)).alias("shared"))
    size = F.col("tag").bitwiseAND((1 << 32) - 1)
    # Whole numbers throughout: places before these in the order are first ones.
    until = size - F.expr(f"({percent} * size + 99) div 100") + 1
    indexed = size - F.expr(f"({2 * percent} * size + {99 + percent}) div {100 + percent}") + 1
    places = shared.withColumn("size", size).withColumn("alone", F.col("size") - F.size("shared"))
    places = places.withColumn("until", until).withColumn("indexed_until", indexed)
    chosen = places.selectExpr("node", "alone", "indexed_until", "posexplode(slice(shared, 1, int(greatest(until - alone, 0)))) as (pos, first)")
    found = chosen.select("node", F.col("first").alias("family"), (F.col("pos") + F.col("alone") < F.col("indexed_until")).alias("indexed"))
    return found.groupBy("node", "family").agg(F.max("indexed").alias("indexed"))


def _meeting(bodies: DataFrame, opened: DataFrame, width: int, percent: int) -> DataFrame:
    """Groups (node, family, component, indexed) in which all links between the components of ``opened`` (node, component) lie."""
    shingles = bodies.mapInArrow(tidy(_shingle_rows(width)), "node long, tag long, shingle long")
    rows = materialize(first_shingles(shingles, percent).join(opened, "node"), "meeting")
    # Groups of the same sets are one group.
    who = [F.bit_xor(F.xxhash64("node", "indexed")), F.sum(F.xxhash64("indexed", "node").cast("decimal(38,0)")), F.count("*")]
    groups = rows.groupBy("family").agg(
        F.struct(*who).alias("who"), F.min("component").alias("a"), F.max("component").alias("b"), F.max("indexed").alias("any")
    )
    groups = groups.where("a <> b and any").groupBy("who").agg(F.min("family").alias("family"))
    return materialize(rows.join(groups.select("family"), "family").select("node", "family", "component", "indexed"), "groups")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable over links)."""
    if not 0 < percent <= 100 or not 0 < width < 32:
        raise ValueError("percent must be 1 to 100 and width 1 to 31")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(chars / BUCKET_CHARS))
    rows = texts.mapInArrow(tidy(_sketch(width, percent, buckets)), SCHEMA).repartition("key").sortWithinPartitions("key")
    met = materialize(rows.mapInArrow(tidy(_meet), SCHEMA).drop("packed"), "met")
    each = met.where("size >= 0").select(F.col("node").alias("id"), F.col("other").alias("stands"), F.col("size").alias("n_shingles"))
    pointing = met.where(f"size = {MET}").groupBy("node", F.col("other").alias("family")).agg(F.sum("key").alias("votes"))
    pointed = materialize(pointing, "pointed")
    own = pointed.select(F.col("family").alias("node"), "family")
    stars = pointed.select("node", "family").union(own).groupBy("node").agg(F.collect_set("family").alias("families"))
    # The family that most signatures of a node speak for.
    best = pointed.groupBy("node").agg(F.max(F.struct("votes", (-F.col("family")).alias("minus"))).alias("best"))
    chosen = best.select("node", (-F.col("best.minus")).alias("family"))
    chosen = chosen.union(chosen.select(F.col("family").alias("node"), "family")).distinct()
    copies = each.where("id <> stands").select(F.col("id").alias("u"), F.col("stands").alias("v"))
    # Each node meets the family it has most in common with; further families only matter where they still span several components.
    found = _hub_components(_bodies(texts, chosen), each, chosen, copies, width, percent)[0]
    spanning, (left,) = saved(_spanning(stars, found), "spanning")
    if left:
        bodies = _bodies(texts, spanning.select("node").distinct())
        opened, (left,) = saved(_open(bodies, spanning, width, percent), "opened")
    if left:
        bodies = bodies.join(opened.select(F.col("node").alias("id")), "id", "left_semi")
        groups = _meeting(bodies, opened, width, percent)
        found = _linked_components(bodies, each, groups, found.select(F.col("node").alias("u"), F.col("component").alias("v")), width, percent)
    return each.join(found, each["id"] == found["node"], "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component_id")
    )


def _spanning(stars: DataFrame, found: DataFrame) -> DataFrame:
    """Of the ``stars`` (node, families), as (node, family, component), those families whose nodes aren't all in one component of ``found``."""
    placed = stars.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    state = materialize(placed, "state").select("node", "component", F.explode("families").alias("family"))
    spread = state.groupBy("family").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("family")
    return state.join(spread, "family").select("node", "family", "component")


def _open(bodies: DataFrame, spanning: DataFrame, width: int, percent: int) -> DataFrame:
    """Distinct (node, component) of ``spanning`` (node, family, component) that may have links to other components: by their prints in families
    of bounded size, and all nodes of larger families."""
    prints = materialize(bodies.mapInArrow(tidy(_print_rows(width, percent)), "node long, size long, print binary"), "prints")
    rows = spanning.join(prints.select("node", F.length("print").alias("bytes")), "node")
    small = rows.groupBy("family").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).selectExpr("family", f"n <= {MOST_BLOCK_SETS} and b <= {PRINT_BYTES} as small")
    told = materialize(spanning.join(small, "family"), "told")

    def near(rows: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, np.uint8) for x in rows["print"].to_pylist()]
        close = close_sets(rows["component"].to_numpy(), rows["size"].to_numpy(), prints, percent)
        return rows.filter(pa.array(close)).select(["node", "component"]).group_by(["node", "component"], use_threads=False).aggregate([])

    checked = told.where("small").drop("small").join(prints, "node").groupBy("family").applyInArrow(near, "node long, component long")
    return told.where("not small").select("node", "component").union(checked).distinct()


def _bodies(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, body): the texts of ``nodes`` in few bytes, picked out once for all that is done with them. A few others may come along; no join finds them.

    Texts are picked out where they lie, so that only those that are needed are ever shuffled.
    """
    wanted = split_by_keys(texts.where("id is not null"), nodes.select(F.col("node").alias("id")), "id")[0]
    return materialize(wanted.mapInArrow(tidy(_deflated), "id long, body binary"), "bodies")


def _hub_components(
    bodies: DataFrame, each: DataFrame, families: DataFrame, known: DataFrame, width: int, percent: int
) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """(node, component) under the edges ``known`` (u, v) and the links that come up when, in every family of (node, family), all blocks
    of sets meet the first; the families' rows with their blocks; and the function that finds the links within further groups.

    Nodes may come with a ``component`` that they are known to belong to; links within it aren't looked for. They may also come as
    ``indexed`` or not; of two nodes that aren't, no links are looked for in this family.
    """
    if "component" not in families.columns:
        families = families.withColumn("component", F.col("node")).withColumn("indexed", F.lit(True))
    sizes = each.groupBy(F.col("id").alias("node")).agg(F.max("n_shingles").alias("size"))
    members, _ = saved(families.join(sizes, "node"), "members")
    known_sizes = [F.count("*").alias("n"), F.sum("size").alias("s"), F.count_if("indexed").alias("i"), F.sum(F.expr("if(indexed, size, 0)")).alias("t")]
    totals = members.groupBy("family").agg(*known_sizes)
    block = F.least(F.greatest(F.col("n") / 64, F.lit(BLOCK_SETS)), F.lit(MOST_BLOCK_SETS))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(1)).cast("long")
    # Few indexed sets are the hub block as a whole; then no blocks are left to meet.
    few = (blocks > 1) & (F.col("i") <= block) & (F.col("t") <= BLOCK_SHINGLES)
    placed = members.join(totals.select("family", blocks.alias("blocks"), few.alias("few")), "family")
    dealt = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = F.when(F.col("few"), F.expr("if(indexed, 0, 1 + pmod(xxhash64(node), blocks - 1))")).otherwise(dealt)
    placed, _ = saved(placed.withColumn("block", dealt.cast("long")), "placed")

    def join_sets(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        nodes, component, indexed, bodies = (rows[c].to_pylist() for c in ("node", "component", "indexed", "body"))
        links = linked(nodes, list(shingle_sets(_inflated(bodies), width)), percent, component, indexed)
        if sum(map(len, bodies)) > BODY_BYTES:
            give_back()
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def joined(groups: DataFrame) -> DataFrame:
        """``groups``: node, family, component, indexed and the name of a group; all sets of a group meet in a tree."""
        full = bodies.join(groups, bodies["id"] == groups["node"]).select("family", "part", "node", "component", "indexed", "body")
        return materialize(full.groupBy("family", "part").applyInArrow(join_sets, "u long, v long"), "links")

    # The hub block goes to every other block's group.
    others = F.when(F.col("block") > 0, F.array("block")).when(F.col("blocks") == 1, F.array(F.lit(0).cast("long")))
    hub = placed.withColumn("part", F.explode(others.otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("blocks") - 1, F.lit(1))))))
    links = joined(hub.select("node", "family", "component", "indexed", F.col("part").cast("string").alias("part")))
    found, _ = saved(components(links.union(known)), "components")
    return found, placed, joined


def _linked_components(
    bodies: DataFrame, each: DataFrame, families: DataFrame, known: DataFrame, width: int, percent: int
) -> DataFrame:
    """(node, component) under the links within ``families`` (node, family, component, indexed) and the edges ``known`` (u, v)."""
    found, placed, joined = _hub_components(bodies, each, families, known, width, percent)
    placed = placed.drop("component")
    large = placed.where("blocks > 1 and not few")
    state = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_families = state.groupBy("family").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("family")
    state, (unconnected,) = saved(state.join(open_families, "family").select("node", "family", "component", "indexed", "size"), "open")
    if not unconnected:
        return found
    # Blocks anew: large components in blocks of their own, which needn't meet each other; the rest pooled.
    counts = state.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sized = counts.withColumn("alone", (F.col("n") >= BLOCK_SETS) | (F.col("s") >= BLOCK_SHINGLES))
    own = sized.where("alone").withColumn("pool", F.col("component"))
    pooled = sized.where("not alone").groupBy("family").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    cut = F.greatest(F.ceil(F.col("n") / F.least(F.greatest(F.col("n") / 64, F.lit(BLOCK_SETS)), F.lit(MOST_BLOCK_SETS))), F.ceil(F.col("s") / BLOCK_SHINGLES))
    shapes = own.select("family", "pool", cut.cast("long").alias("cuts")).union(
        pooled.select("family", F.lit(None).cast("long").alias("pool"), cut.cast("long").alias("cuts"))
    )
    # Blocks of sets that aren't indexed don't meet each other either.
    names = state.join(sized.select("family", "component", "alone"), ["family", "component"]).withColumn("pool", F.when(F.col("alone"), F.col("component")))
    again = names.alias("n").join(shapes.alias("s"), (F.col("n.family") == F.col("s.family")) & F.col("n.pool").eqNullSafe(F.col("s.pool")))
    again = materialize(
        again.select(F.col("n.node").alias("node"), F.col("n.family").alias("family"), F.col("n.component").alias("component"), F.col("n.indexed").alias("indexed"), F.col("n.pool").alias("pool"), F.pmod(F.xxhash64(F.col("n.node")), F.col("cuts")).alias("cut")),
        "again",
    )
    own_block = F.struct(F.coalesce("pool", F.lit(-1)).alias("pool"), F.col("pool").isNull().alias("mixed"), "cut", "indexed")
    listed = again.select("family", own_block.alias("b")).distinct()
    pairs = listed.alias("x").join(listed.alias("y"), F.col("x.family") == F.col("y.family")).where(
        (F.col("x.b") < F.col("y.b")) & ((F.col("x.b.pool") != F.col("y.b.pool")) | F.col("x.b.mixed") | F.col("y.b.mixed")) | (F.col("x.b") == F.col("y.b")) & F.col("x.b.mixed")
    ).where("x.b.indexed or y.b.indexed")
    pairs = pairs.select(F.col("x.family").alias("family"), F.col("x.b").alias("first"), F.col("y.b").alias("second"))
    part = F.concat_ws("/", F.to_json("first"), F.to_json("second"))
    ends = pairs.select("family", part.alias("part"), F.explode(F.array_distinct(F.array("first", "second"))).alias("b"))
    groups = again.withColumn("b", own_block).join(ends, ["family", "b"]).select("node", "family", "component", "indexed", "part")
    return components(joined(groups).union(found.select("node", "component")))
