"""SimHash near-dedup: 64-bit fingerprints, compared exactly in numpy tiles.

Fingerprints that occur more than once are compared once. Two that differ in at most `radius` bits
agree on whole blocks of bits if the word is cut into more than `radius` blocks (pigeonhole), so each
fingerprint goes to the cell of each choice of agreeing blocks and only meets those of its cells.
Within a cell, fingerprints are sorted by population count into tiles, and tile pairs are compared by
exclusive-or and bit count unless their population counts differ beyond the radius. The blocks chosen
only bound the work: every pair within the radius shares a cell, so no link is lost.

For a similarity of sets of shingles, as near-dup stages take it, 64 bits are too few: similar() uses
64 * WORDS bits over the distinct shingles, and blocks of that many bits could not all be tried. Its cells
are the values of MINHASHES min-hashes: two sets share each with a probability of their similarity, so
at 0.8 a pair meets nowhere with a probability under 3e-6, and texts that share nothing don't meet.
Fingerprints only sort pairs out there, within a radius so wide that those of the similarity pass. What
they link is grouped, the sets of a group's texts come together, and a pair links only by the exact
Jaccard similarity of its sets.

A cell of more than `CELL` fingerprints is dealt into a triangle of sub-cells, so none is unbounded. A
cell answers with one edge to its component's smallest member for each linked fingerprint, never with
all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.llm import kernels as K
from tabscout.llm.components import stars
from tabscout.llm.shared import long_list, text_pieces, written

SEED = 42
#: Fingerprints of one tile, and of one cell before it is split.
TILE, CELL = 1024, 8192
#: The same for wide fingerprints, their words, and standard deviations added to their radius.
WIDE_CELL, WORDS, MARGIN = 8192, 16, 5.0
#: Unions of sets up to so many shingles have their share of differing bits computed, not taken from the limit.
SMALL = 40
#: Shingles of one tile of sets that are compared exactly, and of one task's tiles aimed at.
TILE_HASHES, SHARD_HASHES = 1 << 20, 1 << 20
#: Min-hashes by which similar() lets texts meet.
MINHASHES = 8
#: Pairs of which all words are held at once.
PAIRS = 1 << 15
#: Rows of one task's cells aimed at.
SHARD_ROWS = 200_000
#: Up to so many distinct fingerprints radius + 1 blocks are used; then one more for every factor of 256.
FEW = 1 << 22


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased words joined by spaces; starts and ends of the shingles; shingles of each text."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offsets, K.SOLID)
    out, at = K.joined(data, starts, ends)
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    index = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    return out.tobytes(), at[index], at[index + np.repeat(np.minimum(n, width), counts)] - 1, counts


def simhash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text's `counts` hashes: bits that over half of them have set. No hashes: zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    at = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    half, got = counts[full].astype(np.uint64), np.zeros(len(full), np.uint64)
    for bit in range(32):  # two counters of 32 bits in one sum
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(0x0000000100000001), at)
        got |= (2 * (sums & np.uint64(0xFFFFFFFF)) > half).astype(np.uint64) << np.uint64(bit)
        got |= (2 * (sums >> np.uint64(32)) > half).astype(np.uint64) << np.uint64(bit + 32)
    out[full] = got
    return out


def fingerprints_of(column: pa.Array, width: int) -> np.ndarray:
    """Fingerprints of a column of texts."""
    xx, got = xxhash.xxh64_intdigest, []
    for _, _, data, offsets in text_pieces(column):
        text, starts, ends, counts = _shingles(data, offsets, width)
        hashes = np.fromiter((xx(text[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
        got.append(simhash(hashes, counts))
    return np.concatenate(got) if got else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, width: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint long), one for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1), width).view(np.int64))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def _cells(radius: int, distinct: int) -> Column:
    """The cells of a fingerprint: for each choice of agreeing blocks, its number and the bits there."""
    extra, n = 0, distinct / FEW
    while n > 1 and extra < 3:
        extra, n = extra + 1, n / 256
    blocks = min(radius + 1 + extra, 64)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value, shift = F.lit(0).cast("long"), 0
        for b in chosen:
            wide = edges[b + 1] - edges[b]
            part = F.shiftrightunsigned("fingerprint", edges[b]).bitwiseAND(F.lit((1 << wide) - 1 if wide < 64 else -1).cast("long"))
            value, shift = value.bitwiseOR(F.shiftleft(part, shift)), shift + wide
        keys.append(F.struct(F.lit(k).alias("choice"), value.alias("bits")))
    return F.array(*keys)


def linked(values: np.ndarray, radius: int, side: np.ndarray | None = None, lead: float | None = None) -> np.ndarray:
    """For each fingerprint (a row of words): the index of the first member of its component, by pairs within the radius.

    side: compare only those of different sides (sides are compared among themselves elsewhere). Of wide
    fingerprints all words are compared where the first two differ in at most `lead` bits.
    """
    lead = radius if lead is None or values.shape[1] <= 2 else lead
    ones = np.bitwise_count(values).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    v, ones = values[order], ones[order]
    side = None if side is None else side[order]
    label = np.arange(len(v))
    for i in range(0, len(v), TILE):
        a = v[i : i + TILE]
        for j in range(i, len(v), TILE):
            if ones[j] - ones[min(i + TILE, len(v)) - 1] > radius:
                break
            b = v[j : j + TILE]
            apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            if v.shape[1] > 1:
                apart += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
            row, column = np.nonzero(apart <= lead)
            other = column + j > row + i
            if side is not None:
                other &= side[row + i] != side[column + j]
            row, column = row[other], column[other]
            if v.shape[1] > 2 and len(row):
                near = np.empty(len(row), bool)
                for x in range(0, len(row), PAIRS):  # all words of a dense tile's pairs at once would be large
                    r, c = row[x : x + PAIRS], column[x : x + PAIRS]
                    near[x : x + PAIRS] = apart[r, c] + np.bitwise_count(a[r, 2:] ^ b[c, 2:]).sum(axis=1, dtype=np.int64) <= radius
                row, column = row[near], column[near]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]) if len(row) else [0]
            for x, y in zip(edges[:-1], edges[1:]):
                roots = np.unique(np.append(label[j + column[x:y]], label[i + row[x]]))
                for root in roots[1:]:
                    label[label == root] = roots[0]
    first = np.full(len(v), len(v))
    np.minimum.at(first, label, order)
    out = np.empty(len(v), np.int64)
    out[order] = first[label]
    return out


def _comparer(radius: int, words: list[str], lead: float | None):
    def compare(table: pa.Table) -> pa.Table:
        choice, bits, i, j, tile, node = (table.column(c).to_numpy() for c in ("choice", "bits", "i", "j", "tile", "node"))
        order = np.lexsort((node, j, i, bits, choice))
        key = np.stack([choice[order], bits[order], i[order], j[order]])
        value = np.stack([table.column(w).to_numpy()[order] for w in words], axis=1).view(np.uint64)
        node, tile = node[order], tile[order]
        edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(value)]])
        u, v = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                root = linked(value[a:b], radius, None if key[2, a] == key[3, a] else tile[a:b], lead)
                hung = root != np.arange(b - a)
                u.append(node[a:b][hung])
                v.append(node[a:b][root[hung]])
        return pa.table({"u": np.concatenate(u) if u else np.zeros(0, np.int64), "v": np.concatenate(v) if v else np.zeros(0, np.int64)})

    return compare


def links(keyed: DataFrame, prints: DataFrame | None, words: list[str], radius: int, cell: int, shards: int, lead: float | None = None) -> DataFrame:
    """Edges (u, v) of nodes whose components are those of all pairs within the radius that share a cell.

    `keyed` has the cell (choice, bits) and node, once for each cell of a node, and `prints` each node's words
    (None: a node is its own fingerprint). Cells of one node are left out before the fingerprints are fetched,
    and those of more than `cell` nodes are dealt into a triangle of sub-cells.
    """
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    placed = keyed.join(sizes, ["choice", "bits"]).withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = spread.select("choice", "bits", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node")
    cells = cells.withColumn(words[0], F.col("node")) if prints is None else cells.join(prints.select("node", *words), "node")
    cells = cells.withColumn("shard", F.pmod(F.xxhash64("choice", "bits", "i", "j"), F.lit(shards)).cast("int"))
    return cells.groupBy("shard").applyInArrow(_comparer(radius, words, lead), "u long, v long")


def _named(prints: DataFrame, first: DataFrame, edges: DataFrame) -> DataFrame:
    """`prints` with component_id, the smallest id of a node's component; `first` has each node's smallest, `least`."""
    hung = stars(edges)
    labelled = first.select("node", "least").join(hung.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    labelled = written(labelled.withColumn("root", F.coalesce("root", "node")), "labelled")
    smallest = written(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    return prints.join(written(labelled.join(smallest, "root").select("node", "component_id"), "named"), "node")


def components(docs: DataFrame, width: int = 4, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint long, component_id), one for each row of `docs`.

    Texts are lower-cased in A-Z and cut into words `[^\\x20\\x09-\\x0D]+` and shingles of `width` words,
    repeats included, joined by a space; of fewer words the whole sequence is one shingle. Fingerprints
    that differ in at most `radius` bits link, and component_id is the smallest doc_id reachable.

    Null and empty texts have fingerprint zero, linked like any other. A null doc_id is passed over when
    the smallest is sought; a component of nothing else has a null component_id. Repeated rows each give
    a row. An empty table gives no rows. Other columns of `docs` are not read.
    """
    prints = written(fingerprints(docs, width, id_column, text_column), "fingerprints").withColumn("node", F.col("fingerprint"))
    first = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    n = first.count()
    keyed = first.select("node", F.col("node").alias("fingerprint")).select("node", F.explode(_cells(radius, n)).alias("c")).select("node", "c.choice", "c.bits")
    edges = links(keyed, None, ["fingerprint"], radius, CELL, max(16, n * (radius + 1) // SHARD_ROWS))
    return _named(prints, first, edges).select("doc_id", "fingerprint", "component_id")


def _differing(common: int, one: int, other: int) -> float:
    """The probability that a bit of two sets' fingerprints differs, by what they share and what only one has."""
    coins = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    both, k = coins(common), np.arange(common + 1)
    sets = [np.array([coins(n)[2 * (x + np.arange(n + 1)) > common + n].sum() for x in k]) for n in (one, other)]
    return float(both @ (sets[0] * (1 - sets[1]) + sets[1] * (1 - sets[0])))


@lru_cache(maxsize=8)
def wide_radius(similarity: float) -> tuple[int, float]:
    """Bits of 64 * WORDS by which sets of that Jaccard similarity differ at most, and bits of the first 128.

    A bit of large sets differs with probability acos(cosine) / pi, where the cosine of two sets is at least
    2 s / (1 + s); of small ones it differs more often, as even numbers of shingles tie. MARGIN standard deviations
    are added to the worst of them (one more to the first 128 bits).
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for union in range(2, SMALL + 1):
        for apart in range(1, int(union * (1 - similarity) + 1e-9) + 1):
            p = max(p, *(_differing(union - apart, one, apart - one) for one in range(apart // 2 + 1)))
    bound = lambda bits, margin: bits * p + margin * math.sqrt(bits * p * (1 - p))
    return int(bound(64 * WORDS, MARGIN)), bound(128, MARGIN + 1)


def _sets(text: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending; how many; and a hash of each set."""
    xx = xxhash.xxh64_intdigest
    hashes = np.fromiter((xx(text[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, n = hashes[new], np.bincount(owner[new], minlength=len(counts))
    edges = np.concatenate([[0], np.cumsum(n)])
    return hashes, n, K.sequence_hashes(hashes, edges[:-1], edges[1:])


class ShingleSets:
    """Sets of hashes, sorted by size, of which one is compared with many at once."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray) -> None:
        """hashes: those of all sets, end to end, distinct within a set and at least one in each."""
        self.order = np.argsort(sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[self.order]
        self.sizes = sizes[self.order]
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)])
        place = np.repeat(begin - self.edges[:-1], self.sizes) + np.arange(len(hashes))
        known, self.number = np.unique(hashes[place], return_inverse=True)
        self.marked = np.zeros(len(known), np.uint8)

    def within(self, i: int, similarity: float) -> tuple[int, int]:
        """The range of sets whose size leaves the similarity to set i possible."""
        n = int(self.sizes[i])
        return int(np.searchsorted(self.sizes, n * similarity - 1e-6)), int(np.searchsorted(self.sizes, n / similarity + 1e-6, side="right"))

    def alike(self, i: int, lo: int, hi: int, similarity: float) -> np.ndarray:
        """Which of the sets lo to hi have a Jaccard similarity to set i of at least that."""
        own = self.number[self.edges[i] : self.edges[i + 1]]
        self.marked[own] = 1
        shared = np.add.reduceat(self.marked[self.number[self.edges[lo] : self.edges[hi]]], self.edges[lo:hi] - self.edges[lo], dtype=np.int64)
        self.marked[own] = 0
        return shared / (self.sizes[lo:hi] + len(own) - shared) >= similarity


def linked_sets(hashes: np.ndarray, sizes: np.ndarray, similarity: float, side: np.ndarray | None = None) -> np.ndarray:
    """linked() of sets, by pairs of at least the similarity."""
    sets = ShingleSets(hashes, sizes)
    side = None if side is None else side[sets.order]
    label = np.arange(len(sizes))
    for i in range(len(sizes)):
        lo, hi = i + 1, sets.within(i, similarity)[1]
        open_ = label[lo:hi] != label[i]
        if side is not None:
            open_ &= side[lo:hi] != side[i]
        if not open_.any():
            continue
        x = np.flatnonzero(open_)
        lo, hi, open_ = lo + x[0], lo + x[-1] + 1, open_[x[0] : x[-1] + 1]
        found = np.flatnonzero(sets.alike(i, lo, hi, similarity) & open_) + lo
        if len(found):
            label[np.isin(label, label[found])] = label[i]
    first = np.full(len(sizes), len(sizes))
    np.minimum.at(first, label, sets.order)
    out = np.empty(len(sizes), np.int64)
    out[sets.order] = first[label]
    return out


def _sketches(width: int):
    """Rows (doc_id, n, node, f0 ..., m0 ...): distinct shingles, hash, wide fingerprint and min-hashes of the set of them."""
    names, least = [f"f{k}" for k in range(WORDS)], [f"m{k}" for k in range(MINHASHES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, lows, sizes, nodes = [], [], [], []
            for _, _, data, offsets in text_pieces(batch.column(1)):
                hashes, n, node = _sets(*_shingles(data, offsets, width))
                nodes.append(node)
                salted = [hashes, *(K.mixed(hashes + np.uint64(k)) for k in range(1, WORDS))]
                parts.append(np.stack([simhash(h, n) for h in salted], axis=1))
                low, full = np.zeros((len(n), MINHASHES), np.uint64), np.flatnonzero(n)
                if len(full):
                    begin = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    low[full] = np.stack([np.minimum.reduceat(h, begin) for h in salted[:MINHASHES]], axis=1)
                lows.append(low)
                sizes.append(n)
            if parts:
                value, low, n, node = (np.concatenate(x) for x in (parts, lows, sizes, nodes))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node.view(np.int64)), *(pa.array(np.ascontiguousarray(x[:, k]).view(np.int64)) for x in (value, low) for k in range(x.shape[1]))], names=["doc_id", "n", "node", *names, *least])

    return run, "doc_id long, n long, node long, " + ", ".join(f"{k} long" for k in names + least), names, least


def _sets_of(rows: DataFrame, width: int) -> DataFrame:
    """Rows (node, hashes): the set of distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_pieces(batch.column(1)):
                hashes, n, node = _sets(*_shingles(data, offsets, width))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), long_list(hashes.view(np.int64), n)], names=["node", "hashes"])

    return rows.select("doc_id", "text").mapInArrow(run, "node long, hashes array<long>")


def _set_comparer(similarity: float):
    def compare(table: pa.Table) -> pa.Table:
        root, i, j, tile, node = (table.column(c).to_numpy() for c in ("root", "i", "j", "tile", "node"))
        lists = table.column("hashes").combine_chunks()
        edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        order = np.lexsort((node, j, i, root))
        key = np.stack([root[order], i[order], j[order]])
        cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(order)]])
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = order[a:b]
            if len(at) > 1:
                hashes = np.concatenate([flat[edges[k] : edges[k + 1]] for k in at.tolist()])
                first = linked_sets(hashes, (edges[at + 1] - edges[at]).astype(np.int64), similarity, None if key[1, a] == key[2, a] else tile[at])
                hung = first != np.arange(len(at))
                u.append(node[at][hung])
                v.append(node[at][first[hung]])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return compare


def _confirmed(rows: DataFrame, first: DataFrame, hung: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (u, v) of nodes whose components are those of all pairs of one group in `hung` of at least the similarity.

    Only the texts of grouped nodes are read again. A group of many shingles or nodes is dealt into a triangle of tiles.
    """
    grouped = written(hung.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(hung.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).join(first.select("node", "n", "least"), "node"), "grouped")
    sizes = grouped.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / TILE_HASHES), F.ceil(F.count("*") / WIDE_CELL)).cast("int").alias("parts"))
    placed = written(grouped.join(sizes, "root").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "placed")
    total = placed.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    read = rows.join(placed.where("least IS NOT NULL").select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").unionByName(rows.where("doc_id IS NULL"))
    sets = _sets_of(read, width).join(placed.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))
    tiles = placed.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "hashes")
    tiles = tiles.withColumn("shard", F.pmod(F.xxhash64("root", "i", "j"), F.lit(max(16, total // SHARD_HASHES))).cast("int"))
    return tiles.groupBy("shard").applyInArrow(_set_comparer(similarity), "u long, v long")


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, component_id), one for each row of `docs`: components of texts whose sets of shingles are alike.

    Two texts link if the Jaccard similarity of their sets of hashed shingles of `width` words is at least
    `similarity`. Pairs are sought among texts that share a min-hash and whose fingerprints of 64 * WORDS bits
    lie within wide_radius(similarity). Null and empty texts are alike. For null ids, repeated rows and
    empty tables see components().
    """
    run, schema, names, least = _sketches(width)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    prints = written(rows.mapInArrow(run, schema), "sketches")
    first = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(k).alias(k) for k in ("n", *names, *least))), "nodes")
    lows = F.array(*(F.struct(F.lit(k).alias("choice"), F.col(m).alias("bits")) for k, m in enumerate(least)))
    keyed = first.where("n > 0").select("node", F.explode(lows).alias("c")).select("node", "c.choice", "c.bits")
    radius, lead = wide_radius(similarity)
    near = links(keyed, first, names, radius, WIDE_CELL, max(16, first.count() // 4096), lead)
    edges = _confirmed(rows, first, stars(near), width, similarity)
    return _named(prints.select("doc_id", "node"), first, edges).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that have the smallest id of their component in similar(), with all their columns.

    Of repeated rows with one id, all stay or go together. Rows without an id stay: they can't be told apart.
    """
    kept = similar(docs, width, similarity, id_column, text_column).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    own = docs.join(kept, F.col(id_column).cast("long") == F.col("__kept"), "left_semi")
    return own.unionByName(docs.where(F.col(id_column).isNull()))
