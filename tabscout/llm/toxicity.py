"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

1. Examples. A bounded sample of the labelled rows, in which copies and near copies of a text count once for
   a label. Their terms are the vocabulary, all of them: words (lower-cased, ASCII letters and digits and all
   other characters) and their beginnings of 5 and 7 bytes, each also as "at least 2 or 4 times in the
   text". Document frequencies are counted over whole texts of all rows.
2. Weights are (1 + log tf) * idf, times a gain from `FLOOR` to `FLOOR` + 1 that grows with the term's
   chi-square in the sample (terms that go with label 0 have the floor). No term is cut: a text that shares
   any with an example has neighbours. gain=False leaves plain TF-IDF.
3. Index. The examples' unit vectors are sorted so that alike ones share a block. Postings are by term and
   block, and the largest weight of each term and block bounds the cosine that any of its examples can reach.
   Lists of frequent terms are rows of a matrix, whose products are taken of all examples at once.
4. Search. A query takes its most promising blocks first, then every block whose bound reaches its k-th
   best cosine so far: the neighbours are exact, blocks beyond the bound are skipped. All examples tied
   with the k-th count, so results do not depend on the order of rows.
5. Votes weigh 1 / (distance + 0.05). Votes of the examples among each other, without their own, are
   calibrated by isotonic regression in which each class weighs as much as in all labelled rows. Texts
   that share no term with an example have no neighbour; their score is the share of toxic ones among such
   examples, or among all if there are none.

Index and vocabulary grow with the texts of at most about 2 * EXAMPLES rows and are all that tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.llm import kernels as K
from tabscout.llm.calibration import Isotonic
from tabscout.llm.quality_classifier import training_labels
from tabscout.llm.shared import long_list, text_pieces, written
from tabscout.llm.simhash_dedup import ShingleSets

#: Most examples of each label in the sample, neighbours, examples of a block, blocks that a query takes first.
EXAMPLES, NEIGHBOURS, BLOCK, FIRST = 1000, 16, 64, 2
#: Gain of a term: least; chi-square from which it grows; chi-square more at which it has grown by half.
FLOOR, LEAST_CHI, HALF_CHI = 0.1, 4.0, 20.0
#: Beginnings of words, in bytes.
STEMS = (5, 7)
#: A word or beginning is a term of its own for each of these numbers of occurrences that a text reaches.
LEVELS = (1, 2, 4)
#: Jaccard similarity of 3-word windows from which a text of the sample is a copy of another of its label.
COPY = 0.8
#: Share of the examples from which a term is frequent.
DENSE = 0.03
#: Term and block pairs of the queries that are searched at once, and cosines within which neighbours are tied.
SEARCHED, TIE = 1 << 17, 1e-5
#: Nearest examples that are given as evidence.
EVIDENCE = 3
#: Share of score from which a text is called toxic.
THRESHOLD = 0.3


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts, and the text of each."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offsets, K.ALNUM)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, owners = [K.span_hashes(data, starts, ends)], [owner]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        hashes.append(K.mixed(K.span_hashes(data, starts[long], starts[long] + n) + np.uint64(n)))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners)


def _window_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, label, hashes): distinct hashes of a text's 3-word windows (of its words, if fewer; one of its own for no words)."""
    for batch in batches:
        sets = []
        for lo, hi, data, offsets in text_pieces(batch.column(1)):
            starts, ends, first = K.spans(data, offsets, K.SOLID)
            words = K.span_hashes(data, starts, ends)
            at, counts = K.window_starts(first, 3)
            windows, edges = K.window_hashes(words, at, 3), np.concatenate([[0], np.cumsum(counts)])
            for k in range(hi - lo):
                own = windows[edges[k] : edges[k + 1]] if counts[k] else words[first[k] : first[k + 1]]
                sets.append(np.unique(own) if len(own) else np.zeros(1, np.uint64))
        if sets:
            hashes = long_list(np.concatenate(sets).view(np.int64), np.array([len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), hashes], names=["doc_id", "label", "hashes"])


def _originals(table: pa.Table) -> pa.Table:
    """Of one label's rows, by ascending id: those that are not alike to one that stays."""
    lists = table.column("hashes").combine_chunks()
    ids, sizes = table.column("doc_id").to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    sets = ShingleSets(lists.values.to_numpy().view(np.uint64), sizes)
    ids, stays = ids[sets.order], np.ones(len(sizes), bool)
    for i in np.argsort(ids, kind="stable").tolist():
        if stays[i]:
            lo, hi = sets.within(i, COPY)
            stays[lo:hi] &= ~(sets.alike(i, lo, hi, COPY) & (ids[lo:hi] > ids[i]))
    return pa.table({"doc_id": ids[stays], "label": pa.array(np.full(int(stays.sum()), table.column("label")[0].as_py(), np.float64))})


def _without_copies(sampled: DataFrame) -> DataFrame:
    """The sampled rows less those whose windows are alike to a staying row's of the same label and smaller id.

    The sample is bounded, so the window hashes of a label's rows are held by one task and all pairs compared.
    """
    rows = written(sampled.select("doc_id", "text", "label"), "labelled")
    sets = rows.mapInArrow(_window_sets, "doc_id long, label double, hashes array<long>")
    kept = written(sets.groupBy("label").applyInArrow(_originals, "doc_id long, label double").distinct(), "originals")
    return rows.join(F.broadcast(kept), ["doc_id", "label"]).select("doc_id", "text", "label")


def _levelled(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the counts that reach each level, and the level's number."""
    reached = [np.flatnonzero(n >= least) for least in LEVELS]
    return np.concatenate(reached), np.repeat(np.arange(len(LEVELS)), [len(x) for x in reached])


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, label, terms, counts): hashes of a text's words and beginnings, ascending, and how often each occurs."""
    for batch in batches:
        terms, counts, sizes = [], [], []
        for lo, hi, data, offsets in text_pieces(batch.column(1)):
            h, owner = terms_of(data, offsets)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
            terms.append(h[new].view(np.int64))
            counts.append(np.diff(np.append(new, len(h))))
            sizes.append(np.bincount(owner[new], minlength=hi - lo))
        if sizes:
            n = np.concatenate(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), long_list(np.concatenate(terms), n), long_list(np.concatenate(counts), n)], names=["doc_id", "label", "terms", "counts"])


class Vocabulary:
    """The examples' terms, numbered: a hash of a word or beginning and a level."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray) -> None:
        """One entry for each term of each example, repeats included."""
        self.words, word = np.unique(hashes, return_inverse=True)
        keys = np.unique(word * len(LEVELS) + levels)
        self.size = len(keys)
        self.number = np.full(len(self.words) * len(LEVELS), -1, np.int32)
        self.number[keys] = np.arange(self.size, dtype=np.int32)
        #: Words are found by their upper bits: where those of each value begin, and how many there are at most.
        self.shift = np.uint64(64 - max(8, int(len(self.words) * 4).bit_length()))
        self.begin = np.searchsorted(self.words >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.chain = int(np.diff(self.begin).max(initial=0))

    def words_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the hashes that are known: their places, and the numbers of their words."""
        slot = (hashes >> self.shift).astype(np.int64)
        at, end, found = self.begin[slot], self.begin[slot + 1], []
        left = np.arange(len(hashes))
        for _ in range(self.chain):
            open_ = at < end
            left, at, end = left[open_], at[open_], end[open_]
            hit = self.words[at] == hashes[left]
            found.append((left[hit], at[hit]))
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        places, words = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        return places, words.astype(np.int64)

    def terms(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words, and the numbers of their terms, for each level reached that is known."""
        at, level = _levelled(counts)
        term = self.number[words[at] * len(LEVELS) + level]
        return at[term >= 0], term[term >= 0]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of each known term of each text, by text and term."""
        h, owner = terms_of(data, offsets)
        place, word = self.words_of(h)
        key, n = np.unique(owner[place] * max(len(self.words), 1) + word, return_counts=True)
        at, term = self.terms(key % max(len(self.words), 1), n)
        rows = (key // max(len(self.words), 1))[at]
        order = np.lexsort((term, rows))
        return rows[order], term[order], n[at[order]]


def _document_frequencies(vocabulary: Vocabulary):
    """Rows (term, n) of each task: texts that have a term; under -1 all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(vocabulary.size, np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for _, _, data, offsets in text_pieces(batch.column(0)):
                total += np.bincount(vocabulary.texts(data, offsets)[1], minlength=vocabulary.size)
        if texts:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], texts))], names=["term", "n"])

    return run


def gains(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The gain of each term, from the numbers of examples that have it."""
    if not n_toxic or not n_clean:
        return np.full(len(toxic), FLOOR)
    a, b = toxic.astype(float), clean.astype(float)
    c, d, n = n_toxic - a, n_clean - b, n_toxic + n_clean
    chi = (a * d - b * c) ** 2 * n / ((a + b) * (c + d + 1) * n_toxic * n_clean)
    more = np.where(a * n_clean > b * n_toxic, np.maximum(chi - LEAST_CHI, 0), 0)
    return FLOOR + more / (HALF_CHI + more)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of `counts` values each, end to end."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


class BlockMaxIndex:
    """Examples as unit vectors: sparse postings by term and block, with the largest weight of each, and a dense matrix of the frequent terms."""

    def __init__(self, weights: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """weights: of each term; rows, terms, counts: of each term of each example."""
        self.weights = weights
        n = len(ids)
        values = self.unit(rows, terms, counts, n).astype(np.float32)
        strongest, size = np.full(n, len(weights)), np.bincount(rows, minlength=n)
        if len(rows):
            order = np.lexsort((terms, -values, rows))
            first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
            strongest[rows[first]] = terms[first]
        order = np.lexsort((ids, size, strongest, -labels))
        self.ids, self.labels = ids[order], labels[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        example = place[rows]
        #: The frequent terms: their numbers (-1 for others) and the weights that all examples have of them.
        often = np.flatnonzero(np.bincount(terms, minlength=len(weights)) >= max(n * DENSE, 1))
        self.column = np.full(len(weights), -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        dense = self.column[terms] >= 0
        self.dense[self.column[terms[dense]], example[dense]] = values[dense]
        example, terms, values = example[~dense], terms[~dense], values[~dense]
        by = np.lexsort((example, terms))
        self.example, self.value, term = example[by].astype(np.int32), values[by], terms[by]
        block = self.example // BLOCK
        cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        #: Segments, one for each other term and block: where its postings begin, its block and its largest weight; and the first of each term.
        self.begin, self.block = np.append(cut, len(term)).astype(np.int32), block[cut].astype(np.int32)
        self.largest = np.maximum.reduceat(self.value, cut) if len(cut) else np.zeros(0, np.float32)
        self.segments = np.searchsorted(term[cut], np.arange(len(weights) + 1)).astype(np.int32)
        self.edges = np.arange(0, n, BLOCK)

    def __getstate__(self) -> dict:
        """What tasks get: sums are of 64 bits, but weights travel with 32."""
        return {k: v for k, v in self.__dict__.items() if k != "_wide"}

    def unit(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """The weight of each term in its row's unit vector."""
        raw = (1 + np.log(counts)) * self.weights[terms]
        norm = np.sqrt(np.bincount(rows, raw**2, n))
        return raw / norm[rows] if len(raw) else raw

    def cosines(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query: cosines of all examples that can be among the k nearest, at most 0 for others; and the k-th best.

        rows, terms, values: of each term of each query. own: the example that each query is, which does not count.
        """
        size, blocks, k = len(self.ids), len(self.edges), min(NEIGHBOURS, len(self.ids))
        if not k:
            return np.zeros((n, 0)), np.zeros(n)
        dense = self.column[terms] >= 0
        query = np.zeros((n, len(self.dense)))
        query[rows[dense], self.column[terms[dense]]] = values[dense]
        if "_wide" not in self.__dict__:
            self._wide = self.dense.astype(np.float64)
        out = query @ self._wide
        counts = self.segments[terms + 1] - self.segments[terms]
        segment, at = _ranges(self.segments[terms], counts), np.repeat(np.arange(len(terms)), counts)
        row, block = rows[at], self.block[segment]
        bound = np.maximum.reduceat(out, self.edges, axis=1) + np.bincount(row * blocks + block, values[at] * self.largest[segment], n * blocks).reshape(n, -1)
        done = np.zeros((n, blocks), bool)

        def take(chosen: np.ndarray) -> np.ndarray:
            """Adds what the chosen blocks lack; the k-th best of those done so far."""
            use = chosen[row, block]
            s, which = segment[use], at[use]
            length = self.begin[s + 1] - self.begin[s]
            p, which = _ranges(self.begin[s], length), np.repeat(which, length)
            out.ravel()[:] += np.bincount(rows[which] * size + self.example[p], values[which] * self.value[p].astype(np.float64), n * size)
            np.logical_or(done, chosen, out=done)
            if own is not None:
                out[np.arange(n), own] = -1
            known = np.where(np.repeat(done, np.diff(self.edges, append=size), axis=1), out, 0)
            return np.maximum(np.partition(known, size - k, axis=1)[:, size - k], 0)

        best = np.argpartition(-bound, min(FIRST, blocks) - 1, axis=1)[:, :FIRST]
        first = np.zeros((n, blocks), bool)
        first[np.arange(n)[:, None], best] = True
        kth = take(first)
        kth = take((bound >= kth[:, None] - TIE) & (bound > 0) & ~first)
        return np.where(np.repeat(done, np.diff(self.edges, append=size), axis=1), out, 0), kth

    def neighbours(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, own: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first query, end, query, example, cosine): the k nearest of each and all tied with the k-th, nearest first, ties by id.

        rows (ascending), terms, counts: of each known term of each of n queries. Some queries at a time.
        """
        values = self.unit(rows, terms, counts, n)
        work = np.bincount(rows, self.segments[terms + 1] - self.segments[terms], n) if len(rows) else np.zeros(n)
        total, edges, lo = np.concatenate([[0], np.cumsum(np.maximum(work, 1024))]), np.searchsorted(rows, np.arange(n + 1)), 0
        while lo < n:
            hi = min(max(int(np.searchsorted(total, total[lo] + SEARCHED, side="right")) - 1, lo + 1), n)
            part = slice(edges[lo], edges[hi])
            cosines, kth = self.cosines(rows[part] - lo, terms[part], values[part], hi - lo, None if own is None else own[lo:hi])
            query, example = np.nonzero((cosines >= kth[:, None] - TIE) & (cosines > 0))
            near = np.minimum(cosines[query, example], 1).round(5)
            order = np.lexsort((self.ids[example], -near, query))
            yield lo, hi, query[order], example[order], near[order]
            lo = hi

    def votes(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, own: np.ndarray | None = None) -> tuple[np.ndarray, list[list[int]]]:
        """Share of toxic neighbours, by weight, -1 without any; and the ids of the nearest."""
        share, evidence = np.full(n, -1.0), []
        for lo, hi, query, example, near in self.neighbours(rows, terms, counts, n, own):
            weight = 1 / (1.05 - near)
            total, toxic = (np.bincount(query, x, hi - lo) for x in (weight, weight * self.labels[example]))
            share[lo:hi] = np.where(total > 0, toxic / np.where(total > 0, total, 1), -1)
            edges = np.searchsorted(query, np.arange(hi - lo + 1))
            evidence += [self.ids[example[a : min(b, a + EVIDENCE)]].tolist() for a, b in zip(edges[:-1], edges[1:])]
        return share, evidence


def _scorer(vocabulary: Vocabulary, index: BlockMaxIndex, calibrated: Isotonic, alone: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, evidence = [], []
            for lo, hi, data, offsets in text_pieces(batch.column(1)):
                whole = K.span_hashes(data, offsets[:-1], offsets[1:])
                _, first, which = np.unique(whole, return_index=True, return_inverse=True)  # copies are searched once
                rows, terms, counts = vocabulary.texts(data, offsets)
                use = first[which[rows]] == rows
                order = np.lexsort((terms[use], which[rows[use]]))
                vote, near = index.votes(which[rows[use]][order], terms[use][order], counts[use][order], len(first))
                score.append(np.where(vote < 0, alone, calibrated(vote))[which])
                evidence += [near[k] for k in which.tolist()]
            if score:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(score)), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return run


def _sample(train: DataFrame) -> tuple[DataFrame, dict[float, float]]:
    """At most about EXAMPLES ids of each label, by a hash of the id; the rows that one of each label stands for."""
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    share = {k: min(1.0, EXAMPLES / n) for k, n in sizes.items()}
    limit = F.coalesce(*(F.when(F.col("label") == k, F.lit(s)) for k, s in share.items()), F.lit(0.0)) if share else F.lit(0.0)
    return train.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < limit * (1 << 20)), {k: 1 / s for k, s in share.items()}


def _one_each(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ascending, labels, numbers of terms, and the terms and counts end to end; of rows of one id one, whatever the order."""
    lists = [found.column(c).combine_chunks() for c in ("terms", "counts")]
    edges = lists[0].offsets.to_numpy()
    terms, counts = (x.values.to_numpy() for x in lists)
    ids, y = found.column("doc_id").to_numpy(), found.column("label").to_numpy()
    best: dict[int, tuple[bytes, int]] = {}
    for k, i in enumerate(ids.tolist()):
        key = (terms[edges[k] : edges[k + 1]].tobytes() + counts[edges[k] : edges[k + 1]].tobytes(), k)
        best[i] = min(best.get(i, key), key)
    rows = np.array([best[i][1] for i in sorted(best)], np.int64)
    sizes = np.diff(edges)[rows].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    at = _ranges(edges[rows].astype(np.int64), sizes) if len(rows) else rows
    return ids[rows], y[rows], sizes, terms[at].view(np.uint64), counts[at]


def scores(docs: DataFrame, labels: DataFrame, learn: Column, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", gain: bool = True) -> DataFrame:
    """Rows (doc_id, score double from 0 to 1, evidence array of doc_ids), one for each row of `docs`.

    learn: a condition on `labels`, true for rows that labels may be learned from. Only texts are inputs
    of a score. evidence: the nearest examples. Empty and null texts, and others that share no term with an
    example, have no neighbour (see above). Without
    labels, or with one label only, each score is the share of label 1 (0 without labels). Repeated rows
    each give a row; null ids have a score and are no examples. An empty table gives no rows. Other
    columns of `docs` are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    train = written(training_labels(labels, label_column, learn), "labels")
    sample, stands_for = _sample(train)
    sampled = rows.join(F.broadcast(written(sample, "sample")), "doc_id")  # at most about 2 * EXAMPLES ids
    found = _without_copies(sampled).mapInArrow(_example_terms, "doc_id long, label double, terms array<long>, counts array<long>").toArrow()
    ids, y, sizes, hashes, n = _one_each(found)
    del found  # the driver keeps little
    at, level = _levelled(n)
    vocabulary = Vocabulary(hashes[at], level)
    at, terms = vocabulary.terms(np.searchsorted(vocabulary.words, hashes), n)
    row = np.repeat(np.arange(len(ids)), sizes)
    row, counts = row[at], n[at]
    frequency = np.zeros(vocabulary.size + 1)  # the last one of all rows
    told = rows.select("text").mapInArrow(_document_frequencies(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency[told.column("term").to_numpy()] = told.column("n").to_numpy()
    weights = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    if gain:
        toxic = np.bincount(terms, y[row], vocabulary.size)
        weights = weights * gains(toxic, np.bincount(terms, minlength=vocabulary.size) - toxic, int(y.sum()), int(len(y) - y.sum()))
    index = BlockMaxIndex(weights, row, terms, counts, ids, y)
    del hashes, n, at, level, told
    place = np.argsort(index.ids)  # ids ascend in `ids`
    order = np.lexsort((terms, row))
    vote, _ = index.votes(row[order], terms[order], counts[order], len(ids), place)
    weight, near = np.array([stands_for[k] for k in y.tolist()]), vote >= 0
    share = float(np.average(y, weights=weight)) if len(y) else 0.0
    alone = float(np.average(y[~near], weights=weight[~near])) if (~near).any() else share
    calibrated = Isotonic(vote[near], y[near], weight[near], share)
    return rows.mapInArrow(_scorer(vocabulary, index, calibrated, alone), "doc_id long, score double, evidence array<long>")


def keep_clean(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` whose score is under the threshold, with all their columns.

    Rows of one id go together, by their highest score. Rows without an id stay only if no text without
    an id reaches the threshold.
    """
    toxic = scores(docs, labels, learn, id_column=id_column, text_column=text_column).where(F.col("score") >= threshold)
    toxic = written(toxic.select(F.col("doc_id").alias("__toxic")).distinct(), "toxic")
    return docs.join(toxic, F.col(id_column).cast("long").eqNullSafe(F.col("__toxic")), "left_anti")
