"""Exact ranked lexical search by inner products over sparse ball trees.

A document is a sparse vector over the terms of the items: weight of the term times its saturated
frequency, all integers. An item is the indicator of its terms, so a score is an inner product. Each
task builds balls over runs of its documents: a node knows the centroid and the radius of its vectors,
and by Cauchy and Schwarz no document below it can score above <item, centroid> + |item| * radius.
Subtrees are taken best-first; one is dropped for an item whose k-th score so far its bound, rounded up,
does not reach. Leaves are scored in integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import stage

K = 10
LEAF, CHUNK_ROWS, CHUNK_ENTRIES = 16, 4096, 2_000_000
#: Items and terms that one pass over the documents answers.
BLOCK_ITEMS, BLOCK_TERMS = 256, 32_768
#: Stands for a null doc_id, which ranks after all others.
LAST = (1 << 63) - 1
#: Relative error that sums of up to a million doubles can't reach.
SLACK = 1e-9
# Terms are runs of digits, A-Z, a-z and everything beyond ASCII; only A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Tree:
    """Balls over sparse vectors: rows start[i]:start[i + 1] of (ids, values)."""

    def __init__(self, start: np.ndarray, ids: np.ndarray, values: np.ndarray, width: int):
        self.start, self.ids, self.values, self.width = start, ids, values, width
        self.exact = values
        self.floats = values.astype(np.float64)
        self.norms = np.add.reduceat(self.floats**2, start[:-1])
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(start) - 1))

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rows' entries and where each row begins among them."""
        sizes = self.start[rows + 1] - self.start[rows]
        first = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(self.start[rows] - first, sizes), first

    def _dots(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        at, first = self._entries(rows)
        return np.add.reduceat(self.floats[at] * dense[self.ids[at]], first)

    def _row(self, row: int) -> np.ndarray:
        dense = np.zeros(self.width)
        dense[self.ids[self.start[row] : self.start[row + 1]]] = self.floats[self.start[row] : self.start[row + 1]]
        return dense

    def _grow(self, rows: np.ndarray) -> int:
        at, _ = self._entries(rows)
        mean = np.bincount(self.ids[at], weights=self.floats[at], minlength=self.width) / len(rows)
        held = np.flatnonzero(mean)
        norm = float((mean**2).sum())
        apart = self.norms[rows] - 2 * self._dots(rows, mean) + norm
        slack = SLACK * (float(self.norms[rows].max()) + norm)
        radius = math.sqrt(max(float(apart.max()), 0.0) + slack)
        me = len(self.nodes)
        self.nodes.append((held.astype(np.int32), mean[held], radius, rows, ()))
        if len(rows) > LEAF:
            left = self._sides(rows, rows[int(apart.argmax())])
            below = (self._grow(rows[left]), self._grow(rows[~left]))
            self.nodes[me] = (*self.nodes[me][:4], below)
        return me

    def _sides(self, rows: np.ndarray, one: int) -> np.ndarray:
        """The rows nearer to ``one`` than to the row farthest from it; halves where a side would be small."""
        first = self._row(one)
        to_first = self.norms[rows] - 2 * self._dots(rows, first)
        other = self._row(rows[int(to_first.argmax())])
        lean = to_first - (self.norms[rows] - 2 * self._dots(rows, other)) + (first**2).sum() - (other**2).sum()
        left = lean < 0
        if min(left.sum(), (~left).sum()) * 8 < len(rows):
            left = np.zeros(len(rows), bool)
            left[np.argsort(lean, kind="stable")[: len(rows) // 2]] = True
        return left

    def bounds(self, node: int, held: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Upper bound on the score of every row below ``node`` for each of ``items``; terms that no row has don't lengthen an item."""
        ids, mean, radius, _, _ = self.nodes[node]
        asked = held[ids][:, items].astype(np.float64)
        return (mean @ asked + np.sqrt(asked.sum(axis=0)) * radius) * (1 + SLACK) + 1

    def scores(self, node: int, held: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a leaf and their integer scores (row, item)."""
        rows = self.nodes[node][3]
        at, first = self._entries(rows)
        ids, column = np.unique(self.ids[at], return_inverse=True)
        sizes = np.diff(np.append(first, len(at)))
        line = np.repeat(np.arange(len(rows)), sizes)
        asked = held[ids][:, items]
        if np.add.reduceat(self.floats[at], first).max() < 2.0**52:  # then doubles hold every sum exactly
            dense = np.zeros((len(rows), len(ids)))
            dense[line, column] = self.floats[at]
            return rows, (dense @ asked.astype(np.float64)).astype(np.int64)
        dense = np.zeros((len(rows), len(ids)), np.int64)
        dense[line, column] = self.exact[at]
        return rows, dense @ asked.astype(np.int64)


class Best:
    """The k best (score, doc_id) per item so far, and the score that a further one must reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.least = k, np.maximum(floors, 1)
        self.scores = [np.empty(0, np.int64) for _ in floors]
        self.docs = [np.empty(0, np.int64) for _ in floors]

    def add(self, items: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        passed = scores >= self.least[items]
        for column in np.flatnonzero(passed.any(axis=0)):
            item, new = items[column], passed[:, column]
            s = np.concatenate([self.scores[item], scores[new, column]])
            d = np.concatenate([self.docs[item], docs[new]])
            order = np.lexsort((d, -s))[: self.k]
            self.scores[item], self.docs[item] = s[order], d[order]
            if len(order) == self.k:
                self.least[item] = max(self.least[item], s[order[-1]])


def seed(tree: Tree, docs: np.ndarray, held: np.ndarray, best: Best) -> None:
    """Scores the one leaf that each item reaches by the larger bound."""
    open_ = [(tree.root, np.arange(held.shape[1]))]
    while open_:
        node, items = open_.pop()
        below = tree.nodes[node][4]
        if not below:
            rows, scores = tree.scores(node, held, items)
            best.add(items, docs[rows], scores)
            continue
        left = tree.bounds(below[0], held, items) >= tree.bounds(below[1], held, items)
        open_ += [(child, items[side]) for child, side in zip(below, (left, ~left)) if side.any()]


def search(tree: Tree, docs: np.ndarray, held: np.ndarray, best: Best) -> int:
    """Best-first over the tree's nodes with the items that still need them; returns the number of scores computed."""
    items = np.arange(held.shape[1])
    bounds = tree.bounds(tree.root, held, items)
    queue, scored = [(-float(bounds.max()), 0, tree.root, items, bounds)], 0
    pushed = 0
    while queue:
        _, _, node, items, bounds = heapq.heappop(queue)
        needed = bounds >= best.least[items]
        items = items[needed]
        if not len(items):
            continue
        below = tree.nodes[node][4]
        if not below:
            rows, scores = tree.scores(node, held, items)
            best.add(items, docs[rows], scores)
            scored += scores.size
        for child in below:
            reach = np.minimum(tree.bounds(child, held, items), bounds[needed])
            pushed += 1
            heapq.heappush(queue, (-float(reach.max()), pushed, child, items, reach))
    return scored


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs) of the documents with terms: number of terms, and those of the vocabulary with their frequencies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.get
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                found = terms(text)
                if found:
                    counts = Counter(map(known, found))
                    counts.pop(None, None)
                    ids = np.fromiter(counts, np.int32, len(counts))
                    order = np.argsort(ids)
                    tfs = np.fromiter(counts.values(), np.int64, len(counts))
                    out.append((doc_id, len(found), ids[order].tobytes(), tfs[order].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n", "ids", "tfs"])

    numbered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    return numbered.mapInPandas(run, "doc_id long, n long, ids binary, tfs binary")


def _document_counts(postings: DataFrame, width: int) -> np.ndarray:
    """Documents per term of the vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, np.int64)
        for b in batches:
            if len(b):
                total += np.bincount(np.frombuffer(b"".join(b["ids"]), np.int32), minlength=width)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"term": held.astype(np.int32), "df": total[held]})

    out = np.zeros(width, np.int64)
    for r in postings.select("ids").mapInPandas(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _trees(batches: Iterator[pd.DataFrame], weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """Trees over at most CHUNK_ROWS documents, or CHUNK_ENTRIES entries and a document, with their ids."""
    docs, ids, values, held = [], [], [], 0
    for b in batches:
        for doc_id, n, i, t in zip(b["doc_id"], b["n"], b["ids"], b["tfs"]):
            i, tf = np.frombuffer(i, np.int32), np.frombuffer(t, np.int64)
            m = 100 - 90 + (90 * int(n) * n_docs) // n_terms
            docs.append(doc_id)
            ids.append(i)
            values.append(weights[i] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)))
            held += len(i)
            if len(docs) == CHUNK_ROWS or held >= CHUNK_ENTRIES:
                yield _tree(ids, values, len(weights)), np.array(docs, np.int64)
                docs, ids, values, held = [], [], [], 0
    if docs:
        yield _tree(ids, values, len(weights)), np.array(docs, np.int64)


def _tree(ids: list[np.ndarray], values: list[np.ndarray], width: int) -> Tree:
    start = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    return Tree(start, np.concatenate(ids), np.concatenate(values), width)


def _search_block(postings: DataFrame, items: list[tuple], asked: list[list[int]], width: int, k: int) -> DataFrame | None:
    """(item_id, doc_id, score): candidates of each task, among them the k best of every item."""
    size = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not size["docs"]:
        return None
    n_docs, n_terms = size["docs"], int(size["terms"])
    some = postings.where(F.length("ids") > 0)
    weights = np.array([term_weight(n_docs, int(df)) for df in _document_counts(some, width)], np.int64)
    held = np.zeros((width, len(items)), np.uint8)
    for item, ids in enumerate(asked):
        held[ids, item] = 1

    def task(visit: Callable, floors: np.ndarray) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = Best(floors, k)
            for tree, docs in _trees(batches, weights, n_docs, n_terms):
                visit(tree, docs, held, best)
            for item, (scores, docs) in enumerate(zip(best.scores, best.docs)):
                if len(scores):
                    yield pd.DataFrame({"item": np.full(len(scores), item, np.int32), "doc_id": docs, "score": scores})

        return run

    schema = "item int, doc_id long, score long"
    floors = np.zeros(len(items), np.int64)
    seeds = some.mapInPandas(task(seed, floors), schema)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    for r in seeds.withColumn("place", place).where(F.col("place") <= k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).collect():
        floors[r["item"]] = r["score"]
    spark = postings.sparkSession
    ids = spark.createDataFrame(list(enumerate(items)), "item int, item_id long")
    return some.mapInPandas(task(search, floors), schema).join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 of each item.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns are ignored. Ties go to
    the smaller doc_id, a null one counts as the largest; repeated documents are ranked each. The terms
    of an item are those of all its rows; a null item_id is an item too. Texts that are null, empty or
    without terms count for nothing, and items without terms or hits have no rows.

    Items are answered in blocks of bounded size, each by passes over all documents: terms are counted
    and stored, one leaf per item and run of documents gives scores that the k-th must reach, and
    the search prunes by them.
    """
    item_terms = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    load = stage(item_terms.select("item_id", "text", F.regexp_count("text", F.lit("[0-9A-Za-z\u0080-\U0010ffff]+")).alias("n")), "items")
    size = load.agg(F.countDistinct(F.coalesce("item_id", F.lit(LAST))).alias("items"), F.sum("n").alias("n")).first()
    blocks = max(1, -(-size["items"] // BLOCK_ITEMS), -(-(size["n"] or 0) // BLOCK_TERMS)) if size["items"] else 0
    blocks = blocks if blocks < 2 else 2 * blocks  # hashing deals unevenly
    spark, found = docs.sparkSession, None
    for block in range(blocks):
        mine: dict[int | None, set[bytes]] = {}
        for r in load.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(LAST))), F.lit(blocks)) == block).select("item_id", "text").toLocalIterator():
            mine.setdefault(r["item_id"], set()).update(terms(r["text"]))
        mine = {i: t for i, t in mine.items() if t}
        vocabulary = {t: n for n, t in enumerate(sorted(set().union(*mine.values())))}
        if vocabulary:
            asked = [sorted(vocabulary[t] for t in ts) for ts in mine.values()]
            part = _search_block(stage(_postings(docs, vocabulary), "postings"), list(mine), asked, len(vocabulary), k)
            if part is not None:
                part = stage(part, "candidates")
                found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score")
