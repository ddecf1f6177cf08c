"""Similarity joins over distinct names."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namequarry.functions.handles import class_shape, damped_score, edit_similarity, jaccard, ngrams, run_penalty, structural_damp
from namequarry.session import checkpointed

_BLOCK = 500  # names of a block; a task compares two blocks
_GROUP = 10_000  # names of a group; a cell of ``similar_names`` compares two groups


def similar_names(names: DataFrame, column: str, threshold: float, n: int = 3) -> DataFrame:
    """Pairs (a, b, jaccard, edit) of distinct names, a < b, whose n-gram sets have Jaccard similarity >= threshold > 0.

    Exact: names are dealt to groups of about _GROUP, and each pair of groups is a cell in which every name counts the
    grams that it shares with all others by their postings, so that only pairs of the result become rows. The cells are
    as many as the square of the groups, and each name is shuffled once a group. Repeated names are one; null names
    are left out.
    """
    spark = names.sparkSession
    distinct = names.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct()
    total = distinct.count()
    # enough groups that there are two cells a core
    groups = max(1, math.ceil(total / _GROUP), min(math.ceil(total / 500), math.ceil(2 * math.sqrt(spark.sparkContext.defaultParallelism))))
    part = F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int")
    dealt = distinct.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell = (F.least("part", "other") * groups + F.greatest("part", "other")).alias("cell")
    rows = dealt.select(cell, "name", "part").repartition(3 * groups * (groups + 1) // 2, "cell")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches).sort_by("name")
        names, parts = cell["name"].combine_chunks(), cell["part"].to_numpy()
        # the cell of two groups: one asks, the other answers; that of one group asks itself, once a pair
        low, high = divmod(cell["cell"][0].as_py(), groups)
        left, right, same = np.flatnonzero(parts == low), np.flatnonzero(parts == high), low == high
        text = names.to_pylist()
        index = GramIndex([text[i] for i in right], n)
        made, size = [], 0

        def batch() -> pa.RecordBatch:
            i, j, score = (np.concatenate(x) for x in zip(*made))
            first, second = np.minimum(i, j), np.maximum(i, j)  # names stand in their order
            return pa.RecordBatch.from_arrays([names.take(pa.array(first)), names.take(pa.array(second)), pa.array(score)], ["a", "b", "jaccard"])

        for k, i in enumerate(left):
            found = index.jaccards(text[i])
            near = np.flatnonzero(found >= threshold - 1e-9)
            near = near[near > k] if same else near
            made.append((np.full(len(near), i), right[near], found[near]))
            size += len(near)
            if size > 100_000:
                yield batch()
                made, size = [], 0
        if made:
            yield batch()

    found = rows.groupBy("cell").applyInArrow(pairs, "a string, b string, jaccard double")
    return found.withColumn("edit", edit_similarity(F.col("a"), F.col("b")))


def _jaccards(left: list[str], right: list[str], n: int) -> np.ndarray:
    """Jaccard similarity of the n-gram sets of every name on the left with every one on the right."""
    grams = [{p[i : i + n] for i in range(max(1, len(p) - n + 1))} for p in (f"^{s}$" for s in [*left, *right])]
    place = {g: i for i, g in enumerate(sorted(set().union(*grams)))}
    has = np.zeros((len(grams), len(place)), np.float32)
    for row, found in enumerate(grams):
        has[row, [place[g] for g in found]] = 1
    sizes = np.array([len(g) for g in grams], float)
    both = (has[: len(left)] @ has[len(left) :].T).astype(float)
    return both / (sizes[: len(left), None] + sizes[None, len(left) :] - both)


def _edits(left: list[str], right: list[str]) -> np.ndarray:
    """1 - edit distance / length of every name on the left (all of one length) with every one on the right (so too)."""
    m, n = len(left[0]), len(right[0])
    kind = np.int8 if max(m, n) < 100 else np.int32
    codes = [np.array([[ord(c) for c in s] for s in names], np.int32) for names in (left, right)]
    row = [np.full((len(left), len(right)), j, kind) for j in range(n + 1)]
    for i in range(m):
        before, row[0] = row[0], np.full_like(row[0], i + 1)
        for j in range(n):
            here = before + (codes[0][:, i, None] != codes[1][None, :, j]).astype(kind)
            before = row[j + 1]
            row[j + 1] = np.minimum(here, np.minimum(before, row[j]) + kind(1))
    return 1 - row[n] / max(m, n)


def _scored(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of names of two blocks whose score is >= threshold; the parts add up in the order of ``name_similarity``."""
    for batch in batches:
        for row in range(batch.num_rows):
            left, right, same, damp, runs = (batch.column(i)[row].as_py() for i in range(5))
            grams = 0.45 * _jaccards(left, right, 2) + 0.55 * _jaccards(left, right, 3)
            lexical = 0.58 * grams + 0.42 * _edits(left, right)
            score = np.clip((0.94 * lexical + 0.06 * damp) * damp * runs, 0.0, 1.0)
            names = np.array([*left, *right])
            _, rank = np.unique(names, return_inverse=True)
            i, j = np.nonzero(score >= threshold)
            if same:
                i, j = i[keep := rank[i] < rank[len(left) + j]], j[keep]
            p, q, text = i, len(left) + j, pa.array(names)
            first = rank[p] < rank[q]
            yield pa.RecordBatch.from_arrays([text.take(pa.array(np.where(first, p, q))), text.take(pa.array(np.where(first, q, p))), pa.array(score[i, j])], ["a", "b", "similarity"])


def similar_scores(names: DataFrame, column: str, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity) of distinct names, a < b, whose ``name_similarity`` is >= threshold > 0, whether or not they share a gram.

    Exact: the damping is that of the two shapes, and edits between names are no fewer than between their shapes, so
    pairs of shapes (few) whose highest possible score is below the threshold are dropped before names are compared.
    Names of a shape are split into blocks of bounded size and a pair of blocks is one row, so that a frequent shape
    spreads over all tasks. The result grows with the square of the names where the threshold is low. Null and empty
    names are left out.
    """
    spark = names.sparkSession
    distinct = names.where(F.col(column) != "").select(F.col(column).alias("name")).distinct().withColumn("shape", class_shape(F.col("name")))
    counted = distinct.groupBy("shape").agg(F.count("*").alias("n"))
    binned = distinct.join(F.broadcast(counted), "shape").withColumn("bin", F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / _BLOCK)))
    blocks = checkpointed(binned.groupBy("shape", "bin").agg(F.collect_list("name").alias("names")), "name-blocks")
    keys = blocks.select("shape", "bin")
    side = lambda df, x: df.select(*(F.col(c).alias(c + x) for c in df.columns))
    shapes = keys.select("shape").distinct()
    x, y = F.col("shape_x"), F.col("shape_y")
    lexical = 0.58 + 0.42 * edit_similarity(x, y)
    near = side(shapes, "_x").join(F.broadcast(side(shapes, "_y")), x <= y).withColumns({"damp": structural_damp(x, y), "runs": run_penalty(x, y)})
    near = near.where(damped_score(lexical, F.col("damp"), F.col("runs")) >= threshold - 1e-9)
    once = (x < y) | (F.col("bin_x") <= F.col("bin_y"))
    pairs = near.join(side(blocks, "_x"), "shape_x").join(side(blocks, "_y"), "shape_y").where(once)
    pairs = pairs.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shape_x", "bin_x", "shape_y", "bin_y")
    compared = pairs.select("names_x", "names_y", ((x == y) & (F.col("bin_x") == F.col("bin_y"))).alias("same"), "damp", "runs")
    return compared.mapInArrow(lambda batches: _scored(batches, threshold), "a string, b string, similarity double")


# fixed values: weights of shared bigrams, shared trigrams and edits in the two similarities
COMPARABLE_WEIGHTS = (0.94 * 0.58 * 0.45, 0.94 * 0.58 * 0.55, 0.94 * 0.42)
LISTING_WEIGHTS = (0.92 * 0.42, 0.92 * 0.38, 0.92 * 0.2)


def listing_similarity(a: Column, b: Column) -> Column:
    """Similarity of the names of two listings: shared grams, edits and length, damped by differences in digits and underscores."""
    wb, wt, we = LISTING_WEIGHTS
    plus, damp = _listing_parts(a, b)
    score = (wb * jaccard(ngrams(a, 2), ngrams(b, 2)) + wt * jaccard(ngrams(a, 3), ngrams(b, 3)) + we * edit_similarity(a, b) + plus) * damp
    return F.when(a == b, F.when(a != "", 1.0).otherwise(0.0)).when((a == "") | (b == ""), 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def _listing_parts(a: Column, b: Column) -> tuple[Column, Column]:
    share = lambda n: F.coalesce(F.try_divide(F.length(F.regexp_replace(n, "[^0-9]", "")), F.length(n)), F.lit(0.0))
    under = lambda n: F.length(F.regexp_replace(n, "[^_]", ""))
    length = 1 - F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return 0.08 * length, F.exp(-1.5 * F.abs(share(a) - share(b)) - 0.35 * F.abs(under(a) - under(b)))


def _comparable_parts(a: Column, b: Column) -> tuple[Column, Column]:
    damp = structural_damp(a, b)
    return 0.06 * damp, damp * run_penalty(a, b)


def scores_between(targets: DataFrame, names: DataFrame, threshold: float, kind: str = "comparable") -> DataFrame:
    """(target, name, similarity) of every distinct target and name (columns ``name``) whose similarity is >= threshold > 0.

    A stated set of targets against all names, in blocks: names of one shape (class of each character) and bin are one row of
    bounded size, and what a pair of shapes can reach at most drops most pairs of blocks before any name is compared. kind:
    ``comparable`` is ``name_similarity``, ``listing`` is ``listing_similarity``. Null and empty names are left out.
    """
    parts, weights = (_comparable_parts, COMPARABLE_WEIGHTS) if kind == "comparable" else (_listing_parts, LISTING_WEIGHTS)

    def blocks(df: DataFrame, x: str) -> DataFrame:
        distinct = df.where(F.col("name") != "").select("name").distinct().withColumn("shape", class_shape(F.col("name")))
        counted = distinct.groupBy("shape").agg(F.count("*").alias("n"))
        binned = distinct.join(counted, "shape").withColumn("bin", F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / _BLOCK)))
        return binned.groupBy("shape", "bin").agg(F.collect_list("name").alias("names")).select(*(F.col(c).alias(c + x) for c in ("shape", "bin", "names")))

    left, right = checkpointed(blocks(targets, "_x"), "target-blocks"), checkpointed(blocks(names, "_y"), "name-blocks")
    x, y = F.col("shape_x"), F.col("shape_y")
    plus, damp = parts(x, y)
    reach = (weights[0] + weights[1] + weights[2] * edit_similarity(x, y) + plus) * damp
    # the shapes of the targets, a stated set, meet all shapes; names meet only within pairs of shapes that can reach the threshold
    near = right.select("shape_y").distinct().join(F.broadcast(left.select("shape_x").distinct()), reach >= threshold - 1e-9).withColumns({"plus": plus, "damp": damp})
    pairs = near.join(left, "shape_x").join(right, "shape_y").repartition("shape_x", "bin_x", "shape_y", "bin_y")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, plus, damp = (batch.column(i)[row].as_py() for i in range(4))
                score = weights[0] * _jaccards(a, b, 2) + weights[1] * _jaccards(a, b, 3) + weights[2] * _edits(a, b)
                score = np.clip((score + plus) * damp, 0.0, 1.0)
                i, j = np.nonzero(score >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a).take(pa.array(i)), pa.array(b).take(pa.array(j)), pa.array(score[i, j])], ["target", "name", "similarity"])

    return pairs.select("names_x", "names_y", "plus", "damp").mapInArrow(scored, "target string, name string, similarity double")


# ---- names of one process: every target against all names of a cell, without a row for any pair

_AT_ONCE = 1 << 17  # edit distances that are worked out together


def _padded_grams(name: str, n: int) -> set[str]:
    p = f"^{name}$"
    return {p[i : i + n] for i in range(max(1, len(p) - n + 1))}


class GramIndex:
    """The n-grams of names as postings: how many of them another name shares with each."""

    def __init__(self, names: list[str], n: int):
        lists, self.n = defaultdict(list), n
        self.sizes = np.zeros(len(names))
        for i, name in enumerate(names):
            grams = _padded_grams(name, n)
            self.sizes[i] = len(grams)
            for g in grams:
                lists[g].append(i)
        self.postings = {g: np.array(found, np.int32) for g, found in lists.items()}

    def jaccards(self, name: str) -> np.ndarray:
        """Jaccard similarity of one name's grams with those of each name."""
        grams = _padded_grams(name, self.n)
        both = np.zeros(len(self.sizes), np.int32)
        for g in grams:
            if (found := self.postings.get(g)) is not None:
                both[found] += 1
        return both / (len(grams) + self.sizes - both)


def _codes(names: list[str]) -> np.ndarray:
    """Characters of names of one length, a row for each place; bytes where they are enough."""
    codes = np.array([[ord(c) for c in s] for s in names], np.int32).T
    return np.ascontiguousarray(codes, np.uint8 if codes.max() < 256 else np.int32)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edit distances of every column of ``left`` with every one of ``right`` (``_codes``)."""
    (m, a), (n, b) = left.shape, right.shape
    kind = np.int8 if max(m, n) < 100 else np.int32
    row, one = [np.full((a, b), j, kind) for j in range(n + 1)], kind(1)
    spare, here, unlike = np.empty((a, b), kind), np.empty((a, b), kind), np.empty((a, b), bool)
    for i in range(m):
        before, row[0] = row[0], np.full((a, b), i + 1, kind)
        own = left[i][:, None]
        for j in range(n):
            np.not_equal(own, right[j][None], out=unlike)
            np.add(before, unlike.view(np.int8), out=here)
            np.minimum(row[j + 1], row[j], out=spare)
            spare += one
            np.minimum(spare, here, out=spare)
            before, row[j + 1], spare = row[j + 1], spare, before
    return row[n]


def _class_runs(shape: str) -> str:
    return "".join(c for c, _ in groupby(shape))


def _kinds(shape: str) -> list[tuple[str, int]]:
    return [(c, len(list(run))) for c, run in groupby(shape) if c != "_"]


def _edits_apart(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(before + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def _shape_parts(a: str, b: str, kind: str) -> tuple[float, float]:
    """``_comparable_parts`` or ``_listing_parts`` of two shapes (``class_shape``) that aren't empty."""
    share, under = abs(a.count("0") / len(a) - b.count("0") / len(b)), abs(a.count("_") - b.count("_"))
    length = abs(len(a) - len(b)) / max(len(a), len(b))
    if kind == "listing":
        return 0.08 * (1 - length), math.exp(-1.5 * share - 0.35 * under)
    x, y = _class_runs(a), _class_runs(b)
    damp = math.exp(-1.25 * length - 1.4 * share - 0.3 * under) * (0.65 + 0.35 * (1 - _edits_apart(x, y) / max(len(x), len(y))))
    x, y = _kinds(a), _kinds(b)
    apart = abs(len(x) - len(y)) + sum((p != q) + abs(m - n) / max(m, n) for (p, m), (q, n) in zip(x, y))
    return 0.06 * damp, damp * math.exp(-0.9 * apart / max(len(x), len(y), 1))


class NameIndex:
    """Distinct names, none empty, whose similarity (``kind`` as for ``scores_between``) to any other name is worked out for all of them at once."""

    def __init__(self, names: list[str], kind: str):
        self.kind, self.weights = kind, COMPARABLE_WEIGHTS if kind == "comparable" else LISTING_WEIGHTS
        self.grams = GramIndex(names, 2), GramIndex(names, 3)
        self.lengths = np.array([len(s) for s in names])
        self.by_length = [(int(n), at, _codes([names[i] for i in at])) for n in np.unique(self.lengths) for at in [np.flatnonzero(self.lengths == n)]]
        self.shapes, self.shape = np.unique([self._shape(s) for s in names], return_inverse=True)
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _shape(name: str) -> str:
        return "".join("a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else "_" if c == "_" else "?" for c in name)

    def _parts(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if (s := self._shape(name)) not in self.known:
            self.known[s] = tuple(np.array(x) for x in zip(*(_shape_parts(s, str(o), self.kind) for o in self.shapes)))
        return tuple(x[self.shape] for x in self.known[s])

    def similarities(self, targets: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        """Each target with its similarity to every name; targets come ordered by length."""
        most = max(1, 2_000_000 // len(self.lengths))  # targets of one length whose edits are kept at a time
        for m, same in groupby(sorted(targets, key=len), len):
            same = list(same)
            for first in range(0, len(same), most):
                some = same[first : first + most]
                codes, edits = _codes(some), np.empty((len(some), len(self.lengths)), np.int8 if max(m, self.lengths.max()) < 100 else np.int32)
                for n, at, of in self.by_length:
                    for i in range(0, len(some), step := max(1, _AT_ONCE // len(at))):
                        edits[i : i + step, at] = _distances(codes[:, i : i + step], of)
                for row, name in enumerate(some):
                    plus, damp = self._parts(name)
                    score = self.weights[0] * self.grams[0].jaccards(name) + self.weights[1] * self.grams[1].jaccards(name) + self.weights[2] * (1 - edits[row] / np.maximum(m, self.lengths))
                    yield name, np.clip((score + plus) * damp, 0.0, 1.0)
