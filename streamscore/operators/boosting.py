"""Second-order histogram boosting for a binary label, as Spark aggregations.

Features are cut into at most 256 bins by quantiles once. A tree then needs one pass
over the rows per level: every task adds up gradients, curvatures and rows per node,
feature and bin, Spark sums these cells, and the best cuts are chosen from the sums.
What reaches the driver is bounded by nodes x features x bins, whatever the rows are.
Rows that are few enough for one task need no sums of others: their task grows the trees
between two stored margins in one go, the same ones to the bit.
Gradients are whole multiples of 2^-24, so sums do not depend on how rows are dealt, and
a pass that is run again after the loss of an executor gives the same tree.

A tree is grown level by level to its depth and then taken best cut first up to its
number of leaves, which is the same as growing it leaf by leaf, since the gain of a node
depends on its own rows only.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasMaxIter
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from streamscore.sources.storage import drop_stored, stored

BINS = 256
UNIT = 2.0**24

# Margins are stored after so many trees; in between, tasks add the newest trees themselves.
STORED_EVERY = 10

# One task holds about so many rows of some 26 bytes; fewer rows are one task, whose sums need no shuffle.
ROWS_PER_TASK = 1_000_000

CELLS = "cell bigint, gradient bigint, curvature bigint, n bigint"

# Rows are kept in chunks, one per Arrow batch they came in, of a byte per bin and doubles:
# a pass then hands few values over to Python instead of a dozen per row.
CHUNK = "bins binary, label binary, margin binary"


def _descend(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node in which every row (a column of `bins`) ends."""
    feature, cut, left = (np.asarray(tree[k]) for k in ("feature", "cut", "left"))
    # A leaf leads to itself: no bin is above its cut.
    leaf, size = feature < 0, bins.shape[1]
    left = np.where(leaf, np.arange(len(left)), left)
    cut = np.where(leaf, BINS, cut).astype(np.int16)
    start = np.where(leaf, 0, feature) * size
    flat, rows = bins.reshape(-1), np.arange(size)
    node = np.zeros(size, dtype=np.int64)
    for _ in range(tree["depth"]):
        node = left.take(node) + (flat.take(start.take(node) + rows) > cut.take(node))
    return node


def _gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - label) * UNIT), np.rint(p * (1.0 - p) * UNIT)


def _chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bins (a row per feature), labels and margins of every chunk."""
    for batch in batches:
        for row in range(batch.num_rows):
            bins, label, margin = (batch.column(c)[row].as_buffer() for c in ("bins", "label", "margin"))
            yield np.frombuffer(bins, np.uint8).reshape(n, -1), np.frombuffer(label), np.frombuffer(margin)


def _chunk(bins: np.ndarray, label: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (bins, label, margin)]
    return pa.RecordBatch.from_arrays(columns, ["bins", "label", "margin"])


def _moved(margin: np.ndarray, bins: np.ndarray, trees: list[dict]) -> np.ndarray:
    for tree in trees:
        margin = margin + np.asarray(tree["value"])[_descend(tree, bins)]
    return margin


def _sums(
    parts: Iterable[tuple], n: int, width: int, growing: dict, open_nodes: list[int]
) -> np.ndarray:
    """Gradients, curvatures and rows of chunks, summed per open node, feature and bin (of `width`)."""
    many = len(open_nodes)
    # Rows in closed nodes are added up behind the open ones and left out.
    place = np.full(len(growing["feature"]), many * width, dtype=np.int64)
    place[open_nodes] = np.arange(many) * width
    sums = np.zeros((3, many, n, width), dtype=np.int64)
    for bins, gradient, curvature in parts:
        at = place.take(_descend(growing, bins))
        for i in range(n):
            cell = at + bins[i]
            for s, weights in enumerate((gradient, curvature, None)):
                cells = np.bincount(cell, weights, (many + 1) * width)[: many * width]
                sums[s, :, i] += np.rint(cells).astype(np.int64).reshape(many, width)
    return sums


def _named(sums: np.ndarray) -> dict:
    return {name: s / unit for s, name, unit in zip(sums, "ghn", (UNIT, UNIT, 1.0), strict=True)}


def _cells(rows: DataFrame, n: int, trees: list[dict], growing: dict, open_nodes: list[int]) -> dict:
    """Sums per open node, feature and bin: three arrays of that shape."""
    size = len(open_nodes) * n * BINS

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (
            (bins, *_gradients(_moved(margin, bins, trees), label))
            for bins, label, margin in _chunks(batches, n)
        )
        sums = _sums(parts, n, BINS, growing, open_nodes).reshape(3, size)
        used = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(s[used]) for s in sums)], ["cell", "gradient", "curvature", "n"]
        )

    summed = rows.mapInArrow(add_up, CELLS).groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in ("gradient", "curvature", "n")]
    )
    out = np.zeros((3, size), dtype=np.int64)
    table = summed.toArrow()
    cell = table["cell"].to_numpy()
    for s, name in enumerate(("gradient", "curvature", "n")):
        out[s, cell] = table[name].to_numpy()
    return _named(out.reshape(3, len(open_nodes), n, BINS))


def _of_one_task(rows: DataFrame, n: int, many: int, growth: dict) -> list[dict]:
    """The next `many` trees, or those up to the last one, of rows that are one task.

    Nobody else has sums to add, so the task goes on from level to level and tree to tree
    by itself, where `_cells` takes a job for every level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, trees = list(_chunks(batches, n)), []
        if chunks:  # many small chunks would take longer than their rows
            chunks = [tuple(np.concatenate(x, axis=-1) for x in zip(*chunks, strict=True))]
        while len(trees) < many and not (trees and _settled(trees[-1])):
            parts = [(bins, *_gradients(margin, label)) for bins, label, margin in chunks]
            tree = grow(lambda t, nodes: _named(_sums(parts, n, BINS, t, nodes)), **growth)  # noqa: B023
            trees.append(tree)
            chunks = [(bins, label, _moved(margin, bins, [tree])) for bins, label, margin in chunks]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(t) for t in trees], pa.string())], ["tree"])

    return [json.loads(row["tree"]) for row in rows.mapInArrow(run, "tree string").collect()]


def _settled(tree: dict) -> bool:
    """No cut was found, and margins would move by less than a millionth."""
    return tree["feature"][0] < 0 and abs(tree["value"][0]) < 1e-6


def best_cut(g, h, n, l2: float, min_curvature: float, min_rows: int) -> dict | None:
    """The cut of highest gain out of sums per feature and bin; ties: first feature, lowest bin."""
    total_g, total_h, total_n = g[0].sum(), h[0].sum(), n[0].sum()
    left_g, left_h, left_n = (np.cumsum(x, axis=1) for x in (g, h, n))
    right_g, right_h, right_n = total_g - left_g, total_h - left_h, total_n - left_n
    allowed = (left_n >= max(min_rows, 1)) & (right_n >= max(min_rows, 1))
    allowed &= (left_h >= min_curvature) & (right_h >= min_curvature)
    # Without a penalty, a side may have no curvature left.
    score = lambda a, b: a * a / np.maximum(b + l2, 1e-16)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)
    gain = np.where(allowed, gain, -np.inf)
    feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[feature, cut] > 1e-6:
        return None
    at = feature, cut
    return {
        "feature": int(feature),
        "cut": int(cut),
        "gain": float(gain[at]),
        "sides": [(left_g[at], left_h[at]), (right_g[at], right_h[at])],
    }


def _keep_best(tree: dict, gains: list[float], max_leaves: int) -> None:
    """Close all nodes that leaf-wise growth would not have reached."""
    heap, opened = [(-gains[0], 0)] if tree["feature"][0] >= 0 else [], set()
    while heap and len(opened) + 1 < max_leaves:
        _, node = heapq.heappop(heap)
        opened.add(node)
        for child in (tree["left"][node], tree["left"][node] + 1):
            if tree["feature"][child] >= 0:
                heapq.heappush(heap, (-gains[child], child))
    tree["feature"] = [f if i in opened else -1 for i, f in enumerate(tree["feature"])]


def grow(cells_of, depth: int, max_leaves: int, step: float, l2: float, min_curvature: float, min_rows: int) -> dict:
    """One tree; `cells_of(tree, open_nodes)` gives the sums of a level.

    Children of a node are `left` and `left + 1`; rows with a bin up to `cut` go left.
    """
    tree = {"feature": [-1], "cut": [0], "left": [0], "value": [0.0], "depth": 0}
    gains, open_nodes = [0.0], [0]
    value = lambda g, h: float(-step * g / max(h + l2, 1e-16))
    for level in range(depth):
        cells = cells_of(tree, open_nodes)
        if level == 0:
            tree["value"][0] = value(cells["g"][0, 0].sum(), cells["h"][0, 0].sum())
        following = []
        for i, node in enumerate(open_nodes):
            found = best_cut(cells["g"][i], cells["h"][i], cells["n"][i], l2, min_curvature, min_rows)
            if found is None:
                continue
            first = len(tree["feature"])
            tree["feature"][node], tree["cut"][node], tree["left"][node] = found["feature"], found["cut"], first
            gains[node] = found["gain"]
            for side in found["sides"]:
                for name, v in (("feature", -1), ("cut", 0), ("left", 0), ("value", value(*side))):
                    tree[name].append(v)
                gains.append(0.0)
            following += [first, first + 1]
        if not following:
            break
        tree["depth"], open_nodes = level + 1, following
    _keep_best(tree, gains, max_leaves)
    return tree


def bin_edges(rows: DataFrame, inputs: list[str]) -> tuple[list[list[float]], int]:
    """Cuts of every feature, at most 255, and the number of rows.

    A value up to cut k and above cut k-1 has bin k.
    """
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    value = lambda c: F.col(f"`{c}`").cast("double")
    row = rows.agg(
        *[F.percentile_approx(value(c), shares, 10_000).alias(f"q{i}") for i, c in enumerate(inputs)],
        *[F.count_if(value(c).isNull() | F.isnan(value(c))).alias(f"m{i}") for i, c in enumerate(inputs)],
        *[F.max(value(c)).alias(f"x{i}") for i, c in enumerate(inputs)],
        F.count(F.lit(1)).alias("n"),
    ).first()
    missing = [c for i, c in enumerate(inputs) if row[f"m{i}"]]
    if missing:
        raise ValueError(f"missing values in {', '.join(missing)}")
    edges = [sorted({q for q in row[f"q{i}"] or [] if q < row[f"x{i}"]}) for i in range(len(inputs))]
    return edges, row["n"]


def _binned(rows: DataFrame, inputs: list[str], label: str, edges: list[list[float]], base: float) -> DataFrame:
    plain = rows.select(
        *[F.col(f"`{c}`").cast("double").alias(f"b{i}") for i, c in enumerate(inputs)],
        F.col(f"`{label}`").cast("double").alias("label"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = [np.searchsorted(e, batch.column(i).to_numpy()).astype(np.uint8) for i, e in enumerate(edges)]
                yield _chunk(np.stack(bins), batch.column("label").to_numpy(), np.full(batch.num_rows, base))

    return plain.mapInArrow(cut, CHUNK)


def _with_margins(rows: DataFrame, n: int, trees: list[dict]) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, label, margin in _chunks(batches, n):
            yield _chunk(bins, label, _moved(margin, bins, trees))

    return rows.mapInArrow(add, CHUNK)


def _held(rows: DataFrame, tasks: int) -> DataFrame:
    """Written to the shared folder, so that lost executors cost one read, and kept in memory."""
    kept = stored(rows, "boosting")
    dealt = kept.repartition(tasks) if tasks > 1 else kept.coalesce(1)
    return dealt.persist(StorageLevel.MEMORY_AND_DISK)


def _let_go(rows: DataFrame) -> None:
    rows.unpersist()
    drop_stored(rows)


def _tree_sql(tree: dict, edges: list[list[float]], inputs: list[str], at: int = 0) -> str:
    if tree["feature"][at] < 0:
        return f"{tree['value'][at]!r}D"
    f, left = tree["feature"][at], tree["left"][at]
    sides = [_tree_sql(tree, edges, inputs, child) for child in (left, left + 1)]
    return f"CASE WHEN {inputs[f]} <= {edges[f][tree['cut'][at]]!r}D THEN {sides[0]} ELSE {sides[1]} END"


def probability_sql(ensemble: dict, inputs: list[str]) -> str:
    """Probability of class 1 as SQL text over the SQL texts of the features."""
    trees = [_tree_sql(t, ensemble["edges"], inputs) for t in ensemble["trees"]]
    base = f"{ensemble['base']!r}D"
    margin = f"aggregate(array({', '.join(trees)}), {base}, (total, tree) -> total + tree)" if trees else base
    return f"1D / (1D + exp(-({margin})))"


class _BoostingParams(HasInputCols, HasLabelCol, HasMaxIter):
    def _param(name: str, doc: str, converter):  # noqa: N805
        return Param(Params._dummy(), name, doc, typeConverter=converter)

    maxDepth = _param("maxDepth", "most cuts on the way to a leaf", TypeConverters.toInt)
    maxLeaves = _param("maxLeaves", "most leaves of a tree", TypeConverters.toInt)
    stepSize = _param("stepSize", "share of a leaf's value that counts", TypeConverters.toFloat)
    l2 = _param("l2", "penalty added to a leaf's curvature", TypeConverters.toFloat)
    minCurvature = _param("minCurvature", "least curvature of a leaf", TypeConverters.toFloat)
    minRows = _param("minRows", "fewest rows of a leaf", TypeConverters.toInt)


class BoostedTrees(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over numeric columns; missing values are an error, as for the other families.

    `rounds` is the parameter `maxIter`, named as in Spark's own boosted trees. Stops before
    it once a round finds no cut and would move margins by less than a millionth. Without
    rows or with one class only, all scores are the class share (kept within a millionth of
    0 and 1).
    """

    @keyword_only
    def __init__(
        self, *, inputCols=None, labelCol="label", rounds=200, maxDepth=4, maxLeaves=31, stepSize=0.1,
        l2=0.0, minCurvature=1e-3, minRows=20,
    ):
        super().__init__()
        self._set(**{k: v for k, v in {"labelCol": labelCol, "maxIter": rounds, "maxDepth": maxDepth,
            "maxLeaves": maxLeaves, "stepSize": stepSize, "l2": l2, "minCurvature": minCurvature,
            "minRows": minRows, "inputCols": inputCols}.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        get = self.getOrDefault
        inputs, label = self.getInputCols(), self.getLabelCol()
        n = len(inputs)
        edges, count = bin_edges(dataset, [*inputs, label])
        edges = edges[:n]
        tasks = max(1, math.ceil(count / ROWS_PER_TASK))
        share = dataset.agg(F.avg(F.col(f"`{label}`").cast("double"))).first()[0]
        share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        base = math.log(share / (1 - share))
        trees: list[dict] = []
        growth = {
            "depth": get("maxDepth"), "max_leaves": get("maxLeaves"), "step": get("stepSize"), "l2": get("l2"),
            "min_curvature": get("minCurvature"), "min_rows": get("minRows"),
        }
        rows, fresh = _held(_binned(dataset, inputs, label, edges, base), tasks), 0
        try:
            while len(trees) < (rounds := self.getMaxIter()):
                if fresh == STORED_EVERY:
                    older, rows = rows, _held(_with_margins(rows, n, trees[-fresh:]), tasks)
                    _let_go(older)
                    fresh = 0
                newest = trees[len(trees) - fresh :]
                if tasks == 1:
                    found = _of_one_task(rows, n, min(STORED_EVERY, rounds - len(trees)), growth)
                else:
                    found = [grow(lambda t, nodes: _cells(rows, n, newest, t, nodes), **growth)]  # noqa: B023
                done = not found or _settled(found[-1])
                trees += found[:-1] if done else found
                fresh += len(found)
                if done:
                    break
        finally:
            _let_go(rows)
        model = BoostedTreesModel(json.dumps({"base": base, "edges": edges, "trees": trees}))
        return self._copyValues(model._set(inputCols=inputs, labelCol=label))


class BoostedTreesModel(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability` and `prediction`; all trees are one column expression."""

    ensemble = Param(Params._dummy(), "ensemble", "base, edges and trees as JSON", TypeConverters.toString)

    def __init__(self, ensemble: str | None = None):
        super().__init__()
        if ensemble is not None:
            self._set(ensemble=ensemble)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        inputs = [f"CAST(`{c}` AS DOUBLE)" for c in self.getInputCols()]
        positive = F.expr(probability_sql(json.loads(self.getOrDefault("ensemble")), inputs))
        return (
            dataset.withColumn("_positive", positive)
            .withColumn("probability", array_to_vector(F.array(1 - F.col("_positive"), "_positive")))
            .withColumn("prediction", (F.col("_positive") > 0.5).cast("double"))
            .drop("_positive")
        )
