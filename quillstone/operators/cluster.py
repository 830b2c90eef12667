"""Gaussian-mixture clusters with soft membership, and the tree of summaries built of them level by level.

How many clusters there are is told by the data: the number of the least Bayesian information criterion (BIC), without
a cap. In the tree, clusters that are still large are split again in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.shared import cut

#: Rows that one task clusters at once; larger tables are parted by bisecting k-means first. Parts up to so many times that are halved by one task each.
LOCAL = 2048
HALVED = 16
MOST_TASKS = 2000
#: Added to the diagonals of covariances, as a share of the mean variance.
REGULAR = 1e-4


def _points(rows: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """id and features, the first dim principal components, so that full covariances stay small."""
    points = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(F.col(vector)).alias("raw"))
    return PCA(k=dim, inputCol="raw", outputCol="features").fit(points).transform(points).select("id", "features")


def _bic(likelihood: float, k: int, n: int, dim: int) -> float:
    return (k * (1 + dim + dim * (dim + 1) / 2) - 1) * float(np.log(n)) - 2 * likelihood


def least(cost, most: int) -> int:
    """The k from 1 to most of least cost: k is doubled until the cost has risen twice running, then the best k's neighbours are halved upon."""
    known: dict[int, float] = {}

    def at(k: int) -> float:
        if k not in known:
            known[k] = cost(k)
        return known[k]

    best, k, risen = 1, 1, 0
    while k <= most and risen < 2:
        risen = 0 if at(k) <= at(best) else risen + 1
        best, k = (k if at(k) <= at(best) else best), k * 2
    step = best // 2
    while step:
        best = min((x for x in (best, best - step, best + step) if 1 <= x <= most), key=lambda x: (at(x), x))
        step //= 2
    return best


def soft_clusters(rows: DataFrame, *, k: int | None = None, threshold: float = 0.1, id_col: str = "vec_id", vector: str = "embedding", dim: int = 8, seed: int = 0) -> DataFrame:
    """id, cluster, probability of every membership above the threshold; a row may be in several clusters.

    Without k, it is that of least BIC.
    """
    points = _points(rows, id_col, vector, dim).persist()
    n, fits = points.count(), {}

    def cost(k: int) -> float:
        fits[k] = _fit(points, k, n, seed)
        return _bic(fits[k][1], k, n, dim)

    if not n:
        model = None
    elif k is None:
        model = fits[least(cost, n)][0]
    else:
        model = _fit(points, k, n, seed)[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            share = np.round(_shares(_rows(batch.column(1)), model)[0], 6)
            row, c = np.nonzero(share > threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(c.astype(np.int32)), pa.array(share[row, c])], ["id", "cluster", "probability"])

    found = points.select("id", vector_to_array("features").alias("x"))
    return found.mapInArrow(work, f"id {dict(points.dtypes)['id']}, cluster int, probability double")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _shares(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, float]:
    """(probability of each cluster for each row, log-likelihood) under (weights, means, lower factors of the covariances)."""
    weight, mean, low = model
    log = np.empty((len(x), len(weight)))
    for c in range(len(weight)):
        z = np.linalg.solve(low[c], (x - mean[c]).T)
        log[:, c] = np.log(weight[c]) - 0.5 * ((z * z).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(low[c])).sum()
    top = log.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(log - top).sum(axis=1, keepdims=True))
    return np.exp(log - total), float(total.sum())


def _fit(points: DataFrame, k: int, n: int, seed: int, rounds: int = 30) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """(model, log-likelihood) by EM from the centres of k-means; each task sends sums of its rows, as many numbers as the model has."""
    moments = points.select(Summarizer.mean(F.col("features")), Summarizer.variance(F.col("features"))).first()
    mean, variance = moments[0].toArray()[None], moments[1].toArray()
    if k > 1:
        mean = np.array(KMeans(k=k, seed=seed).fit(points).clusterCenters())
    k, d = mean.shape
    at, floor = moments[0].toArray(), np.eye(d) * max(REGULAR * float(variance.mean()), 1e-12)
    model = (np.full(k, 1 / k), mean, np.repeat(np.linalg.cholesky(np.diag(variance) / k ** (2 / d) + floor)[None], k, axis=0))
    sent, last = points.select(vector_to_array("features").alias("x")), -np.inf
    for _ in range(rounds):

        def work(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            out = np.zeros(1 + k * (1 + d + d * d))
            for batch in batches:
                if batch.num_rows:
                    x = _rows(batch.column(0))
                    share, own = _shares(x, model)
                    y = x - at
                    squares = np.stack([(y * share[:, [c]]).T @ y for c in range(k)])
                    out += np.concatenate([[own], share.sum(axis=0), (share.T @ y).ravel(), squares.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()])], ["sums"])

        sums = np.sum([r.sums for r in sent.mapInArrow(work, "sums array<double>").collect()], axis=0)
        if sums[0] - last < 1e-3 * n:
            return model, max(float(sums[0]), last)
        last, weight = float(sums[0]), sums[1 : 1 + k] + 1e-9
        y = sums[1 + k : 1 + k + k * d].reshape(k, d) / weight[:, None]
        covariance = sums[1 + k + k * d :].reshape(k, d, d) / weight[:, None, None] - y[:, :, None] * y[:, None, :]
        model = (weight / weight.sum(), y + at, np.linalg.cholesky(covariance + floor))
    return model, last


def _mixture(x: np.ndarray, k: int, seed: int, rounds: int = 30) -> tuple[np.ndarray, float]:
    """(cluster of each row, log-likelihood) of a mixture of k full Gaussians over the rows of one task, by EM from k-means++."""
    n, d = x.shape
    r = np.random.default_rng(seed)
    centre = x[[int(r.integers(n))]]
    far = ((x - centre) ** 2).sum(axis=1)
    while len(centre) < k and far.sum() > 0:
        centre = np.vstack([centre, x[[int(r.choice(n, p=far / far.sum()))]]])
        far = np.minimum(far, ((x - centre[-1]) ** 2).sum(axis=1))
    share = np.zeros((n, len(centre)))
    share[np.arange(n), ((x * x).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(axis=1)).argmin(axis=1)] = 1
    floor, last = np.eye(d) * max(REGULAR * float(x.var(axis=0).mean()), 1e-12), -np.inf
    for _ in range(rounds):
        weight = share.sum(axis=0) + 1e-9
        mean = (share.T @ x) / weight[:, None]
        low = np.stack([np.linalg.cholesky(((x - m) * share[:, [c]]).T @ (x - m) / weight[c] + floor) for c, m in enumerate(mean)])
        share, now = _shares(x, (weight / n, mean, low))
        if now - last < 1e-3 * n:
            break
        last = now
    return share.argmax(axis=1), now


def split(x: np.ndarray, most: int, seed: int = 0) -> np.ndarray:
    """A cluster's number for each row, by mixtures of least BIC; a cluster of more than most rows is split again, in two at least."""
    out, done, todo = np.zeros(len(x), np.int64), 0, [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out[rows], done = done, done + 1
            continue
        own = x[rows]
        k = least(lambda k: _bic(_mixture(own, k, seed)[1], k, len(own), own.shape[1]), len(own) // (own.shape[1] + 1))  # noqa: B023
        label = _mixture(own, max(2, k), seed)[0]
        if (label == label[0]).all():  # nothing tells them apart
            label = np.arange(len(rows)) * 2 // len(rows)
        todo += [rows[label == c] for c in np.unique(label)[::-1]]
    return out


def _halved(x: np.ndarray, most: int) -> np.ndarray:
    """The number of a part of at most so many rows for each row, by 2-means; by the median where that leaves one side small."""
    out, done, todo = np.zeros(len(x), np.int64), 0, [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out[rows], done = done, done + 1
            continue
        own = x[rows]
        along = own[:, own.var(axis=0).argmax()]
        right = along > along.mean()
        for _ in range(20):
            if right.all() or not right.any():
                break
            a, b = own[~right].mean(axis=0), own[right].mean(axis=0)
            was, right = right, own @ (b - a) > (b @ b - a @ a) / 2
            if (was == right).all():
                break
        if not len(rows) / 16 <= right.sum() <= len(rows) * 15 / 16:
            right = np.zeros(len(rows), bool)
            right[np.argsort(along, kind="stable")[len(rows) // 2 :]] = True
        todo += [rows[right], rows[~right]]
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return _rows(column.combine_chunks())


def _parted(points: DataFrame, seed: int) -> DataFrame:
    """id, part, x: parts of LOCAL rows at most."""
    points = cut(points.withColumn("part", F.lit("0")))
    most, many = LOCAL, LOCAL  # after the first round, what is still too large for one task is rare
    while large := {r.part: r["count"] for r in points.groupBy("part").count().where(F.col("count") > many).collect()}:
        out, held = points.where(~F.col("part").isin(list(large))), []
        for part, n in large.items():
            held.append(own := points.where(F.col("part") == part).persist())
            found = BisectingKMeans(k=2 * -(-n // LOCAL), seed=seed).fit(own).transform(own)
            if found.select("prediction").distinct().count() < 2:
                found = found.withColumn("prediction", F.pmod(F.xxhash64("id"), F.lit(2 * -(-n // LOCAL))))
            out = out.union(found.select("id", "features", F.concat("part", F.lit("."), F.col("prediction").cast("string"))))
        points, many = cut(out), HALVED * LOCAL
        for own in held:
            own.unpersist()
    left = points.groupBy("part").count().where(F.col("count") > most).limit(1).count()
    points = points.select("id", "part", vector_to_array("features").alias("x"))

    def halve(table: pa.Table) -> pa.Table:
        if len(table) <= most:
            return table
        table = table.sort_by("id")
        part = table["part"][0].as_py()
        return table.set_column(1, "part", pa.array([f"{part}.{c}" for c in _halved(_matrix(table["x"]), most)]))

    return cut(points.groupBy("part").applyInArrow(halve, points.schema)) if left else points


def clusters(rows: DataFrame, *, most: int, id_col: str = "vec_id", vector: str = "embedding", dim: int = 8, seed: int = 0) -> DataFrame:
    """id, cluster: one cluster for each row, of at most so many rows, as many clusters as that takes.

    Parts are few bytes and much work, so that they are spread by their number and not by their size.
    """
    points = _parted(_points(rows, id_col, vector, dim), seed)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        part = table["part"][0].as_py()
        return pa.table({"id": table["id"], "cluster": pa.array([f"{part}.{c}" for c in split(_matrix(table["x"]), most, seed)])})

    tasks = min(4 * -(-max(1, points.count()) // LOCAL), MOST_TASKS)
    return points.repartition(tasks, "part").groupBy("part").applyInArrow(work, f"id {dict(points.dtypes)['id']}, cluster string")


def tree(rows: DataFrame, *, levels: int = 2, per_cluster: int = 10, id_col: str = "vec_id", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """node, parent, level of a tree whose leaves are the rows: each level clusters the centres of the one before.

    A leaf is named by its id, a cluster by its level and number. No cluster has more than 2 * per_cluster members,
    however many rows there are; as few as that, and the tree ends.
    """
    nodes = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("string").alias("node"), F.col(vector).cast("array<double>").alias("v"))
    width = nodes.select(F.size("v")).first()
    if width is None:
        return nodes.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"))
    parts = []
    for level in range(levels + 1):
        if level == levels or nodes.count() < 2 * per_cluster:
            parts.append(nodes.select("node", F.lit(None).cast("string").alias("parent"), F.lit(level).alias("level")))
            break
        best = clusters(nodes, most=2 * per_cluster, id_col="node", vector="v", seed=seed)
        named = cut(nodes.join(best, F.col("node") == F.col("id")).select("node", "v", F.concat(F.lit(f"L{level + 1}-"), "cluster").alias("parent")))
        parts.append(named.select("node", "parent", F.lit(level).alias("level")))
        means = named.groupBy("parent").agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(width[0])])
        nodes = cut(means.select(F.col("parent").alias("node"), F.array(*[F.col(f"m{i}") for i in range(width[0])]).alias("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def ancestors(adjacency: DataFrame, root: str) -> DataFrame:
    """node, depth of all that hang below a root of (node, parent), by a recursive query."""
    adjacency.createOrReplaceTempView("_quillstone_adjacency")
    return adjacency.sparkSession.sql(
        "WITH RECURSIVE t(node, depth) AS (SELECT node, 0 FROM _quillstone_adjacency WHERE node = :root UNION ALL SELECT a.node, t.depth + 1 FROM t JOIN _quillstone_adjacency a ON a.parent = t.node) SELECT node, depth FROM t",
        args={"root": root},
    )
