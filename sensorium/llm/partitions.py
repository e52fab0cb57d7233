"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into parts of equal size, and
a small network learns where a vector's neighbours lie. Every vector is filed under its
most probable part; a query goes to as many of its most probable parts as the sample
needs for the wanted recall, and is compared with all their vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorium.llm.base import Scratch, pick

SAMPLE = 8_000


def neighbours(data: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The ``k`` rows of largest inner product with each row, itself left out."""
    out = []
    for a in range(0, len(data), block):
        score = data[a : a + block] @ data.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        near = np.argpartition(-score, min(k, len(data) - 1) - 1, 1)[:, :k]
        out.append(np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), 1), 1))
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cut a neighbour graph into parts of equal size by repeated bisection.

    A half is the lower half of the second eigenvector of the smoothed graph, found by
    power iteration; swaps of the best moves of both sides then lessen the cut.
    """
    source = np.repeat(np.arange(len(graph)), graph.shape[1])
    target = graph.ravel()
    label = np.zeros(len(graph), np.int64)

    def halve(rows: np.ndarray, share: float) -> np.ndarray:
        place = np.full(len(graph), -1)
        place[rows] = np.arange(len(rows))
        inside = (place[source] >= 0) & (place[target] >= 0)
        a, b = place[source[inside]], place[target[inside]]
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        degree = np.bincount(a, minlength=len(rows)) + 1e-9
        v = rng.standard_normal(len(rows))
        for _ in range(60):
            v = 0.5 * v + 0.5 * np.bincount(a, v[b], len(rows)) / degree
            v -= (v * degree).sum() / degree.sum()
            v /= np.linalg.norm(v) + 1e-12
        low = np.zeros(len(rows), bool)
        low[np.argsort(v, kind="stable")[: round(len(rows) * share)]] = True
        for _ in range(10):
            gain = np.bincount(a, np.where(low[a] == low[b], -1.0, 1.0), len(rows))
            ins, outs = np.flatnonzero(~low), np.flatnonzero(low)
            ins, outs = ins[np.argsort(-gain[ins], kind="stable")], outs[np.argsort(-gain[outs], kind="stable")]
            n = min(len(ins), len(outs))
            swap = np.flatnonzero(gain[ins[:n]] + gain[outs[:n]] > 2)[: max(1, n // 20)]
            if not len(swap):
                break
            low[ins[swap]], low[outs[swap]] = True, False
        return low

    work = [(np.arange(len(graph)), 0, parts)]
    while work:
        rows, first, count = work.pop()
        if count == 1 or len(rows) < 2:
            label[rows] = first
            continue
        left = count // 2
        low = halve(rows, left / count)
        work += [(rows[low], first, left), (rows[~low], first + left, count - left)]
    return label


@dataclass
class Router:
    """A network with one hidden layer; ``probes`` parts are searched for a query."""

    layers: list[np.ndarray]
    probes: int
    scale: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(x * self.scale @ w1 + b1, 0) @ w2 + b2


def fit(sample: np.ndarray, parts: int, k: int = 20, recall: float = 0.95, hidden: int = 128, epochs: int = 15, seed: int = 7) -> Router:
    """Cut the sample's graph, learn the parts of each vector's neighbours, and choose the probes."""
    rng = np.random.default_rng(seed)
    sample = sample.astype(np.float32)
    scale = float(1 / max(1e-12, np.sqrt((sample.astype(float) ** 2).sum(1).mean()) / np.sqrt(sample.shape[1])))
    shapes = ((sample.shape[1], hidden), (hidden,), (hidden, parts), (parts,))
    layers = [rng.standard_normal(s).astype(np.float32) * (np.sqrt(2 / s[0]) if len(s) > 1 else 0) for s in shapes]
    if len(sample) < max(4 * parts, 2 * k):
        return Router(layers, parts, scale)
    near = neighbours(sample, k)
    label = balanced_parts(near[:, :10], parts, rng)
    want = np.zeros((len(sample), parts), np.float32)
    np.add.at(want, (np.repeat(np.arange(len(sample)), near.shape[1]), label[near].ravel()), 0.5 / near.shape[1])
    want[np.arange(len(sample)), label] += 0.5
    test = rng.permutation(len(sample))
    held, train = test[: min(1000, len(test) // 5)], test[min(1000, len(test) // 5) :]
    m, v, t = [0 * x for x in layers], [0 * x for x in layers], 0
    router = Router(layers, parts, scale)
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
            x = sample[batch] * scale
            w1, b1, w2, b2 = layers
            h = np.maximum(x @ w1 + b1, 0)
            z = h @ w2 + b2
            p = np.exp(z - z.max(1, keepdims=True))
            dz = (p / p.sum(1, keepdims=True) - want[batch]) / len(batch)
            dh = (dz @ w2.T) * (h > 0)
            t += 1
            rate = 0.003 * (1 - epoch / epochs)
            for k_, g in enumerate((x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[k_] = 0.9 * m[k_] + 0.1 * g
                v[k_] = 0.99 * v[k_] + 0.01 * g * g
                layers[k_] -= rate * (m[k_] / (1 - 0.9**t)) / (np.sqrt(v[k_] / (1 - 0.99**t)) + 1e-8)
    # all rows are filed by the network, so the held vectors' neighbours are too
    filed = router.logits(sample).argmax(1)
    order = np.argsort(-router.logits(sample[held]), 1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None].repeat(len(held), 0), 1)
    found = np.bincount(np.take_along_axis(rank, filed[near[held]], 1).ravel(), minlength=parts).cumsum() / (len(held) * near.shape[1])
    router.probes = int(np.searchsorted(found, recall) + 1)
    return router


def sound(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, parts: int | None = None, recall: float = 0.95, sample: int = SAMPLE, block: int = 4096) -> DataFrame:
    """The ``k`` nearest vectors found for each query: ``query_id, rank, vec_id, score``.

    ``queries`` is a condition on the column ``id``; candidates are all rows of another id.
    Score: inner product in double precision; ties to the smaller id. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do those of another than the
    most frequent dimension. Equal vectors are compared once: their ``k + 1`` smallest ids
    stand for them, which no query can exhaust; repeated rows of one id and vector count once.
    ``parts``: by default one for 4,096 rows, 16 to 1,024. The router is fitted on at most
    ``sample`` vectors (smallest hashed ids). A part is compared in tiles of ``block`` vectors
    and queries, so no task holds a whole part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = pick(vectors, id=id_column, vector=vector_column).filter(F.col("id").isNotNull() & sound(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x.cast("double") + 0.0))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, vec_id {rows.schema['id'].dataType.simpleString()}, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dimension = sizes["d"]
    rows = rows.filter(F.size("vector") == dimension)
    # different vectors, with their smallest ids; the limit is applied before the shuffle
    few = rows.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("nth") <= k + 1)
    points = scratch.keep(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("key", F.monotonically_increasing_id()))
    total = points.count()
    parts = parts or max(16, min(1024, total // 4096))
    picked = points.select("vector", F.xxhash64(F.col("ids")[0].cast("string")).alias("h")).orderBy("h").limit(sample).select("vector").toArrow().column(0)
    router = spark.sparkContext.broadcast(fit(np.array(picked.combine_chunks().flatten().to_numpy()).reshape(-1, dimension), parts, k, recall))

    @F.arrow_udf("array<int>")
    def route(vector: pa.Array) -> pa.Array:
        x = vector.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
        probes = min(router.value.probes, parts)
        order = np.argsort(-router.value.logits(x), 1, kind="stable")[:, :probes].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, probes, dtype=np.int32)), pa.array(order.ravel()))

    asked = rows.filter(queries).select("id", "vector").distinct()
    routed = scratch.keep(points.select("key", "vector", F.col("ids")[0].alias("least"), route("vector").alias("parts")))
    filed = routed.select("key", "vector", "least", F.col("parts")[0].alias("part"))
    named = scratch.keep(asked.join(points.select("vector", "key"), "vector").select("id", "key"))
    sent = scratch.keep(named.select("key").distinct()).join(routed, "key").select("key", "vector", F.explode("parts").alias("part"))
    # numbers of tiles of each part: a small table, parts rows
    load = filed.groupBy("part").agg(F.count("*").alias("n")).join(sent.groupBy("part").agg(F.count("*").alias("q")), "part")
    load = F.broadcast(scratch.keep(load.select("part", F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil(F.col("q") / block).cast("int").alias("qb"))))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    left = filed.join(load, "part").select("key", "vector", "least", "part", own("nb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"))
    right = sent.join(load, "part").select(
        F.col("key").alias("key2"), F.col("vector").alias("vector2"), F.col("part").alias("part2"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i2"), own("qb").alias("j2")
    )

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        return np.array(table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dimension)

    def compare(points_: pa.Table, queries_: pa.Table) -> pa.Table:
        out = [[], [], []]
        if points_.num_rows and queries_.num_rows:
            data, asked_ = matrix(points_, "vector"), matrix(queries_, "vector2")
            least, keys, names = (np.array(t.column(c)) for t, c in ((points_, "least"), (points_, "key"), (queries_, "key2")))
            for a in range(0, len(asked_), 256):
                score = asked_[a : a + 256] @ data.T
                cut = -np.partition(-score, min(k, score.shape[1] - 1), 1)[:, min(k, score.shape[1] - 1)]
                for q, line in enumerate(score):
                    best = np.flatnonzero(line >= cut[q])
                    best = best[np.lexsort((least[best], -line[best]))][: k + 1]
                    out[0].append(np.full(len(best), names[a + q]))
                    out[1].append(keys[best])
                    out[2].append(line[best])
        flat = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, float), strict=True)]
        return pa.table(dict(zip(("query", "key", "score"), flat, strict=True)))

    met = left.groupBy("part", "i", "j").cogroup(right.groupBy("part2", "i2", "j2")).applyInArrow(compare, "query long, key long, score double")
    ids = points.select("key", "ids")
    # tie break by the smallest id, as in the tiles
    met = scratch.keep(met).join(ids, "key")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    short = scratch.keep(met.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).select("query", "ids", "score"))
    full = named.select(F.col("id").alias("query_id"), F.col("key").alias("query")).join(short, "query")
    full = full.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return full.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
