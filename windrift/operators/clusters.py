"""The clustering study: imputing, standardising, k-means, silhouette, profiles, PCA, a surrogate tree and linkage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.functions.values import rounded

#: The features of an axis.
AXES = {
    "pressure": ("iqrRatio", "cv", "gustFactor", "lullPeakSpread", "windRange"),
    "shift": ("rollingShiftFrequency", "circularStdDev", "detrendedCircularStdDev"),
    "regularity": ("oscillationRegularity", "phasePersistence"),
    "trend": ("directionTrendDeg", "speedTrendSlope"),
    "coherence": ("pressureShiftCorrelation", "speedDirectionCoherence"),
}
#: Weights of the axes; "low" is the smaller of pressure and shift, "apart" their distance.
ARCHETYPES = {
    "Connect the Dots": {"pressure": 2.2, "shift": -1.2, "regularity": -0.8, "trend": -0.3},
    "Inside Track": {"shift": 2.0, "regularity": 1.3, "pressure": -1.2},
    "Outside Track": {"trend": 1.8, "pressure": 0.5, "shift": 0.3, "regularity": -0.4},
    "Edge Out": {"low": 1.6, "pressure": 0.5, "shift": 0.5, "apart": -0.7},
    "Uncertain": {"regularity": -1.4, "coherence": -0.8, "trend": -0.3},
}


#: Rows that average linkage takes one by one: a matrix of 4 LINKED^2 distances (128 MB) in one task.
LINKED = 2000


def merge_features(calibrated: DataFrame, core: DataFrame, derived: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each feature from the first of the three (by session_id) that has it; 6 decimals. A row that still lacks one raises."""
    rows = derived.alias("d").join(core.alias("c"), "session_id", "left").join(calibrated.alias("e"), "session_id", "left")
    has = lambda t, df, n: [F.col(f"{t}.`{n}`")] if n in df.columns else []
    value = lambda n: rounded(F.coalesce(*has("e", calibrated, n), *has("c", core, n), *has("d", derived, n)))
    must = lambda n: F.coalesce(value(n), F.raise_error(F.concat(F.lit(f"{n} is missing: "), F.col("session_id"))).cast("double"))
    return rows.select("session_id", F.col("d.venue").alias("venue"), *[must(n).alias(n) for n in names])


def impute_sessions(sessions: DataFrame, names: Sequence[str], prefix: int = 4) -> DataFrame:
    """Sessions whose features are null (``available`` false) take those of the first available session, by id, with the same ``prefix`` letters; else the means.

    ``imputed_from`` is that session, or "means". A venue of Other is taken over too. One row for each prefix is joined,
    however many sessions share it.
    """
    p = F.substring("session_id", 1, prefix)
    there = sessions.where("available")
    companion = there.groupBy(p.alias("p")).agg(F.min(F.struct("session_id", "venue", *names)).alias("c"))
    means = there.agg(*[F.avg(n).alias(n) for n in names])
    rows = sessions.withColumn("p", p).join(companion, "p", "left").crossJoin(F.broadcast(means.select(F.struct("*").alias("m"))))
    take = lambda n: F.when(F.col("available"), F.col(n)).otherwise(F.coalesce(F.col(f"c.{n}"), F.col(f"m.{n}")))
    source = F.when(~F.col("available"), F.coalesce("c.session_id", F.lit("means")))
    venue = F.when(~F.col("available") & (F.col("venue") == "Other"), F.coalesce("c.venue", "venue")).otherwise(F.col("venue"))
    return rows.select("session_id", venue.alias("venue"), *[take(n).alias(n) for n in names], source.alias("imputed_from"))


def zscore(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns less their mean, over their population standard deviation (1 where that is 0)."""
    stats = features.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    rows = features.crossJoin(F.broadcast(stats))
    spread = lambda n: F.when(F.col(f"s_{n}") == 0, 1.0).otherwise(F.col(f"s_{n}"))
    keep = [c for c in features.columns if c not in names]
    return rows.select(*keep, *[((F.col(n) - F.col(f"m_{n}")) / spread(n)).alias(n) for n in names])


def _vector(names: Sequence[str] | str) -> Column:
    return array_to_vector(F.col(names) if isinstance(names, str) else F.array(*names)).alias("features")


#: Fits that run at once; each is a row of small jobs, which leave a cluster idle one after the other.
AT_ONCE = 8
#: Bytes of vectors in a block of the exact silhouette; two blocks are in a task at once.
BLOCK_BYTES = 4 << 20
#: Rows of a cluster that a silhouette's distances are taken to, their shares for its error, and the most bytes of all of them.
PARTNERS, REPLICAS, PARTNER_BYTES = 256, 8, 64 << 20


@contextmanager
def _kept(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` dealt out and kept while fits and silhouettes read them many times."""
    rows = rows.repartition(min(AT_ONCE, rows.sparkSession.sparkContext.defaultParallelism)) if rows.rdd.getNumPartitions() == 1 else rows
    rows = rows.persist()
    try:
        rows.count()
        yield rows
    finally:
        rows.unpersist()


def _best_fits(rows: DataFrame, ks: Sequence[int], seeds: Sequence[int], max_iter: int) -> dict[int, KMeansModel]:
    """The model with the smallest cost of the starts of each k; of equal ones that of the first seed."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        models = list(pool.map(lambda x: (x[0], KMeans(k=x[0], seed=x[1], maxIter=max_iter).fit(rows)), [(k, s) for k in ks for s in seeds]))
    return {k: min((m for n, m in models if n == k), key=lambda m: m.summary.trainingCost) for k in ks}


def kmeans_best(z: DataFrame, names: Sequence[str] | str, k: int = 4, seeds: Sequence[int] = range(1, 25), max_iter: int = 60) -> KMeansModel:
    """The model with the smallest cost of several starts."""
    with _kept(z.select(_vector(names))) as rows:
        return _best_fits(rows, [k], seeds, max_iter)[k]


def k_scan(z: DataFrame, names: Sequence[str] | str, ks: Sequence[int] = range(2, 7), seeds: Sequence[int] = range(1, 13), max_iter: int = 40, partners: int = PARTNERS) -> DataFrame:
    """(k, inertia, silhouette, error, by_cluster): the Euclidean silhouette of all rows with its standard error, and of each cluster's rows (map).

    A row's distances are those to all rows of a cluster of up to ``partners``, else to so many of it (``sampled_silhouette``); the error is 0 if no cluster has more.
    """
    with _kept(z.select(_vector(names))) as rows:
        models = _best_fits(rows, ks, seeds, max_iter)

        def judged(k: int) -> tuple:
            labelled = models[k].transform(rows).select(F.col("prediction").alias("cluster_id"), vector_to_array("features").alias("z"))
            per = silhouette_summary(sampled_silhouette(labelled, partners=partners)).collect()  # k rows and one of all
            whole = next((r for r in per if r.cluster_id is None), None)
            value, error = (float(whole.silhouette), float(whole.error)) if whole else (0.0, 0.0)
            return k, float(models[k].summary.trainingCost), value, error, {int(r.cluster_id): float(r.silhouette) for r in per if r.cluster_id is not None}

        with ThreadPoolExecutor(AT_ONCE) as pool:
            out = list(pool.map(judged, ks))
    return z.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double, error double, by_cluster map<int, double>")


def _partners(labelled: DataFrame, n: int) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """The size of each cluster and the vectors of up to ``n`` of its rows, drawn alike from all of them whatever their vectors are."""
    sizes = {r.cluster_id: r["count"] for r in labelled.groupBy("cluster_id").count().collect()}  # a row for each cluster
    # Spark keeps the first n of each cluster in every task before it shuffles.
    drawn = labelled.withColumn("u", F.rand(7)).withColumn("at", F.row_number().over(Window.partitionBy("cluster_id").orderBy("u"))).where(F.col("at") <= n)
    found: dict[int, list] = {c: [] for c in sizes}
    for r in drawn.select("cluster_id", "z").toLocalIterator():
        found[r.cluster_id].append(r.z)
    if sum(len(v) * len(v[0]) * 8 for v in found.values() if v) > PARTNER_BYTES:
        raise ValueError("partners take too much memory; ask for fewer")
    return sizes, {c: np.array(v, float) for c, v in found.items()}


def sampled_silhouette(labelled: DataFrame, vector: str = "z", key: str | None = None, partners: int | None = PARTNERS) -> DataFrame:
    """(key, cluster_id, silhouette, without): the Euclidean silhouette of each row (without ``key`` if none is named); 0 for a cluster of one, or if there is one cluster.

    A cluster of up to ``partners`` rows takes part whole, so that small inputs have exact values. Of a larger one that many rows are drawn, and a mean distance is
    that to them: work and memory grow with the rows, not with their pairs. ``without`` has the silhouettes that each of ``REPLICAS`` shares of the drawn rows, left out,
    would give; they are one another's error (``silhouette_summary``). Which rows are drawn depends on how the table is dealt out. Rows without a vector or a cluster have no row.
    ``partners`` None takes clusters of any size whole, by the blocks of ``silhouette``: all values are exact and have no error, and the work is that of all pairs; ``key`` then names a row.
    """
    if partners is None:
        return _whole_silhouette(labelled, vector, key)
    if partners < 2 * REPLICAS:
        raise ValueError(f"at least {2 * REPLICAS} partners")
    names = [key] if key else []
    rows = labelled.where(F.col("cluster_id").isNotNull() & F.col(vector).isNotNull()).select(*[F.col(n).alias("key") for n in names], F.col("cluster_id").cast("int").alias("cluster_id"), F.col(vector).cast("array<double>").alias("z"))
    kind = f"{'key ' + rows.schema['key'].dataType.simpleString() + ', ' if key else ''}cluster_id int, silhouette double, without array<double>"
    sizes, drawn = _partners(rows, partners)
    ids = sorted(sizes)
    n = np.array([sizes[c] for c in ids], float)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, own = np.stack(pdf.z.to_numpy()), np.searchsorted(ids, pdf.cluster_id.to_numpy())
            # By row, cluster and replica (the last has all partners): the sum of the distances, and how many partners it has.
            total, count = np.zeros((len(x), len(ids), REPLICAS + 1)), np.zeros((len(ids), REPLICAS + 1))
            for c, name in enumerate(ids):
                y = drawn[name]
                share = np.arange(len(y)) % REPLICAS
                kept = np.ones((len(y), REPLICAS + 1))
                if len(y) < n[c]:
                    kept[:, :REPLICAS] = share[:, None] != np.arange(REPLICAS)
                count[c] = kept.sum(0)
                step = max(1, (1 << 20) // y.size)
                for at in range(0, len(x), step):
                    total[at : at + step, c] = np.sqrt(((x[at : at + step, None] - y) ** 2).sum(-1)) @ kept
            mean = total / count
            line = np.arange(len(x))
            # The row itself is among its cluster's n, at no distance.
            a = mean[line, own] * (n / np.maximum(n - 1, 1))[own][:, None]
            mean[line, own] = np.inf
            b = mean.min(1)
            most = np.maximum(a, b)
            good = (n[own] > 1)[:, None] & np.isfinite(b) & (most > 0)
            s = np.where(good, (np.where(good, b, 0) - a) / np.where(good, most, 1), 0.0)
            yield pd.DataFrame(({"key": pdf.key} if key else {}) | {"cluster_id": pdf.cluster_id, "silhouette": s[:, -1], "without": list(s[:, :-1])})

    out = rows.mapInPandas(score, kind)
    return out.withColumnRenamed("key", key) if key else out


def _whole_silhouette(labelled: DataFrame, vector: str, key: str | None) -> DataFrame:
    rows = labelled.where(F.col("cluster_id").isNotNull() & F.col(vector).isNotNull()).withColumn("cluster_id", F.col("cluster_id").cast("int"))
    if not key:
        # The number is drawn once a row, before rows are dealt to several blocks.
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
    scores = silhouette(rows, key or "_row", vector).withColumn("without", F.array_repeat("silhouette", REPLICAS))
    return scores if key else scores.drop("_row")


def silhouette_summary(scores: DataFrame) -> DataFrame:
    """(cluster_id, size, silhouette, error): means of the rows of ``sampled_silhouette`` by cluster, and of all where ``cluster_id`` is null; no row of no rows.

    ``error`` is the standard error by the jackknife over the left-out shares. All rows share the partners, so it does not fall with their number.
    """
    left = [F.avg(F.get("without", F.lit(i))).alias(f"w{i}") for i in range(REPLICAS)]
    rows = scores.rollup("cluster_id").agg(F.count("*").alias("size"), F.avg("silhouette").alias("silhouette"), *left).where("size > 0")
    mean = reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(REPLICAS)]) / REPLICAS
    squares = reduce(lambda a, b: a + b, [F.pow(F.col(f"w{i}") - F.col("_m"), F.lit(2.0)) for i in range(REPLICAS)])
    return rows.withColumn("_m", mean).select("cluster_id", "size", "silhouette", F.sqrt(squares * ((REPLICAS - 1) / REPLICAS)).alias("error"))


def squared_silhouette(labelled: DataFrame, vector: str = "z") -> DataFrame:
    """(cluster_id, size, silhouette): the mean silhouette of squared distances of each cluster's rows; 0 for a cluster of one.

    The mean squared distance of a row x to a cluster is |x|^2 + (sum of |y|^2 - 2 x (sum of y)) / n, so one row of sums a cluster serves all rows.
    """
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    rows = labelled.select("cluster_id", F.col(vector).alias("z"), square.alias("q"))
    flat = rows.select("cluster_id", F.posexplode("z").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("x").alias("x"))
    sums = flat.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("y"))  # a number for each dimension
    sums = sums.join(rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("q").alias("p")), "cluster_id")
    all_ = sums.agg(F.collect_list(F.struct("cluster_id", "y", "n", "p")).alias("all"))  # a row for each cluster
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    total = lambda c: c.n * F.col("q") + c.p - 2 * dot(F.col("z"), c.y)
    own = lambda c: c.cluster_id == F.col("cluster_id")
    mine = F.get(F.filter("all", own), F.lit(0))
    other = F.array_min(F.transform(F.filter("all", lambda c: ~own(c)), lambda c: total(c) / c.n))
    met = rows.crossJoin(F.broadcast(all_)).withColumns({"alone": mine.n < 2, "a": total(mine) / F.greatest(mine.n - 1, F.lit(1)), "b": other})
    score = F.when(F.col("alone") | F.col("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return met.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg(score).alias("silhouette"))


def centroid_table(model) -> DataFrame:
    """(cluster_id, centroid) of a k-means model."""
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centroid array<double>")


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def assign_clusters(z: DataFrame, centroids: DataFrame, vector: str = "z") -> DataFrame:
    """``z`` with ``cluster_id`` of the nearest centroid (the lowest id of equally near ones) and its squared ``distance``."""
    all_ = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("all"))  # k rows
    near = F.array_min(F.transform("all", lambda c: F.struct(distance2(F.col(vector), c.centroid).alias("d"), c.cluster_id.alias("id"))))
    return z.crossJoin(F.broadcast(all_)).withColumn("_near", near).select(*z.columns, F.col("_near.id").alias("cluster_id"), F.col("_near.d").alias("distance"))


def _between(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the distances of each row of ``x`` to the rows of ``y`` in each of ``k`` clusters, and of each of ``y`` to those of ``x``; clusters ascend in both."""
    there, back = np.zeros((len(x), k)), np.zeros((len(y), k))
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    for i in range(0, len(x), 256):
        for j in range(0, len(y), 1024):
            p, q, here, other = x[i : i + 256], y[j : j + 1024], cx[i : i + 256], cy[j : j + 1024]
            most = xx[i : i + 256, None] + yy[j : j + 1024]
            d = most - 2 * (p @ q.T)
            # Where the difference of the squares has lost digits, the squares of the differences.
            r, c = np.nonzero(d <= 1e-6 * most)
            for at in range(0, len(r), 4096):
                m, n = r[at : at + 4096], c[at : at + 4096]
                d[m, n] = ((p[m] - q[n]) ** 2).sum(1)
            np.sqrt(d, out=d)
            f, g = (np.flatnonzero(np.diff(ids, prepend=-1)) for ids in (other, here))
            there[i : i + 256, other[f]] += np.add.reduceat(d, f, axis=1)
            back[j : j + 1024, here[g]] += np.add.reduceat(d, g, axis=0).T
    return there, back


def _block_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of the distances between two blocks of rows (or within one) by row and cluster of the other rows."""
    within = pdf.lo.iloc[0] == pdf.hi.iloc[0]
    rows = pdf[pdf.v.notna()].sort_values("cluster_id", kind="stable")
    # Rows that are nobody's partner are named once.
    out = [pdf[pdf.v.isna() & within].assign(c2=None, total=0.0, n=1)]
    if len(rows):
        codes, names = pd.factorize(rows.cluster_id)
        z = np.stack(rows.v.to_numpy())
        z = z - z.mean(0)
        first = (rows.b == rows.lo).to_numpy()
        sides = [np.flatnonzero(first), np.flatnonzero(first if within else ~first)]
        sums = _between(*[z[at] for at in sides], *[codes[at] for at in sides], len(names))
        for at, other, total in zip(sides, sides[::-1], sums, strict=True):
            n = np.tile(np.bincount(codes[other], minlength=len(names)), (len(at), 1))
            if within:
                n[np.arange(len(at)), codes[at]] -= 1
            i, c = np.nonzero(n)
            out.append(rows.iloc[at[i]].assign(c2=names[c], total=total[i, c], n=n[i, c]))
            if within:
                break
    out = [df for df in out if len(df)] or out[:1]
    return pd.concat([df[["key", "cluster_id", "c2", "total", "n"]].astype({"c2": object}) for df in out])


def silhouette(labelled: DataFrame, key: str, vector: str = "z", blocks: int = 8) -> DataFrame:
    """The exact Euclidean silhouette of each row (``key``, which names a row, cluster_id, silhouette); 0 for a cluster of one. ``sampled_silhouette`` has an estimate without all pairs.

    Rows are dealt into ``blocks``, or more for ``BLOCK_BYTES`` of vectors in each, and each two blocks meet once as matrices; only sums by row and cluster leave them. The work is that of
    all pairs, some ten nanoseconds for each. Rows without a cluster or with a missing number have 0 and are nobody's partner.
    """
    v = F.col(vector).cast("array<double>")
    whole = F.col("cluster_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    rows = labelled.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.when(whole, v).alias("v"), "cluster_id")
    of = rows.agg(F.greatest(F.lit(blocks), F.ceil(F.sum(F.size("v")) * 8 / BLOCK_BYTES)).cast("int").alias("of"))  # one row
    dealt = rows.crossJoin(F.broadcast(of)).withColumn("b", F.pmod(F.xxhash64("key"), F.col("of")).cast("int"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select("key", "v", "cluster_id", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    pairs = met.groupBy("lo", "hi").applyInPandas(_block_sums, f"key {kind('key')}, cluster_id {kind('cluster_id')}, c2 {kind('cluster_id')}, total double, n long")
    sums = pairs.groupBy("key", "cluster_id", "c2").agg((F.sum("total") / F.sum("n")).alias("d"))
    own = F.max(F.when(F.col("cluster_id") == F.col("c2"), F.col("d")))
    other = F.min(F.when(F.col("cluster_id") != F.col("c2"), F.col("d")))
    per = sums.groupBy("key", "cluster_id").agg(own.alias("a"), other.alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select(F.col("key").alias(key), "cluster_id", score.alias("silhouette"))


def feature_stats(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: ``means`` and ``spreads`` (population standard deviation, 1 where it is 0) of the named columns, as arrays in their order."""
    spread = lambda n: F.when(F.stddev_pop(n) == 0, 1.0).otherwise(F.stddev_pop(n))
    return features.agg(F.array(*[F.avg(n) for n in names]).alias("means"), F.array(*[spread(n) for n in names]).alias("spreads"))


def cluster_summary(labelled: DataFrame, names: Sequence[str], top: int = 5, stats: DataFrame | None = None) -> DataFrame:
    """(cluster_id, size, centroid, raw, features).

    ``centroid`` holds the mean z of each named feature, and ``raw`` the same as a value (mean + z * spread) where ``stats`` of the features are given, else null; both are
    maps. ``features`` are the ``top`` by the size of the centroid's z, largest first, each with its reading: higher or lower than the mean.
    """
    means = labelled.groupBy("cluster_id").agg(F.count("*").alias("size"), *[F.avg(n).alias(n) for n in names])
    keys, z = F.array(*map(F.lit, names)), F.array(*map(F.col, names))
    ranked = F.array_sort(F.array(*[F.struct((-F.abs(F.col(n))).alias("a"), F.lit(i).alias("i"), F.lit(n).alias("feature"), F.col(n).alias("z")) for i, n in enumerate(names)]))
    reading = lambda s: F.when(s.z >= 0, "higher than the mean").otherwise("lower than the mean")
    features = F.transform(F.slice(ranked, 1, top), lambda s: F.struct(s.feature.alias("feature"), s.z.alias("z"), reading(s).alias("reading")))
    if stats is None:
        raw = F.lit(None).cast("map<string,double>")
    else:
        means = means.crossJoin(F.broadcast(stats))  # one row
        raw = F.map_from_arrays(keys, F.transform(F.arrays_zip(z.alias("z"), F.col("means"), F.col("spreads")), lambda s: s.means + s.z * s.spreads))
    return means.select("cluster_id", "size", F.map_from_arrays(keys, z).alias("centroid"), raw.alias("raw"), features.alias("features"))


def representatives(labelled: DataFrame, n: int = 5) -> DataFrame:
    """(cluster_id, rank, session_id, distance, venue): the ``n`` sessions of each cluster nearest to its centroid (``distance`` is squared in ``labelled``), ties by id.

    All members of a cluster are the rows of ``labelled`` itself.
    """
    w = Window.partitionBy("cluster_id").orderBy("distance", "session_id")
    return labelled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("cluster_id", "rank", "session_id", F.sqrt("distance").alias("distance"), *(["venue"] if "venue" in labelled.columns else []))


def cluster_axes(centroids: DataFrame) -> DataFrame:
    """(cluster_id, pressure, shift, regularity, trend, coherence) from centroids with a column of z for each feature."""
    z = lambda n: F.coalesce(F.col(n), F.lit(0.0)) if n in centroids.columns else F.lit(0.0)
    mean = lambda cols: reduce(lambda a, b: a + b, cols) / len(cols)
    axes = {a: mean([F.abs(z(n)) if a == "trend" else z(n) for n in names]) for a, names in AXES.items()}
    axes["regularity"] = axes["regularity"] - 0.3 * F.abs(z("dominantOscillationPeriodMinutes"))
    return centroids.select("cluster_id", *[c.alias(a) for a, c in axes.items()])


#: What is said of a cluster where an axis is above (or below) a limit, in this order.
SAYINGS = (
    ("pressure", ">", 0.5, "pressure variation is above average"),
    ("shift", ">", 0.5, "directional movement is above average"),
    ("regularity", ">", 0.3, "the shifts show useful repeatability"),
    ("regularity", "<", -0.3, "the pattern is structurally messy"),
    ("trend", ">", 0.7, "persistent trend matters more than pure oscillation"),
    ("coherence", ">", 0.3, "speed and direction are meaningfully linked"),
)
SAYING_OTHERWISE = "the session sits near the center of the fleet distribution"


def describe_clusters(axes: DataFrame) -> DataFrame:
    """``name`` by the first rule that fits and ``description``, a sentence of all that holds."""
    p, s, r, t = (F.col(n) for n in ("pressure", "shift", "regularity", "trend"))
    name = F.when(t > 0.7, "Trend Lane").when((p > 0.6) & (s < 0.2), "Pressure Hunt").when((s > 0.6) & (r > 0), "Oscillating Shift").when((p > 0.3) & (s > 0.3), "Mixed Edge").otherwise("Unsettled Blend")
    some = F.array_compact(F.array(*[F.when(F.col(a) > limit if sign == ">" else F.col(a) < limit, text) for a, sign, limit, text in SAYINGS]))
    said = F.when(F.size(some) > 0, F.array_join(some, ", ")).otherwise(SAYING_OTHERWISE)
    sentence = F.concat(F.upper(F.substring("_said", 1, 1)), F.expr("substring(_said, 2)"), F.lit("."))
    named = axes.withColumns({"name": F.concat(name, F.lit(" "), (F.col("cluster_id") + 1).cast("string")), "_said": said})
    return named.withColumn("description", sentence).drop("_said")


def score_archetypes(axes: DataFrame, rules: dict[str, dict[str, float]] = ARCHETYPES) -> DataFrame:
    """(cluster_id, archetype, score, rank, gap): every archetype's score; gap is the best less the second."""
    values = {n: F.col(n) for n in AXES} | {"low": F.least("pressure", "shift"), "apart": F.abs(F.col("pressure") - F.col("shift"))}
    score = lambda w: reduce(lambda a, b: a + b, [values[k] * v for k, v in w.items()])
    rows = axes.select("cluster_id", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("archetype"), score(w).alias("score")) for i, (n, w) in enumerate(rules.items())])))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "i")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    all_ = Window.partitionBy("cluster_id")
    gap = F.max("score").over(all_) - F.max(F.when(F.col("rank") == 2, F.col("score"))).over(all_)
    return ranked.select("cluster_id", "archetype", rounded("score").alias("score"), "rank", rounded(gap).alias("gap"))


def compact_profiles(described: DataFrame, summary: DataFrame, archetypes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """A row for each cluster to write out: (cluster_id, name, archetype, description, raw, thresholds), the last a map of feature to (min_z, max_z)."""
    best = archetypes.where("rank = 1").select("cluster_id", "archetype")
    limits = thresholds.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", F.struct("min_z", "max_z"))))).alias("thresholds"))  # a few features
    rows = described.select("cluster_id", "name", "description").join(best, "cluster_id").join(summary.select("cluster_id", "raw"), "cluster_id")
    return rows.join(limits, "cluster_id", "left").select("cluster_id", "name", "archetype", "description", "raw", "thresholds")


def group_distribution(labelled: DataFrame, group: str, k: int) -> DataFrame:
    """Sessions and share (%) of each cluster in each group, zeros too."""
    counts = labelled.groupBy(group, "cluster_id").agg(F.count("*").alias("n"))
    every = counts.groupBy(group).agg(F.sum("n").alias("total")).withColumn("cluster_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return every.join(counts, [group, "cluster_id"], "left").select(group, "cluster_id", F.coalesce("n", F.lit(0)).alias("n"), rounded(F.coalesce("n", F.lit(0)) / F.col("total") * 100, 2).alias("share"))


def top_cluster(distribution: DataFrame, group: str) -> DataFrame:
    """The cluster with most sessions in each group, the lowest id of equal ones."""
    return distribution.groupBy(group).agg(F.max(F.struct("n", (-F.col("cluster_id")).alias("c"), "share")).alias("m")).select(group, (-F.col("m.c")).alias("cluster_id"), F.col("m.share").alias("share"))


def _components(z: DataFrame, names: Sequence[str] | str, k: int) -> tuple[PCAModel, np.ndarray]:
    """The model and the sign of each component, which makes its largest loading positive."""
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(z.select(_vector(names)))
    load = model.pc.toArray()
    return model, np.where(load[np.abs(load).argmax(0), range(k)] < 0, -1.0, 1.0)


def pca(z: DataFrame, names: Sequence[str] | str, key: str, k: int = 2) -> DataFrame:
    """(key, pc1, pc2, ..): scores on the first components; each component's largest loading is positive."""
    model, sign = _components(z, names, k)
    score = vector_to_array("pc")
    return model.transform(z.select(key, _vector(names))).select(key, *[(F.get(score, F.lit(i)) * float(sign[i])).alias(f"pc{i + 1}") for i in range(k)])


def pca_components(z: DataFrame, names: Sequence[str], k: int = 2) -> DataFrame:
    """(component, explained, loadings): the share of the variance that each component explains, and its loadings by feature."""
    model, sign = _components(z, names, k)
    load = model.pc.toArray() * sign
    rows = [(f"PC{i + 1}", float(model.explainedVariance[i]), {n: float(x) for n, x in zip(names, load[:, i], strict=True)}) for i in range(k)]
    return z.sparkSession.createDataFrame(rows, "component string, explained double, loadings map<string, double>")


def surrogate_tree(labelled: DataFrame, names: Sequence[str], depth: int = 3, min_leaf: int = 6) -> DecisionTreeClassificationModel:
    """A small gini tree that predicts the cluster from the features."""
    rows = labelled.select(_vector(names), F.col("cluster_id").cast("double").alias("label"))
    return DecisionTreeClassifier(impurity="gini", maxDepth=depth, minInstancesPerNode=min_leaf, maxBins=128).fit(rows)


def tree_rules(model: DecisionTreeClassificationModel, labelled: DataFrame, names: Sequence[str], top: int = 6) -> DataFrame:
    """(rule, prediction, size, purity) of the tree's leaves on ``labelled``, the ``top`` largest first."""
    leaves: list[tuple[Column, str, float]] = []

    def walk(node, condition: Column, path: list[str]) -> None:
        if node.numDescendants() == 0:
            leaves.append((condition, " and ".join(path) or "always", node.prediction()))
            return
        n, t = names[node.split().featureIndex()], node.split().threshold()
        walk(node.leftChild(), condition & (F.col(n) <= t), [*path, f"{n} <= {t:.3f}"])
        walk(node.rightChild(), condition & (F.col(n) > t), [*path, f"{n} > {t:.3f}"])

    walk(model._call_java("rootNode"), F.lit(True), [])
    rule, predicted = F.lit(None).cast("string"), F.lit(None).cast("double")
    for c, text, p in leaves:
        rule, predicted = F.when(c, text).otherwise(rule), F.when(c, p).otherwise(predicted)
    rows = labelled.select(rule.alias("rule"), predicted.cast("int").alias("prediction"), "cluster_id")
    return rows.groupBy("rule", "prediction").agg(F.count("*").alias("size"), F.avg((F.col("cluster_id") == F.col("prediction")).cast("double")).alias("purity")).orderBy(F.desc("size"), "rule").limit(top)


def cluster_thresholds(rules: DataFrame) -> DataFrame:
    """(cluster_id, feature, min_z, max_z): the limits of each cluster's largest rule, ties by the rule's text; the last one of a feature counts.

    ``rules`` are those of ``tree_rules``.
    """
    largest = rules.groupBy(F.col("prediction").alias("cluster_id")).agg(F.min(F.struct((-F.col("size")).alias("n"), "rule")).alias("m"))
    parts = largest.select("cluster_id", F.posexplode(F.split("m.rule", " and ")).alias("i", "part"))
    taken = lambda g: F.regexp_extract("part", r"^(\S+) (<=|>) (-?[0-9.]+)$", g)
    limits = parts.select("cluster_id", "i", taken(1).alias("feature"), taken(2).alias("sign"), F.expr("try_cast(regexp_extract(part, '(-?[0-9.]+)$', 1) as double)").alias("limit")).where("feature <> ''")
    last = lambda sign: F.max_by("limit", F.when(F.col("sign") == sign, F.col("i")))
    only = lambda sign: F.when(F.max((F.col("sign") == sign).cast("int")) == 1, last(sign))
    return limits.groupBy("cluster_id", "feature").agg(only(">").alias("min_z"), only("<=").alias("max_z"))


def _leaves(z: DataFrame, names: Sequence[str] | str, key: str, limit: int, seed: int) -> DataFrame:
    """(key, leaf, point): up to ``limit`` rows are leaves in the order of ``key``; more are summarised by k-means with ``limit`` centroids."""
    rows = z.select(F.col(key), _vector(names))
    if rows.count() <= limit:
        order = Window.orderBy(key, vector_to_array("features"))  # at most ``limit`` rows
        return rows.select(key, (F.row_number().over(order) - 1).alias("leaf"), vector_to_array("features").alias("point"))
    rows = rows.cache()
    model = KMeans(k=limit, seed=seed).fit(rows)
    rows.unpersist()
    found = model.transform(rows).select(key, F.col("prediction").alias("id"))
    # Numbers without gaps, as a centroid may have no rows.
    used = found.select("id").distinct().withColumn("leaf", F.row_number().over(Window.orderBy("id")) - 1)
    centres = centroid_table(model).select(F.col("cluster_id").alias("id"), F.col("centroid").alias("point"))
    return found.join(used.join(centres, "id"), "id").select(key, "leaf", "point")


def linkage_leaves(z: DataFrame, names: Sequence[str] | str, key: str = "session_id", limit: int = LINKED, seed: int = 1) -> DataFrame:
    """(key, leaf): the leaf of ``linkage``'s tree that each row is in; with at most ``limit`` rows, one of its own."""
    return _leaves(z, names, key, limit, seed).select(key, "leaf")


def linkage(z: DataFrame, names: Sequence[str] | str, key: str = "session_id", limit: int = LINKED, seed: int = 1) -> DataFrame:
    """Average linkage: (step, left, right, distance, size), sizes in rows. Leaves are 0 to n - 1, and step s makes n + s.

    Up to ``limit`` rows are linked exactly, with n - 1 merges. More are summarised by ``limit`` k-means centroids first, so that the
    merging sees a bounded number of weighted points; ``linkage_leaves`` has the leaf of every row.
    """
    table = _leaves(z, names, key, limit, seed).groupBy("leaf").agg(F.first("point").alias("c"), F.count("*").alias("n"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf").reset_index(drop=True)
        x, n = np.stack(pdf.c), len(pdf)
        weight = np.concatenate((pdf.n.to_numpy(float), np.zeros(n)))
        # Distances of earlier to later clusters; a merged one comes last. ``least`` holds the smallest of each row.
        far = np.full((2 * n, 2 * n), np.inf)
        for i in range(n - 1):
            far[i, i + 1 : n] = np.sqrt(((x[i + 1 :] - x[i]) ** 2).sum(1))
        least, to, live, out = far.min(1), far.argmin(1), np.zeros(2 * n, bool), []
        live[:n] = True
        for new in range(n, 2 * n - 1):
            a = int(least.argmin())
            b = int(to[a])
            out.append((new - n, a, b, float(least[a]), int(weight[a] + weight[b])))
            live[a] = live[b] = False
            others = np.flatnonzero(live)
            d = [far[np.minimum(others, c), np.maximum(others, c)] for c in (a, b)]
            weight[new] = weight[a] + weight[b]
            far[[a, b]] = far[:, [a, b]] = np.inf
            far[others, new] = (d[0] * weight[a] + d[1] * weight[b]) / weight[new]
            least[[a, b]] = np.inf
            stale = others[(to[others] == a) | (to[others] == b)]
            least[stale], to[stale] = far[stale].min(1), far[stale].argmin(1)
            nearer = others[far[others, new] < least[others]]
            least[nearer], to[nearer] = far[nearer, new], new
            live[new] = True
        return pd.DataFrame(out, columns=["step", "left", "right", "distance", "size"])

    return table.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(merge, "step int, left int, right int, distance double, size long")


def run_summary(scan: DataFrame, archetypes: DataFrame) -> DataFrame:
    """One row: the k with the best silhouette, the archetypes that are best for some cluster and those that are for none."""
    best = scan.agg(F.max(F.struct("silhouette", (-F.col("k")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("best_k"))
    won = archetypes.where("rank = 1").select("archetype").distinct()
    lost = archetypes.select("archetype").distinct().join(won, "archetype", "left_anti")
    listed = lambda df, n: df.agg(F.array_join(F.array_sort(F.collect_list("archetype")), ", ").alias(n))
    return best.crossJoin(listed(won, "found")).crossJoin(listed(lost, "missing"))
