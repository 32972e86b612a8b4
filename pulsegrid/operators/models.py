"""Models: isolation forest, L1 quantile regression, quantile forest."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from .evaluation import weighted_percentiles


def _hash_order(seed: int, *cols: str):
    return F.xxhash64(F.lit(seed), *cols)


# ---------------------------------------------------------------------------------------------- isolation forest


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_scores(df: DataFrame, keys: Sequence[str], features: Sequence[str], trees: int = 100, rows: int = 256, seed: int = 0, threshold: float = -0.07) -> DataFrame:
    """Adds score = 0.5 - 2^(-mean depth / expected depth) and abnormal (score <= threshold).

    Each tree is grown by one task from a hashed sample of about ``rows`` rows; what is broadcast is at most
    trees * 2 * rows nodes, whatever the input.  Nulls count as 0.
    """
    values = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    data = df.withColumn("__x", values)
    n = data.count()
    share = min(1.0, 1.5 * rows / max(n, 1))
    million = 1_000_000
    # The trees that take a row are chosen inside the row: only sampled rows are multiplied.
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("__key")), F.lit(million)) < math.ceil(share * million))
    picked = data.select("__x", F.struct(*keys).alias("__key")).select("__x", F.explode(chosen).alias("tree"), "__key")

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        x = np.array(table.column("__x").to_pylist(), float)
        x = x[np.lexsort(x.T[::-1])]  # the same tree whatever the order of arrival
        rng = np.random.default_rng([seed, tree])
        x = x[rng.permutation(len(x))[:rows]]
        limit = math.ceil(math.log2(max(len(x), 2)))
        out: list[list] = [[], [], [], [], []]  # feature, cut, left, right, extra depth of a leaf

        def node(part: np.ndarray, depth: int) -> int:
            at = len(out[0])
            for c in out:
                c.append(None)
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(wide):
                out[0][at], out[4][at] = -1, depth + _average_path(len(part))
                return at
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            out[0][at], out[1][at] = f, cut
            out[2][at] = node(part[part[:, f] < cut], depth + 1)
            out[3][at] = node(part[part[:, f] >= cut], depth + 1)
            return at

        node(x, 0)
        return pa.table({"tree": pa.array([tree], pa.int32()), "n": pa.array([len(x)]), "feature": pa.array([out[0]], pa.list_(pa.int32())), "cut": pa.array([out[1]], pa.list_(pa.float64())), "left": pa.array([out[2]], pa.list_(pa.int32())), "right": pa.array([out[3]], pa.list_(pa.int32())), "depth": pa.array([out[4]], pa.list_(pa.float64()))})

    grown = picked.groupBy("tree").applyInArrow(grow, "tree int, n long, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>").collect()  # bounded by trees * rows
    forest = [(np.array(t["feature"]), np.array([c or 0.0 for c in t["cut"]]), np.array([i or 0 for i in t["left"]]), np.array([i or 0 for i in t["right"]]), np.array([d or 0.0 for d in t["depth"]])) for t in grown]
    expected = _average_path(float(np.mean([t["n"] for t in grown]))) if grown else 1.0
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(xs):
        import pandas as pd

        forest = shared.value
        x = np.array(xs.tolist(), float).reshape(len(xs), -1)
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in forest:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] < cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += depth[at]
        return pd.Series(0.5 - 2.0 ** (-(total / max(len(forest), 1)) / max(expected, 1e-9)))

    return data.withColumn("score", score("__x")).drop("__x").withColumn("abnormal", F.col("score") <= threshold)


# ---------------------------------------------------------------------------------------- L1 quantile regression


def quantile_loss(residual: np.ndarray, tau: float) -> float:
    return float(np.where(residual >= 0, tau * residual, (tau - 1) * residual).mean())


def _soft_pinball(r: np.ndarray, middle: float, half: float, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, slope and curvature of middle r + half |r|, whose dual bounds are kept by logarithmic barriers of weight mu.

    That is the maximum over d of d r + mu log((half - d + middle) (half + d - middle)), less terms that depend on mu only.
    """
    s = np.sqrt(mu * mu + half * half * r * r)
    return middle * r + s - mu * np.log(mu + s), middle + r * half * half / (mu + s), mu * half * half / ((mu + s) * s)


#: Parts of a Newton step whose values are compared.
SIZES = 0.5 ** np.arange(8)


class _Cell:
    """Newton's method for one (tau, lam), along barrier weights mu = 10^-1 .. 10^-levels.

    Passes over the rows alternate: slopes and curvature at a point, then the values at parts of the step from there, of
    which the least is taken (the full step is mostly too far, the first that descends mostly too short).
    """

    def __init__(self, lam: float, start: np.ndarray, levels: int):
        self.lam, self.beta, self.step, self.levels, self.level = lam, start, None, levels, 1
        self.value, self.done = np.inf, False

    @property
    def mu(self) -> float:
        return 10.0**-self.level

    def take_slopes(self, value: float, grad: np.ndarray, gram: np.ndarray) -> None:
        p, dp, ddp = _soft_pinball(self.beta[1:], 0.0, 1.0, self.mu)
        at = np.arange(1, len(grad))
        self.value, grad, hess = value + self.lam * p.sum(), grad.copy(), gram.copy()
        grad[1:] += self.lam * dp
        hess[at, at] += self.lam * ddp
        hess[np.diag_indices(len(grad))] += 1e-13 * np.trace(hess)
        self.step = -np.linalg.solve(hess, grad)
        if -grad @ self.step < (0.1 if self.level < self.levels else 1e-4) * self.mu:
            self.beta = self.beta + self.step
            self._next_weight()

    def take_values(self, values: np.ndarray) -> None:
        values = values + [self.lam * _soft_pinball(self.beta[1:] + z * self.step[1:], 0.0, 1.0, self.mu)[0].sum() for z in SIZES]
        best = int(np.argmin(values))
        if values[best] < self.value:
            self.beta, self.step = self.beta + SIZES[best] * self.step, None
        else:  # as near as sums of doubles tell
            self._next_weight()

    def _next_weight(self) -> None:
        self.done, self.level, self.step = self.level == self.levels, min(self.level + 1, self.levels), None

    def coefficients(self) -> np.ndarray:
        """A coefficient below the root of the last weight is one whose dual value is inside its bounds: zero."""
        return np.r_[self.beta[0], np.where(np.abs(self.beta[1:]) > math.sqrt(self.mu), self.beta[1:], 0.0)]


def quantile_regression_grid(sample: DataFrame, features: Sequence[str], target: str, taus: Sequence[float], lams: Sequence[float], levels: int = 8) -> DataFrame:
    """tau, lam, feature, coef for each grid cell: minima of mean pinball loss + lam |coef|, features standardised.

    The intercept has the name ''.  Rows with nulls are left out; no rows give no coefficients.  One solver serves every
    size: the dual of the linear program is followed along logarithmic barriers, and as the barrier's duals have a
    closed form in the residual, rows need no state.  A pass serves all cells that are not done: tasks add up slopes and
    weighted products of the features (p * p numbers a cell), Spark sums them, the driver solves p equations a cell.  Where
    several coefficients are optimal, the path ends in the middle of them.
    """
    spark = sample.sparkSession
    rows = sample.select(*(F.col(c).cast("double").alias(c) for c in (*features, target))).dropna()
    kept = cut_lineage(rows.select(F.array(*features).cast("array<double>").alias("x"), F.col(target).alias("y")))
    means = [F.avg(F.col("x")[i]) for i in range(len(features))] + [F.stddev_pop(F.col("x")[i]) for i in range(len(features))]
    stats = kept.agg(F.count("*"), F.avg("y"), F.stddev_pop("y"), *means).first()
    schema, p = "tau double, lam double, feature string, coef double", len(features) + 1
    n = stats[0]
    if n == 0:
        return spark.createDataFrame([], schema)
    unit, centre, spread = float(stats[2]) or 1.0, np.array(stats[3 : p + 2], float), np.array(stats[p + 2 :], float)
    scale = np.where(spread > 0, spread, np.inf)
    grid = [(float(t), float(v)) for t in taus for v in lams]
    cells = [_Cell(lam, np.r_[stats[1] / unit, np.zeros(p - 1)], levels) for _, lam in grid]
    while asked := [(c, grid[c][0], cell.mu, cell.beta, cell.step) for c, cell in enumerate(cells) if not cell.done]:
        shared = spark.sparkContext.broadcast((asked, centre, scale, unit))

        def sums(batches, shared=shared):
            asked, centre, scale, unit = shared.value
            p = len(centre) + 1
            total = [np.zeros(1 + p + p * p) if step is None else np.zeros(len(SIZES)) for *_, step in asked]
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                a, y = np.column_stack([np.ones(len(x)), (x - centre) / scale]), batch.column("y").to_numpy() / unit
                for out, (_, tau, mu, beta, step) in zip(total, asked, strict=True):
                    r = y - a @ beta
                    if step is None:
                        value, d, dd = _soft_pinball(r, tau - 0.5, 0.5, mu)
                        out += np.r_[value.sum(), -(a.T @ d), ((a * dd[:, None]).T @ a).ravel()]
                    else:
                        move = a @ step
                        out += [_soft_pinball(r - z * move, tau - 0.5, 0.5, mu)[0].sum() for z in SIZES]
            yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in asked], pa.int32()), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))], ["cell", "sums"])

        parts = kept.mapInArrow(sums, "cell int, sums array<double>").select("cell", F.posexplode("sums").alias("at", "v"))
        table = parts.groupBy("cell", "at").agg(F.sum("v").alias("v")).toPandas()  # cells * (1 + p + p * p) numbers
        total = np.zeros((len(grid), 1 + p + p * p))
        total[table["cell"].to_numpy(), table["at"].to_numpy()] = table["v"].to_numpy() / n
        for c, *_, step in asked:
            if step is None:
                cells[c].take_slopes(total[c, 0], total[c, 1 : p + 1], total[c, p + 1 :].reshape(p, p))
            else:
                cells[c].take_values(total[c, : len(SIZES)])
        shared.unpersist()
    found = [(t, v, name, float(b)) for (t, v), cell in zip(grid, cells, strict=True) for name, b in zip(["", *features], unit * cell.coefficients(), strict=True)]
    return spark.createDataFrame(found, schema)


# ------------------------------------------------------------------------------------------------ quantile forest


#: P(count <= k) of a Poisson variable of mean 1, up to where it is 1 in double precision.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)]).tolist()


def bootstrap_count(tree: Column, seed: int, row: str) -> Column:
    """How often the tree's bootstrap sample holds the row: a Poisson draw of mean 1, hashed from seed, tree and row.

    That is how often a row comes up in n draws from n rows, for many rows.  Counts depend on the row alone, not on its
    place or partition; equal rows have equal counts.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), tree, row), F.lit(1 << 53)) / float(1 << 53)
    return F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda c: draw >= c))


def leaf_weights(bag: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """key, __y, __weight: a row's count over the counts of its leaf, added up over the trees in whose leaf it meets the key.

    bag: __tree, __leaf, __y, __count; asked: key, __tree, __leaf.  Counts are added up by (tree, leaf, target) before the
    join, which bounds what a key meets to the different targets of its leaves.
    """
    leaves = bag.where("__count > 0").groupBy("__tree", "__leaf", "__y").agg(F.sum("__count").alias("__w"))
    total = leaves.groupBy("__tree", "__leaf").agg(F.sum("__w").alias("__all"))
    shares = cut_lineage(leaves.join(total, ["__tree", "__leaf"]).select("__tree", "__leaf", "__y", (F.col("__w") / F.col("__all")).alias("__share")))
    return asked.join(shares, ["__tree", "__leaf"]).groupBy(key, "__y").agg(F.sum("__share").alias("__weight"))


def quantile_forest(train: DataFrame, test: DataFrame, key: str, features: Sequence[str], target: str, percents: Sequence[float], trees: int = 100, min_leaf: int = 5, max_depth: int = 10, seed: int = 0, at_once: int = 8) -> DataFrame:
    """key, percent, value for each test row: weighted percentiles of the training targets that share its leaves.

    Each tree is grown by Spark's learner on its own bootstrap sample, the counts of ``bootstrap_count`` being the rows'
    weights; the same counts weigh the rows of a leaf (see ``leaf_weights``).  ``at_once`` trees are grown at a time.  Rows
    with a null feature, or a null target in train, are left out.  Training rows that agree in key, features and target
    have equal counts.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import DecisionTreeRegressor

    assemble = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="skip")
    whole = assemble.transform(train.where(F.col(target).isNotNull())).select(key, F.col(target).cast("double").alias("__y"), "__features")
    known = cut_lineage(whole.withColumn("__row", F.xxhash64(key, "__y", vector_to_array("__features"))))
    held = known.agg(*(F.max(bootstrap_count(F.lit(t), seed, "__row")) for t in range(trees))).first()
    grown = [t for t in range(trees) if held[t]]  # of few rows, a sample may hold none

    def grow(t: int):
        learner = DecisionTreeRegressor(featuresCol="__features", labelCol="__y", weightCol="__n", predictionCol=f"__at{t}", leafCol=f"__leaf{t}", maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed + t)
        return learner.fit(known.select("__y", "__features", bootstrap_count(F.lit(t), seed, "__row").cast("double").alias("__n")).where("__n > 0"))

    with ThreadPool(at_once) as pool:
        forest = pool.map(inheritable_thread_target(train.sparkSession)(grow), grown)

    def leaves(df: DataFrame, *cols: str) -> DataFrame:
        """cols, __tree, __leaf, from one pass over df."""
        for tree in forest:
            df = tree.transform(df)
        own = F.array(*(F.struct(F.lit(t).alias("__tree"), F.col(f"__leaf{t}").cast("int").alias("__leaf")) for t in grown))
        return df.select(*cols, F.inline(own.cast("array<struct<__tree:int,__leaf:int>>")))

    bag = leaves(known, "__y", "__row").withColumn("__count", bootstrap_count(F.col("__tree"), seed, "__row"))
    weights = leaf_weights(bag, leaves(assemble.transform(test).select(key, "__features"), key), key)
    return weighted_percentiles(weights, [key], "__y", "__weight", percents)
