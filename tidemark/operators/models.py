"""Encoders, linear models, calibration, moments-based regression and boosted trees on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import column_quantiles


class MissingEncoder:
    """Median-imputed columns and an indicator for each; medians come from the rows that were fitted. A column
    without any value becomes 0. Infinity is refused."""

    def __init__(self, columns: list[str]):
        self.columns, self.medians = columns, {}

    def fit(self, df: DataFrame) -> MissingEncoder:
        bad = [F.count_if(F.abs(c) == float("inf")).alias(f"{c}__i") for c in self.columns]
        r = df.agg(*bad).first()
        if any(r[f"{c}__i"] for c in self.columns):
            raise ValueError("infinite values: " + ", ".join(c for c in self.columns if r[f"{c}__i"]))
        found = column_quantiles(df, self.columns, [0.5])
        self.medians = {c: float(found[c][0]) if c in found else 0.0 for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        check = lambda c: F.when(F.abs(c) == float("inf"), F.raise_error(F.lit(f"{c} is infinite")).cast("double")).otherwise(F.coalesce(F.col(c), F.lit(self.medians[c])))
        flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in self.columns}
        return df.withColumns(flags).withColumns({c: check(c) for c in self.columns})


def active_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one value."""
    r = df.agg(*[F.min(c).alias(f"{c}__a") for c in columns], *[F.max(c).alias(f"{c}__z") for c in columns]).first()
    return [c for c in columns if r[f"{c}__a"] is not None and r[f"{c}__a"] != r[f"{c}__z"]]


class Standardiser:
    """Zero mean and unit population deviation; columns without variance become 0."""

    def __init__(self, columns: list[str]):
        self.columns, self.at = columns, {}

    def fit(self, df: DataFrame) -> Standardiser:
        r = df.agg(*[x for c in self.columns for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
        self.at = {c: (r[f"{c}__m"] or 0.0, r[f"{c}__s"] or 0.0) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s if s > 0 else F.lit(0.0) for c, (m, s) in self.at.items()})


class RidgeLogistic:
    """Logistic regression with a squared penalty of strength 1/C on all coefficients but the intercept."""

    def __init__(self, columns: list[str], c: float = 1.0, balanced: bool = False):
        self.columns, self.c, self.balanced = columns, c, balanced
        self.coefficients: list[float] = []
        self.intercept = 0.0
        self.shift = 0.0

    def fit(self, df: DataFrame, y: str = "y") -> RidgeLogistic:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        d = VectorAssembler(inputCols=self.columns, outputCol="_x").transform(df.select(F.col(y).cast("double").alias("_y"), *self.columns))
        n, p = d.agg(F.count("*"), F.sum("_y")).first()
        if not n or not p or p == n:
            raise ValueError("training rows of one class")
        w1, w0 = (n / (2 * p), n / (2 * (n - p))) if self.balanced else (1.0, 1.0)
        self.shift = float(__import__("math").log(w1 / w0))
        d = d.withColumn("_w", F.when(F.col("_y") == 1, w1).otherwise(w0))
        total = float(p * w1 + (n - p) * w0)
        m = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1 / (self.c * total), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(d)
        self.coefficients, self.intercept = [float(x) for x in m.coefficients], float(m.intercept)
        return self

    def margin(self):
        return sum((F.col(c) * b for c, b in zip(self.columns, self.coefficients, strict=True)), F.lit(self.intercept))

    def predict(self, df: DataFrame, name: str = "prob") -> DataFrame:
        """Probabilities; those of balanced fits are shifted back to the classes' own share."""
        return df.withColumn(name, 1 / (1 + F.exp(-(self.margin() - self.shift))))

    def contributions(self, df: DataFrame, prefix: str = "contrib_") -> DataFrame:
        """Additive parts of the margin; an indicator's part goes to the column that it is about."""
        parts: dict[str, list] = {}
        for c, b in zip(self.columns, self.coefficients, strict=True):
            parts.setdefault(c.removesuffix("_missing"), []).append(F.col(c) * b)
        return df.withColumns({prefix + c: sum(x[1:], x[0]) for c, x in parts.items()})


def grid_search(df: DataFrame, columns: list[str], group: str, cs: list[float], y: str = "y") -> dict[float, float]:
    """Mean log-loss of each C over leave-one-group-out folds; infinite where a fold cannot be fitted. More than 1000 groups are an error."""
    groups = [r[0] for r in df.select(group).distinct().orderBy(group).limit(1001).collect()]
    if len(groups) > 1000:
        raise ValueError("more than 1000 groups; assign them to fewer folds and give the folds as groups")
    out = {}
    for c in cs:
        losses = []
        for g in groups:
            train, test = df.where(F.col(group) != g), df.where(F.col(group) == g)
            try:
                m = RidgeLogistic(columns, c).fit(train, y)
            except ValueError:
                losses.append(float("inf"))
                continue
            p = F.least(F.greatest(F.col("prob"), F.lit(1e-15)), F.lit(1 - 1e-15))
            losses.append(m.predict(test).agg(F.avg(-(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p)))).first()[0])
        out[c] = sum(losses) / len(losses)
    return out


class Calibrator:
    """Probabilities from scores: two parameters on the logit, or isotonic with enough positives. One class
    alone cannot be calibrated: scores then pass through and `fitted` is false."""

    def __init__(self, kind: str = "sigmoid", least_positives: int = 200):
        self.kind, self.least = kind, least_positives
        self.a, self.b, self.steps, self.fitted, self.negative_slope = 1.0, 0.0, None, False, False

    @staticmethod
    def _logit(c: str):
        p = F.least(F.greatest(F.col(c), F.lit(1e-7)), F.lit(1 - 1e-7))
        return F.log(p / (1 - p))

    def fit(self, df: DataFrame, score: str = "score", y: str = "y") -> Calibrator:
        from pyspark.ml.feature import VectorAssembler

        d = df.where(F.col(score).isNotNull()).select(F.col(y).cast("double").alias("_y"), self._logit(score).alias("_l"), F.col(score).alias("_s"))
        n, p = d.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0.0))).first()
        if not p or p == n:
            return self
        self.fitted = True
        if self.kind == "isotonic" and p >= self.least:
            from pyspark.ml.regression import IsotonicRegression

            m = IsotonicRegression(featuresCol="_s", labelCol="_y").fit(d)
            self.steps = ([float(x) for x in m.boundaries], [float(x) for x in m.predictions])
            return self
        from pyspark.ml.classification import LogisticRegression

        m = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=0.0, standardization=False, maxIter=200, tol=1e-12).fit(VectorAssembler(inputCols=["_l"], outputCol="_v").transform(d))
        self.a, self.b = float(m.coefficients[0]), float(m.intercept)
        self.negative_slope = self.a <= 0
        return self

    def transform(self, df: DataFrame, score: str = "score", name: str = "prob") -> DataFrame:
        if not self.fitted:
            return df.withColumn(name, F.col(score))
        if self.steps is None:
            return df.withColumn(name, 1 / (1 + F.exp(-(self._logit(score) * self.a + self.b))))
        xs, ys = (F.from_json(F.lit(str(s)), "array<double>") for s in self.steps)
        s = F.col(score)
        i = F.greatest(F.size(F.filter(xs, lambda x: x <= s)) - 1, F.lit(0))
        j = F.least(i + 1, F.size(xs) - 1)
        t = F.when(xs[j] > xs[i], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - xs[i]) / (xs[j] - xs[i])))).otherwise(0.0)
        return df.withColumn(name, F.when(s.isNotNull(), ys[i] + t * (ys[j] - ys[i])))


def calibration_line(df: DataFrame, prob: str = "prob", y: str = "y") -> tuple[float, float] | None:
    """Slope and intercept of a logistic fit of y on the logit of the probability; None for one class."""
    c = Calibrator().fit(df, prob, y)
    return (c.a, c.b) if c.fitted else None


def moments(df: DataFrame, x: str, y: str):
    """Rows, means and centred cross-products of an array column and y: partial sums per task, added as
    vectors by row of the matrix. The driver gets p + 2 rows of p numbers, whatever the number of rows."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.array(batch.column(x).to_pylist(), float)
            z = np.concatenate([np.ones((len(rows), 1)), rows, np.array(batch.column(y).to_pylist(), float)[:, None]], axis=1)
            part = z.T @ z
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = df.select(x, F.col(y).cast("double").alias(y)).where(F.col(x).isNotNull() & F.col(y).isNotNull()).mapInArrow(run, "i long, v array<double>")
    rows = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r")).collect()
    m = np.zeros((len(rows), len(rows)))
    for r in rows:
        m[r.i] = [e.v for e in r.r]
    n = m[0, 0]
    mean = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    return n, mean[:-1], mean[-1], centred[:-1, :-1], centred[:-1, -1]


class PartialLeastSquares:
    """Regression on k orthogonal components, from second moments alone: weights are the Krylov sequence
    of the cross-products, made orthogonal in the metric of the data."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, df: DataFrame, x: str = "x", y: str = "y") -> PartialLeastSquares:
        import numpy as np

        _, self.x_mean, self.y_mean, s, c = moments(df, x, y)
        left, basis, self.beta = c.copy(), [], np.zeros(len(c))
        for _ in range(self.k):
            w = left / np.linalg.norm(left)
            for b in basis:
                w = w - b * (b @ s @ w) / (b @ s @ b)
            gain = (w @ c) / (w @ s @ w)
            self.beta = self.beta + w * gain
            left = c - s @ self.beta
            basis.append(w)
            if np.linalg.norm(left) < 1e-12 * np.linalg.norm(c):
                break
        self.first_weight = c / np.linalg.norm(c)
        return self

    def predict(self, df: DataFrame, x: str = "x", name: str = "score") -> DataFrame:
        beta = F.from_json(F.lit(str([float(b) for b in self.beta])), "array<double>")
        shift = self.y_mean - float(self.x_mean @ self.beta)
        return df.withColumn(name, F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(shift), lambda acc, v: acc + v))


def effective_freedom(df: DataFrame, x: str, y: str, penalty: float) -> float:
    """Sum of d / (d + penalty) over the eigenvalues of the centred cross-products."""
    import numpy as np

    d = np.linalg.eigvalsh(moments(df, x, y)[3])
    return float((d / (d + penalty)).sum())
