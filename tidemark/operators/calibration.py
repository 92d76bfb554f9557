"""Calibration and selective prediction from scored rows: truth, prob_* columns, optional weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import VALIDATION_TOKENS, reject_look_ahead

UNKNOWN = "UNKNOWN"


def top_class(df: DataFrame, labels: list[str]) -> DataFrame:
    """df with confidence, predicted (the first of the largest), correct (UNKNOWN truths are never correct) and w."""
    ps = [F.col(f"prob_{x}") for x in labels]
    best = F.greatest(*ps) if len(ps) > 1 else ps[0]
    predicted = F.coalesce(*[F.when(p == best, x) for p, x in zip(ps, labels, strict=True)])
    w = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    return df.withColumns({"confidence": best, "predicted": predicted, "w": w}).withColumn("correct", F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False)).cast("double"))


def bin_of(confidence: F.Column, bins: int) -> F.Column:
    """0-based bin by explicit edges i / bins, [low, high), the last closed."""
    edges = [i / bins for i in range(1, bins)]
    return sum((F.when(confidence >= e, 1).otherwise(0) for e in edges[1:]), F.when(confidence >= edges[0], 1).otherwise(0)) if edges else F.lit(0)


def reliability(df: DataFrame, labels: list[str], bins: int = 10) -> DataFrame:
    """A row a bin, empty ones too: n, weight, confidence, accuracy."""
    rows = top_class(df, labels).withColumn("bin", bin_of(F.col("confidence"), bins).cast("int"))
    sums = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("confidence")) / F.sum("w")).alias("confidence"), (F.sum(F.col("w") * F.col("correct")) / F.sum("w")).alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(sums, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "confidence", "accuracy")


def expected_calibration_error(df: DataFrame, labels: list[str], bins: int = 10) -> DataFrame:
    gap = F.col("weight") * F.abs(F.col("confidence") - F.col("accuracy"))
    return reliability(df, labels, bins).agg((F.sum(gap) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("ece"))


def coverage_risk(df: DataFrame, labels: list[str], thresholds: int = 101) -> DataFrame:
    """A row a threshold: coverage, and risk among accepted rows (confidence at or above it). Rows are first counted by
    the largest threshold they reach, then summed from above, so they are not paired with thresholds."""
    grid = df.sparkSession.range(thresholds).select(F.col("id").cast("int").alias("k"), (F.col("id") / F.lit(float(thresholds - 1))).alias("threshold"))
    n = float(thresholds - 1)
    rows = top_class(df, labels)
    # the float grid decides: step to the neighbour where the quotient was rounded over an edge
    k = F.floor(F.col("confidence") * n).cast("int")
    k = F.when((k + 1) / n <= F.col("confidence"), k + 1).when(k / n > F.col("confidence"), k - 1).otherwise(k)
    sums = rows.groupBy(F.least(k, F.lit(thresholds - 1)).alias("k")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * (1 - F.col("correct"))).alias("e"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = grid.join(sums, "k", "left").withColumns({"w": F.coalesce("w", F.lit(0.0)), "e": F.coalesce("e", F.lit(0.0))})
    out = out.withColumns({"aw": F.sum("w").over(above), "ae": F.sum("e").over(above), "t": F.sum("w").over(everything)})
    return out.select("threshold", (F.col("aw") / F.nullif(F.col("t"), F.lit(0.0))).alias("coverage"), (F.col("ae") / F.nullif(F.col("aw"), F.lit(0.0))).alias("risk"))


def unknown_threshold(df: DataFrame, labels: list[str], *, target_error: float = 0.10, min_coverage: float = 0.0) -> DataFrame:
    """One row: the least threshold of enough coverage and little risk; 1 if there is none."""
    fine = (F.col("coverage") >= min_coverage) & (F.col("risk") <= target_error)
    return coverage_risk(df, labels).agg(F.coalesce(F.min(F.when(fine, F.col("threshold"))), F.lit(1.0)).alias("unknown_threshold"))


def selective_metrics(df: DataFrame, labels: list[str], threshold: float) -> DataFrame:
    """One row: Brier, log loss, accuracy and coverage of known truths; coverage, selective risk and rejection of all."""
    rows = top_class(df, labels).withColumns({"known": F.col("truth") != UNKNOWN, "accepted": F.col("confidence") >= threshold})
    own = F.coalesce(*[F.when(F.col("truth") == x, F.col(f"prob_{x}")) for x in labels], F.lit(0.0))
    brier = sum((F.pow(F.col(f"prob_{x}") - (F.col("truth") == x).cast("double"), F.lit(2.0)) for x in labels[1:]), F.pow(F.col(f"prob_{labels[0]}") - (F.col("truth") == labels[0]).cast("double"), F.lit(2.0)))
    mean = lambda x, cond: F.sum(F.when(cond, F.col("w") * x)) / F.nullif(F.sum(F.when(cond, F.col("w"))), F.lit(0.0))
    known, accepted = F.col("known"), F.col("accepted")
    return rows.agg(
        mean(brier, known).alias("brier"), mean(-F.ln(F.greatest(own, F.lit(1e-15))), known).alias("log_loss"), mean(F.col("correct"), known).alias("accuracy"),
        mean(accepted.cast("double"), F.lit(True)).alias("coverage"), mean(1 - F.col("correct"), accepted).alias("selective_risk"), mean(accepted.cast("double"), known).alias("known_coverage"),
        mean((~accepted).cast("double"), ~known).alias("unknown_rejection_rate"),
    )


def per_class(df: DataFrame, labels: list[str]) -> DataFrame:
    """(label, precision, recall, f1, weighted_support) over rows of known truth."""
    rows = top_class(df, labels).where(F.col("truth") != UNKNOWN)
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (F.col("truth") == x).alias("is"), (F.col("predicted") == x).alias("said")) for x in labels]))
    s = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    out = rows.select("w", cells.alias("x")).select("w", "x.*").groupBy("label").agg(s(F.col("is") & F.col("said")).alias("tp"), s(F.col("said")).alias("p"), s(F.col("is")).alias("weighted_support"))
    out = out.withColumns({"precision": F.coalesce(F.col("tp") / F.nullif(F.col("p"), F.lit(0.0)), F.lit(0.0)), "recall": F.coalesce(F.col("tp") / F.nullif(F.col("weighted_support"), F.lit(0.0)), F.lit(0.0))})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.select("label", "precision", "recall", f1.alias("f1"), "weighted_support")


def macro_metrics(df: DataFrame, labels: list[str]) -> DataFrame:
    """One row: macro_f1, and balanced_accuracy over labels that occur."""
    return per_class(df, labels).agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("weighted_support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def aps_scores(df: DataFrame, labels: list[str]) -> DataFrame:
    """df with aps_score: the probability of all labels at least as probable as the truth (null for other truths)."""
    ps = F.array(*[F.col(f"prob_{x}") for x in labels])
    own = F.coalesce(*[F.when(F.col("truth") == x, F.col(f"prob_{x}")) for x in labels])
    return df.withColumn("aps_score", F.when(own.isNotNull(), F.aggregate(F.filter(ps, lambda p: p >= own), F.lit(0.0), lambda s, p: s + p)))


#: Cells that a range of scores is counted in.
CELLS = 4096


def aps_quantile(df: DataFrame, labels: list[str], alpha: float = 0.10) -> DataFrame:
    """One row: the score of conformal rank. Scores are counted in cells of equal width; the cell that holds the rank is the
    only one whose scores are ordered, and its cells are cut again the same way, so no task sorts all rows."""
    scores = aps_scores(df, labels).where("aps_score IS NOT NULL").select("aps_score")
    one = scores.agg(F.count(F.lit(1)).alias("total"), F.min("aps_score").alias("low"), F.max("aps_score").alias("high"))
    rank = F.least(F.col("total") - 1, F.ceil((F.col("total") + 1) * (1 - alpha)) - 1)
    bracket = one.select(rank.alias("rank"), "low", "high")
    for _ in range(2):  # each time to one of CELLS
        cell = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("aps_score") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS), F.lit(CELLS - 1))).otherwise(0)
        inside = scores.crossJoin(F.broadcast(bracket)).where(F.col("aps_score").between(F.col("low"), F.col("high")))  # one row
        cells = inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("aps_score").alias("least"), F.max("aps_score").alias("most"), F.first("rank").alias("rank"))
        upto = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))  # a row a cell
        found = cells.withColumn("upto", upto).where("upto > rank")
        bracket = found.agg(F.min(F.struct("cell", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "least", "most")).alias("b")).select(F.col("b.rank").alias("rank"), F.col("b.least").alias("low"), F.col("b.most").alias("high"))
    left = scores.crossJoin(F.broadcast(bracket)).where(F.col("aps_score").between(F.col("low"), F.col("high")))
    counts = left.groupBy("aps_score").agg(F.count(F.lit(1)).alias("n"), F.first("rank").alias("rank"))
    upto = F.sum("n").over(Window.orderBy("aps_score").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).where("upto > rank").agg(F.min("aps_score").alias("aps_q"))


def prediction_sets(df: DataFrame, labels: list[str], q: float) -> DataFrame:
    """df with prediction_set: labels from the most probable on until their sum reaches q."""
    pairs = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"prob_{x}").alias("p"), F.lit(x).alias("x")) for x in labels])))
    state = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<string>").alias("xs"))
    step = lambda a, b: F.when(a["s"] >= q, a).otherwise(F.struct((a["s"] + b["p"]).alias("s"), F.array_append(a["xs"], b["x"]).alias("xs")))
    return df.withColumn("prediction_set", F.aggregate(pairs, state, step, lambda a: a["xs"]))


def purged_folds(segments: DataFrame, splits: int = 3, min_train: int = 8) -> DataFrame:
    """(fold, segment_id, role): distinct end dates in splits + 2 blocks; fold f trains on blocks 0..f, calibrates on the
    next and tests on the one after; training rows end before both others begin, calibration rows before the test."""
    dates = segments.select(F.col("end").alias("d")).distinct().withColumn("block", F.ntile(splits + 2).over(Window.orderBy("d")) - 1)
    rows = segments.select("segment_id", "start", "end").join(dates, F.col("end") == F.col("d")).drop("d")
    folds = segments.sparkSession.range(splits).select(F.col("id").cast("int").alias("fold"))
    b, f = F.col("block"), F.col("fold")
    role = F.when(b <= f, "train").when(b == f + 1, "calibration").when(b == f + 2, "test")
    parts = rows.crossJoin(F.broadcast(folds)).withColumn("role", role).where("role IS NOT NULL")  # splits is a setting
    starts = parts.groupBy("fold").agg(F.min(F.when(F.col("role") == "calibration", F.col("start"))).alias("cal"), F.min(F.when(F.col("role") == "test", F.col("start"))).alias("test"))
    kept = parts.join(F.broadcast(starts), "fold").where("role = 'test' OR role = 'train' AND end < least(cal, test) OR role = 'calibration' AND end < test")
    enough = kept.groupBy("fold").agg((F.count_if(F.col("role") == "train") >= min_train).alias("ok")).where("ok")
    return kept.join(F.broadcast(enough.select("fold")), "fold", "left_semi").select("fold", "segment_id", "role")


class CalibratedClassifier:
    """Balanced logistic regression on standardised features, calibrated on held-out rows by a sigmoid or isotonic curve
    for each class; UNKNOWN rows are not learned from. fit() and scoring run on MLlib."""

    def __init__(self, features: list[str], method: str = "sigmoid", tree: bool = False):
        reject_look_ahead(features, VALIDATION_TOKENS)
        self.features, self.method, self.tree, self.threshold = features, method, tree, 0.0

    def _raw(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(df).withColumn("_p", vector_to_array("_probability"))
        return out.drop("_raw", "_probability", "_prediction", "_x", "_z", *[f"_f_{c}" for c in self.features])

    def fit(self, train: DataFrame, calibration: DataFrame, truth: str = "truth") -> CalibratedClassifier:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
        from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
        from pyspark.ml.regression import IsotonicRegression

        known = train.where((F.col(truth) != UNKNOWN) & F.col(truth).isNotNull()).withColumns({c: F.col(c).cast("double") for c in self.features})
        counts = known.groupBy(truth).count()  # a row a class
        n, k = counts.agg(F.sum("count"), F.count(F.lit(1))).first()
        known = known.join(F.broadcast(counts), truth).withColumn("_w", F.lit(float(n)) / (F.lit(float(k)) * F.col("count"))).drop("count").select(truth, "_w", *self.features).persist()
        index = StringIndexer(inputCol=truth, outputCol="_y", stringOrderType="alphabetAsc").fit(known)
        self.labels = list(index.labels)
        common = {"featuresCol": "_z", "labelCol": "_y", "weightCol": "_w", "probabilityCol": "_probability", "rawPredictionCol": "_raw", "predictionCol": "_prediction"}
        learner = DecisionTreeClassifier(maxDepth=4, **common) if self.tree else LogisticRegression(family="multinomial", regParam=1.0 / max(n, 1), **common)
        filled = [f"_f_{c}" for c in self.features]
        steps = [Imputer(strategy="median", inputCols=self.features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), StandardScaler(withMean=True, inputCol="_x", outputCol="_z"), learner]
        self.model = Pipeline(stages=steps).fit(index.transform(known))
        known.unpersist()
        held = self._raw(calibration.where((F.col(truth) != UNKNOWN) & F.col(truth).isNotNull())).select("_p", truth).persist()
        self.curves = []
        for j, label in enumerate(self.labels):
            rows = held.select(F.get("_p", F.lit(j)).alias("p"), (F.col(truth) == label).cast("double").alias("y"))
            if self.method == "isotonic":
                m = IsotonicRegression(featuresCol="p", labelCol="y").fit(rows)
                self.curves.append(("isotonic", list(m.boundaries), list(m.predictions)))
            else:
                logit = F.ln(F.greatest("p", F.lit(1e-9)) / F.greatest(1 - F.col("p"), F.lit(1e-9)))
                m = LogisticRegression(featuresCol="_x", labelCol="y").fit(VectorAssembler(inputCols=["l"], outputCol="_x").transform(rows.withColumn("l", logit)))
                self.curves.append(("sigmoid", float(m.intercept), float(m.coefficients[0])))
        held.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prob_* scaled to 1 and predicted_label, UNKNOWN below the threshold."""
        out = self._raw(df)
        cs = []
        for j, (label, curve) in enumerate(zip(self.labels, self.curves, strict=True)):
            p = F.get("_p", F.lit(j))
            if curve[0] == "sigmoid":
                c = 1 / (1 + F.exp(-(F.lit(curve[1]) + F.lit(curve[2]) * F.ln(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9))))))
            else:
                c = F.lit(curve[2][0])
                for (x0, y0), (x1, y1) in zip(list(zip(*curve[1:], strict=True)), list(zip(*curve[1:], strict=True))[1:], strict=False):
                    c = F.when(p >= x0, F.lit(y0) + (F.lit(y1 - y0) * F.least(F.greatest((p - x0) / F.lit(max(x1 - x0, 1e-12)), F.lit(0.0)), F.lit(1.0)))).otherwise(c)
            cs.append(c.alias(f"_c{j}"))
        out = out.select("*", *cs)
        total = F.nullif(sum((F.col(f"_c{j}") for j in range(1, len(cs))), F.col("_c0")), F.lit(0.0))
        out = out.withColumn("_t", total).withColumns({f"prob_{x}": F.coalesce(F.col(f"_c{j}") / F.col("_t"), F.lit(1.0 / len(cs))) for j, x in enumerate(self.labels)}).drop("_t", "_p", *[f"_c{j}" for j in range(len(cs))])
        best = F.greatest(*[F.col(f"prob_{x}") for x in self.labels]) if len(cs) > 1 else F.col(f"prob_{self.labels[0]}")
        label = F.coalesce(*[F.when(F.col(f"prob_{x}") == best, x) for x in self.labels])
        return out.withColumn("predicted_label", F.when(best >= self.threshold, label).otherwise(UNKNOWN))

    def choose_threshold(self, calibration: DataFrame, **limits) -> float:
        self.threshold = unknown_threshold(self.predict(calibration).drop("predicted_label"), self.labels, **limits).first()[0]
        return self.threshold
