"""Soft clusters of segments with abstention: ensemble fits on all rows, scoring by broadcast parameters, walk-forward refits.

Fits run as one task a model version, which holds all of its training rows; scoring is a pass over rows. Cluster names are local to a model version.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BASELINE_GATES, GateConfig
from ..functions import kernels as K
from ..functions.checks import DISCOVERY_TOKENS, reject_look_ahead, require
from ..functions.density import DensityClusters
from ..functions.numeric import clip, dense_numbers
from ..session import cut
from . import labels as L

#: Segments of a sample for fits on a whole market.
FIT_ROWS = 50_000


@dataclass
class Ensemble:
    """Parameters of one model version, in the order of clusters by mean return."""

    features: list[str]
    scaler: K.RobustScaler
    members: list[K.Mixture]
    process: K.Mixture | None
    low_density: float
    names: list[str]
    density: DensityClusters | None = None
    nearest: np.ndarray | None = None  # for each density cluster the mixture component of the nearest mean

    @property
    def converged(self) -> bool:
        return all(m.converged for m in self.members) and (self.process is None or self.process.converged)

    def score(self, x: np.ndarray) -> dict[str, np.ndarray]:
        z = self.scaler(x)
        own = np.stack([m.probabilities(z) for m in self.members])
        process = own[-1] if self.process is None else self.process.probabilities(z)
        each = own if self.process is None else np.concatenate([own, process[None]])
        noise, strength = None, None
        if self.density is not None:
            label, strength = self.density.predict(z)
            noise, k = label < 0, own.shape[2]
            h = np.full((len(z), k), 1.0 / k)
            some = np.flatnonzero(~noise)
            h[some] = ((1 - strength[some]) / k)[:, None]
            h[some, self.nearest[label[some]]] += strength[some]
            each = np.concatenate([each, h[None]])
        p = each.mean(axis=0)
        p = p / p.sum(axis=1, keepdims=True)
        k = p.shape[1]
        entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1) / np.log(k) if k > 1 else np.zeros(len(p))
        # the discovery ensemble takes the first member's density, the baseline the mean of all
        density = self.members[0].log_density(z) if self.process is not None else np.mean([m.log_density(z) for m in self.members], axis=0)
        return {"p": p, "gmm": own.mean(axis=0), "dpgmm": process, "noise": noise, "strength": strength, "entropy": entropy, "disagreement": each.std(axis=0).mean(axis=1), "density": density, "low": density < self.low_density}


def _reorder(m, order: np.ndarray):
    """A mixture with its components in another order."""
    return m._replace(**{f: getattr(m, f)[order] for f in m._fields if f not in ("converged", "bound")})


def fit_ensemble(x: np.ndarray, features: list[str], cfg: GateConfig, key: tuple = ()) -> Ensemble:
    """Mixtures on bootstrap samples and a process mixture, all aligned with the first by the nearest means."""
    scaler = K.RobustScaler(x)
    z = scaler(x)
    k = max(1, min(cfg.n_clusters, len(z), len(np.unique(z, axis=0))))
    rng = K.keyed_rng(cfg.random_state, *key)
    members = []
    for j in range(cfg.ensemble_size):
        rows = z if j == 0 else z[rng.integers(0, len(z), len(z))]
        members.append(K.gaussian_mixture(rows, k, rng, max_iter=cfg.max_iter))
    process = K.process_mixture(z, k, rng, max_iter=cfg.max_iter)
    lead = features.index("cumulative_return") if "cumulative_return" in features else 0
    members[0] = _reorder(members[0], np.lexsort((members[0].means.sum(axis=1), members[0].means[:, lead])))
    base = members[0].means
    align = lambda m: _reorder(m, K.assign(((base[:, None, :] - m.means[None, :, :]) ** 2).sum(axis=2)))
    members[1:] = [align(m) for m in members[1:]]
    low = float(np.quantile(members[0].log_density(z), cfg.density_quantile))
    model = Ensemble(features, scaler, members, align(process), low, [f"CLUSTER_{chr(65 + j)}" for j in range(k)])
    if cfg.include_hdbscan:
        model.density = DensityClusters(z, max(2, min(cfg.min_cluster_samples, len(z))))
        centres = [z[model.density.labels == c].mean(axis=0) for c in range(model.density.count)]
        model.nearest = np.array([((base - c) ** 2).sum(axis=1).argmin() for c in centres], int)
    return model


def fit_baseline(x: np.ndarray, features: list[str], cfg: GateConfig, key: tuple = ()) -> Ensemble:
    """Full-covariance mixtures on all rows from different seeds, aligned with the first; no process mixture."""
    scaler = K.RobustScaler(x)
    z = scaler(x)
    k = max(1, min(cfg.n_clusters, len(z), len(np.unique(z, axis=0))))
    members = [K.full_mixture(z, k, K.keyed_rng(cfg.random_state + j, *key), max_iter=cfg.max_iter) for j in range(cfg.ensemble_size)]
    lead = features.index("cumulative_return") if "cumulative_return" in features else 0
    members[0] = _reorder(members[0], np.lexsort((members[0].means.sum(axis=1), members[0].means[:, lead])))
    base = members[0].means
    members[1:] = [_reorder(m, K.assign(((base[:, None, :] - m.means[None, :, :]) ** 2).sum(axis=2))) for m in members[1:]]
    model = Ensemble(features, scaler, members, None, -np.inf, [f"CLUSTER_{chr(65 + j)}" for j in range(k)])
    model.low_density = float(np.quantile(model.score(x)["density"], cfg.density_quantile))
    return model


def hash_order(df: DataFrame, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col("segment_id").cast("string"), F.lit(seed)), "segment_id")


def sample_rows(df: DataFrame, most: int = FIT_ROWS, seed: int = 42) -> DataFrame:
    return hash_order(df, seed).limit(most)


def year_quotas(df: DataFrame, most: int, floor: int = 0) -> DataFrame:
    """(year, available, quota): proportional shares by largest remainder, at least floor where there are as many. A row a year."""
    rows = df.groupBy(F.year("start").alias("year")).agg(F.count(F.lit(1)).alias("available"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.least(F.col("available"), F.lit(floor))
    rest = F.greatest(F.least(F.lit(most), F.sum("available").over(everything)) - F.sum(low).over(everything), F.lit(0))
    share = rest * (F.col("available") - low) / F.nullif((F.sum(F.col("available") - low).over(everything)).cast("double"), F.lit(0.0))
    rows = rows.withColumns({"low": low, "rest": rest, "share": F.coalesce(share, F.lit(0.0))}).withColumn("whole", F.floor("share"))
    left = F.col("rest") - F.sum("whole").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc(F.col("share") - F.col("whole")), "year"))
    return rows.select("year", "available", (F.col("low") + F.col("whole") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("quota"))


def keyed_hash(key: str, seed: int) -> F.Column:
    """60 bits of the MD5 of the key and the seed: a number from 0 that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long")


def hash_share(h: F.Column, take, of) -> F.Column:
    """Whether the hash h (of 60 bits) is among the smallest share that holds `take` of `of` rows with room to spare (six
    deviations), so that few more rows than are taken are sorted."""
    room = F.least(F.lit(1.0), (take + 6 * F.sqrt(take.cast("double")) + 6) / of)
    return h.cast("double") <= room * F.lit(2.0**60)


def stratified_fit_sample(df: DataFrame, most: int, floor: int = 0, seed: int = 42) -> DataFrame:
    q = year_quotas(df, most, floor).select(F.col("year").alias("_y"), "available", "quota")  # a row a year
    h = keyed_hash("segment_id", seed)
    rows = df.withColumns({"_year": F.year("start"), "_h": h}).join(F.broadcast(q), F.col("_year").eqNullSafe(F.col("_y"))).where(hash_share(F.col("_h"), F.col("quota"), F.col("available")))
    w = Window.partitionBy("_year").orderBy("_h", "segment_id")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r <= quota").drop("_year", "_r", "_y", "_h", "available", "quota")


def score_segments(df: DataFrame, model: Ensemble) -> DataFrame:
    """df with prob_*, gmm_prob_*, dpgmm_prob_*, candidate_label, max_probability, posterior_entropy, model_disagreement,
    density_score, is_low_density, mixture_converged, hdbscan columns (absent) and soft_label."""
    names = model.names
    need = df.select("segment_id", *[F.col(f).cast("double") for f in model.features])

    def run(batches):
        for pdf in batches:
            s = model.score(pdf[model.features].to_numpy(float))
            yield pd.DataFrame({"segment_id": pdf["segment_id"], "p": list(s["p"]), "g": list(s["gmm"]), "d": list(s["dpgmm"]), "posterior_entropy": s["entropy"], "model_disagreement": s["disagreement"], "density_score": s["density"], "is_low_density": s["low"], "hdbscan_noise": s["noise"] if s["noise"] is not None else None, "hdbscan_strength": s["strength"] if s["strength"] is not None else np.nan})

    kind = next(f.dataType.simpleString() for f in df.schema if f.name == "segment_id")
    scored = need.mapInPandas(run, f"segment_id {kind}, p array<double>, g array<double>, d array<double>, posterior_entropy double, model_disagreement double, density_score double, is_low_density boolean, hdbscan_noise boolean, hdbscan_strength double")
    out = df.join(scored, "segment_id")
    fan = {f"{prefix}prob_{n}": F.get(a, F.lit(j)) for prefix, a in (("", "p"), ("gmm_", "g"), ("dpgmm_", "d")) for j, n in enumerate(names)}
    top = F.array_max("p")
    best = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("p", top).cast("int"))
    return out.withColumns(fan | {
        "max_probability": top, "candidate_label": best, "soft_label": F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("p")), "mixture_converged": F.lit(model.converged),
        "hdbscan_available": F.lit(model.density is not None), "hdbscan_strength": F.when(~F.isnan("hdbscan_strength"), F.col("hdbscan_strength")),
    }).drop("p", "g", "d")


def boundary_uncertainty(df: DataFrame) -> DataFrame:
    """df with boundary_uncertainty, which fails closed: a given one counts 1 where it is null; where the column is missing or
    has no value at all it is 1 less the first boundary probability there is (null: 0), and 0 without any evidence column."""
    bounded = lambda c, missing: clip(F.coalesce(F.col(c).cast("double"), F.lit(missing)), 0.0, 1.0)
    given = "boundary_uncertainty" in df.columns
    evidence = next((c for c in ("boundary_probability", "start_boundary_probability", "end_boundary_probability") if c in df.columns), None)
    otherwise = 1 - bounded(evidence, 0.0) if evidence else F.lit(0.0)
    if not given:
        return df.withColumn("boundary_uncertainty", otherwise)
    # looked at while the plan is made: the first value found ends the look
    has = df.where(F.col("boundary_uncertainty").isNotNull()).limit(1).count() > 0
    return df.withColumn("boundary_uncertainty", bounded("boundary_uncertainty", 1.0) if has else otherwise)


def context_conflict(df: DataFrame) -> DataFrame:
    """df with context_conflict: a given column of that name or of conflicts between periods (null: 0), else the share of
    numeric multitf_ return, slope and trend columns whose sign is not the segment's return's."""
    given = next((c for c in ("context_conflict", "multi_period_conflict", "multiperiod_conflict") if c in df.columns), None)
    if given:
        return df.withColumn("context_conflict", clip(F.coalesce(F.col(given).cast("double"), F.lit(0.0)), 0.0, 1.0))
    signs = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name.startswith("multitf_") and any(t in f.name.lower() for t in ("return", "slope", "trend"))]
    if not signs or "cumulative_return" not in df.columns:
        return df.withColumn("context_conflict", F.lit(0.0))
    parts = [F.when(F.col(c).isNotNull() & (F.signum(F.col(c)) != 0) & (F.signum("cumulative_return") != 0), (F.signum(F.col(c)) != F.signum("cumulative_return")).cast("double")) for c in signs]
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return df.withColumn("context_conflict", F.coalesce(F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(arr).cast("double"), F.lit(0.0)), F.lit(0.0)))


def label_segments(df: DataFrame, model: Ensemble, support: DataFrame, cfg: GateConfig, gates: list | None = None) -> DataFrame:
    """Scores, recognizability and gates. support: (candidate_label, cluster_supported) of the fitted rows."""
    scored = L.recognizability(context_conflict(boundary_uncertainty(score_segments(df, model))), cfg)
    scored = scored.join(F.broadcast(support), "candidate_label", "left").withColumn("cluster_supported", F.coalesce("cluster_supported", F.lit(False)))
    return L.apply_gates(scored, gates or L.discovery_gates(cfg))


def discover(df: DataFrame, features: list[str], cfg: GateConfig | None = None, *, most: int | None = None, backend: str = "ensemble") -> DataFrame:
    """Fit on all rows, which the driver holds (or on a sample of `most`, by year where there is a start), then label every
    row. backend: ensemble, or gmm for the baseline with its own gates."""
    if backend not in ("ensemble", "gmm"):
        raise ValueError(f"unknown backend {backend!r}")
    cfg = cfg or (GateConfig() if backend == "ensemble" else BASELINE_GATES)
    reject_look_ahead(features, DISCOVERY_TOKENS)
    require(df, ("segment_id", *features), "segments")
    chosen = df if most is None else stratified_fit_sample(df, most) if "start" in df.columns else sample_rows(df, most)
    sample = hash_order(chosen.select("segment_id", *[F.col(f).cast("double") for f in features])).toPandas()
    if not len(sample):
        raise ValueError("no segments to fit on")
    model = (fit_ensemble if backend == "ensemble" else fit_baseline)(sample[features].to_numpy(float), features, cfg)
    if {"symbol", "start"} <= set(df.columns):
        support = L.cluster_support(score_segments(df, model), cfg)
    else:  # without provenance no cluster is supported
        support = df.sparkSession.createDataFrame([(n, False) for n in model.names], "candidate_label string, cluster_supported boolean")
    return label_segments(df, model, support, cfg, L.discovery_gates(cfg) if backend == "ensemble" else L.baseline_gates(cfg))


def profiles(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """(label, feature, mean): probability-weighted means."""
    cells = [F.struct(F.lit(n).alias("label"), F.lit(f).alias("feature"), (F.sum(F.col(f"prob_{n}") * F.col(f)) / F.nullif(F.sum(F.when(F.col(f).isNotNull(), F.col(f"prob_{n}"))), F.lit(0.0))).alias("mean")) for n in labels for f in features]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def suggest_names(df: DataFrame, labels: list[str]) -> DataFrame:
    """(label, suggested): UPTREND, DOWNTREND, RANGE or TRANSITION by weighted return against the median size of returns."""
    own = profiles(df, ["cumulative_return"], labels)
    size = df.agg(F.median(F.abs("cumulative_return")).alias("m"))
    r, m = F.col("mean"), F.col("m")
    name = F.when(r > 0.5 * m, "UPTREND").when(r < -0.5 * m, "DOWNTREND").when(F.abs(r) <= 0.2 * m, "RANGE").otherwise("TRANSITION")
    return own.crossJoin(F.broadcast(size)).select("label", name.alias("suggested"))  # one row


# --- walk forward ---------------------------------------------------------------------------------------------------


def refit_schedule(df: DataFrame, *, min_rows: int = 100, every: int = 20) -> DataFrame:
    """(decision_at, version): the model in force on each day something became available: it is refitted on the first day
    with min_rows rows available before it and then on days whose number is divisible by every. A row a day."""
    days = df.groupBy(F.col("available_at").alias("decision_at")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("decision_at")
    days = days.withColumns({"k": F.row_number().over(w) - 1, "before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    enough = F.col("before") >= min_rows
    first = F.min(F.when(enough, F.col("k"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fits = enough & ((F.col("k") == first) | (F.col("k") % every == 0))
    return days.withColumn("version", F.last(F.when(fits, F.col("decision_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).select("decision_at", "version")


def training_bounds(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """(version, train_rows, train_max_end, train_max_available_at) of rows available strictly before a version."""
    versions = schedule.where("version IS NOT NULL").select("version").distinct()
    rows = df.select("available_at", "end")
    both = versions.select(F.col("version").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("timestamp_ntz").alias("end"), F.lit(0).alias("one")).unionByName(rows.groupBy("available_at").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("one")).select(F.col("available_at").alias("t"), F.lit(1).alias("side"), "end", "one"))
    w = Window.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"train_rows": F.sum("one").over(w), "train_max_end": F.max("end").over(w), "train_max_available_at": F.max(F.when(F.col("side") == 1, F.col("t"))).over(w)})
    return out.where("side = 0").select(F.col("t").alias("version"), "train_rows", "train_max_end", "train_max_available_at")


def purge_overlaps(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """df with version, symbol_train_max_end (the last end of its symbol's rows that the version saw) and purged: the row
    starts no later than that."""
    rows = df.join(schedule, df["available_at"] == schedule["decision_at"], "left").drop("decision_at")
    asks = rows.where("version IS NOT NULL").select("segment_id", "symbol", F.col("version").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("timestamp_ntz").alias("e"))
    seen = df.select(F.lit(None).cast("string").alias("segment_id"), "symbol", F.col("available_at").alias("t"), F.lit(1).alias("side"), F.col("end").alias("e"))
    w = Window.partitionBy("symbol").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = asks.unionByName(seen).withColumn("last_end", F.max("e").over(w)).where("side = 0").select("segment_id", "last_end")
    return rows.join(last, "segment_id", "left").withColumn("purged", F.coalesce(F.col("start") <= F.col("last_end"), F.lit(False))).withColumnRenamed("last_end", "symbol_train_max_end")


def check_segments(df: DataFrame) -> None:
    """Raises where segments cannot be states of a past-only run: no time of availability, one before the segment's end, or a
    repeated id."""
    early, none, rows = df.agg(F.count_if(F.col("available_at") < F.col("end")), F.count_if(F.col("available_at").isNull()), F.count(F.lit(1))).first()
    if none:
        raise ValueError(f"available_at is missing in {none} of {rows} segments")
    if early:
        raise ValueError(f"available_at precedes the end of {early} segments")
    if df.groupBy("segment_id").count().where("count > 1").limit(1).count():
        raise ValueError("segment_id must be unique")


def walk_forward(df: DataFrame, features: list[str], cfg: GateConfig | None = None, *, min_rows: int = 100, every: int = 20, salts: int = 4) -> DataFrame:
    """Out-of-sample states: each row is scored by the version in force when it became available, fitted on all rows
    available strictly before. Versions are fitted in parallel, one task each, which holds that version's past; a fit leaves
    one row of parameters, and rows are scored apart from fits, each version's in `salts` tasks."""
    cfg = cfg or GateConfig()
    if min_rows < 2 or every < 1:
        raise ValueError("min_rows must be at least 2 and every positive")
    reject_look_ahead(features, DISCOVERY_TOKENS)
    require(df, ("segment_id", "symbol", "start", "end", "available_at", *features), "segments")
    df = cut(df)
    check_segments(df)
    schedule = refit_schedule(df, min_rows=min_rows, every=every)
    bounds = training_bounds(df, schedule)
    rows = purge_overlaps(df, schedule)
    values = [F.col(f).cast("double").alias(f) for f in features]
    # versions are few (one in `every` days) and travel as one row; a row goes to each version that is later than it
    versions = bounds.agg(F.collect_list("version").alias("_versions"))
    need = df.select("segment_id", "symbol", F.year("start").alias("year"), "available_at", *values).crossJoin(F.broadcast(versions))
    train = need.withColumn("version", F.explode(F.filter("_versions", lambda v: v > F.col("available_at")))).drop("_versions", "available_at")

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment_id")
        x = pdf[features].to_numpy(float)
        model = fit_ensemble(x, features, cfg, (str(pd.Timestamp(key[0])),))
        own = model.score(x)["p"].argmax(axis=1)
        good = [j for j in range(len(model.names)) if (m := own == j).sum() >= cfg.min_cluster_samples and pdf.symbol[m].nunique() >= cfg.min_cluster_symbols and pdf.year[m].nunique() >= cfg.min_cluster_years]
        return pd.DataFrame({"version": [key[0]], "model": [pickle.dumps((model, good))]})

    models = train.groupBy("version").applyInPandas(learn, "version timestamp_ntz, model binary")
    k = cfg.n_clusters
    columns = [f"prob_CLUSTER_{chr(65 + j)}" for j in range(k)]
    schema = "segment_id string, candidate_label string, max_probability double, posterior_entropy double, model_disagreement double, density_score double, is_low_density boolean, hdbscan_noise boolean, hdbscan_strength double, mixture_converged boolean, cluster_supported boolean, " + ", ".join(f"{c} double" for c in columns)
    names = [x.split()[0] for x in schema.split(", ")]

    def score(ask: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(fitted):
            return pd.DataFrame(columns=names)
        model, good = pickle.loads(fitted["model"].iloc[0])
        s = model.score(ask[features].to_numpy(float))
        p = np.zeros((len(ask), k))
        p[:, : s["p"].shape[1]] = s["p"]
        best = p.argmax(axis=1)
        out = pd.DataFrame({"segment_id": ask.segment_id, "candidate_label": [model.names[b] for b in best], "max_probability": p.max(axis=1), "posterior_entropy": s["entropy"], "model_disagreement": s["disagreement"], "density_score": s["density"], "is_low_density": s["low"], "hdbscan_noise": s["noise"] if s["noise"] is not None else None, "hdbscan_strength": s["strength"] if s["strength"] is not None else None, "mixture_converged": model.converged, "cluster_supported": [b in good for b in best]})
        return out.assign(**{c: p[:, j] for j, c in enumerate(columns)})[names]

    asks = rows.where("version IS NOT NULL AND NOT purged").select("segment_id", *values, "version", F.pmod(F.xxhash64("segment_id"), F.lit(salts)).cast("int").alias("_salt"))
    salted = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scored = asks.groupBy("version", "_salt").cogroup(salted.groupBy("version", "_salt")).applyInPandas(score, schema)
    out = rows.join(scored, "segment_id", "left").join(bounds.drop("train_max_end"), "version", "left")
    out = L.apply_gates(L.recognizability(context_conflict(boundary_uncertainty(out)), cfg), L.discovery_gates(cfg))
    special = F.when(F.col("version").isNull(), "insufficient_history").when(F.col("purged"), "purged_overlap")
    reason = F.coalesce(special, F.col("unknown_reason"))
    known = reason == ""
    return out.withColumns({
        "unknown_reason": reason, "label": F.when(known, F.col("candidate_label")).otherwise(L.UNKNOWN), "is_unknown": ~known, "candidate_status": F.when(known, "classified").otherwise("model_abstention"),
        "state_available_at": F.col("available_at"), "oos_model_trained_at": F.col("version"), "oos_train_rows": F.coalesce("train_rows", F.lit(0)), "oos_train_max_end": F.col("symbol_train_max_end"), "oos_train_max_available_at": F.col("train_max_available_at"),
    }).drop("version", "train_rows", "symbol_train_max_end", "train_max_available_at")


# --- fixed groups ---


def soft_assign(df: DataFrame, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", floor: float = 1e-4) -> DataFrame:
    """key, candidate_label, max_probability: posterior of a diagonal Gaussian mixture with the labels' groups as components,
    over all dimensions of the vectors. floor is added to variances."""
    x = F.col(vector).cast("array<double>")
    cells = df.select(F.col(label).alias("candidate_label"), F.posexplode(x).alias("k", "x"))
    cells = cells.groupBy("candidate_label", "k").agg(F.avg("x").alias("m"), (F.var_pop("x") + floor).alias("s"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("k", "m", "s"))), lambda c: F.struct(c["m"].alias("m"), c["s"].alias("s")))
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    params = cells.groupBy("candidate_label").agg(each.alias("c")).join(sizes.withColumn("lw", F.ln(F.col("n") / total)), F.col("candidate_label") == F.col("_l"))
    terms = F.zip_with(x, F.col("c"), lambda v, c: (v - c["m"]) * (v - c["m"]) / c["s"] + F.ln(F.lit(2.0) * F.pi() * c["s"]))
    joint = df.select(key, vector).crossJoin(F.broadcast(params.select("candidate_label", "c", "lw")))  # a row a component
    joint = joint.select(key, "candidate_label", (F.col("lw") - 0.5 * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)).alias("lj"))
    best = joint.groupBy(key).agg(F.max("lj").alias("top"), F.max_by("candidate_label", "lj").alias("candidate_label"), F.collect_list("lj").alias("ljs"))
    return best.select(key, "candidate_label", (1 / F.aggregate("ljs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))).alias("max_probability"))


# --- robustness -----------------------------------------------------------------------------------------------------


def bootstrap_symbols(df: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, symbol, multiplicity): symbols drawn with replacement, as many as there are. Each of n slots of a draw picks a
    symbol's number by a keyed hash; numbers are dealt by hash bucket, so no task holds all symbols."""
    numbered = dense_numbers(df.select("symbol").distinct(), "symbol", "i", seed)
    n = numbered.count()
    slots = df.sparkSession.range(draws * n).select(F.floor(F.col("id") / max(n, 1)).cast("int").alias("draw"), (F.col("id") % max(n, 1)).alias("slot"))
    picks = slots.select("draw", F.pmod(F.xxhash64("draw", "slot", F.lit(seed)), F.lit(max(n, 1))).alias("i"))
    return picks.groupBy("draw", "i").agg(F.count(F.lit(1)).alias("multiplicity")).join(numbered, "i").select("draw", "symbol", "multiplicity")


def perturb_features(df: DataFrame, features: list[str], noise: float, *, fixed: tuple = (), seed: int = 0) -> DataFrame:
    """df with Gaussian noise of noise x 1.4826 MAD (or the deviation where that is 0) on features that are not fixed. The
    noise is a function of (segment_id, feature, seed)."""
    moved = [f for f in features if f not in fixed]
    mid = df.agg(*[F.median(f).alias(f"m_{f}") for f in moved])
    spread = df.crossJoin(F.broadcast(mid)).agg(*[F.coalesce(F.nullif(1.4826 * F.median(F.abs(F.col(f) - F.col(f"m_{f}"))), F.lit(0.0)), F.stddev_pop(f), F.lit(0.0)).alias(f"s_{f}") for f in moved])
    u = lambda f, k: (F.shiftrightunsigned(F.xxhash64(F.col("segment_id").cast("string"), F.lit(f), F.lit(k), F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    normal = lambda f: F.sqrt(-2 * F.ln(u(f, 0))) * F.cos(F.lit(2 * np.pi) * u(f, 1))
    return df.crossJoin(F.broadcast(spread)).withColumns({f: F.col(f) + F.lit(noise) * F.col(f"s_{f}") * normal(f) for f in moved}).drop(*[f"s_{f}" for f in moved])


def align_labels(overlap: list[tuple[str, str, float]]) -> dict[str, str]:
    """Names of right labels in terms of left ones at the largest total overlap (from labels.overlap_matrix)."""
    left, right = sorted({a for a, _, _ in overlap}), sorted({b for _, b, _ in overlap})
    m = np.zeros((len(left), len(right)))
    for a, b, x in overlap:
        m[left.index(a), right.index(b)] = x
    n = max(m.shape)
    square = np.zeros((n, n))
    square[: m.shape[0], : m.shape[1]] = m
    return {right[j]: left[i] for i, j in enumerate(K.assign(-square)) if i < len(left) and j < len(right)}


def align_prototypes(base: Ensemble, other: Ensemble) -> tuple[dict[str, str], float]:
    """Names of other's clusters in terms of base's by the nearest prototypes, and the root mean square distance of matched
    ones. Prototypes are the first members' means in raw units, and distances are in units of base's scaler."""
    if len(base.names) != len(other.names):
        raise ValueError("cluster counts differ: no alignment")
    raw = [m.scaler.middle + m.members[0].means * m.scaler.spread for m in (base, other)]
    unit = np.where(np.isfinite(base.scaler.spread) & (base.scaler.spread > 1e-12), base.scaler.spread, 1.0)
    gap = (((raw[0][:, None, :] - raw[1][None, :, :]) / unit) ** 2).mean(axis=2)
    to = K.assign(gap)  # for each of base's clusters the place of other's
    return {other.names[j]: base.names[i] for i, j in enumerate(to)}, float(np.sqrt(np.mean([gap[i, j] for i, j in enumerate(to)])))


def remap(df: DataFrame, names: dict[str, str], prefix: str = "prob_", labels: list[str] | None = None) -> DataFrame:
    """df in terms of other labels (a map from align_labels or align_prototypes): candidate_label and known labels are
    renamed, and probability columns stand under the new names, in the order of labels (0 where none maps to one)."""
    own = [c for c in df.columns if c.startswith(prefix)]
    labels = labels or [names.get(c.removeprefix(prefix), c.removeprefix(prefix)) for c in own]
    renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    out = df.select(*[F.col(c) for c in df.columns if c not in own], *[
        next((F.col(f"{prefix}{a}") for a, b in names.items() if b == x and f"{prefix}{a}" in own), F.col(f"{prefix}{x}") if f"{prefix}{x}" in own and x not in names else F.lit(0.0)).alias(f"{prefix}{x}") for x in labels
    ])
    for c in ("candidate_label", "label"):
        if renamed is not None and c in out.columns:
            out = out.withColumn(c, F.coalesce(F.when(F.col(c) != L.UNKNOWN, F.get(F.array(F.try_element_at(renamed, F.col(c))), F.lit(0))), F.col(c)))
    return out


def training_digest(sample: DataFrame) -> str:
    """SHA-256 of the ids of a fit's bounded sample, in order."""
    return sample.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("segment_id").cast("string"))), "\n"), 256)).first()[0]


def silhouette(df: DataFrame, features: list[str], label: str = "candidate_label") -> float:
    """Mean silhouette of labelled rows on standardised features (squared Euclidean, MLlib's linear-time form)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler

    rows = df.where((F.col(label) != L.UNKNOWN) & F.col(label).isNotNull()).select(label, *[F.col(f).cast("double") for f in features]).dropna()
    steps = [StringIndexer(inputCol=label, outputCol="_y"), VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(withMean=True, inputCol="_x", outputCol="_z")]
    return ClusteringEvaluator(featuresCol="_z", predictionCol="_y").evaluate(Pipeline(stages=steps).fit(rows).transform(rows))


def tree_rules(df: DataFrame, features: list[str], label: str = "label") -> str:
    """Text of a shallow balanced tree that tells known labels apart."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler

    known = df.where((F.col(label) != L.UNKNOWN) & F.col(label).isNotNull()).withColumns({f: F.col(f).cast("double") for f in features})
    counts = known.groupBy(label).count()
    k, n = counts.agg(F.count(F.lit(1)), F.sum("count")).first()
    if k < 2:
        return "fewer than two labels: no rules"
    rows = known.join(F.broadcast(counts), label).withColumn("_w", F.lit(n / k) / F.col("count"))
    filled = [f"_f_{f}" for f in features]
    tree = DecisionTreeClassifier(maxDepth=3, minInstancesPerNode=5, labelCol="_y", featuresCol="_x", weightCol="_w")
    fitted = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), tree]).fit(rows)
    text = fitted.stages[-1].toDebugString
    for i, f in reversed(list(enumerate(features))):
        text = text.replace(f"feature {i} ", f"{f} ")
    return text


def project(df: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """df with pc_1 .. pc_k of standardised features, gaps at the median."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumns({f"_d_{f}": F.col(f).cast("double") for f in features})
    ins, outs = [f"_d_{f}" for f in features], [f"_f_{f}" for f in features]
    steps = [Imputer(strategy="median", inputCols=ins, outputCols=outs), VectorAssembler(inputCols=outs, outputCol="_x"), StandardScaler(withMean=True, inputCol="_x", outputCol="_z"), PCA(k=k, inputCol="_z", outputCol="_p")]
    out = Pipeline(stages=steps).fit(rows).transform(rows).withColumn("_a", vector_to_array("_p"))
    return out.withColumns({f"pc_{j + 1}": F.get("_a", F.lit(j)) for j in range(k)}).drop("_x", "_z", "_p", "_a", *ins, *outs)
