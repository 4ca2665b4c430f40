"""Configurations, run manifests and evidence: small records checked on the driver, digests joined as tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def path_component(value: object, label: str = "name") -> str:
    """One literal name: no separators, no blanks at the ends, not ``.`` or ``..``."""
    if not isinstance(value, str) or not value or value != value.strip() or value in (".", "..") or any(c in value for c in "/\\\0"):
        raise ValueError(f"invalid {label}: {value!r}")
    return value


def dataset_stem(value: object) -> str:
    name = path_component(value, "dataset")
    for end in (".zarr", ".geff"):
        name = name.removesuffix(end)
    return path_component(name, "dataset")


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class TrackingConfig:
    max_link_distance_um: float = 15.0
    division_search_radius_um: float = 20.0
    max_daughters: int = 2

    def __post_init__(self):
        _positive(max_link_distance_um=self.max_link_distance_um, division_search_radius_um=self.division_search_radius_um)
        if self.max_daughters < 2:
            raise ValueError("max_daughters must be at least 2")


@dataclass(frozen=True)
class MetricConfig:
    node_match_max_distance_um: float = 7.0
    adjusted_jaccard_alpha: float = 0.1
    division_weight: float = 0.1

    def __post_init__(self):
        _positive(node_match_max_distance_um=self.node_match_max_distance_um)
        if self.adjusted_jaccard_alpha < 0 or self.division_weight < 0:
            raise ValueError("weights must not be negative")


@dataclass(frozen=True)
class GateConfig:
    evaluation_epochs: tuple[int, ...] = (50, 65, 80, 100)
    minimum_mean_gain: float = 0.003
    maximum_fold_regression: float = 0.001
    minimum_ensemble_gain: float = 0.002

    def __post_init__(self):
        epochs = tuple(self.evaluation_epochs)
        object.__setattr__(self, "evaluation_epochs", epochs)
        if not epochs or min(epochs) < 1 or tuple(sorted(set(epochs))) != epochs:
            raise ValueError("evaluation_epochs must be positive and strictly increasing")
        if min(self.minimum_mean_gain, self.maximum_fold_regression, self.minimum_ensemble_gain) < 0:
            raise ValueError("gates must not be negative")


@dataclass(frozen=True)
class Config:
    tracking: TrackingConfig = field(default_factory=TrackingConfig)
    metrics: MetricConfig = field(default_factory=MetricConfig)
    gates: GateConfig = field(default_factory=GateConfig)


def load_config(text: str) -> Config:
    """A configuration from JSON, or YAML where that library is installed; unknown keys are errors."""
    try:
        raw = json.loads(text or "{}")
    except ValueError:
        import yaml

        raw = yaml.safe_load(text) or {}
    parts = {"tracking": TrackingConfig, "metrics": MetricConfig, "gates": GateConfig}
    if unknown := sorted(set(raw) - set(parts)):
        raise ValueError(f"unknown sections: {unknown}")
    out = {}
    for name, cls in parts.items():
        own = raw.get(name) or {}
        if unknown := sorted(set(own) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown keys in {name}: {unknown}")
        out[name] = cls(**own)
    return Config(**out)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def run_manifest(candidate: str, config: bytes, split: bytes, fold: str, seed: int, max_hours: float, commit: str) -> dict:
    path_component(candidate, "candidate")
    _positive(max_hours=max_hours)
    if seed < 0:
        raise ValueError("seed must not be negative")
    return {"candidate": candidate, "config_sha256": sha256(config), "split_sha256": sha256(split), "fold": fold, "seed": seed, "max_hours": max_hours, "commit": commit}


def manifest_problems(manifest: dict, config: bytes, split: bytes, candidate: str | None = None) -> list[str]:
    """What has changed since the manifest was written."""
    checks = (("config", manifest["config_sha256"] != sha256(config)), ("split", manifest["split_sha256"] != sha256(split)), ("candidate", candidate not in (None, manifest["candidate"])))
    return [name for name, bad in checks if bad]


def manifests(runs: DataFrame, digests: DataFrame) -> DataFrame:
    """Manifest rows of ``runs`` (candidate, config_path, split_path, fold, seed, max_hours, commit, created_at) with the hashes of their files.

    ``digests``: path, sha256 of the files at hand.  Raises if a run breaks a
    rule: the candidate is one path component, seed >= 0, max_hours > 0,
    created_at is a time, both files are there.  An empty created_at is the
    present time in UTC.
    """
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    said = runs.withColumn("created_at", F.when(F.coalesce("created_at", F.lit("")) == "", now).otherwise(F.col("created_at")))
    for side in ("config", "split"):
        said = said.join(digests.select(F.col("path").alias(f"{side}_path"), F.col("sha256").alias(f"{side}_sha256")), f"{side}_path", "left")
    name = F.trim(F.coalesce("candidate", F.lit("")))
    rules = F.array_compact(F.array(
        F.when((name == "") | name.isin(".", "..") | F.col("candidate").rlike(r"[/\\]"), "candidate"), F.when(~F.coalesce(F.col("seed") >= 0, F.lit(False)), "seed"),
        F.when(~F.coalesce(F.col("max_hours") > 0, F.lit(False)), "max_hours"), F.when(F.try_to_timestamp("created_at").isNull(), "created_at"),
        F.when(F.col("config_sha256").isNull(), "config_path"), F.when(F.col("split_sha256").isNull(), "split_path"),
    ))
    broken = said.select("candidate", rules.alias("rules")).filter(F.size("rules") > 0).first()
    if broken is not None:
        raise ValueError(f"run {broken['candidate']}: {', '.join(broken['rules'])}")
    return said.select("candidate", "created_at", "commit", "config_path", "config_sha256", "split_path", "split_sha256", "fold", "seed", "max_hours")


def manifest_changes(known: DataFrame, digests: DataFrame) -> DataFrame:
    """candidate, problem of every manifest whose files are not what they were: another hash, or missing."""
    out = []
    for side in ("config", "split"):
        now = digests.select(F.col("path").alias(f"{side}_path"), F.col("sha256").alias("_now"))
        problem = F.when(F.col("_now").isNull(), f"{side} missing").when(F.col("_now") != F.col(f"{side}_sha256"), f"{side} hash")
        out.append(known.join(now, f"{side}_path", "left").select("candidate", problem.alias("problem")).filter("problem IS NOT NULL"))
    return out[0].unionByName(out[1]).distinct()


def evidence(claims: DataFrame, digests: DataFrame) -> DataFrame:
    """run, path, problem for claimed artifacts (run, path, sha256) against actual digests (path, sha256): missing, mismatch or outside."""
    actual = digests.select("path", F.col("sha256").alias("_actual"))
    joined = claims.join(actual, "path", "left")
    outside = F.col("path").startswith("/") | F.col("path").contains("..")
    problem = F.when(outside, "outside").when(F.col("_actual").isNull(), "missing").when(F.lower("sha256") != F.col("_actual"), "mismatch")
    return joined.select("run", "path", problem.alias("problem")).filter("problem IS NOT NULL")


def unbound(runs: DataFrame, results: DataFrame, same: list[str]) -> DataFrame:
    """run, field of every result row (by run) whose identity fields differ from its run's, or that has no run."""
    a = runs.select("run", *(F.col(c).alias(f"_{c}") for c in same), F.lit(True).alias("_known"))
    both = results.join(a, "run", "left")
    hit = F.filter(F.array(F.when(F.col("_known").isNull(), "run"), *(F.when(F.col("_known") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in same)), lambda x: x.isNotNull())
    return both.select("run", F.explode(hit).alias("field"))
