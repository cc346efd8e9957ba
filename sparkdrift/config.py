"""Configuration: immutable defaults, deep merge, YAML loading."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any


class ConfigError(ValueError):
    """A configuration value is unusable."""


def deep_merge(base: Mapping[str, Any], override: Mapping[str, Any] | None) -> dict[str, Any]:
    """Recursive merge that shares nothing with either input."""
    merged = copy.deepcopy(dict(base))
    for key, value in (override or {}).items():
        if isinstance(value, Mapping) and isinstance(merged.get(key), Mapping):
            merged[key] = deep_merge(merged[key], value)
        else:
            merged[key] = copy.deepcopy(value)
    return merged


def load_yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover - depends on the installation
        raise ConfigError("reading YAML needs the PyYAML package") from exc
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


@dataclass(frozen=True)
class ColumnSpec:
    """A numeric column and its inclusive valid range."""

    name: str
    lower: float
    upper: float


# Default observation layout and its valid ranges.
DEFAULT_SPECS = (
    ColumnSpec("temperature", -50.0, 60.0),
    ColumnSpec("humidity", 0.0, 100.0),
    ColumnSpec("precipitation", 0.0, 500.0),
    ColumnSpec("wind_speed", 0.0, 400.0),
    ColumnSpec("pressure", 900.0, 1100.0),
)


@dataclass(frozen=True)
class QualityConfig:
    """What ``validate`` and its parts need to know."""

    specs: tuple[ColumnSpec, ...] = DEFAULT_SPECS
    time_column: str = "timestamp"
    max_gap_hours: float = 2.0
    z_threshold: float = 3.0
    min_score: float = 0.8
    min_completeness: float = 0.0
    null_issue_percent: float = 5.0
    completeness_weight: float = 0.4
    validity_weight: float = 0.4
    consistency_weight: float = 0.2

    @property
    def columns(self) -> list[str]:
        return [s.name for s in self.specs]

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any]) -> QualityConfig:
        """Read ``<column>_bounds: {min, max}`` and thresholds from a data-quality section."""
        section = settings.get("data_quality", settings)
        specs = []
        for spec in DEFAULT_SPECS:
            bounds = section.get(f"{spec.name}_bounds", {})
            specs.append(
                ColumnSpec(
                    spec.name,
                    float(bounds.get("min", spec.lower)),
                    float(bounds.get("max", spec.upper)),
                )
            )
        config = cls(specs=tuple(specs))
        if "max_null_percentage" in section:
            config = replace(config, null_issue_percent=float(section["max_null_percentage"]))
        if "min_completeness" in section:
            # The setting's name notwithstanding, it is the lowest overall score that passes.
            config = replace(config, min_score=float(section["min_completeness"]))
        return config


@dataclass(frozen=True)
class FeatureConfig:
    """Which features are built and under which names."""

    # Default feature layout.
    measures: tuple[str, ...] = (
        "temperature_2m",
        "relative_humidity_2m",
        "precipitation",
        "wind_speed_10m",
        "surface_pressure",
    )
    temporal: tuple[str, ...] = (
        "hour_of_day",
        "day_of_week",
        "day_of_year",
        "is_weekend",
        "hour_sin",
        "hour_cos",
    )
    extra_temporal: tuple[str, ...] = ("month", "day_sin", "day_cos", "month_sin", "month_cos")
    lags: tuple[int, ...] = (1, 6, 24)
    windows: tuple[int, ...] = (6, 24)
    lag_columns: tuple[str, ...] = ("temperature_2m", "relative_humidity_2m")
    rolling_columns: tuple[str, ...] = ("temperature_2m",)
    target_source: str = "temperature_2m"
    target: str = "target_next_day_max_temp"
    horizon: int = 24
    excluded: tuple[str, ...] = (
        "id",
        "timestamp",
        "location_name",
        "latitude",
        "longitude",
        "raw_data",
        "batch_id",
        "data_source",
        "ingestion_timestamp",
        "created_at",
        "updated_at",
        "season",
    )

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any]) -> FeatureConfig:
        features = settings.get("features", {})
        model = settings.get("model", {})
        names = {
            "measures": features.get("weather"),
            "temporal": features.get("temporal"),
            "lags": features.get("lag_hours"),
            "windows": features.get("rolling_windows"),
            "lag_columns": features.get("lag_columns"),
            "rolling_columns": features.get("rolling_columns"),
        }
        given = {k: tuple(v) for k, v in names.items() if v is not None}
        if model.get("target") is not None:
            given["target"] = model["target"]
        if model.get("prediction_horizon_hours"):
            given["horizon"] = int(model["prediction_horizon_hours"])
        return cls(**given)

    @classmethod
    def from_yaml(cls, path: str) -> FeatureConfig:
        return cls.from_mapping(load_yaml(path))

    def as_dict(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


# Severity levels in rising order, with their scores.
SEVERITIES = ("none", "low", "moderate", "significant", "severe")
SEVERITY_SCORES = {"none": 0.0, "low": 0.25, "moderate": 0.5, "significant": 0.75, "severe": 1.0}

# Default drift thresholds.
DRIFT_DEFAULTS: dict[str, Any] = {
    "thresholds": {
        "psi": {"low": 0.1, "moderate": 0.15, "significant": 0.2, "severe": 0.5},
        "ks_p_value": 0.05,
        "js_divergence": {"low": 0.05, "moderate": 0.1, "significant": 0.2, "severe": 0.4},
    },
    "detection": {"method": "psi", "min_samples": 50, "features_drifted_threshold": 0.3},
    "monitoring": {"window_size_hours": 168},
}


@dataclass(frozen=True)
class DriftConfig:
    """Drift thresholds; built from nested settings in either of the two spellings in use."""

    psi: Mapping[str, float] = field(
        default_factory=lambda: dict(DRIFT_DEFAULTS["thresholds"]["psi"])
    )
    js: Mapping[str, float] = field(
        default_factory=lambda: dict(DRIFT_DEFAULTS["thresholds"]["js_divergence"])
    )
    ks_p_value: float = 0.05
    method: str = "psi"
    min_samples: int = 50
    drifted_share: float = 0.3
    window_hours: int = 168

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any] | None) -> DriftConfig:
        given = dict(settings or {})
        given = dict(given.get("drift_detection", given))
        flat = {"thresholds": {}, "detection": {}}
        if "psi_thresholds" in given:
            flat["thresholds"]["psi"] = given["psi_thresholds"]
        if "js_thresholds" in given:
            flat["thresholds"]["js_divergence"] = given["js_thresholds"]
        if "ks_significance" in given:
            flat["thresholds"]["ks_p_value"] = given["ks_significance"]
        if "primary_method" in given:
            flat["detection"]["method"] = given["primary_method"]
        merged = deep_merge(deep_merge(DRIFT_DEFAULTS, flat), given)
        return cls(
            psi=merged["thresholds"]["psi"],
            js=merged["thresholds"]["js_divergence"],
            ks_p_value=float(merged["thresholds"]["ks_p_value"]),
            method=str(merged["detection"]["method"]).lower(),
            min_samples=int(merged["detection"]["min_samples"]),
            drifted_share=float(merged["detection"]["features_drifted_threshold"]),
            window_hours=int(merged["monitoring"]["window_size_hours"]),
        )

    @classmethod
    def from_yaml(cls, path: str) -> DriftConfig:
        return cls.from_mapping(load_yaml(path))


@dataclass(frozen=True)
class TrainingConfig:
    """Split sizes and the acceptance gate."""

    test_days: int = 7
    validation_days: int = 3
    # Registration gate.
    max_rmse: float = 5.0
    min_r2: float = 0.5

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any]) -> TrainingConfig:
        section = settings.get("training", {})
        return cls(
            test_days=int(section.get("test_days", cls.test_days)),
            validation_days=int(section.get("validation_days", cls.validation_days)),
        )
