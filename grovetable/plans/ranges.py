"""Bounds used by rules. Overrides are merged while a plan is built, so they end up as literals."""

from __future__ import annotations

from dataclasses import dataclass

#: Default bounds.
RANGES: dict[str, dict[str, float]] = {
    "infant_weight": {"min": 0.5, "max": 35.0}, "infant_height": {"min": 30.0, "max": 130.0}, "school_weight": {"min": 12.0, "max": 50.0}, "school_height": {"min": 100.0, "max": 160.0},
    "bio_weight": {"min": 0.5, "max": 80.0}, "bio_height": {"min": 30.0, "max": 130.0}, "bio_bmi": {"min": 5.0, "max": 40.0}, "bio_age_months": {"min": 0.0, "max": 120.0},
    "biv_waz": {"min": -6.0, "max": 5.0}, "biv_haz": {"min": -6.0, "max": 6.0}, "biv_baz": {"min": -5.0, "max": 5.0}, "zscore_cap": {"value": 6.0},
    "bmi_max": {"value": 40.0}, "infant_age_cap": {"value": 60.0}, "school_age_years": {"min": 5.0, "max": 10.0},
    "rule_weight": {"min": 10.0, "max": 125.0}, "rule_height": {"min": 50.0, "max": 200.0}, "rule_year_level": {"min": 1.0, "max": 7.0}, "rule_age_years": {"value": 20.0},
    "height_unit_suspect": {"value": 200.0}, "geo_lat": {"min": 1.0, "max": 7.5}, "geo_lon": {"min": 99.5, "max": 119.5},
    "flag_weight": {"min": 12.0, "max": 50.0}, "flag_height": {"min": 100.0, "max": 160.0}, "flag_bmi": {"min": 13.5, "max": 18.5},
}
EDITABLE = ("infant_weight", "infant_height", "school_weight", "school_height", "bmi_max", "infant_age_cap", "bio_weight", "bio_height")


@dataclass(frozen=True)
class Profile:
    """Plausible weights and heights of a cohort."""

    name: str
    weight: tuple[float, float]
    height: tuple[float, float]


def merged(overrides: dict | None = None) -> dict[str, dict[str, float]]:
    problems = invalid(overrides or {})
    if problems:
        raise ValueError("; ".join(problems))
    return {k: v | (overrides or {}).get(k, {}) for k, v in RANGES.items()}


def invalid(overrides: dict) -> list[str]:
    """What is wrong with some overrides: unknown keys or parts, no number, low above high."""
    out = []
    for key, value in overrides.items():
        if key not in RANGES:
            out.append(f"unknown range {key}")
            continue
        for part, x in value.items():
            if part not in RANGES[key]:
                out.append(f"{key} has no {part}")
            elif isinstance(x, bool) or not isinstance(x, (int, float)):
                out.append(f"{key}.{part} is no number")
        both = RANGES[key] | {p: x for p, x in value.items() if isinstance(x, (int, float))}
        if "min" in both and both["min"] >= both["max"]:
            out.append(f"{key}: min is not below max")
    return out


def bounds(ranges: dict, key: str) -> tuple[float, float]:
    return ranges[key]["min"], ranges[key]["max"]


def cohort(name: str, overrides: dict | None = None) -> Profile:
    """``infant`` or ``school``."""
    r = merged(overrides)
    return Profile(name, bounds(r, f"{name}_weight"), bounds(r, f"{name}_height"))
