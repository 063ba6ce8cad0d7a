"""Thresholds and limits of the photo engine, in one place so that callers can vary them."""

from dataclasses import dataclass

# The hue bands and their centres in degrees.
BANDS = (("Red", 0.0), ("Orange", 35.0), ("Yellow", 60.0), ("Green", 135.0), ("Aqua", 180.0), ("Blue", 225.0), ("Purple", 275.0), ("Magenta", 315.0))

# Calibration fields and the setting that each is written to.
CALIBRATION = (("shadow_tint", "ShadowTint"), ("red_hue", "RedHue"), ("red_saturation", "RedSaturation"), ("green_hue", "GreenHue"), ("green_saturation", "GreenSaturation"), ("blue_hue", "BlueHue"), ("blue_saturation", "BlueSaturation"))


@dataclass(frozen=True)
class Measure:
    """How pixels are measured."""

    highlight: int = 250
    shadow_l: float = 5.0
    neutral_chroma: float = 10.0
    neutral_low: float = 20.0
    neutral_high: float = 92.0
    saturated: float = 0.97
    band_share: float = 0.01
    sharp_quantile: float = 0.75


@dataclass(frozen=True)
class Match:
    """How photos are matched to reference photos."""

    most: int = 3
    exact: float = 1e-6
    spread: float = 25.0


@dataclass(frozen=True)
class Plan:
    """Limits of planned settings."""

    step_ev: float = 2.0
    clip_limit: float = 0.02
    exposure_dead: float = 0.10
    cast_dead: float = 3.0
    neutral_share: float = 0.02
    refine_share: float = 0.005
    step_temp: float = 600.0
    step_tint: float = 10.0
    divergence_l: float = 4.0
    sharp_crop_area: float = 0.8
    slope_prior: float = 17.0
