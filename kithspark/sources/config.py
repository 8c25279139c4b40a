"""Settings from a YAML file."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from kithspark.functions.vectors import validate_weights
from kithspark.operators.clustering import check_tolerance
from kithspark.schemas import EYE_WEIGHT, FULL_WEIGHT, MIN_FACES, TOLERANCE, UNKNOWN_FOLDER

# The keys of a settings file and what they are without one.
DEFAULTS: dict[str, Any] = {
    "input_folder": "./input_images",
    "output_folder": "./sorted_output",
    "tolerance": TOLERANCE,
    "min_faces_per_cluster": MIN_FACES,
    "min_samples": 1,
    "mode": "copy",
    "unknown_folder": UNKNOWN_FOLDER,
    "names_db": None,
    "workers": 0,
    "use_eye_regions": True,
    "weight_full_face": FULL_WEIGHT,
    "weight_eye_region": EYE_WEIGHT,
}


def load_config(path: str, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """The defaults, then the file, then the overrides that aren't None; checked.

    A missing file, one that holds no mapping and weights under other names than
    ``weight_full_face`` and ``weight_eye_region`` are errors; keys that this
    engine has no use for are kept as they are.
    """
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError("the configuration must be a mapping")
    if wrong := sorted(k for k in data if "weight" in str(k) and k not in DEFAULTS):
        raise ValueError(f"unknown settings: {', '.join(wrong)}")
    out = DEFAULTS | data | {k: v for k, v in (overrides or {}).items() if v is not None}
    check_tolerance(float(out["tolerance"]))
    validate_weights(out["weight_full_face"], out["weight_eye_region"])
    return out
