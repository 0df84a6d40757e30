"""The example pipelines."""

from __future__ import annotations

from .definition import Pipeline, pipeline


def _step(kind: str, name: str, **config) -> dict:
    return {"id": kind.split("_")[-1] + "-" + kind.split("_")[0], "type": kind, "name": name, "config": config}


def _chain(name: str, description: str, *steps: dict) -> Pipeline:
    edges = [{"id": f"e{i + 1}", "source": a["id"], "target": b["id"]} for i, (a, b) in enumerate(zip(steps, steps[1:]))]
    return pipeline({"name": name, "description": description, "version": 1, "steps": list(steps), "edges": edges})


GERMAN_ADDRESSES = _chain(
    "German Address Cleanup",
    "Normalises German addresses and sets rows without a valid postal code aside.",
    _step("load_dataset", "Load"),
    _step("normalize_address", "Normalise addresses"),
    _step("quarantine_invalid_rows", "Set invalid postal codes aside", condition="invalid_postal_code"),
    _step("export_dataset", "Export", filename="german-address-cleanup"),
)
COORDINATES = _chain(
    "Coordinate Validation and Transformation",
    "Validates coordinates, repairs swapped pairs and transforms them to UTM zone 32N.",
    _step("load_dataset", "Load"),
    _step("validate_coordinates", "Validate coordinates"),
    _step("transform_crs", "Transform to EPSG:25832", x_column="longitude_validated", y_column="latitude_validated"),
    _step("quarantine_invalid_rows", "Set invalid coordinates aside", condition="invalid_coordinates"),
    _step("export_dataset", "Export", filename="coordinate-validation"),
)
FULL_QUALITY = _chain(
    "Full Data Quality and Deduplication",
    "Addresses, coordinates, blocked fuzzy duplicates and quarantine in one run.",
    _step("load_dataset", "Load"),
    _step("normalize_address", "Normalise addresses"),
    _step("validate_coordinates", "Validate coordinates"),
    _step(
        "detect_duplicates", "Detect duplicates",
        comparison_columns=["street_normalized", "postal_code_normalized", "city_normalized"], blocking_columns=["postal_code_normalized"],
        weights={"street_normalized": 0.5, "postal_code_normalized": 0.3, "city_normalized": 0.2}, minimum_score=82, review_threshold=94,
    ),
    _step("quarantine_invalid_rows", "Set invalid values aside", condition="any_validation_error"),
    _step("export_dataset", "Export", filename="full-quality"),
)
EXAMPLES = (GERMAN_ADDRESSES, COORDINATES, FULL_QUALITY)
