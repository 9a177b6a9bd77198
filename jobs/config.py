"""Config files of jobs: JSON objects with known fields."""

from __future__ import annotations

import json
from pathlib import Path


def load(path: str | Path, required: dict[str, type]) -> dict:
    """The settings in a file; unknown, missing and wrongly typed ones are errors."""
    held = json.loads(Path(path).read_text())
    if unknown := sorted(set(held) - set(required)):
        raise ValueError(f"unknown settings {unknown} in {path}")
    for name, kind in required.items():
        if name not in held:
            raise ValueError(f"setting {name} is missing in {path}")
        if not isinstance(held[name], kind) or isinstance(held[name], bool) is not (kind is bool):
            raise ValueError(f"setting {name} in {path} must be of type {kind.__name__}")
    return held
