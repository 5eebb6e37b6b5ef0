"""Configuration: several files merged into one dictionary, then overridden."""

from __future__ import annotations

import json
from pathlib import Path


def _load(path: Path) -> dict:
    text = path.read_text()
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path.name}: PyYAML is not installed; use JSON") from e
    return yaml.safe_load(text) or {}


def load_config(folder: str, names: dict[str, str], overrides: dict | None = None) -> dict:
    """{key: contents of folder/file} for each of ``names`` (key: file stem), with top-level ``overrides``.

    A missing file is an error; an override of a dictionary replaces its named entries only.
    """
    out: dict = {}
    for key, stem in names.items():
        found = [p for suffix in (".json", ".yaml", ".yml") if (p := Path(folder) / f"{stem}{suffix}").exists()]
        if not found:
            raise FileNotFoundError(f"{stem} in {folder}")
        out[key] = _load(found[0])
    for key, value in (overrides or {}).items():
        out[key] = out[key] | value if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def bbox(config: dict) -> tuple[float, float, float, float]:
    """west, south, east, north of the area of interest."""
    b = config["aoi"]["bbox"]
    if isinstance(b, dict):
        b = [b[k] for k in ("west", "south", "east", "north")]
    west, south, east, north = map(float, b)
    if west > east or south > north:
        raise ValueError(f"box out of order: {b}")
    return west, south, east, north
