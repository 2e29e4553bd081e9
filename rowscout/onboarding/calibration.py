"""Camera calibration side-cars. They are kept with a stream for audit and never applied to data."""

from __future__ import annotations

import json
import os
from typing import Any

#: Files beside images that may hold a calibration, the likeliest first.
SIDE_CARS = ("sensor.yaml", "calib.txt", "calibration.json", "camera.yaml")
_LISTS = {"intrinsics": None, "resolution": 2, "distortion_coefficients": None, "T_BS": 16}


def _scalar(text: str) -> Any:
    text = text.strip().strip("'\"")
    if text.startswith("["):
        return [_scalar(x) for x in text.strip("[]").split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_pairs(text: str) -> dict[str, Any]:
    """`key: value` lines as simple YAML has them: nested by indent, lists in brackets over several lines, comments."""
    out: dict[str, Any] = {}
    parents: list[tuple[int, dict]] = [(-1, out)]
    joined: list[str] = []
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip() or line.startswith(("%", "---")):
            continue
        if joined and joined[-1].count("[") > joined[-1].count("]"):
            joined[-1] += " " + line.strip()
        else:
            joined.append(line)
    for line in joined:
        indent = len(line) - len(line.lstrip())
        key, sep, value = line.strip().partition(":")
        if not sep:
            key, sep, value = line.strip().partition("=")
        if not sep:
            key, _, value = line.strip().partition(" ")
        while parents[-1][0] >= indent:
            parents.pop()
        if value.strip():
            parents[-1][1][key.strip()] = _scalar(value)
        else:
            parents[-1][1][key.strip()] = child = {}
            parents.append((indent, child))
    return out


def tidy(raw: dict[str, Any]) -> tuple[dict[str, Any], list[str]]:
    """The fields that are known, as numbers; wrong ones are left out with a warning."""
    found, warnings = {}, []
    for name, size in _LISTS.items():
        value = raw.get(name)
        if isinstance(value, dict):
            value = value.get("data")
        if value is None:
            continue
        if isinstance(value, str):
            value = [_scalar(x) for x in value.split()]
        ok = isinstance(value, list) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value)
        if not ok or (size and len(value) != size):
            warnings.append(f"calibration field {name} is not {f'{size} ' if size else ''}numbers")
        else:
            found[name] = [float(x) for x in value]
    for name in ("rate_hz", "camera_model", "distortion_model", "sensor_type", "comment"):
        if name in raw:
            found[name] = raw[name]
    return found, warnings


def read_text(name: str, text: str) -> tuple[dict[str, Any] | None, list[str]]:
    try:
        raw = json.loads(text) if name.endswith(".json") else parse_pairs(text)
        if not isinstance(raw, dict):
            raise ValueError("no object")
    except ValueError as e:
        return None, [f"{name} can't be read: {e}"]
    found, warnings = tidy(raw)
    return ({"source": name, **found} if found else None), warnings


def beside(folder: str) -> tuple[dict[str, Any] | None, list[str]]:
    """Calibration of the first side-car in a folder or above it."""
    for place in (folder, os.path.dirname(folder.rstrip("/"))):
        for name in SIDE_CARS:
            path = os.path.join(place, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    return read_text(name, f.read())
    return None, []
