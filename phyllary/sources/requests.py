"""What to ask sources for: names, parameters and settings. Plain Python, no network."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

#: What each kind of occurrence asks for, by its names in settings (fixed values).
OCCURRENCE_MODES = {
    "specimens": "PRESERVED_SPECIMEN", "observations": "HUMAN_OBSERVATION", "specimens-and-observations": ["PRESERVED_SPECIMEN", "HUMAN_OBSERVATION"], "specimens_observations": ["PRESERVED_SPECIMEN", "HUMAN_OBSERVATION"],
    "all-images": None, "all": None,
}
COORDINATE_FILTERS = {
    "any": {}, "with-coordinates": {"hasCoordinate": "true", "hasGeospatialIssue": "false"}, "with_coordinates": {"hasCoordinate": "true", "hasGeospatialIssue": "false"}, "coordinates": {"hasCoordinate": "true", "hasGeospatialIssue": "false"},
    "without-coordinates": {"hasCoordinate": "false"}, "without_coordinates": {"hasCoordinate": "false"}, "no-coordinates": {"hasCoordinate": "false"},
}
#: Other names of sources (fixed values).
SOURCE_ALIASES = {"pterido portal": "pteridoportal", "uc/jeps": "ucjeps", "uc-jeps": "ucjeps", "uc": "ucjeps", "jeps": "ucjeps"}


def source_name(name: str) -> str:
    """A source's name as settings know it: small letters, digits, underscore and hyphen."""
    key = " ".join(name.lower().split())
    return SOURCE_ALIASES.get(key, re.sub(r"[^a-z0-9_-]+", "", key))


def source_names(names: list[str]) -> list[str]:
    """The sources named, each once, in order."""
    return list(dict.fromkeys(n for n in map(source_name, names) if n))


def aggregator_parameters(query_name: str, mode: str = "specimens", coordinates: str = "any", limit: int = 100, offset: int = 0, institutions: Sequence[str] = (), extra: Mapping | None = None) -> dict[str, object]:
    """Parameters of an occurrence search, so that what is not wanted is never sent. An unknown mode or filter is an error."""
    kind, where = mode.strip().lower(), coordinates.strip().lower()
    if kind not in OCCURRENCE_MODES:
        raise ValueError(f"unknown occurrence mode {mode!r}")
    if where not in COORDINATE_FILTERS:
        raise ValueError(f"unknown coordinate filter {coordinates!r}")
    out: dict[str, object] = {"scientificName": query_name, "mediaType": "StillImage", "limit": limit, "offset": offset}
    if codes := [c.strip() for c in institutions if c.strip()]:
        out["institutionCode"] = codes
    out |= {k: v for k, v in (extra or {}).items() if v not in (None, "", [])}
    if OCCURRENCE_MODES[kind]:
        out["basisOfRecord"] = OCCURRENCE_MODES[kind]
    return out | COORDINATE_FILTERS[where]


def settings_with_profile(settings: Mapping, profile: str) -> dict:
    """Image settings overlaid with those of a named profile; an unknown profile is an error."""
    profiles = settings.get("profiles", {})
    if profile not in profiles:
        raise ValueError(f"unknown image profile {profile!r}")
    return {k: v for k, v in settings.items() if k != "profiles"} | dict(profiles[profile])


def parse_environment(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, blank lines and quotes around values are dropped."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.removeprefix("export ").partition("=")
            out[key.strip()] = value.strip().strip("\"'")
    return out


def pyramid_levels(width: int, height: int, tile: int) -> list[dict[str, int]]:
    """The levels of a tiled image, smallest first: halved as long as one side exceeds half a tile; id 0 is the full image."""
    out = []
    while max(width, height) > tile / 2 + 1:
        out.append({"id": len(out), "width": width, "height": height})
        width, height = width // 2, height // 2
    return out[::-1]
