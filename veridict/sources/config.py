"""Configuration that stays on the driver: short lists and the topic map."""

from __future__ import annotations

import importlib.util
import json
from dataclasses import dataclass, field


@dataclass
class TopicMap:
    """How topics become categories; the arguments of ``operators.topics.map_topics`` and ``canonical``."""

    overrides: dict[str, str] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    misc: str | None = None
    combined_to_misc: bool = False
    normalize: bool = True


def _payload(path: str) -> dict:
    """An object from a JSON or YAML file, by its name's ending; YAML needs PyYAML."""
    kind = path.rpartition(".")[2].lower()
    if kind not in ("json", "yaml", "yml"):
        raise ValueError(f"{path}: neither JSON nor YAML")
    with open(path, encoding="utf-8-sig") as file:
        if kind == "json":
            found = json.load(file)
        elif importlib.util.find_spec("yaml") is None:
            raise RuntimeError(f"{path} can't be read without PyYAML; give a JSON file instead")
        else:
            found = importlib.import_module("yaml").safe_load(file) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: expected an object")
    return found


def read_topic_map(path: str) -> TopicMap:
    """A topic map from an object with map, drop, misc_category, combined_to_misc and normalize, as JSON or YAML.

    Without the keys "unknown" is dropped and combined labels become "Misc";
    entries of the map without a source or a target are passed over.
    """
    found = _payload(path)
    given, drop = found.get("map") or {}, found.get("drop", ["unknown"])
    if not isinstance(given, dict):
        raise ValueError(f"{path}: map must be an object")
    pairs = {str(k).strip(): str(v).strip() for k, v in given.items()}
    return TopicMap(
        {k: v for k, v in pairs.items() if k and v}, [str(x) for x in drop if x] if isinstance(drop, (list, tuple)) else [],
        str(found.get("misc_category", "Misc")).strip() or "Misc", bool(found.get("combined_to_misc", True)), bool(found.get("normalize", True)),
    )


def read_names(path: str) -> list[str]:
    """The items of a YAML list of texts, comments left out, repeats once and in order; any other line is an error."""
    names = []
    with open(path, encoding="utf-8-sig") as file:
        for line in file:
            item = line.split("#", 1)[0].strip()
            if not item:
                continue
            if not item.startswith("-"):
                raise ValueError(f"{path}: expected items of a list, got {line.strip()!r}")
            item = item[1:].strip()
            names.append(item[1:-1].strip() if len(item) > 1 and item[0] == item[-1] and item[0] in "'\"" else item)
    return list(dict.fromkeys(x for x in names if x))


def parse_names(raw, label: str, required: bool = False) -> list[str]:
    """Names of a list, or of a text with commas; an error if they are needed and missing, or of another kind."""
    if raw is not None and not isinstance(raw, (str, list, tuple, set)):
        raise ValueError(f"{label} must be a text with commas or a list of texts")
    parts = raw.split(",") if isinstance(raw, str) else raw or []
    names = [x.strip() for x in parts if isinstance(x, str) and x.strip()]
    if required and not names:
        raise ValueError(f"no names given for {label}")
    return names


def whole_number(config: dict, key: str, default: int) -> int:
    try:
        return int(config.get(key, default))
    except (TypeError, ValueError):
        raise ValueError(f"expected a whole number for {key!r}, got {config.get(key)!r}") from None


def parse_topics(text: str) -> list[str]:
    """Topics of a text: between commas if there is one, else a line each; none is an error."""
    topics = [x.strip() for x in (text.split(",") if "," in text else text.splitlines()) if x.strip()]
    if not topics:
        raise ValueError("no topics")
    return topics


def check_keys(report: dict, keys: tuple[str, ...]) -> None:
    """An error that names the keys a report lacks."""
    missing = [k for k in keys if k not in report]
    if missing:
        raise ValueError(f"the report lacks {missing}")
