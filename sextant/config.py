"""Settings: defaults, files over them, and a deep merge."""

import json

#: The defaults.
DEFAULTS = {
    "chunking": {"size": 500, "overlap": 50, "max_file_size": 1 << 20},
    "watcher": {"debounce_seconds": 1.0},
    "ingest": {"batch": 1000, "text_length": 1_000_000},
    "embedding": {"batch": 32},
    "pipeline": {"type": "default", "profile": "balanced"},
}


def merge(old: dict, new: dict | None) -> dict:
    """The union of the keys; where both hold objects these are merged, else the new value stands.  Neither is changed."""
    new = new or {}
    nested = {k for k in old.keys() & new.keys() if isinstance(old[k], dict) and isinstance(new[k], dict)}
    return {**old, **new, **{k: merge(old[k], new[k]) for k in nested}}


def load(path: str) -> dict:
    """The defaults with a JSON file's settings over them (YAML too, where a reader of it is installed)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no reader of YAML is installed; give JSON") from e
        return merge(DEFAULTS, yaml.safe_load(text))
    return merge(DEFAULTS, json.loads(text))
