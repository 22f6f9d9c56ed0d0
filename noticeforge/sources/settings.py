"""Settings from a file of NAME=value lines; what the environment has already is kept."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from pathlib import Path


def load_env(path: str, environment: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """The settings of the file that were taken over. Blank lines and those that begin with # are left out, quotes around a value too."""
    env = os.environ if environment is None else environment
    taken: dict[str, str] = {}
    lines = Path(path).read_text("utf-8").splitlines() if Path(path).is_file() else []
    for line in lines:
        name, sep, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if sep and name and not name.startswith("#") and name not in env:
            env[name] = taken[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return taken
