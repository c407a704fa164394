"""Configuration files: one parent, variables from the environment, nothing silently missing."""

from __future__ import annotations

import os
import re
from pathlib import Path
from typing import Any


class ConfigError(RuntimeError):
    """A configuration is missing or can't be resolved."""


def merged(base: dict, over: dict) -> dict:
    """Dicts are merged key by key; lists and other values are replaced."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def expanded(node: Any) -> Any:
    """node with every ${NAME} replaced; a name that is not set raises."""
    if isinstance(node, dict):
        return {k: expanded(v) for k, v in node.items()}
    if isinstance(node, list):
        return [expanded(v) for v in node]
    if not isinstance(node, str):
        return node

    def value(m: re.Match) -> str:
        if m.group(1) not in os.environ:
            raise ConfigError(f"the variable {m.group(1)} is not set")
        return os.environ[m.group(1)]

    return re.sub(r"\$\{([^}]+)\}", value, node)


def load(path: str | Path) -> dict:
    """The file's settings over those of the file named by `inherit`, looked for from here, then beside it."""
    import yaml

    path = Path(path)
    if not path.is_file():
        raise ConfigError(f"no file {path}")
    own = yaml.safe_load(path.read_text()) or {}
    parent = own.pop("inherit", None)
    if parent:
        where = next((p for p in (Path(parent), path.parent / parent, path.parent.parent / parent) if p.is_file()), None)
        if where is None:
            raise ConfigError(f"no file {parent} to inherit")
        own = merged(load(where), own)
    return expanded(own)
