"""KEY=VALUE files, as .env: `export`, quotes and comments after a blank are taken off."""

from __future__ import annotations

import os

from tabscout.errors import BackendConfigurationError


def parse_env(text: str) -> dict[str, str]:
    """The assignments of a file's text; the last of a key counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if not eq or not key or key.startswith("#"):
            continue
        if value[:1] in ("'", '"') and value.find(value[0], 1) > 0:
            value = value[1 : value.find(value[0], 1)]
        else:
            value = value.split(" #", 1)[0].rstrip()
        out[key] = value
    return out


def read_env(path: str) -> dict[str, str]:
    """A missing file is empty; a byte order mark is skipped."""
    if not os.path.exists(path):
        return {}
    try:
        with open(path, encoding="utf-8-sig") as f:
            return parse_env(f.read())
    except (OSError, UnicodeDecodeError) as error:
        raise BackendConfigurationError(f"unable to read settings from {path!r}: {type(error).__name__}") from error
