"""Settings and credentials from the environment and a file of ``NAME=value`` lines."""

from __future__ import annotations

import os
from pathlib import Path


def load_env(path: str = ".env") -> None:
    """Adds the file's values to the environment; what is set stays. Blank lines, ``#`` lines and lines without ``=`` are skipped."""
    file = Path(path)
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else ():
        name, equals, value = line.partition("=")
        if equals and not line.lstrip().startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def get_env(name: str, default: str | None = None, path: str = ".env") -> str | None:
    load_env(path)
    return os.environ.get(name, default)
