"""Settings of jobs: command line over environment over a dotenv file over a default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

_ON = frozenset({"1", "true", "yes", "y", "on"})


def read_dotenv(path: str | Path = ".env") -> dict[str, str]:
    """KEY=VALUE lines; comments and lines without = are passed over, ``export`` and one pair of quotes removed."""
    file, found = Path(path), {}
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else ():
        line = line.strip()
        if line.startswith("#"):
            continue
        key, sign, value = line.removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if sign and key:
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            found[key] = value[1:-1] if quoted else value
    return found


def setting(name: str, given: str | None = None, env: Mapping[str, str] | None = None, dotenv: str | Path = ".env", default: str = "") -> str:
    """First of these that is not blank: the given value, the environment's, the file's, the default."""
    sources = (lambda: given, lambda: (os.environ if env is None else env).get(name), lambda: read_dotenv(dotenv).get(name))
    return next((v.strip() for v in (s() for s in sources) if v and v.strip()), default)


def is_on(value: str) -> bool:
    return value.strip().lower() in _ON
