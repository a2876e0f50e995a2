"""Settings of the command line: a file ``relgrove.toml``, over it RELGROVE_* variables, over these the arguments.

    schema = "model.fga"
    tuples = "s3a://bucket/tuples"
    registry = "s3a://bucket/registry"

    [client]
    language = "typescript"
    output = "src/authz"

    [migrate]
    dry_run = false
"""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

FILE = "relgrove.toml"
#: Folders that are searched upwards, the present one included.
MAX_UP = 25
#: Each setting, its type, and what it is if nothing says otherwise.
SETTINGS: dict[str, tuple[type, object]] = {
    "schema": (str, None),
    "tuples": (str, None),
    "format": (str, "parquet"),
    "registry": (str, None),
    "client.language": (str, "python"),
    "client.output": (str, "."),
    "client.package": (str, "authz"),
    "client.filter": (str, ""),
    "client.id_type": (str, None),
    "migrate.dry_run": (bool, False),
    "migrate.force": (bool, False),
    "migration.output": (str, "migrations"),
    "migration.name": (str, "model"),
    "migration.form": (str, "split"),
    "doctor.view": (str, None),
}


class ConfigError(ValueError):
    """A setting that can't be read or used."""


def find(start: str | Path = ".") -> Path | None:
    """The settings' file in a folder or the next one above it; a repository's root ends the search."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][:MAX_UP]:
        if (folder / FILE).is_file():
            return folder / FILE
        if (folder / ".git").exists():
            return None
    return None


def _value(name: str, value: object) -> object:
    kind = SETTINGS[name][0]
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("1", "true", "yes", "0", "false", "no"):
            raise ConfigError(f"{name}: {value!r} is neither true nor false")
        return value.lower() in ("1", "true", "yes")
    if not isinstance(value, kind):
        raise ConfigError(f"{name}: {value!r} is no {kind.__name__}")
    return value


def load(path: str | Path | None = None, environ: dict[str, str] | None = None) -> dict[str, object]:
    """All settings by name. path: the file; else it is searched for. Unknown names are refused."""
    environ = os.environ if environ is None else environ
    out = {name: default for name, (_, default) in SETTINGS.items()}
    file = Path(path) if path else find()
    if file is not None:
        try:
            data = tomllib.loads(file.read_text())
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"{file}: {e}") from e
        flat = {f"{k}.{inner}" if isinstance(v, dict) else k: x for k, v in data.items() for inner, x in (v.items() if isinstance(v, dict) else [("", v)])}
        for name, value in flat.items():
            if name not in SETTINGS:
                raise ConfigError(f"{file}: there is no setting {name}")
            out[name] = _value(name, value)
    for name in SETTINGS:
        if (value := environ.get("RELGROVE_" + name.upper().replace(".", "_"))) is not None:
            out[name] = _value(name, value)
    return out
