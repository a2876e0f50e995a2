"""Migration files: the SQL that brings the functions of one model to those of another, and back."""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime
from pathlib import Path

from relgrove import __version__
from relgrove.functions.sql import statements
from relgrove.plans.analysis import validate
from relgrove.plans.model import Model, to_dsl

FORMATS = ("split", "single")


def definitions(model: Model) -> dict[str, str]:
    """The statements of all functions of a model, by name."""
    validate(model)
    out: dict[str, str] = {}
    for t, r in model.nodes():
        for name, sql in statements(t, r).items():
            if name in out:
                raise ValueError(f"two relations would have the function {name}")
            out[name] = sql
    return out


def checksums(model: Model) -> dict[str, str]:
    """By relation: changes with its own expression, with those that it needs, and with the text of its functions."""
    analysis = validate(model)
    out = {}
    for t, r in model.nodes():
        needed = sorted(f"{a}.{b}: {to_dsl(model.expr(a, b))}" for g in analysis.needed([(t, r)]) for a, b in g)
        out[f"{t}.{r}"] = hashlib.sha256("\n".join([*needed, *statements(t, r).values()]).encode()).hexdigest()
    return out


def up(new: Model, old: Model | None = None) -> str:
    """Drops the functions that are gone and defines those of relations that changed; all of them without an old model."""
    wanted, before = definitions(new), definitions(old) if old else {}
    sums, old_sums = checksums(new), checksums(old) if old else {}
    changed = [k for k in sums if old_sums.get(k) != sums[k]]
    lines = ["-- up", f"-- engine {__version__}", f"-- schema {hashlib.sha256(new.to_dsl().encode()).hexdigest()}", f"-- changed relations: {len(changed)} of {len(sums)}", ""]
    gone = sorted(before.keys() - wanted.keys())
    lines += [f"DROP TEMPORARY FUNCTION IF EXISTS {n};" for n in gone] + [""] * bool(gone)
    for k in changed:
        t, _, r = k.partition(".")
        lines += [f"-- {k}: {to_dsl(new.expr(t, r))}", *(f"{sql};" for sql in statements(t, r).values()), ""]
    return "\n".join(lines)


def down(new: Model) -> str:
    """Drops all functions of the model; an earlier version is restored by its own up file."""
    return "\n".join(["-- down", "-- an earlier version is restored by its own up file", "", *(f"DROP TEMPORARY FUNCTION IF EXISTS {n};" for n in sorted(definitions(new))), ""])


def write(folder: str | Path, name: str, new: Model, old: Model | None = None, form: str = "split", now: datetime | None = None) -> list[Path]:
    """Writes the files ``<time>_<name>.up.sql`` and ``.down.sql``, or one file with both sections; none if nothing changes."""
    if form not in FORMATS:
        raise ValueError(f"the form of a migration is one of {', '.join(FORMATS)}")
    if not re.fullmatch(r"[\w-]+", name):
        raise ValueError(f"not a name for a file: {name!r}")
    if old is not None and checksums(old) == checksums(new):
        return []
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    base = f"{(now or datetime.now(UTC)):%Y%m%d%H%M%S}_{name}"
    files = {f"{base}.up.sql": up(new, old), f"{base}.down.sql": down(new)}
    if form == "single":
        files = {f"{base}.sql": "\n".join(files.values())}
    for file, text in files.items():
        with open(folder / file, "x") as f:  # never over another migration
            f.write(text)
    return [folder / file for file in files]
