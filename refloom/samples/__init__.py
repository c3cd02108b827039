"""A list of references and recorded answers to try the check with; the works are made up."""

from __future__ import annotations

from pathlib import Path

from refloom.errors import InputError


def names() -> list[str]:
    return sorted(p.name for p in Path(__file__).parent.iterdir() if p.suffix in (".txt", ".json"))


def sample_path(name: str) -> str:
    if name not in names():
        raise InputError(f"no sample is called {name!r}; there are {', '.join(names())}")
    return str(Path(__file__).parent / name)
