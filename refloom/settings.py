"""Settings of a run from an environment and a .env file; the environment wins, and the process's own environment is never changed."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from refloom.errors import InputError

PREFIX = "REFLOOM_"
TRUE, FALSE = frozenset({"1", "true", "yes", "on"}), frozenset({"", "0", "false", "no", "off"})


@dataclass(frozen=True)
class Settings:
    api_key: str | None = None
    store: str | None = None
    usage_log: str | None = None
    demo_only: bool = False

    def __repr__(self) -> str:
        return f"Settings(api_key={'set' if self.api_key else None}, store={self.store!r}, usage_log={self.usage_log!r}, demo_only={self.demo_only})"


def dotenv(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        name, sign, value = line.removeprefix("export ").partition("=")
        if sign and not line.lstrip().startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def flag(name: str, raw: str) -> bool:
    value = raw.strip().lower()
    if value not in TRUE | FALSE:
        raise InputError(f"{name} must be true or false.")
    return value in TRUE


def load_settings(environ: Mapping[str, str], dotenv_path: str | None = None) -> Settings:
    path = Path(dotenv_path) if dotenv_path else None
    merged = (dotenv(path.read_text()) if path and path.is_file() else {}) | dict(environ)
    get = lambda name: merged.get(PREFIX + name, "").strip() or None
    return Settings(get("API_KEY"), get("STORE"), get("USAGE_LOG"), flag(PREFIX + "DEMO_ONLY", merged.get(PREFIX + "DEMO_ONLY", "")))
