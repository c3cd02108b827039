"""Errors by who can mend them, each with its exit code, and messages and logs without secrets."""

from __future__ import annotations

import logging
import re
import sys
from collections.abc import Iterable

FINE, PROBLEMS_FOUND, WRONG_INPUT, CHECK_FAILED = range(4)
HIDDEN = "[REDACTED]"
MIN_SECRET_CHARS = 8
# What is hidden wherever it stands, a value of api_key and a string like a key.
KEY_VALUE = r"""(?i)(api_key["']?\s*[=:]\s*["']?)[^&\s"',}]+"""
KEY_LIKE = r"(?<![0-9a-fA-F])[0-9a-fA-F]{64}(?![0-9a-fA-F])"


def worth_hiding(secrets: Iterable[str]) -> list[str]:
    """The longest first, so that none leaves a part of another behind; short ones would hide ordinary words."""
    return sorted((s for s in secrets if len(s) >= MIN_SECRET_CHARS), key=len, reverse=True)


def redact(text: str, secrets: Iterable[str] = ()) -> str:
    for secret in worth_hiding(secrets):
        text = text.replace(secret, HIDDEN)
    return re.sub(KEY_LIKE, HIDDEN, re.sub(KEY_VALUE, rf"\1{HIDDEN}", text))


class RefloomError(Exception):
    """Something that ends a run; its message holds no secrets."""

    exit_code = CHECK_FAILED

    def __init__(self, message: str, secrets: Iterable[str] = ()):
        super().__init__(redact(message, secrets))


class InputError(RefloomError, ValueError):
    """The user has to change something."""

    exit_code = WRONG_INPUT


class CheckFailed(RefloomError):
    """The check could not be carried out."""


class Redacting(logging.Formatter):
    """A formatter whose lines, tracebacks too, hold no secrets."""

    def __init__(self, secrets: Iterable[str] = (), **format):
        super().__init__(**format)
        self.secrets = worth_hiding(secrets)

    def format(self, record: logging.LogRecord) -> str:
        return redact(super().format(record), self.secrets)


def log_to_stderr(secrets: Iterable[str] = (), level: int = logging.INFO) -> logging.Logger:
    """The package's logger with one handler of its own, whose formatter hides secrets; other loggers are left alone."""
    out = logging.getLogger("refloom")
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(Redacting(secrets, fmt="%(asctime)s %(levelname)s %(message)s"))
    out.handlers[:] = [handler]
    out.setLevel(level)
    out.propagate = False
    return out
