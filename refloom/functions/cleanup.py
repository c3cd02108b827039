"""Text cleanup that every input goes through."""

from __future__ import annotations

import re
import unicodedata

# Characters without a visible role, and blanks.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
BLANKS = "[ \t\u00a0\u2000-\u200a\u202f\u205f\u3000]+"
_blanks, _invisible = re.compile(BLANKS), re.compile(f"[{INVISIBLE}]")


def clean_text(text: str) -> str:
    text = _invisible.sub("", unicodedata.normalize("NFKC", text))
    return "\n".join(_blanks.sub(" ", line).strip() for line in re.split(r"\r\n|\r|\n", text))


def decode_text(data: bytes) -> str | None:
    """UTF-8, with or without a mark, else Windows-1252; None if it is neither or holds NUL."""
    if b"\0" in data:
        return None
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return None
