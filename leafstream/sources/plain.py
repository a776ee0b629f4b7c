"""The test for text worth rendering, for code that runs on one file at a time."""

from __future__ import annotations

import re

_WORTH = re.compile(r"[^\W\d_]")


def translatable(text: str) -> bool:
    """Whether a text has letters, or numbers other than decimal digits."""
    return bool(_WORTH.search(text))
