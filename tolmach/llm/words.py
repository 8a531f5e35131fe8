"""Words as the data's description defines them: maximal runs of letters and digits, lower-cased."""

from __future__ import annotations

import re

_RUN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for a null."""
    if not text:
        return []
    if "İ" in text:  # the one letter whose lower case has a mark that would end a word
        return [w.lower() for w in _RUN.findall(text)]
    return _RUN.findall(text.lower())
