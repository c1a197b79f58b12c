"""Words as this project counts them: runs of characters other than space, tab, CR and LF."""

from __future__ import annotations

import re

_RUN = re.compile(r"[^ \t\r\n]+")
#: Characters that str.split() takes for white space but that do not end a word here.
_NO_BREAK = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def runs(text: str | None) -> list[str]:
    text = text or ""
    return _RUN.findall(text) if _NO_BREAK.search(text) else text.split()
