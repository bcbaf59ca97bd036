"""Names of result files and tables."""

from __future__ import annotations

import re
from datetime import date

#: The characters of a tag.
_TAG = re.compile(r"[A-Za-z0-9_.-]+")


def stem(base: str, symbol: str, start: str | date, end: str | date, tag: str | None = None, horizon: int | None = None) -> str:
    """base[_tag]_SYMBOL_start_to_end[_hN]; an empty tag counts as none."""
    tag = (tag or "").strip()
    if tag and not _TAG.fullmatch(tag):
        raise ValueError(f"a tag holds letters, digits, underscores, dots and hyphens only: {tag!r}")
    if horizon is not None and horizon <= 0:
        raise ValueError("the horizon must be positive")
    return f"{base}{'_' + tag if tag else ''}_{symbol}_{start}_to_{end}{'' if horizon is None else f'_h{horizon}'}"
