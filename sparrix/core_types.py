"""Small conversions shared by the operators."""

from __future__ import annotations

from typing import Any


def label_type(label: Any) -> str | None:
    """A label as text; parts of a composite one are joined with ``; ``."""
    if label is None:
        return None
    return "; ".join(map(str, label)) if isinstance(label, list | tuple) else str(label)
