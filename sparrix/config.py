"""Settings from files of ``name value`` lines, the least important file first."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from pathlib import Path

#: Names the user's own file of settings; besides, there may be one in the home folder.
VARIABLE, HOME_FILE = "SPARRIX_CONFIG", ".sparrix_config"
SETTING = re.compile(r"^[^\S\n]*(?!#)(\S+)(.*)$", re.MULTILINE)


def parse_settings(text: str) -> dict[str, str | None]:
    """Values by name, their words with single blanks between them; a name alone has none. ``#`` lines are comments."""
    return {name: " ".join(value.split()) or None for name, value in SETTING.findall(text)}


def package_folder() -> Path:
    return Path(__file__).resolve().parent


def settings_files() -> list[Path]:
    """The files that count if they are there: the package's, the one the environment names, the one at home."""
    named = os.environ.get(VARIABLE)
    return [package_folder() / "settings", *([Path(named)] if named else []), Path.home() / HOME_FILE]


def load_settings(files: Iterable[Path | str] | None = None) -> dict[str, str | None]:
    """The settings of all files that can be read; of a name set twice the later value."""
    out: dict[str, str | None] = {}
    for path in settings_files() if files is None else files:
        try:
            out |= parse_settings(Path(path).read_text(encoding="utf-8"))
        except OSError:
            continue
    return out
