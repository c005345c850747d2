"""Exceptions, and a profile of named checks whose failure can be handled in five ways."""

from __future__ import annotations

import sys
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

STATES = ("ignore", "warn", "raise", "call", "print")


class SparrixError(Exception):
    """Base of all errors of this package."""


class ParseError(SparrixError):
    """A file does not have the format it should have."""


class TableError(SparrixError):
    """A table cannot be built or an operation is not defined for it."""


class DisjointIDError(TableError):
    """Two tables that must not share ids do."""


class UnknownAxisError(TableError):
    def __init__(self, axis: object):
        super().__init__(f"unknown axis {axis!r}; it must be 'sample' or 'observation'")


class UnknownIDError(TableError, KeyError):
    def __init__(self, missing: object, axis: str):
        super().__init__(f"{axis} id {missing!r} does not exist")

    def __str__(self) -> str:
        return str(self.args[0])


class ErrorProfile:
    """Named checks of a table; ``test(item)`` is true where the check fails."""

    def __init__(self) -> None:
        self._checks: dict[str, dict[str, Any]] = {}

    def register(
        self, name: str, message: str, state: str, test: Callable[[Any], bool], callback: Callable[[Any], Any] | None = None, exception: type[Exception] = TableError
    ) -> None:
        if name in self._checks:
            raise KeyError(f"{name} is registered already")
        if state not in STATES:
            raise KeyError(f"unknown state {state!r}")
        self._checks[name] = {"message": message, "state": state, "test": test, "callback": callback, "exception": exception}

    def unregister(self, name: str) -> dict[str, Any]:
        if name not in self._checks:
            raise KeyError(name)
        return self._checks.pop(name)

    def __contains__(self, name: str) -> bool:
        return name in self._checks

    @property
    def state(self) -> dict[str, str]:
        return {k: v["state"] for k, v in self._checks.items()}

    @state.setter
    def state(self, new: dict[str, str]) -> None:
        new = dict.fromkeys(self._checks, new["all"]) if "all" in new else new
        for name, state in new.items():
            if name not in self._checks or state not in STATES:
                raise KeyError(f"unknown check or state: {name}={state}")
        for name, state in new.items():
            self._checks[name]["state"] = state

    def getcall(self, name: str) -> Callable[[Any], Any] | None:
        return self._checks[name]["callback"]

    def setcall(self, name: str, callback: Callable[[Any], Any]) -> Callable[[Any], Any] | None:
        before, self._checks[name]["callback"] = self._checks[name]["callback"], callback
        return before

    def test(self, item: Any, *names: str) -> Any:
        """Runs the named checks, or all, by name; handles the first that fails."""
        for name in sorted(names or self._checks):
            if name not in self._checks:
                raise KeyError(name)
            if self._checks[name]["state"] != "ignore" and self._checks[name]["test"](item):
                return self._handle(name, item)
        return None

    def _handle(self, name: str, item: Any) -> Any:
        check = self._checks[name]
        if check["state"] == "warn":
            warnings.warn(check["message"], stacklevel=3)
        elif check["state"] == "raise":
            return check["exception"](check["message"])
        elif check["state"] == "call":
            return check["callback"](item) if check["callback"] else None
        elif check["state"] == "print":
            print(check["message"], file=sys.stdout)
        return None


def _unknown_cells(axis: str) -> Callable[[Any], bool]:
    def test(table: Any) -> bool:
        frame, key = table._axis(axis)
        return not table.cells.join(frame.select(frame["id"].alias(key)), key, "left_anti").isEmpty()

    return test


def _repeated_ids(axis: str) -> Callable[[Any], bool]:
    def test(table: Any) -> bool:
        return not table._axis(axis)[0].groupBy("id").count().where("count > 1").isEmpty()

    return test


def _null_ids(axis: str) -> Callable[[Any], bool]:
    def test(table: Any) -> bool:
        return not table._axis(axis)[0].where("id is null").isEmpty()

    return test


PROFILE = ErrorProfile()
PROFILE.register("empty", "the table is empty", "ignore", lambda t: t.is_empty())
for _short, _axis in (("obs", "observation"), ("samp", "sample")):
    PROFILE.register(f"{_short}size", f"cells name an {_axis} that is not on the axis", "raise", _unknown_cells(_axis))
    PROFILE.register(f"{_short}dup", f"duplicate {_axis} ids", "raise", _repeated_ids(_axis))
    PROFILE.register(f"{_short}null", f"null {_axis} ids", "raise", _null_ids(_axis))
    # metadata is a column of the axis, so it always has the axis' length
    PROFILE.register(f"{_short}mdsize", f"{_axis} metadata of another length than the axis", "raise", lambda t: False)


def geterr() -> dict[str, str]:
    return PROFILE.state


def seterr(**states: str) -> dict[str, str]:
    before = PROFILE.state
    PROFILE.state = states
    return before


def geterrcall(name: str) -> Callable[[Any], Any] | None:
    return PROFILE.getcall(name)


def seterrcall(name: str, callback: Callable[[Any], Any]) -> Callable[[Any], Any] | None:
    return PROFILE.setcall(name, callback)


def errcheck(table: Any, *names: str) -> None:
    result = PROFILE.test(table, *names)
    if isinstance(result, Exception):
        raise result


@contextmanager
def errstate(**states: str) -> Iterator[None]:
    """Sets states for a block and restores them, also after an exception."""
    before = seterr(**states)
    try:
        yield
    finally:
        PROFILE.state = before
