"""Declared options of sources and sinks: name, type, default and what they are for."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

# Options that say how an insert runs; every sink table may carry them.
JOB_OPTIONS = ("outputMode", "name", "every", "checkpoint")


class _Required:
    def __repr__(self) -> str:
        return "required"


REQUIRED = _Required()


def _truth(text) -> bool:
    known = {"true": True, "false": False}
    if str(text).lower() not in known:
        raise ValueError(f"{text!r} is neither true nor false")
    return known[str(text).lower()]


@dataclass(frozen=True)
class Option:
    name: str
    kind: Callable = str
    default: object = REQUIRED
    description: str = ""

    def read(self, value):
        if value is None:
            return None
        if self.kind is Callable:
            if not callable(value):
                raise ValueError(f"{value!r} cannot be called")
            return value
        return (_truth if self.kind is bool else self.kind)(value)


def read_options(who: str, declared: Iterable[Option], given: dict, also: Iterable[str] = ()) -> dict:
    """Values of all declared options: given ones in their type, else defaults.

    An option that is missing, mistyped, or that nobody declared is an error that names it.
    """
    declared = {option.name: option for option in declared}
    unknown = sorted(set(given) - set(declared) - set(also))
    if unknown:
        raise ValueError(f"{who}: unknown options {unknown}, there are {sorted(declared)}")
    out = {}
    for name, option in declared.items():
        value = given.get(name)
        if value is None:
            if option.default is REQUIRED:
                raise ValueError(f"{who}: option {name} is missing")
            out[name] = option.default
            continue
        try:
            out[name] = option.read(value)
        except (TypeError, ValueError) as error:
            raise ValueError(f"{who}: option {name}: {error}") from None
    return out


def listed(declared: Iterable[Option]) -> list[dict]:
    """Key, description and default of each option, the default as text and empty where there is none."""
    return [{"key": o.name, "description": o.description,
             "default": "" if o.default is REQUIRED or o.default is None else str(o.default)} for o in declared]
