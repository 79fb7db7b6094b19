"""JSON path reads.

:func:`json_get` follows keys through lists, :func:`json_read` takes a path as it stands.

The built-in ``get_json_object`` answers every path that meets only objects
and fixed positions. The rules below cover the rest, still as column
expressions: a key applied to a list collects that key from each object in it
and opens one level of nested lists, ``[*]`` opens a list, and a lone hit of
``[..]`` stands without its list. Intermediate values are JSON text, so object
key order and number text stay those of the built-in.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a key and a position of a path look like.
KEY = re.compile(r"[a-zA-Z0-9_\-:\s]+")
POSITION = re.compile(r"\[([0-9]+|\*)\]")


class _Part:
    """One dotted part of a path: an optional key, then positions."""

    def __init__(self, text: str, keyed: bool):
        found = KEY.match(text) if keyed else None
        self.valid = bool(found) or not keyed
        self.key = found.group(0) if found else None
        self.positions = POSITION.findall(text)

    def builtin(self, positions: int | None = None) -> str:
        """This part for the built-in, with all or the first ``positions`` positions."""
        key = "" if self.key is None else f"['{self.key}']"
        return key + "".join(f"[{position}]" for position in self.positions[:positions])


def _parts(path: str) -> list[_Part] | None:
    """Parts of ``path``, the first one without a key if its root is a list; None if never a hit."""
    if not path.startswith("$") or (len(path) > 1 and path[1] not in ".["):
        return None
    if path == "$":
        return []
    from_list = path[1] == "[" or path[2:3] == "["
    texts = path.split(".")
    if path[1] == ".":
        texts = texts[1:]
    parts = [_Part(text, keyed=not (from_list and at == 0)) for at, text in enumerate(texts)]
    return parts if all(part.valid for part in parts) else None


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _boxed(text: Column, path: str) -> Column:
    """Value at ``path`` below ``text`` as JSON text, strings still quoted."""
    return F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), f"$[*]{path}")


def _elements(text: Column) -> Column:
    """Elements of a JSON list, each as JSON text; no elements for anything else."""
    plain = F.from_json(text, "array<string>")
    # Only lists with quotes in them can hold strings, whose elements come unquoted.
    typed = F.zip_with(
        plain, F.from_json(text, "array<variant>"),
        lambda s, v: F.when(s.isNull(), F.lit("null"))
        .when(F.schema_of_variant(v) == "STRING", F.to_json(v))
        .otherwise(s),
    )
    untyped = F.transform(plain, lambda s: F.coalesce(s, F.lit("null")))
    return (
        F.when(~text.startswith("["), F.array().cast("array<string>"))
        .when(text.contains('"'), typed)
        .otherwise(untyped)
    )


def _objects(text: Column) -> Column:
    """The objects among the elements of a JSON list."""
    # Without a string that begins like an object, the first character tells objects apart.
    items = F.when(text.contains('"{'), _elements(text)).otherwise(F.from_json(text, "array<string>"))
    return F.filter(items, lambda s: s.startswith("{"))


def _at(position: int) -> Callable[[Column], Column]:
    return lambda text: F.slice(_elements(text), position + 1, 1)


def _member(key: str, default: Column) -> Callable[[Column], Column]:
    return lambda text: F.coalesce(_boxed(text, f"['{key}']"), default)


def _as_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _collect_key(objects: Column, key: str) -> Column:
    """Values of ``key`` in ``objects``, lists opened once."""
    values = F.transform(objects, lambda e: _boxed(e, f"['{key}']"))
    found = F.filter(values, lambda v: v.isNotNull())
    return F.flatten(F.transform(found, lambda v: F.when(v.startswith("["), _elements(v)).otherwise(F.array(v))))


def _follow_key(text: Column, key: str) -> Column:
    def follow(t: Column) -> Column:
        collected = _let(_collect_key(_objects(t), key), lambda c: F.when(F.size(c) > 0, _as_list(c)))
        return F.when(t.startswith("{"), _boxed(t, f"['{key}']")).when(t.startswith("["), collected)

    return _let(text, follow)


def _follow_positions(text: Column, positions: list[str]) -> Column:
    hits = F.array(text)
    for position in positions:
        if position == "*":
            hits = F.flatten(F.transform(hits, _elements))
        else:
            hits = F.flatten(F.transform(hits, _at(int(position))))
    return _let(hits, lambda h: F.when(F.size(h) == 1, F.element_at(h, 1)).when(F.size(h) > 1, _as_list(h)))


def _plain(text: Column) -> Column:
    """JSON text as the result shows it: strings without quotes, no JSON nulls."""
    unquoted = F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")
    return F.when(text.startswith('"'), unquoted).when(text != "null", text)


def _builtin_path(parts: list[_Part]) -> str:
    return "$" + "".join(part.builtin() for part in parts)


def _from_list(json: Column, path: str, positions: list[str], rest: list[_Part]) -> Column:
    """What the remaining steps find in the list at ``path``; null if there is no list."""

    def walk(text: Column) -> Column:
        if positions:
            text = _follow_positions(text, positions)
        for part in rest:
            text = _follow_key(text, part.key)
            if part.positions:
                text = _follow_positions(text, part.positions)
        return _let(text, _plain)

    stepwise = F.when(F.get_json_object(json, f"{path}[*]").isNotNull(), _let(F.get_json_object(json, path), walk))
    # After a fixed position the built-in leaves a lone hit of [*] in its list.
    lone_hits_stand_alone = positions == ["*"] and not POSITION.search(path.replace("[*]", ""))
    if lone_hits_stand_alone and not rest:
        return _let(F.get_json_object(json, f"{path}[*]"), _plain)
    if not (lone_hits_stand_alone or not positions) or len(rest) != 1 or rest[0].positions:
        return stepwise

    def from_hits(hits: Column) -> Column:
        # A list without further lists in it needs no opening, whether it holds all hits or is the only one.
        flat = hits.startswith("[") & (F.locate("[", hits, 2) == 0) & (hits != "[]")
        out = F.when(flat, hits)
        if positions:
            # No hit is no answer yet: the only element may be a list of objects.
            return out.otherwise(stepwise)
        out = out.when(hits == "[]", F.lit(None)).when(~hits.startswith("["), F.concat(F.lit("["), hits, F.lit("]")))
        return out.when(hits.isNotNull(), stepwise)

    return _let(F.get_json_object(json, f"{path}[*]['{rest[0].key}']"), from_hits)


def _direct(json: Column, parts: list[_Part]) -> Column:
    """The answer of the built-in; at a position it shows a JSON null as text."""
    path = _builtin_path(parts)
    found = F.get_json_object(json, path)
    if not parts[-1].positions:
        return found
    return _let(found, lambda f: F.when(f == "null", _plain(_boxed(json, path[1:]))).otherwise(f))


def json_get(json: Column, path: str) -> Column:
    """Text at ``path``: scalars plain, objects and lists as JSON, null when missing.

    The path is read once while the plan is built. The built-in goes as far as
    it can; the longer way starts only at a list it stops at.
    """
    read = _parts(path) if path else None
    if read is None:
        return F.lit(None).cast("string")
    parts = read
    if not parts:
        return F.when(F.ltrim(json).rlike(r"^[\[{]"), F.get_json_object(json, "$"))
    star = next((at for at, part in enumerate(parts) if "*" in part.positions), None)
    stops = [
        _from_list(json, _builtin_path(parts[:at]), [], parts[at:])
        for at in range(1, len(parts) if star is None else star + 1)
    ]
    if star is not None:
        lead = parts[star].positions.index("*")
        before = _builtin_path(parts[:star]) + parts[star].builtin(lead)
        stops.append(_from_list(json, before, parts[star].positions[lead:], parts[star + 1:]))
    if star is None:
        stops.insert(0, _direct(json, parts))
    return F.coalesce(*stops)


STEP = re.compile(r"\.([^.\[\]]+)|\[([0-9]+|\*)\]|\['([^']+)'\]")


def json_read(json: Column, path: str) -> Column:
    """Text at ``path`` without looking through lists; a path with ``[*]`` always gives a list.

    An object that lacks the last key of such a path adds a null to the list.
    """
    if not path.startswith("$") or STEP.sub("", path[1:]):
        raise ValueError(f"cannot read JSON path {path!r}")
    steps = [(named or quoted, position) for named, position, quoted in STEP.findall(path[1:])]
    if ("", "*") not in steps:
        direct = "".join(f"['{key}']" if key else f"[{at}]" for key, at in steps)
        found = F.get_json_object(json, f"${direct}")
        if not steps or steps[-1][0]:
            return found
        return _let(found, lambda f: F.when(f == "null", _plain(_boxed(json, direct))).otherwise(f))
    hits = F.filter(F.array(F.get_json_object(json, "$")), lambda t: t.isNotNull())
    for number, (key, position) in enumerate(steps, 1):
        if position == "*":
            hits = F.flatten(F.transform(hits, _elements))
        elif position:
            hits = F.flatten(F.transform(hits, _at(int(position))))
        else:
            default = F.lit("null" if number == len(steps) else None)
            objects = F.filter(hits, lambda t: t.startswith("{"))
            hits = F.filter(F.transform(objects, _member(key, default)), lambda t: t.isNotNull())
    return F.when(F.get_json_object(json, "$").isNotNull(), _as_list(hits))
