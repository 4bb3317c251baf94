"""What a rule looks like, as data, and the walker that compares a mapping with it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

#: Allowed levels and modifiers, names in `detection` that are no selections, what a rule id looks like.
LEVELS = ("informational", "info", "low", "medium", "high", "critical")
MODIFIERS = ("contains", "startswith", "endswith", "re", "regex", "exists", "gt", "gte", "lt", "lte")
RESERVED = ("condition", "timeframe", "threshold", "group_by", "correlation", "sequence")
RULE_ID = r"[A-Za-z0-9][A-Za-z0-9._:-]{2,127}"

#: A shape is given a value and its place, and yields what is wrong with it.
Shape = Callable[[Any, str], Iterator[str]]


def a(kind: type, what: str, fits: Callable[[Any], Any] = lambda v: True) -> Shape:
    def check(value: Any, at: str) -> Iterator[str]:
        if not (isinstance(value, kind) and fits(value)):
            yield f"{at}: {what} is expected"

    return check


def text(pattern: str = r"(?s).*\S.*", what: str = "a text") -> Shape:
    return a(str, what, re.compile(pattern).fullmatch)


def whole(least: int) -> Shape:
    return a(int, f"a whole number from {least}", lambda v: v >= least)


def either(*shapes: Shape) -> Shape:
    def check(value: Any, at: str) -> Iterator[str]:
        found = [list(s(value, at)) for s in shapes]
        if all(found):
            yield " or ".join(p for ps in found for p in ps)

    return check


def items(shape: Shape, least: int = 0) -> Shape:
    def check(value: Any, at: str) -> Iterator[str]:
        if not isinstance(value, list) or len(value) < least:
            yield f"{at}: a list of {least} or more is expected"
        else:
            for i, v in enumerate(value):
                yield from shape(v, f"{at}[{i}]")

    return check


def record(required: Mapping[str, Shape], optional: Mapping[str, Shape] = {}, ignored: tuple[str, ...] = (), names: Shape | None = None, rest: Shape | None = None, least: int = 0) -> Shape:
    """A mapping with these members. Others are free, or, if names or rest is given, at least `least` in number, with names
    and values of those shapes."""
    known = {*required, *optional, *ignored}

    def check(value: Any, at: str) -> Iterator[str]:
        if not isinstance(value, dict):
            yield f"{at}: a mapping is expected"
            return
        for name in required.keys() - value.keys():
            yield f"{at}.{name}: is missing"
        for name, shape in (*required.items(), *optional.items()):
            if name in value:
                yield from shape(value[name], f"{at}.{name}")
        others = {k: v for k, v in value.items() if k not in known}
        if len(others) < least:
            yield f"{at}: {least} or more members are expected"
        for name, v in others.items():
            yield from names(name, f"{at}: name {name!r}") if names else ()
            yield from rest(v, f"{at}.{name}") if rest else ()

    return check


def by(member: str, default: str, kinds: Mapping[str, Shape]) -> Shape:
    """The shape that a member of the mapping names."""

    def check(value: Any, at: str) -> Iterator[str]:
        kind = value.get(member, default) if isinstance(value, dict) else default
        if isinstance(kind, str) and kind in kinds:
            yield from kinds[kind](value, at)
        else:
            yield f"{at}.{member}: one of {', '.join(kinds)} is expected"

    return check


def unless_null(shape: Shape) -> Shape:
    return lambda value, at: iter(()) if value is None else shape(value, at)


_ANY_TEXT = text("(?s).*")
_SHARED = {"group_by": items(text("(?s).+", "a field"), 1), "timeframe": either(whole(1), text("(?i)[1-9][0-9]*[smhd]", "a number with s, m, h or d"))}
_CORRELATION = by("type", "count", {
    "count": record({"threshold": whole(1)}, _SHARED),
    "sequence": record({"sequence": items(text("(?s).+", "a selection"), 2)}, _SHARED),
})
_SELECTION = record({}, names=text(rf"(?s)(?!$)[^|]*(\|(?i:{'|'.join(MODIFIERS)}))?", "a field with a known modifier, or none,"), least=1)
RULE = record(
    {
        "id": text(RULE_ID, "an id of 3 to 128 letters, digits and . _ : -"),
        "title": text(),
        "logsource": record({}, least=1),
        "detection": record({"condition": text()}, {"correlation": unless_null(_CORRELATION)}, ignored=RESERVED, rest=_SELECTION, least=1),
    },
    {"level": text("|".join(LEVELS), f"one of {', '.join(LEVELS)}"), "tags": items(_ANY_TEXT), "references": items(_ANY_TEXT)},
)


def problems(spec: Any) -> list[str]:
    """All that is wrong with a rule's shape, and stages that are no selections."""
    found = [*RULE(spec, "rule")]
    if not found:
        detection = spec["detection"]
        stages = (detection.get("correlation") or {}).get("sequence", []) if (detection.get("correlation") or {}).get("type") == "sequence" else []
        found = [f"rule.detection.correlation.sequence: no selection {s!r}" for s in stages if s in RESERVED or s not in detection]
    return found


def remarks(spec: dict[str, Any]) -> list[str]:
    """What is allowed, but hardly meant: a modifier in capitals is known, yet compares as equality."""
    selections = {k: v for k, v in spec["detection"].items() if k not in RESERVED}
    entries = [(s, e) for s, v in selections.items() for e in v]
    return [f"rule.detection.{s}: {e} compares as equality; modifiers are written small" for s, e in entries if "|" in e and e.partition("|")[2] not in MODIFIERS]
