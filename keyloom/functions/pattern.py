"""Key patterns such as ``users##{group}##{id}##{attr}``: how a string key splits into captures and an attribute name."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from keyloom.errors import PatternError

ATTR = "attr"
_NOT_IN_NAME = re.compile(r"[^A-Za-z0-9_]")


@dataclass(frozen=True)
class Segment:
    """A literal text, or a variable (``name`` is set; the attribute's is ``attr``)."""

    text: str = ""
    name: str | None = None

    @property
    def is_attr(self) -> bool:
        return self.name == ATTR

    @property
    def is_capture(self) -> bool:
        return self.name is not None and self.name != ATTR


def _segments(pattern: str) -> list[Segment]:
    if not pattern:
        raise PatternError("Key pattern cannot be empty")
    out: list[Segment] = []
    seen: set[str] = set()
    at = 0
    while at < len(pattern):
        opened = pattern.find("{", at)
        if opened != at:
            out.append(Segment(text=pattern[at:] if opened < 0 else pattern[at:opened]))
            if opened < 0:
                break
        closed = pattern.find("}", opened)
        if closed < 0:
            raise PatternError(f"Unclosed '{{' in pattern at position {opened}")
        name = pattern[opened + 1 : closed]
        if not name:
            raise PatternError("Empty placeholder '{}' in pattern")
        if bad := _NOT_IN_NAME.search(name):
            raise PatternError(f"Invalid character '{bad[0]}' in placeholder name '{name}'")
        if name in seen:
            raise PatternError("Multiple {attr} segments in pattern" if name == ATTR else f"Duplicate capture name '{name}' in pattern")
        seen.add(name)
        out.append(Segment(name=name))
        at = closed + 1
    return out


class KeyPattern:
    """A parsed and validated key pattern."""

    def __init__(self, pattern: str) -> None:
        self.pattern = pattern
        self.segments = tuple(_segments(pattern))
        if not any(s.is_attr for s in self.segments):
            raise PatternError("Pattern must contain {attr} segment")
        for one, following in zip(self.segments, self.segments[1:], strict=False):
            if one.name and following.name:
                if one.is_attr:
                    raise PatternError("{attr} must be followed by a literal delimiter or end of pattern")
                raise PatternError("Consecutive variable segments without delimiter between them")

    def __repr__(self) -> str:
        return f"KeyPattern({self.pattern!r})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, KeyPattern) and other.pattern == self.pattern

    def __hash__(self) -> int:
        return hash(self.pattern)

    @cached_property
    def capture_names(self) -> tuple[str, ...]:
        return tuple(s.name for s in self.segments if s.is_capture)

    @property
    def capture_count(self) -> int:
        return len(self.capture_names)

    def has_capture(self, name: str) -> bool:
        return name in self.capture_names

    def capture_index(self, name: str) -> int:
        """Place of a capture among the captures, -1 if there is none of that name."""
        return self.capture_names.index(name) if name in self.capture_names else -1

    @property
    def has_attr(self) -> bool:
        return True

    @cached_property
    def attr_index(self) -> int:
        """Place of the attribute among all segments."""
        return next(i for i, s in enumerate(self.segments) if s.is_attr)

    @cached_property
    def literal_prefix(self) -> str:
        return self.segments[0].text

    @cached_property
    def uniform_delimiter(self) -> str | None:
        """The delimiter if the variables are parted by one text only, the attribute is last, and nothing follows it."""
        first = 0 if self.segments[0].name else 1
        rest = self.segments[first:]
        between = {s.text for s in rest if not s.name}
        if not rest[-1].is_attr or len(between) > 1:
            return None
        return between.pop() if between else ""

    def parse(self, key: str) -> tuple[tuple[str, ...], str] | None:
        """Captures and attribute of a key, or None. A variable ends at the first occurrence of the literal after it."""
        captures, attr, at = [], None, 0
        for i, s in enumerate(self.segments):
            if not s.name:
                if not key.startswith(s.text, at):
                    return None
                at += len(s.text)
                continue
            last = i + 1 == len(self.segments)
            end = len(key) if last else key.find(self.segments[i + 1].text, at)
            if end <= at:
                return None
            if s.is_attr:
                attr = key[at:end]
            else:
                captures.append(key[at:end])
            at = end
        return (tuple(captures), attr) if at == len(key) else None

    def matches(self, key: str) -> bool:
        return self.parse(key) is not None

    def build(self, values: Sequence[str] | Mapping[str, str], attr: str) -> str:
        """The key of captures (in pattern order, or by name) and an attribute. Nothing is escaped."""
        if isinstance(values, Mapping):
            for name in self.capture_names:
                if name not in values:
                    raise PatternError(f"Missing capture value for '{name}'")
            values = [values[n] for n in self.capture_names]
        if len(values) != self.capture_count:
            raise PatternError(f"Expected {self.capture_count} capture values, got {len(values)}")
        if not attr:
            raise PatternError("attr_name cannot be empty")
        for name, v in zip(self.capture_names, values, strict=True):
            if not v:
                raise PatternError(f"Capture value for '{name}' cannot be empty")
        given = iter(values)
        return "".join(s.text if not s.name else attr if s.is_attr else next(given) for s in self.segments)

    def build_prefix(self, values: Sequence[str] = ()) -> str:
        """The text that every key with these leading captures begins with."""
        out, given = [], iter(values)
        for s in self.segments:
            if s.name:
                v = None if s.is_attr else next(given, None)
                if v is None:
                    break
                out.append(v)
            else:
                out.append(s.text)
        return "".join(out)

    def leading(self, known: Mapping[str, str]) -> list[str]:
        """Values of the leading captures that are known, in pattern order."""
        out = []
        for s in self.segments:
            if s.is_attr or s.is_capture and s.name not in known:
                break
            if s.is_capture:
                out.append(known[s.name])
        return out

    def starts_with_prefix(self, key: str) -> bool:
        return key.startswith(self.literal_prefix)
