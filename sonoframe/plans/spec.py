"""Selection specs: what a query may say, and how YAML says it.

A spec filters samples, orders them and picks one. This module only reads and checks; compile.py makes plans of it.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field, replace
from typing import Any

import yaml

COMPARISONS = ("gte", "lte", "gt", "lt", "eq")

#: The YAML names of the numeric fields, and what they are called in specs.
NUMERIC = {"duration": "duration", "onsets": "onsets", "tempo": "tempo", "pitch": "pitch_hz", "quantized_beats": "quantized_beats"}
#: The older order words, as (scorer, direction).
ORDER_WORDS = {
    "newest": ("age", "desc"), "oldest": ("age", "asc"),
    "duration_asc": ("duration", "asc"), "duration_desc": ("duration", "desc"),
    "pitch_asc": ("pitch", "asc"), "pitch_desc": ("pitch", "desc"),
    "onsets_asc": ("onsets", "asc"), "onsets_desc": ("onsets", "desc"),
    "tempo_asc": ("tempo", "asc"), "tempo_desc": ("tempo", "desc"),
    "loudest": ("level", "desc"), "quietest": ("level", "asc"),
    "similarity": ("similarity", "desc"),
    "quantized_beats_asc": ("quantized_beats", "asc"), "quantized_beats_desc": ("quantized_beats", "desc"),
}
SCORERS = {"duration", "pitch", "onsets", "tempo", "level", "age", "quantized_beats", "beat_match", "similarity"}
#: The processors' names; older names with the name and parameters they stand for; older parameter names.
PROCESSORS = {"repitch", "stretch_quantize", "pad_quantize", "filter_low", "filter_high", "filter_band", "reverse", "saturate", "compress", "limit", "hpss", "gate", "distort", "reshape", "transient", "vocoder"}
OLD_PROCESSORS = {"beat_quantize": ("stretch_quantize", {}), "hpss_harmonic": ("hpss", {"keep": "harmonic"}), "hpss_percussive": ("hpss", {"keep": "percussive"})}
OLD_PARAMETERS = {"saturate": {"amount": "drive"}, "transient": {"amount": "gain"}, "stretch_quantize": {"amount": "strength", "bpm": "tempo"}, "pad_quantize": {"amount": "strength", "bpm": "tempo"}}

PITCH_CLASSES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


class SpecError(ValueError):
    """A spec that can't be read, with the assignment it is in."""

    def __init__(self, where: str, what: str):
        super().__init__(f"assignment {where!r}: {what}")


@dataclass(frozen=True)
class Range:
    """Bounds that all have to hold; none holds for everything."""

    gte: float | None = None
    lte: float | None = None
    gt: float | None = None
    lt: float | None = None
    eq: float | None = None

    @property
    def bounds(self) -> list[tuple[str, float]]:
        return [(op, getattr(self, op)) for op in COMPARISONS if getattr(self, op) is not None]


@dataclass(frozen=True)
class Where:
    ranges: tuple[tuple[str, Range], ...] = ()
    pitched: bool | None = None
    reference: str | None = None
    name: str | None = None
    name_path: str | None = None
    directory: str | None = None

    def range(self, of: str) -> Range:
        return dict(self.ranges).get(of, Range())


@dataclass(frozen=True)
class Order:
    by: str
    descending: bool = False
    params: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Select:
    where: Where = field(default_factory=Where)
    order: tuple[Order, ...] = ()
    pick: int = 1
    pick_given: bool = False


@dataclass(frozen=True)
class Controller:
    """A parameter that follows a MIDI controller: 0..127 is spread over low..high."""

    cc: int
    low: float = 0.0
    high: float = 1.0
    initial: float | None = None
    channel: int | None = None

    def at(self, value: int | None) -> float:
        if value is None:
            return (self.low + self.high) / 2 if self.initial is None else self.initial
        return self.low + value / 127 * (self.high - self.low)


@dataclass(frozen=True)
class Step:
    name: str
    params: tuple[tuple[str, Any], ...] = ()

    def get(self, key: str, otherwise: Any = None) -> Any:
        return dict(self.params).get(key, otherwise)


@dataclass(frozen=True)
class Assignment:
    name: str
    channel: int
    notes: tuple[int, ...]
    select: tuple[Select, ...]
    process: tuple[Step, ...] = ()
    one_shot: bool = True
    gain: float = 0.0
    pan: tuple[float, ...] | None = None
    output: tuple[int, ...] | None = None


def path_like(text: str) -> bool:
    return text.startswith(".") or "/" in text


def note_number(name: str | int) -> int:
    """MIDI number of a note: C4 is 60, with sharps (#, s) and flats (b)."""
    if isinstance(name, int):
        return name
    m = re.fullmatch(r"([A-Ga-g])([#sb]?)(-?\d+)", name.strip())
    if not m:
        raise ValueError(f"not a note: {name!r}")
    return PITCH_CLASSES[m[1].upper()] + {"": 0, "#": 1, "s": 1, "b": -1}[m[2]] + 12 * (int(m[3]) + 1)


def note_hz(name: str | int) -> float:
    return 440.0 * 2 ** ((note_number(name) - 69) / 12)


def expand_notes(raw: Any, where: str = "") -> tuple[int, ...]:
    """A number, a name, lo..hi, or a list of these."""
    if isinstance(raw, list):
        return tuple(n for x in raw for n in expand_notes(x, where))
    try:
        if isinstance(raw, str) and ".." in raw:
            low, high = (note_number(int(x) if x.strip().isdigit() else x) for x in raw.split(".."))
            notes = tuple(range(low, high + 1))
        else:
            notes = (note_number(int(raw) if str(raw).isdigit() else raw),)
    except ValueError as e:
        raise SpecError(where, str(e)) from e
    if not notes or min(notes) < 0 or max(notes) > 127:
        raise SpecError(where, f"notes must be within 0 and 127, got {raw!r}")
    return notes


class Reader:
    """Reads specs. base: folder of relative paths; strict: whether unknown names are errors or left out."""

    def __init__(self, where: str = "", base: str = "/", strict: bool = True):
        self.where, self.base, self.strict = where, base, strict

    def fail(self, what: str) -> SpecError:
        return SpecError(self.where, what)

    def path(self, text: str) -> str:
        return posixpath.normpath(posixpath.join(self.base, text))

    def number(self, of: str, value: Any) -> float:
        if of == "pitch_hz" and isinstance(value, str):
            try:
                return note_hz(value)
            except ValueError as e:
                raise self.fail(str(e)) from e
        try:
            return float(value)
        except (TypeError, ValueError) as e:
            raise self.fail(f"{of} must be a number, got {value!r}") from e

    def select(self, raw: Any) -> tuple[Select, ...]:
        """One spec, or a list of which the first with a result counts."""
        return tuple(self.one(x) for x in (raw if isinstance(raw, list) else [raw]))

    def one(self, raw: Any) -> Select:
        if not isinstance(raw, dict):
            raise self.fail("select must be a mapping or a list of mappings")
        if "order" in raw and "order_by" in raw:
            raise self.fail("give order or order_by, not both")
        condition = self.conditions(raw.get("where"))
        order = self.order(raw["order"] if "order" in raw else raw["order_by"]) if {"order", "order_by"} & raw.keys() else ()
        if not order and not {"order", "order_by"} & raw.keys() and condition.reference is not None:
            order = (Order("similarity", True),)
        try:
            pick = int(raw.get("pick", 1))
        except (TypeError, ValueError) as e:
            raise self.fail("pick must be a whole number") from e
        if pick < 1:
            raise self.fail(f"pick counts from 1, got {pick}")
        return Select(condition, order, pick, "pick" in raw)

    def conditions(self, raw: Any) -> Where:
        if raw is None:
            return Where()
        if not isinstance(raw, dict):
            raise self.fail("where must be a mapping")
        ranges: dict[str, dict[str, float]] = {}
        form: dict[str, str] = {}
        out = Where()
        for key, value in raw.items():
            end, _, rest = str(key).partition("_")
            old = end in ("min", "max") and rest in NUMERIC
            if old or key in NUMERIC:
                of = NUMERIC[rest if old else key]
                if form.setdefault(of, "old" if old else "new") != ("old" if old else "new"):
                    raise self.fail(f"{of} is given in both the old and the new form")
                given = {"gte" if end == "min" else "lte": value} if old else value if isinstance(value, dict) else {"eq": value}
                if unknown := given.keys() - set(COMPARISONS):
                    raise self.fail(f"unknown comparison {sorted(unknown)[0]!r} of {key}")
                ranges.setdefault(of, {}).update({op: self.number(of, x) for op, x in given.items()})
            elif key == "pitched":
                if not isinstance(value, bool):
                    raise self.fail("pitched must be true or false")
                out = replace(out, pitched=value)
            elif key == "reference":
                out = replace(out, reference=self.path(str(value)) if path_like(str(value)) else str(value))
            elif key in ("name", "path"):
                if out.name is not None:
                    raise self.fail("give name or path, not both")
                text = str(value)
                if key == "path" or path_like(text):
                    out = replace(out, name=posixpath.splitext(posixpath.basename(text))[0], name_path=self.path(text))
                else:
                    out = replace(out, name=text)
            elif key == "directory":
                out = replace(out, directory=self.path(str(value)))
            elif self.strict:
                raise self.fail(f"unknown condition {key!r}")
        return replace(out, ranges=tuple((of, Range(**bounds)) for of, bounds in sorted(ranges.items())))

    def order(self, raw: Any) -> tuple[Order, ...]:
        if not isinstance(raw, (str, dict, list)):
            raise self.fail("order must be a word, a mapping or a list")
        out = tuple(self.clause(x) for x in (raw if isinstance(raw, list) else [raw]))
        if any(c.by == "similarity" for c in out[1:]):
            raise self.fail("similarity can only come first")
        return out

    def clause(self, raw: Any) -> Order:
        if isinstance(raw, str):
            if raw not in ORDER_WORDS:
                raise self.fail(f"unknown order {raw!r}")
            by, direction = ORDER_WORDS[raw]
            return Order(by, direction == "desc")
        if not isinstance(raw, dict) or "by" not in raw:
            raise self.fail("an order must be a word or a mapping with 'by'")
        by, direction = str(raw["by"]), str(raw.get("dir", "asc")).lower()
        if direction not in ("asc", "desc"):
            raise self.fail(f"dir must be asc or desc, got {direction!r}")
        if by not in SCORERS | USER_SCORERS.keys():
            raise self.fail(f"unknown scorer {by!r}")
        params = {str(k): v for k, v in raw.items() if k not in ("by", "dir")}
        if by == "beat_match":
            params["pattern"] = self.pattern(params.get("pattern"))
        return Order(by, direction == "desc", tuple(params.items()))

    def pattern(self, raw: Any) -> tuple[float, ...]:
        if not isinstance(raw, list) or len(raw) < 2 or not all(isinstance(x, (int, float)) for x in raw):
            raise self.fail("beat_match needs a pattern of two numbers or more")
        if not all(0 <= x <= 1 for x in raw):
            raise self.fail("a pattern's numbers are from 0 to 1")
        return tuple(float(x) for x in raw)

    def process(self, raw: Any) -> tuple[Step, ...]:
        if raw is None:
            return ()
        if not isinstance(raw, list):
            raise self.fail("process must be a list")
        return tuple(self.step(x) for x in raw)

    def step(self, raw: Any) -> Step:
        if isinstance(raw, dict) and len(raw) != 1:
            raise self.fail("a process entry has exactly one name")
        if not isinstance(raw, (str, dict)):
            raise self.fail("a process entry is a name or a mapping")
        name, given = (raw, None) if isinstance(raw, str) else next(iter(raw.items()))
        name = str(name)
        if self.strict and name not in PROCESSORS | OLD_PROCESSORS.keys() | USER_PROCESSORS:
            raise self.fail(f"unknown processor {name!r}")
        name, implied = OLD_PROCESSORS.get(name, (name, {}))
        if given is None or isinstance(given, bool):
            given = {}
        if not isinstance(given, dict):
            raise self.fail(f"{name} takes a mapping of parameters")
        params = {}
        for key, value in given.items():
            key = OLD_PARAMETERS.get(name, {}).get(str(key), str(key))
            if key in params:
                raise self.fail(f"{name} has {key} twice")
            params[key] = self.value(value)
        return Step(name, tuple(({k: v for k, v in implied.items() if k not in params} | params).items()))

    @staticmethod
    def value(raw: Any) -> Any:
        if isinstance(raw, dict) and "cc" in raw:
            number = lambda key, kind: kind(raw[key]) if key in raw else None
            return Controller(int(raw["cc"]), float(raw.get("min", 0.0)), float(raw.get("max", 1.0)), number("default", float), number("channel", int))
        return raw


#: Names of processors added by users; functions.dsp has what they do.
USER_PROCESSORS: set[str] = set()
#: Scorers added by users: name to (function of the samples' row giving a Column, whether rows without one are dropped).
USER_SCORERS: dict[str, tuple[Any, bool]] = {}


def register_scorer(name: str, column: Any, drop_missing: bool = False) -> None:
    if name in SCORERS or name in USER_SCORERS:
        raise ValueError(f"there is a scorer {name!r}")
    USER_SCORERS[name] = (column, drop_missing)


def read_map(text: str, base: str = "/", strict: bool = True, references: set[str] | None = None) -> tuple[list[Assignment], list[dict]]:
    """Assignments and banks of a map in YAML. With references given, assignments that name another are left out."""
    raw = yaml.safe_load(text) or {}
    out = []
    for i, x in enumerate(raw.get("assignments") or []):
        name = str(x.get("name", f"#{i + 1}"))
        reader = Reader(name, base, strict)
        channel = int(x.get("channel", 0))
        if not 1 <= channel <= 16:
            raise reader.fail(f"channel must be from 1 to 16, got {channel}")
        select = reader.select(x.get("select", {}))
        asked = {s.where.reference for s in select} - {None}
        if references is not None and any(not path_like(r) and r.upper() not in references for r in asked):
            continue
        pan = x.get("pan")
        if pan is not None and (len(pan) not in (1, 2, 4, 6, 8) or any(float(w) < 0 for w in pan)):
            raise reader.fail("pan has 1, 2, 4, 6 or 8 weights of 0 or more")
        output = x.get("output")
        if output is not None and (len(set(output)) != len(output) or min(output) < 1):
            raise reader.fail("output has channels from 1, each once")
        out.append(Assignment(name, channel, expand_notes(x["notes"], name), select, reader.process(x.get("process")), bool(x.get("one_shot", True)), float(x.get("gain", 0.0)), tuple(map(float, pan)) if pan is not None else None, tuple(output) if output is not None else None))
    return out, read_banks(raw.get("banks"))


def read_banks(raw: Any) -> list[dict]:
    """Banks with name, directory and program: by default its place in the list, unique, from 0 to 127."""
    out = []
    for i, x in enumerate(raw or []):
        if not isinstance(x, dict) or not x.get("name") or not x.get("directory"):
            raise SpecError("banks", "a bank has a name and a directory")
        out.append({"name": str(x["name"]), "directory": str(x["directory"]), "program": int(x.get("program", i))})
    programs = [b["program"] for b in out]
    if len(set(programs)) != len(programs) or any(not 0 <= p <= 127 for p in programs):
        raise SpecError("banks", "programs are from 0 to 127, each once")
    return out


def note_map(assignments: list[Assignment]) -> dict[tuple[int, int], tuple[Assignment, int]]:
    """(channel, note) to the assignment and its pick; the last to name a note has it.

    The n-th of several notes takes the n-th rank, unless pick is given or the notes are one sound repitched.
    """
    out = {}
    for a in assignments:
        spread = len(a.notes) > 1 and not any(s.pick_given for s in a.select) and not any(s.name == "repitch" for s in a.process)
        for i, note in enumerate(a.notes):
            out[a.channel, note] = (a, i + 1 if spread else a.select[0].pick)
    return out


def controllers_of(assignments: list[Assignment]) -> set[tuple[int, int]]:
    """(channel, controller) of all that processors follow; a controller without a channel is on the assignment's."""
    values = [(a, v) for a in assignments for step in a.process for _, v in step.params if isinstance(v, Controller)]
    return {(a.channel if v.channel is None else v.channel, v.cc) for a, v in values}
