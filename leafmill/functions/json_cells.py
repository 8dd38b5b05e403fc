"""The json_cells() column: a JSON text to the cells of its records, one Arrow batch at a time."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator, Sequence
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Beyond these the JSON reader of Spark has limits of its own.
_MOST_CHARS = 50_000
_MOST_DEPTH = 500
# Numbers whose printed form is beyond doubt; a double has all digits of the short ones.
_INTEGER = re.compile(r"-?[0-9]{1,18}")
_SHORT = re.compile(r"-?[0-9]{1,9}\.[0-9]{1,6}")
_BRACKETS = re.compile(r'"(?:[^"\\]++|\\.)*+"|([{\[])|([}\]])', re.S)
_MOST_KEPT = 100_000
_STARTS = ("{", "[")
_NOTHING: dict = {}


class _Odd(ValueError):
    """A text that is left to the JSON functions of Spark."""


class _Number(str):
    """A number as a browser prints it."""


class _Sorted(tuple):
    """An object whose members are printed in the order of their names, as VARIANT has them."""


class _Kept(dict):
    """What ``make`` gives for a text, made once for each of them."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str):
        if len(self) > _MOST_KEPT:
            self.clear()
        found = self[text] = self.make(text)
        return found


def _number(text: str) -> _Number:
    if _SHORT.fullmatch(text):
        return _Number(text.rstrip("0").rstrip(".") if text.strip("-0.") else "0")
    if _INTEGER.fullmatch(text):
        return _Number(text if text != "-0" else "0")
    value = float(text) if len(text) < 20 else 0.5
    # a whole number with an exponent is a double, and below this size it is printed without one
    if "e" in text.lower() and value.is_integer() and abs(value) < 1e7:
        return _Number(int(value))
    raise _Odd(text)


def _no_number(text: str):
    raise _Odd(text)


def _depth(text: str) -> int:
    now = most = 0
    for opens, closes in _BRACKETS.findall(text):
        now += bool(opens) - bool(closes)
        most = max(most, now)
    return most


_PLAIN = {None: "null", True: "true", False: "false"}
_names = _Kept(lambda name: encode_basestring(name) + ":")


def _json(value) -> str:
    """JSON text with members in their own order."""
    kind = type(value)
    if kind is str:
        return encode_basestring(value)
    if kind is _Number:
        return value
    if kind is list:
        return "[" + ",".join([v if type(v) is _Number else encode_basestring(v) if type(v) is str else _json(v) for v in value]) + "]"
    if kind is tuple and (len(value) < 2 or len(dict(value)) == len(value)):
        return "{" + ",".join([_names[k] + (v if type(v) is _Number else encode_basestring(v) if type(v) is str else _json(v)) for k, v in value]) + "}"
    if isinstance(value, tuple):
        raise _Odd
    return _PLAIN[value]


def _sorted_json(value) -> str:
    """JSON text with all members in the order of their names, of equal names the last one."""
    if isinstance(value, tuple):
        members = dict(value)
        if not all(map(str.isascii, members)):
            raise _Odd
        return "{" + ",".join([_names[k] + _sorted_json(members[k]) for k in sorted(members)]) + "}"
    return "[" + ",".join(map(_sorted_json, value)) + "]" if type(value) is list else _json(value)


def _cell(value) -> str:
    """A cell that is neither text nor a number nor missing."""
    if type(value) is bool:
        return _PLAIN[value]
    try:
        return _json(value)
    except _Odd:
        # what has a name twice somewhere is printed as VARIANT has it
        return _sorted_json(value)


def _members(values: list) -> list[dict]:
    """The members of each object; what is none has none."""
    return [dict(v) if isinstance(v, tuple) else _NOTHING for v in values]


def _step(value, step: str | int):
    """What a member, or a position, leads to; a position may also be the name of a member."""
    if type(value) is list:
        return value[step] if type(step) is int and step < len(value) else None
    return dict(value).get(str(step)) if isinstance(value, tuple) else None


def _columns(records: list, paths: Sequence[tuple]) -> list[list[str]]:
    """The cells at each path; what stands on the way of several paths is looked up once."""
    found, opened = {(): records}, {}

    def members(path: tuple) -> list[dict]:
        if path not in opened:
            opened[path] = _members(at(path))
        return opened[path]

    def at(path: tuple) -> list:
        if path not in found:
            *above, step = path
            above = tuple(above)
            if isinstance(step, str):
                found[path] = [m.get(step) for m in members(above)]
            else:
                # a position may also be the name of a member
                name = str(step)
                found[path] = [(v[step] if step < len(v) else None) if type(v) is list else m.get(name) for v, m in zip(at(above), members(above), strict=True)]
        return found[path]

    def cells(path: tuple) -> list[str]:
        values = at(path)
        if path[-1:] == ("length",):
            values = [_Number(len(above)) if v is None and type(above) is list else v for v, above in zip(values, at(path[:-1]), strict=True)]
        return [v if isinstance(v, str) else "" if v is None else _cell(v) for v in values]

    return [cells(path) for path in paths]


def _reader(rows: tuple, paths: Sequence[tuple]):
    """Texts to arrays of their records' cells, NULL for the texts that are left to Spark."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = _Kept(_number).__getitem__
        kept = {"parse_int": numbers, "parse_float": numbers, "parse_constant": _no_number}
        # objects stay tuples of members, so that names that stand twice are seen
        whole = json.JSONDecoder(object_pairs_hook=tuple, **kept)
        single = json.JSONDecoder(object_pairs_hook=_Sorted, **kept)

        def parsed(doc: str):
            # an object that stands alone has no text for the order of its members
            decoder = whole if doc.count("{") > 1 else single
            if doc[:1] in _STARTS:
                value, end = decoder.raw_decode(doc)
                if end == len(doc):
                    return value
            return decoder.decode(doc)

        def records(doc: str | None) -> list | None:
            """None where another reader might see it otherwise: escaped units, rare numbers, anything malformed."""
            if doc is None or len(doc) > _MOST_CHARS or "\\u" in doc:
                return None
            if len(doc) > 2 * _MOST_DEPTH and doc.count("{") + doc.count("[") > _MOST_DEPTH and _depth(doc) > _MOST_DEPTH:
                return None
            try:
                value = parsed(doc)
            except (ValueError, RecursionError):
                return None
            for step in rows:
                value = _step(value, step)
            return value if type(value) is list else [] if value is None else [value]

        def cells(found: list) -> tuple[list, list[list[str]]]:
            """The records of each text, and the columns of them all."""
            try:
                return found, _columns([r for some in found if some for r in some], paths)
            except (ValueError, RecursionError):
                if len(found) == 1:
                    return [None], [[] for _ in paths]
            each = [cells([some]) for some in found]
            return [some for one, _ in each for some in one], [[c for _, columns in each for c in columns[i]] for i in range(len(paths))]

        for docs in batches:
            found, columns = cells([records(doc) for doc in _texts(docs)])
            ends = [0]
            for some in found:
                ends.append(ends[-1] + len(some or ()))
            item = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=[f"_{i}" for i in range(len(paths))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item, mask=pa.array([some is None for some in found], pa.bool_()))

    return read


def _texts(docs: pa.Array) -> list[str | None]:
    try:
        return docs.to_pylist()
    except UnicodeDecodeError:
        return [_text(doc) for doc in docs]


def _text(doc: pa.Scalar) -> str | None:
    try:
        return doc.as_py()
    except UnicodeDecodeError:
        return None


# The helper travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def json_cells(doc: Column, rows: Sequence[str | int], paths: Sequence[Sequence[str | int]]) -> Column:
    """The cells, ``_0`` and on, of the records at ``rows`` of a JSON text: ARRAY(STRUCT), NULL where a text isn't plain.

    Cells are those of ``json_cell`` and ``nested_text``. Texts that Python might read otherwise than VARIANT stay
    NULL and are left to those. Declared non-deterministic so that a text is read once.
    """
    kind = f"array<struct<{','.join(f'_{i}:string' for i in range(len(paths)))}>>"
    return F.arrow_udf(_reader(tuple(rows), [tuple(p) for p in paths]), kind).asNondeterministic()(doc)
