"""The small JSON path grammar, and reading values and records out of parsed JSON (VARIANT)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..fixed import RESERVED_PATH_NAMES
from .text import bind, let

_NAME = r"[\p{L}_][\p{L}\p{N}_-]*"
GRAMMAR = rf"^(?:{_NAME}|\[\d+\])(?:\.{_NAME}|\[\d+\])*$"
MAX_PATH_CHARS = 300
MAX_PATH_STEPS = 32


class JsonPathError(ValueError):
    """The path is malformed or uses an unsupported form."""


def path_steps(path: str) -> list[str | int]:
    """Names and array positions of a path; ``""`` and ``$`` mean the value itself."""
    text = path.strip()
    if text in ("", "$"):
        return []
    if len(text) > MAX_PATH_CHARS or (text[0] == "$" and text[1] not in ".["):
        raise JsonPathError(path)
    if text[0] == "$":
        text = text[2:] if text[1] == "." else text[1:]
    if not regex.match(GRAMMAR, text):
        raise JsonPathError(path)
    steps = [int(n) if n else name for name, n in regex.findall(rf"({_NAME})|\[(\d+)\]", text)]
    if len(steps) > MAX_PATH_STEPS or any(s in RESERVED_PATH_NAMES for s in steps):
        raise JsonPathError(path)
    return steps


def is_valid_path(path: str) -> bool:
    try:
        path_steps(path)
        return True
    except JsonPathError:
        return False


def spark_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def normalize_path(c: Column) -> Column:
    """Canonical ``$.a.b[0]`` of a path column; NULL when the path is not allowed."""
    text = F.trim(c)
    body = F.regexp_replace(F.regexp_replace(text, r"^\$", ""), r"^\.", "")
    tail = F.when(text.startswith("$"), body).otherwise(text)
    steps = F.regexp_extract_all(tail, F.lit(rf"{_NAME}|\[\d+\]"), 0)
    ok = (
        ~text.rlike(r"^\$[^.\[]")
        & (F.length(text) <= MAX_PATH_CHARS)
        & tail.rlike(GRAMMAR)
        & (F.size(steps) <= MAX_PATH_STEPS)
        & ~F.arrays_overlap(steps, F.array(*[F.lit(n) for n in RESERVED_PATH_NAMES]))
    )
    joined = F.array_join(F.transform(steps, lambda s: F.when(s.startswith("["), s).otherwise(F.concat(F.lit("."), s))), "")
    return F.when(text.isin("", "$"), F.lit("$")).when(ok, F.concat(F.lit("$"), joined))


# Numbers so short that a double has all their digits: they are printed without the zeros at the end.
_SHORT_NUMBER = r"^(?!-0\.0+$)-?\d{1,9}\.\d{1,6}$"


def number_text(c: Column) -> Column:
    """A JSON number literal the way a browser prints it (1.0 is 1, 1.5E-7 is 1.5e-7)."""
    d = c.try_cast("double")
    size = F.abs(d)
    plain = F.regexp_replace(F.regexp_replace(d.cast("string").try_cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    text = d.cast("string")
    exponent = F.concat(
        F.regexp_replace(F.regexp_extract(text, r"^([^E]*)E", 1), r"\.0$", ""),
        F.lit("e"),
        F.when(text.contains("E-"), "-").otherwise("+"),
        F.regexp_extract(text, r"E-?(\d+)$", 1),
    )
    return (
        F.when(c == "-0", "0")
        .when(c.rlike(r"^-?\d+$"), c)
        .when(c.rlike(_SHORT_NUMBER), F.rtrim(F.rtrim(c, F.lit("0")), F.lit(".")))
        .when(d == 0, "0")
        .when((size < 1e-6) | (size >= 1e21), exponent)
        .otherwise(plain)
    )


# Numbers whose spelling may differ from the printed form: a fraction, an exponent or -0.
_ODD_NUMBER = r"^-?\d+(\.\d+([eE][+-]?\d+)?|[eE][+-]?\d+)$|^-0$"
# Texts whose kind must be known before they are a cell.
_UNSURE = rf"^[\[{{]|{_ODD_NUMBER}"
# Stand for a backslash and a quote that are escaped within a JSON string: no text has these code points.
_BACKSLASH, _QUOTE = "\ufdd0", "\ufdd1"


def parsed(df: DataFrame, doc: str = "doc", name: str = "parsed") -> DataFrame:
    """Adds the VARIANT of a JSON text, NULL where it is malformed. With duplicate names the last one wins.

    The generator keeps the optimizer from parsing once more for every filter and projection above.
    """
    return df.select("*", F.explode_outer(F.array(F.try_parse_json(doc))).alias(name))


def _cut(path: Column) -> Column:
    """The steps of a normalized path: ``.name`` and ``[position]``."""
    return F.regexp_extract_all(path, F.lit(r"\.[^.\[]+|\[\d+\]"), 0)


class JsonPlace:
    """A place in JSON, read from VARIANT by ``get`` and ``text``; ``steps`` lead there in JSON text.

    A position may also be the name of an object's member, and ``length`` behind an array is its size.
    """

    def __init__(self, steps: Column, read: Callable[[Column, str], Column], parent: JsonPlace | None):
        self.steps, self.get, self.parent = steps, read, parent
        # the steps, where they are known before the job
        self.names: list[str | int] | None = None

    @classmethod
    def of(cls, path: str) -> JsonPlace:
        return cls._fixed(path_steps(path))

    @classmethod
    def _fixed(cls, steps: list[str | int]) -> JsonPlace:
        positions = [i for i, s in enumerate(steps) if isinstance(s, int)]
        # a value is an array or an object, so one of the ways at most leads somewhere
        ways = [spark_path(list(way)) for way in product(*[(s, str(s)) if isinstance(s, int) else (s,) for s in steps])] if len(positions) <= 3 else []

        def read(value: Column, kind: str = "variant") -> Column:
            if ways:
                return F.coalesce(*[F.try_variant_get(value, way, kind) for way in ways])
            done = 0
            for i in positions:
                found = F.try_variant_get(value, spark_path(steps[done:i]), "variant") if i > done else value
                value, done = let(found, lambda v, s=steps[i]: _member_or_element(v, F.lit(f"[{s}]"))), i + 1
            return F.try_variant_get(value, spark_path(steps[done:]), kind)

        written = F.array(*[F.lit(f"[{s}]" if isinstance(s, int) else f".{s}") for s in steps]).cast("array<string>")
        place = cls(written, read, cls._fixed(steps[:-1]) if steps and steps[-1] == "length" else None)
        place.names = steps
        return place

    @classmethod
    def at(cls, path: Column) -> JsonPlace:
        """For a path column as ``normalize_path`` gives it."""

        def reader(path: Column) -> Callable[[Column, str], Column]:
            steps = _cut(path)
            by_step = lambda value: F.aggregate(steps, value, _member_or_element)
            return lambda value, kind="variant": F.when(path.contains("["), F.try_variant_get(by_step(value), "$", kind)).otherwise(
                F.try_variant_get(value, path, kind)
            )

        above = F.when(path.endswith(".length"), F.regexp_replace(path, r"\.length$", ""))
        return cls(_cut(path), reader(path), cls(_cut(above), reader(above), None))

    def text(self, value: Column) -> Column:
        found = self.get(value, "string")
        return found if self.parent is None else F.coalesce(found, F.size(self.parent.get(value, "array<variant>")).cast("string"))


def _member_or_element(value: Column, step: Column) -> Column:
    """One step of a path, ``.name`` or ``[position]``."""
    found = F.try_variant_get(value, F.concat(F.lit("$"), step), "variant")
    return F.coalesce(found, F.when(step.startswith("["), F.try_variant_get(value, F.regexp_replace(step, r"\[(\d+)\]", r"\$['$1']"), "variant")))


def unsure(text: Column) -> Column:
    """Whether the kind of a value must be known before its text is a cell."""
    return text.rlike(_UNSURE)


def cell_of(text: Column, json: Column) -> tuple[Column, Column]:
    """(text, nested) of a cell from its text and, where that is ``unsure``, its ``to_json``; see ``json_cell``."""
    container = json.rlike(r"^[\[{]")
    # only members of one object can be out of order
    nested = container & json.contains("{") & json.contains(",")
    return F.when(json.startswith('"'), text).when(nested, json).when(container, browser_text(json)).otherwise(number_text(json)), nested


def json_cell(value: Column, place: JsonPlace) -> Column:
    """(text, nested) of what stands at ``place`` in a VARIANT; the text is NULL when it is missing or null.

    Strings are as they are, numbers as a browser prints them, and so are objects and arrays. Those with
    several members are ``nested``, and their text is still that of ``to_json``, with the names in order:
    see ``nested_text``.
    """

    both = lambda text, nested: F.struct(text.alias("text"), nested.alias("nested"))
    return let(place.text(value), lambda text: _typed(text, place.get(value), both))


def _typed(text: Column, value: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then(text, nested)`` of a cell from its text and its VARIANT, which is looked at where the text is ``unsure``."""
    return F.when(unsure(text), bind(F.to_json(value), lambda json: then(*cell_of(text, json)))).otherwise(then(text, F.lit(False)))


def path_plan(paths: Column) -> Column:
    """How an array of paths, as ``normalize_path`` gives them, is read in one go: STRUCT(inner, cells).

    ``inner`` has the containers below a record that any path leads through, each once and behind the one it
    stands in, ``cells`` one entry for each path. An entry is a step from container ``up`` (0 is the record, and n
    the n-th of ``inner``): to member ``name``, or before it to element ``at``. Without a name it is the container
    itself, without ``up`` nothing.
    """
    joined = lambda steps, n: F.array_join(F.slice(steps, 1, n), "")
    above = F.transform(paths, lambda p: let(_cut(p), lambda steps: F.transform(steps, lambda _, n: joined(steps, n))))
    within = F.array_sort(F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.filter(above, lambda a: a.isNotNull())))))

    def entry(path: Column, containers: Column) -> Column:
        def last(steps: Column) -> Column:
            step = F.get(steps, F.size(steps) - 1)
            up = F.when(F.size(steps) <= 0, F.lit(0)).otherwise(F.array_position(containers, joined(steps, F.size(steps) - 1)) - 1)
            return F.struct(
                F.when(path.isNotNull(), up).cast("int").alias("up"),
                F.regexp_replace(step, r"^\.|[\[\]]", "").alias("name"),
                F.when(step.startswith("["), F.regexp_replace(step, r"[\[\]]", "")).try_cast("int").alias("at"),
            )

        return let(_cut(path), last)

    def planned(containers: Column) -> Column:
        inner = F.slice(containers, 2, F.size(containers))
        return F.struct(F.transform(inner, lambda c: entry(c, containers)).alias("inner"), F.transform(paths, lambda p: entry(p, containers)).alias("cells"))

    return let(within, planned)


def plan_cells(value: Column, plan: Column, then: Callable[[Column, Column, Column], Column]) -> Column:
    """``then(k, text, nested)`` for the k-th path of a ``path_plan``, with text and nested as in ``json_cell``.

    A container is opened once, whatever number of paths leads through it, and no path is parsed: one that isn't known
    before the job would be for every cell.
    """
    opened = lambda v: F.struct(
        v.alias("value"), F.try_variant_get(v, "$", "map<string,variant>").alias("members"), F.try_variant_get(v, "$", "array<variant>").alias("elements")
    )
    found = lambda within, e: F.when(e["name"].isNull(), within["value"]).otherwise(
        F.coalesce(F.get(within["elements"], e["at"]), F.try_element_at(within["members"], e["name"]))
    )
    step = lambda containers, e: F.concat(containers, F.array(bind(found(F.get(containers, e["up"]), e), opened)))

    def cell(within: Column, e: Column, k: Column) -> Column:
        size = F.when((e["name"] == "length") & e["at"].isNull(), F.size(within["elements"]).cast("string"))
        text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), size)
        return bind(found(within, e), lambda v: bind(text(v), lambda t: _typed(t, v, lambda *found: then(k, *found))))

    containers = F.aggregate(plan["inner"], F.array(opened(value)), step)
    return bind(containers, lambda c: F.transform(plan["cells"], lambda e, k: cell(F.get(c, e["up"]), e, k)))


def json_records(value: Column, place: JsonPlace) -> Column:
    """The records at ``place`` as an array of VARIANT: array elements, or the one value; none for null."""

    def listed(found: Column) -> Column:
        elements = F.coalesce(F.try_variant_get(found, "$", "array<variant>"), F.array(found))
        return F.when(found.isNull() | F.is_variant_null(found), F.slice(F.array(found), 1, 0)).otherwise(elements)

    return let(place.get(value), listed)


def text_at(json: Column, place: JsonPlace) -> Column:
    """The JSON text at ``place``, members in their original order; of members with one name the last."""

    def member(text: Column, step: Column) -> Column:
        name = F.regexp_replace(step, r"^\.|[\[\]]", "")
        entries = F.map_entries(F.from_json(text, "map<string,string>"))
        named = F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]
        element = F.get(F.from_json(F.when(text.startswith("["), text), "array<string>"), name.try_cast("int"))
        return F.when(step.startswith("["), F.coalesce(element, named)).otherwise(named)

    if place.names is not None and not any(isinstance(name, int) for name in place.names):
        return reduce(lambda text, name: _last_member(text, name), place.names, F.trim(json))
    return F.aggregate(place.steps, F.trim(json), member)


def _last_member(text: Column, name: str) -> Column:
    """The text of the last member of that name; a struct takes the first element of an array, which has no names."""
    return F.from_json(F.when(~text.rlike(r"^\s*\["), text), StructType([StructField(name, StringType())]))[name]


def record_texts(doc: Column, place: JsonPlace) -> Column:
    """The JSON texts of the records at ``place``, members in their original order."""
    return let(text_at(doc, place), lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x)))


def _masked(json: Column) -> Column:
    return F.replace(F.replace(json, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"


# Numbers in a JSON text with a fraction, and those that are more than digits and a short fraction. What stands in
# a string may look like one too.
_DECIMALS = r"(?:^|[:\[,\s])-?\d+\."
_LONG_NUMBERS = r"(?:^|[:\[,\s])(?:-0|-?\d++(?:\.\d++)?[eE]|-?\d{10,}+\.|-?\d++\.\d{7,}+)"
# A string, or a number that is not within one with the zeros at the end of its fraction set aside.
_TRAILING_ZEROS = r'("[^"]*+")|(-?\d++(?:\.\d*[1-9])?)(?:\.?0+)?(?![\d.])'


def browser_text(json: Column) -> Column:
    """A JSON text with its numbers as a browser prints them, and characters instead of escaped pairs."""

    # the patterns have only quantifiers that give nothing back, so long strings need no stack
    def numbers(text: Column) -> Column:
        short = F.regexp_replace(text, _TRAILING_ZEROS, "$1$2")
        tokens = F.regexp_extract_all(text, F.lit(r'"[^"]*+"|-?\d[\d.eE+-]*+|[^"\d-]++|-'), 0)
        spelled = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(_ODD_NUMBER), let(t, number_text)).otherwise(t)), "")
        return F.when(text.rlike(_LONG_NUMBERS), spelled).when(text.rlike(_DECIMALS), short).otherwise(text)

    def characters(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(rf"{_PAIR}|[^\\]++|\\"), 0)
        units = lambda t: F.unhex(F.concat(F.substring(t, 3, 4), F.substring(t, 9, 4)))
        spelled = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^{_PAIR}"), F.decode(units(t), "UTF-16BE")).otherwise(t)), "")
        return F.when(text.rlike(_PAIR), spelled).otherwise(text)

    plain = let(let(_masked(json), numbers), characters)
    plain = F.replace(F.replace(plain, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    return F.when(json.rlike(rf"\d[.eE]|-0|{_PAIR}"), plain).otherwise(json)


def nesting(json: Column) -> Column:
    """How deep the brackets of a JSON text stand in each other."""
    brackets = F.split(F.regexp_replace(F.regexp_replace(_masked(json), '"[^"]*+"', ""), r"[^{}\[\]]++", ""), "")
    deeper = lambda at, c: at + F.when(c.isin("{", "["), 1).when(c == "", 0).otherwise(-1)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda s, c: F.struct(deeper(s["now"], c).alias("now"), F.greatest(s["most"], deeper(s["now"], c)).alias("most"))
    return F.aggregate(brackets, start, step)["most"]


def _members(json: Column) -> Column:
    """Names with their values, and values, of a JSON text: alike for texts that differ in order only."""
    return F.sort_array(F.regexp_extract_all(_masked(json), F.lit(r'"[^"]*+":(?:"[^"]*+"|[^"{\[,}\]]++|[{\[])|"[^"]*+"|[^",:{}\[\]]++'), 0))


def nested_text(json: Column, doc: Column, place: JsonPlace) -> Column:
    """The text of an object or array, from its ``to_json`` and the JSON text that it stands in.

    VARIANT has the right values and no order of members, the text has the order and all duplicates. Where
    both have the same members the text is taken; else there are duplicates, and members are sorted.
    """

    def chosen(sorted_: Column) -> Column:
        # without the blanks between members
        original = browser_text(F.get_json_object(text_at(doc, place), "$"))
        same = lambda o: (F.length(o) == F.length(sorted_)) & (_members(o) == _members(sorted_))
        return let(original, lambda o: F.when(same(o), o).otherwise(sorted_))

    return let(browser_text(json), chosen)
