"""CSS selectors as Spark expressions over a page's node array.

A selector text is read once, when the plan is built, into plain lists; it then becomes either
a specialised predicate (one rule) or a row of a rules table evaluated by one generic
expression (many rules). Both give the nodes in document order.

Supported: type, ``*``, ``#id``, ``.class``, attribute tests (= ~= |= ^= $= *= and ``i``), the
four combinators, comma lists, ``:scope`` (alone or leading), ``:has :not :is :where`` holding
compounds, ``:first-child :last-child :only-child`` and their ``-of-type`` forms, the four
``:nth-`` forms, ``:empty``, ``:root`` and ``:contains``. Anything else raises ``SelectorError``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


class SelectorError(ValueError):
    """The selector is malformed or uses an unsupported form."""


@dataclass
class Test:
    kind: str  # tag, id, class, attr, nth, empty, root, contains, not, is, has
    name: str = ""
    op: str = ""
    value: str = ""
    a: int = 0
    b: int = 0
    groups: list = field(default_factory=list)  # compounds of not/is/has


@dataclass
class Step:
    comb: str  # "" first step, " " descendant, ">" child, "+" next, "~" later sibling
    tests: list


_IDENT = r"(?:-?(?:[_a-zA-Z]|[^\x00-\x7f]|\\.)(?:[\w-]|[^\x00-\x7f]|\\.)*)"
_SIMPLE = re.compile(
    rf"(?P<tag>{_IDENT}|\*)|\#(?P<id>(?:[\w-]|[^\x00-\x7f]|\\.)+)|\.(?P<cls>{_IDENT})"
    rf"|\[\s*(?P<attr>{_IDENT}(?:\:{_IDENT})?)\s*(?:(?P<op>[~|^$*]?=)\s*"
    rf"(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<raw>(?:[\w-]|[^\x00-\x7f]|\\.)+))\s*(?P<flag>[iIsS]?)\s*)?\]"
    rf"|::?(?P<pseudo>[a-zA-Z-]+)(?P<open>\()?"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"^\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*$", re.I)

_FIXED_NTH = {
    "first-child": ("sib", 0, 1),
    "last-child": ("last_sib", 0, 1),
    "first-of-type": ("sib_of_type", 0, 1),
    "last-of-type": ("last_sib_of_type", 0, 1),
}
_NTH_NAMES = {
    "nth-child": "sib",
    "nth-last-child": "last_sib",
    "nth-of-type": "sib_of_type",
    "nth-last-of-type": "last_sib_of_type",
}


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _balanced(text: str, start: int) -> int:
    """Position of the bracket closing the one just before ``start``."""
    depth, quote, i = 1, "", start
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return i
        i += 1
    raise SelectorError(f"unclosed bracket in {text!r}")


def _commas(text: str) -> list[str]:
    parts, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[last:i])
            last = i + 1
    return parts + [text[last:]]


def _pseudo(name: str, arg: str | None, nested: bool) -> list[Test]:
    if arg is None:
        if name in _FIXED_NTH:
            index, a, b = _FIXED_NTH[name]
            return [Test("nth", index, a=a, b=b)]
        if name in ("only-child", "only-of-type"):
            suffix = name[len("only-") :]
            return _pseudo("first-" + suffix, None, nested) + _pseudo("last-" + suffix, None, nested)
        if name in ("empty", "root", "scope"):
            return [Test(name)]
        raise SelectorError(f"unsupported pseudo-class :{name}")
    if name in _NTH_NAMES:
        found = _NTH.match(arg)
        if not found:
            raise SelectorError(f"bad argument of :{name}: {arg!r}")
        if found["word"]:
            a, b = 2, 1 if found["word"].lower() == "odd" else 0
        elif found["only"]:
            a, b = 0, int(found["only"])
        else:
            a = int(found["a"] + "1") if found["a"] in ("", "+", "-") else int(found["a"])
            b = int((found["sign"] or "+") + (found["b"] or "0"))
        return [Test("nth", _NTH_NAMES[name], a=a, b=b)]
    if name == "contains":
        return [Test("contains", value=arg.strip().strip("\"'"))]
    if name in ("not", "is", "where", "matches", "has"):
        if nested:
            raise SelectorError(f":{name} inside another pseudo-class is not supported")
        groups = []
        for part in _commas(arg):
            part, rel = part.strip(), ""
            if name == "has" and part.startswith(">"):
                part, rel = part[1:].strip(), ">"
            steps = _steps(part, nested=True)
            if len(steps) != 1 or any(t.kind == "scope" for t in steps[0].tests):
                raise SelectorError(f":{name} takes compound selectors only: {arg!r}")
            groups.append((rel, steps[0].tests))
        return [Test({"where": "is", "matches": "is"}.get(name, name), groups=groups)]
    raise SelectorError(f"unsupported pseudo-class :{name}()")


def _steps(text: str, nested: bool = False) -> list[Step]:
    text = text.strip()
    if not text:
        raise SelectorError("empty selector")
    steps, pos, comb = [], 0, ""
    while True:
        tests = []
        while pos < len(text) and (found := _SIMPLE.match(text, pos)):
            if found["tag"]:
                if tests:
                    raise SelectorError(f"type must come first: {text!r}")
                tests.append(Test("tag", value=_plain(found["tag"]).lower()))
            elif found["id"]:
                tests.append(Test("attr", "id", "=", _plain(found["id"])))
            elif found["cls"]:
                tests.append(Test("class", value=_plain(found["cls"])))
            elif found["attr"]:
                value = next((v for v in (found["dq"], found["sq"], found["raw"]) if v is not None), "")
                op = found["op"] or ""
                if (found["flag"] or "").lower() == "i":
                    op, value = op + "i", value.lower()
                tests.append(Test("attr", _plain(found["attr"]).lower(), op, _plain(value)))
            else:
                arg, end = None, found.end()
                if found["open"]:
                    close = _balanced(text, end)
                    arg, end = text[end:close], close + 1
                tests += _pseudo(found["pseudo"].lower(), arg, nested)
                pos = end
                continue
            pos = found.end()
        if not tests:
            raise SelectorError(f"not a supported selector: {text!r}")
        steps.append(Step(comb, tests))
        if pos >= len(text):
            break
        link = _COMBINATOR.match(text, pos)
        if not link:
            raise SelectorError(f"not a supported selector: {text!r}")
        comb, pos = link.group(1) or " ", link.end()
    for i, step in enumerate(steps):
        scoped = [t for t in step.tests if t.kind == "scope"]
        if scoped and (i or len(step.tests) > 1):
            raise SelectorError(":scope must stand alone or come first")
    return steps


def parse_selector(text: str) -> list[list[Step]]:
    """Comma branches, each a list of steps from left to right."""
    return [_steps(part) for part in _commas(text)]


def is_valid_selector(text: str) -> bool:
    try:
        parse_selector(text)
        return True
    except SelectorError:
        return False


# --- predicates of one node ---------------------------------------------------------------


def is_element(n: Column) -> Column:
    return ~n["tag"].startswith("#")


def descendants(nodes: Column, n: Column) -> Column:
    """The subtree below ``n``: a contiguous slice of the page's array."""
    return F.slice(nodes, n["pre"] + 2, n["n_desc"])


def subtree_text(nodes: Column, n: Column) -> Column:
    """Concatenated text runs below ``n``."""
    return F.array_join(F.transform(descendants(nodes, n), lambda d: d["text"]), "")


def _attr(n: Column, name) -> Column:
    return F.try_element_at(n["attrs"], F.lit(name) if isinstance(name, str) else name)


def _position(n: Column, index: str) -> Column:
    if index.startswith("last_"):
        own = index[len("last_") :]
        return n["n_" + own] - n[own] + 1
    return n[index]


def _nth(at: Column, a: int, b: int) -> Column:
    if a == 0:
        return at == b
    return ((at - b) % a == 0) & (((at - b) / a) >= 0)


def _attr_test(value: Column, op: str, wanted: str) -> Column:
    if op.endswith("i"):
        value, op = F.lower(value), op[:-1]
    if op == "":
        return value.isNotNull()
    if op == "=":
        test = value == wanted
    elif not wanted:
        test = F.lit(False)
    elif op == "~=":
        test = F.array_contains(F.split(value, r"[ \t\n\f\r]+"), wanted)
    elif op == "|=":
        test = (value == wanted) | value.startswith(wanted + "-")
    else:
        test = {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[op](wanted)
    return F.coalesce(test, F.lit(False))


def _test(nodes: Column, n: Column, t: Test) -> Column:
    if t.kind == "tag":
        return F.lit(True) if t.value == "*" else n["tag"] == t.value
    if t.kind == "class":
        return F.array_contains(n["classes"], t.value)
    if t.kind == "attr":
        return _attr_test(_attr(n, t.name), t.op, t.value)
    if t.kind == "nth":
        return _nth(_position(n, t.name), t.a, t.b)
    if t.kind == "empty":
        return n["n_desc"] == 0
    if t.kind == "root":
        return n["parent"] == 0
    if t.kind == "contains":
        return subtree_text(nodes, n).contains(t.value)
    if t.kind == "has":
        return F.exists(
            descendants(nodes, n),
            lambda d: is_element(d)
            & _any(
                [
                    _all(nodes, d, tests) & ((d["parent"] == n["pre"]) if rel == ">" else F.lit(True))
                    for rel, tests in t.groups
                ]
            ),
        )
    inner = _any([_all(nodes, n, tests) for _, tests in t.groups])
    return ~inner if t.kind == "not" else inner


def _all(nodes: Column, n: Column, tests: list[Test]) -> Column:
    result = None
    for t in tests:
        one = _test(nodes, n, t)
        result = one if result is None else result & one
    return result


def _any(columns: list[Column]) -> Column:
    result = columns[0]
    for c in columns[1:]:
        result = result | c
    return result


def _flag(flags: Column, at: Column) -> Column:
    return F.coalesce(F.get(flags, at), F.lit(False))


def _related(nodes: Column, n: Column, flags: Column, comb: str) -> Column:
    """Whether the node on the left of the combinator is flagged."""
    if comb == " ":
        return F.exists(n["path"], lambda p: _flag(flags, p))
    if comb == ">":
        return _flag(flags, n["parent"])
    if comb == "+":
        return (n["prev"] >= 0) & _flag(flags, F.greatest(n["prev"], F.lit(0)))
    return (n["prev"] >= 0) & F.exists(
        F.slice(nodes, n["parent"] + 2, F.greatest(n["pre"] - n["parent"] - 1, F.lit(0))),
        lambda m: (m["parent"] == n["parent"]) & _flag(flags, m["pre"]),
    )


# --- one rule: specialised expressions ----------------------------------------------------


def _with_chain(nodes: Column, steps: list[Step], scope: Column | None, then) -> Column:
    """Calls ``then(predicate)`` with the predicate of a branch, binding inner flags once."""

    def after(flags, comb, rest):
        step, more = rest[0], rest[1:]

        def holds(n: Column) -> Column:
            here = is_element(n) & _all(nodes, n, step.tests)
            return here if flags is None else here & _related(nodes, n, flags, comb)

        if not more:
            return then(holds)
        return let(F.transform(nodes, lambda n: holds(n)), lambda f: after(f, more[0].comb, more))

    if steps[0].tests[0].kind == "scope":
        flags = F.transform(nodes, lambda n: n["pre"] == (scope["pre"] if scope is not None else F.lit(0)))
        if len(steps) == 1:
            return then(lambda n: n["pre"] == (scope["pre"] if scope is not None else F.lit(0)))
        return let(flags, lambda f: after(f, steps[1].comb, steps[1:]))
    return after(None, "", steps)


def select(nodes: Column, selector: str, scope: Column | None = None) -> Column:
    """All nodes of the page that match ``selector``, in document order."""
    branches = parse_selector(selector)

    def chained(done, rest):
        if not rest:
            return F.filter(nodes, lambda n: _any([p(n) for p in done]))
        return _with_chain(nodes, rest[0], scope, lambda p: chained(done + [p], rest[1:]))

    return chained([], branches)


def is_scoped(selector: str) -> bool:
    """True when the selector has to be evaluated once per container."""
    return any(branch[0].tests[0].kind == "scope" for branch in parse_selector(selector))


def first(nodes: Column, selector: str) -> Column:
    return F.get(select(nodes, selector), F.lit(0))


def present(nodes: Column, selector: str) -> Column:
    return F.size(select(nodes, selector)) > 0


# --- many rules: selectors as data --------------------------------------------------------

_SIMPLE_TYPE = "kind:string,name:string,op:string,value:string,a:int,b:int"
_TEST_TYPE = (
    f"struct<{_SIMPLE_TYPE},"
    f"groups:array<struct<rel:string,tests:array<struct<{_SIMPLE_TYPE}>>>>>"
)
BRANCHES = f"array<array<struct<comb:string,anchor:struct<kind:string,name:string,value:string>,tests:array<{_TEST_TYPE}>>>>"


def _anchor(tests: list[Test]) -> tuple[str, str, str]:
    """The test to look nodes up by."""
    wanted = [
        lambda t: t.kind == "attr" and t.op == "=" and t.name == "id",
        lambda t: t.kind == "class",
        lambda t: t.kind == "attr" and t.op == "=",
        lambda t: t.kind == "tag" and t.value != "*",
    ]
    for fits in wanted:
        for t in tests:
            if fits(t):
                return t.kind, t.name, t.value
    return "any", "", ""


def selector_rows(selector: str) -> list:
    """The parsed selector as nested tuples of type BRANCHES; an empty text gives no branch."""
    if not selector.strip():
        return []

    def simple(t: Test):
        return (t.kind, t.name, t.op, t.value, t.a, t.b)

    return [
        [
            (step.comb, _anchor(step.tests), [(*simple(t), [(rel, [simple(x) for x in tests]) for rel, tests in t.groups]) for t in step.tests])
            for step in branch
        ]
        for branch in parse_selector(selector)
    ]


def _data_simple(nodes: Column, n: Column, t: Column) -> Column:
    """One test held in a table; the same meaning as ``_test``."""
    value = _attr(n, F.when(t["kind"] == "attr", t["name"]).otherwise(""))
    lowered = F.when(t["op"].endswith("i"), F.lower(value)).otherwise(value)
    op = F.regexp_replace(t["op"], "i$", "")
    given = t["value"] != ""
    attr = (
        F.when(op == "", value.isNotNull())
        .when(op == "=", lowered == t["value"])
        .when(op == "~=", given & F.array_contains(F.split(lowered, r"[ \t\n\f\r]+"), t["value"]))
        .when(op == "|=", given & ((lowered == t["value"]) | lowered.startswith(F.concat(t["value"], F.lit("-")))))
        .when(op == "^=", given & lowered.startswith(t["value"]))
        .when(op == "$=", given & lowered.endswith(t["value"]))
        .otherwise(given & lowered.contains(t["value"]))
    )
    at = (
        F.when(t["name"] == "sib", _position(n, "sib"))
        .when(t["name"] == "last_sib", _position(n, "last_sib"))
        .when(t["name"] == "sib_of_type", _position(n, "sib_of_type"))
        .otherwise(_position(n, "last_sib_of_type"))
    )
    nth = F.when(t["a"] == 0, at == t["b"]).otherwise(
        (F.try_mod(at - t["b"], t["a"]) == 0) & (F.try_divide(at - t["b"], t["a"]) >= 0)
    )
    return F.coalesce(
        F.when(t["kind"] == "tag", (t["value"] == "*") | (n["tag"] == t["value"]))
        .when(t["kind"] == "class", F.array_contains(n["classes"], t["value"]))
        .when(t["kind"] == "attr", attr)
        .when(t["kind"] == "nth", nth)
        .when(t["kind"] == "empty", n["n_desc"] == 0)
        .when(t["kind"] == "root", n["parent"] == 0)
        .when(t["kind"] == "contains", subtree_text(nodes, n).contains(t["value"])),
        F.lit(False),
    )


def _data_test(nodes: Column, n: Column, t: Column) -> Column:
    def inside(m: Column, direct) -> Column:
        return F.exists(
            t["groups"],
            lambda g: direct(g) & F.forall(g["tests"], lambda x: _data_simple(nodes, m, x)),
        )

    own = inside(n, lambda g: F.lit(True))
    return (
        F.when(~t["kind"].isin("not", "is", "has"), _data_simple(nodes, n, t))
        .when(t["kind"] == "not", ~own)
        .when(t["kind"] == "is", own)
        .when(
            t["kind"] == "has",
            F.exists(
                descendants(nodes, n),
                lambda d: is_element(d) & inside(d, lambda g: (g["rel"] == "") | (d["parent"] == n["pre"])),
            ),
        )
    )


def _anchored(nodes: Column, step: Column) -> Column:
    """The elements that pass the step's most telling test: its id, else a class, else its tag.

    One comparison per node, so that all other tests only see what is left.
    """
    by = step["anchor"]
    return (
        F.when(by["kind"] == "tag", F.filter(nodes, lambda n: n["tag"] == by["value"]))
        .when(by["kind"] == "class", F.filter(nodes, lambda n: F.array_contains(n["classes"], by["value"])))
        .when(by["kind"] == "attr", F.filter(nodes, lambda n: is_element(n) & (_attr(n, by["name"]) == by["value"])))
        .otherwise(F.filter(nodes, is_element))
    )


def select_by(nodes: Column, branches: Column, scope: Column | None = None) -> Column:
    """Nodes that match a selector held in a column of type BRANCHES, in document order.

    Each step is looked for among the nodes of its anchor, and linked to the places that the step before
    it has found.
    """
    scope_pre = scope["pre"] if scope is not None else F.lit(0)

    def follow(found: Column, step: Column) -> Column:
        def linked(n: Column) -> Column:
            comb = step["comb"]
            return (
                F.when(comb == "", F.lit(True))
                .when(comb == " ", F.arrays_overlap(n["path"], found))
                .when(comb == ">", F.array_contains(found, n["parent"]))
                .when(comb == "+", F.array_contains(found, n["prev"]))
                .otherwise(F.exists(found, lambda m: (m < n["pre"]) & (F.get(nodes, m)["parent"] == n["parent"])))
            )

        held = F.filter(_anchored(nodes, step), lambda n: linked(n) & F.forall(step["tests"], lambda t: _data_test(nodes, n, t)))
        scoped = F.exists(step["tests"], lambda t: t["kind"] == "scope")
        return F.when(scoped, F.array(scope_pre)).otherwise(F.transform(held, lambda n: n["pre"]))

    places = F.transform(branches, lambda steps: F.aggregate(steps, F.array().cast("array<int>"), follow))
    one = F.when(F.size(branches) == 1, F.get(places, F.lit(0))).otherwise(F.array_sort(F.array_distinct(F.flatten(places))))
    return F.transform(one, lambda p: F.get(nodes, p))
