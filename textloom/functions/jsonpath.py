"""JSONPath: names, quoted names, indexes, slices, wildcards and recursive descent.

A path is compiled when the plan is built. Names, indexes and slices become expressions over VARIANT. The members of an object keep
the order of the text only outside of VARIANT, so paths that run over members (``.*``, ``..``) are walked by a small
function over Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F

_NAME = r"[^\W\d][\w-]*"
_STEP = re.compile(
    rf"""(?P<deep>\.\.)?(?:(?P<dot>\.)?(?:(?P<name>{_NAME})|(?P<any>\*)|(?P<quoted>'[^']*'|"[^"]*"))
    |\.?\[\s*(?:(?P<index>-?\d+)|(?P<each>\*)|(?P<slice>-?\d*\s*:\s*-?\d*(?:\s*:\s*-?\d*)?)
    |(?P<names>(?:'[^']*'|"[^"]*"|{_NAME})(?:\s*,\s*(?:'[^']*'|"[^"]*"|{_NAME}))*))\s*\])""",
    re.VERBOSE,
)

#: A step: ("names", (a, b)), ("members", ()), ("index", n), ("slice", (start, stop, step)), ("deep", ()).
Step = tuple[str, Any]


def parse(path: str) -> list[Step]:
    """Steps of a path; filters, functions and anything else are refused."""
    text = path.strip()
    at = 1 if text.startswith("$") else 0
    steps: list[Step] = []
    while at < len(text):
        found = _STEP.match(text, at)
        plain = found and (found["name"] or found["any"] or found["quoted"])
        if not found or found.end() == at or (plain and not found["dot"] and not found["deep"] and at > 0):
            raise ValueError(f"unsupported path {path}")
        if found["deep"]:
            steps.append(("deep", ()))
        if found["index"]:
            steps.append(("index", int(found["index"])))
        elif found["each"]:
            steps.append(("slice", (None, None, None)))
        elif found["slice"]:
            parts = [int(p) if p.strip() else None for p in found["slice"].split(":")]
            if len(parts) == 3 and parts[2] == 0:
                raise ValueError(f"a slice of step 0 in {path}")
            steps.append(("slice", (*parts, None)[:3]))
        elif found["any"]:
            steps.append(("members", ()))
        else:
            listed = found["names"] or found["name"] or found["quoted"]
            names = re.findall(rf"""'[^']*'|"[^"]*"|{_NAME}""", listed)
            steps.append(("names", tuple(n[1:-1] if n[0] in "'\"" else n for n in names)))
        at = found.end()
    return steps


def _children(value: Any, step: Step) -> Iterator[tuple[Any, Any]]:
    """(container, key) of what a step finds below a value."""
    kind, what = step
    if kind == "names" and isinstance(value, dict):
        yield from ((value, name) for name in what if name in value)
    elif kind == "members" and isinstance(value, dict):
        yield from ((value, name) for name in value)
    elif kind == "index" and isinstance(value, list) and -len(value) <= what < len(value):
        yield value, what % len(value)
    elif kind == "slice":
        held = value if isinstance(value, list) else [value]
        yield from ((held, i) for i in range(*slice(*what).indices(len(held))))


def find(value: Any, steps: list[Step]) -> Iterator[tuple[Any, Any]]:
    """(container, key) of every match, in the order of the text; what lies higher comes before what lies below it."""
    if not steps:
        return
    # An explicit stack, so deep documents need no recursion: values to be walked with the number of a step, or matches.
    stack: list[tuple[str, Any, Any]] = [("walk", value, 0)]
    while stack:
        kind, held, at = stack.pop()
        if kind == "match":
            yield held, at
            continue
        step = steps[at]
        if step[0] == "deep":
            below = ("members", ()) if isinstance(held, dict) else ("slice", (None, None, None))
            inner = list(_children(held, below)) if isinstance(held, (dict, list)) else []
            stack += [("walk", box[key], at) for box, key in reversed(inner)]
            stack.append(("walk", held, at + 1))
            continue
        places = list(_children(held, step))
        if at + 1 == len(steps):
            stack += [("match", box, key) for box, key in reversed(places)]
        else:
            stack += [("walk", box[key], at + 1) for box, key in reversed(places)]


def ordered(steps: list[Step]) -> bool:
    """Whether matches depend on the order of members."""
    return any(kind in ("members", "deep") for kind, _ in steps)


def _plain(step: Step) -> str | None:
    """A step as part of a VARIANT path, if it is one name or one index from the start."""
    kind, what = step
    if kind == "index" and what >= 0:
        return f"[{what}]"
    if kind == "names" and len(what) == 1 and not ("'" in what[0] and '"' in what[0]):
        return f"['{what[0]}']" if "'" not in what[0] else f'["{what[0]}"]'
    return None


def _listed(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _sliced(items: Column, start: int | None, stop: int | None, step: int | None) -> Column:
    size, step = F.size(items), step or 1

    def place(n: int) -> Column:
        return F.lit(n) if n >= 0 else size + n

    if step > 0:
        first = F.lit(0) if start is None else F.greatest(place(start), F.lit(0))
        last = size if stop is None else place(stop)
        return F.filter(items, lambda _, i: (i >= first) & (i < last) & ((i - first) % step == 0))
    first = size - 1 if start is None else F.least(place(start), size - 1)
    last = F.lit(-1) if stop is None else F.greatest(place(stop), F.lit(-1))
    return F.reverse(F.filter(items, lambda _, i: (i <= first) & (i > last) & ((first - i) % -step == 0)))


def _found(value: Column, steps: list[Step]) -> Column:
    """``array<variant>`` of all matches below a value."""
    path, at = "$", 0
    while at < len(steps) and (part := _plain(steps[at])):
        path, at = path + part, at + 1
    here = value if at == 0 else F.try_variant_get(value, path, "variant")
    if at == len(steps):
        return F.filter(F.array(here), lambda v: v.isNotNull())
    kind, what = steps[at]
    if kind == "slice":
        whole = F.coalesce(_listed(here), F.filter(F.array(here), lambda v: v.isNotNull()))
        inner = _sliced(whole, *what)
    elif kind == "index":
        inner = F.filter(F.array(F.get(_listed(here), F.size(_listed(here)) + what)), lambda v: v.isNotNull())
    else:
        inner = F.filter(F.array(*(_one(here, name) for name in what)), lambda v: v.isNotNull())
    return inner if at + 1 == len(steps) else F.flatten(F.transform(inner, lambda v: _found(v, steps[at + 1 :])))


def _one(value: Column, name: str) -> Column:
    part = _plain(("names", (name,)))
    if part is None:
        raise ValueError(f"a name with both quotes: {name}")
    return F.try_variant_get(value, "$" + part, "variant")


def first_match(text: Column, path: str) -> Column:
    """The first match of a path in a JSON text as VARIANT; NULL where nothing matches or the text is no JSON."""
    steps = parse(path)
    if not ordered(steps):
        return F.get(_found(F.try_parse_json(text), steps), F.lit(0))

    @F.pandas_udf("string")
    def walked(texts: pd.Series) -> pd.Series:
        def one(body: str | None) -> str | None:
            try:
                box, key = next(find(json.loads(body), steps))
            except (StopIteration, TypeError, ValueError, RecursionError):
                return None
            return json.dumps(box[key], ensure_ascii=False)

        return texts.map(one).astype(object)

    return F.try_parse_json(walked(text))
