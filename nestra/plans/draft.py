"""Recorded projections over nested rows: a callback says what is wanted, the plan reads only that.

`draft(df, fn)` calls fn once with a recorder of the row. Struct fields are
attributes; a list has map, filter, slice and reduce. What the callbacks touch
of structs in a list is recorded first, and lists are then rebuilt from only
those leaves, so that the scan reads no other field of the list's elements (a
lambda over the whole element would read them all).

A filter keeps the elements whose answer is true by the scripting rule, whatever
its type; the type is that of the callback's answer over typed nulls. An answer
that also uses what lies outside of the list must be a boolean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from weakref import WeakKeyDictionary

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from nestra.functions.scalars import truthy


class _Touched(Exception):
    """A whole element is used, not only fields of it."""


class _Spy:
    """Stands for an element while its used fields are recorded; each field is a typed null."""

    def __init__(self, kind: T.StructType, used: dict[str, None]):
        object.__setattr__(self, "_kind", kind)
        object.__setattr__(self, "_used", used)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._kind.names:
            raise AttributeError(f"no field {name!r}; there are {self._kind.names}")
        self._used[name] = None
        return wrap(F.lit(None).cast(self._kind[name].dataType), self._kind[name].dataType)

    __getitem__ = __getattr__


class Struct:
    """A struct value; fields are attributes, or items if their names are taken."""

    def __init__(self, column: Column | None, kind: T.StructType, single: str | None = None):
        self.__dict__.update(_column=column, _kind=kind, _single=single)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._kind.names:
            raise AttributeError(f"no field {name!r}; there are {self._kind.names}")
        kind = self._kind[name].dataType
        if self._single == name:
            return wrap(self._column, kind)
        return wrap(F.col(f"`{name}`") if self._column is None else self._column[name], kind)

    __getitem__ = __getattr__

    def __contains__(self, name: str) -> bool:
        return name in self._kind.names

    def __iter__(self):
        return iter(self._kind.names)


@dataclass(frozen=True)
class List:
    """A list with steps to apply, in the order in which they are written; its elements may be structs, lists or plain values."""

    column: Column
    kind: T.DataType
    steps: tuple[tuple, ...] = ()

    def map(self, fn: Callable) -> List:
        return replace(self, steps=(*self.steps, ("map", fn)))

    def filter(self, fn: Callable) -> List:
        return replace(self, steps=(*self.steps, ("filter", fn)))

    def slice(self, start: int = 0, end: int | None = None) -> List:
        last = self.steps[-1] if self.steps else None
        if last and last[0] == "slice" and start >= 0 and last[1] >= 0 and (end is None or end >= 0) and (last[2] is None or last[2] >= 0):
            low = last[1] + start  # slices of slices are one
            high = min((x for x in (last[2], None if end is None else last[1] + end) if x is not None), default=None)
            return replace(self, steps=(*self.steps[:-1], ("slice", low, high)))
        return replace(self, steps=(*self.steps, ("slice", start, end)))

    def reduce(self, fn: Callable, initial) -> Column:
        """fn(accumulator, element) from `initial`: a value, or a dict as an accumulator of several fields."""
        start = output(initial)
        array, element = self._lowered(extra=lambda x: fn(_Accumulator(start, initial), x))
        return F.aggregate(array, start, lambda acc, x: output(fn(_Accumulator(acc, initial), element(x))))

    def size(self) -> Column:
        return F.size(self.lower())

    def at(self, place: int):
        """The element at a place from 0; null if there is none."""
        if any(step[0] == "map" for step in self.steps):
            return F.get(self.lower(), F.lit(place))
        return wrap(F.get(self.lower(), F.lit(place)), self.kind)

    def lower(self) -> Column:
        return self._lowered()[0]

    def _lowered(self, extra: Callable | None = None) -> tuple[Column, Callable]:
        used: dict[str, None] = {}
        structs = isinstance(self.kind, T.StructType)
        spy = _Spy(self.kind, used) if structs else wrap(F.lit(None).cast(self.kind), self.kind)
        mapped, kinds = False, []
        for step in self.steps:
            kinds.append(None)
            if step[0] != "slice" and not mapped:
                answer = step[1](spy)
                mapped = step[0] == "map"
                kinds[-1] = None if mapped else _kind_of(answer)
        if extra and not mapped:
            extra(spy)
        whole = not mapped and not extra  # elements come out as they are
        if whole or not used:
            array, element = self.column, lambda x: wrap(x, self.kind)
        elif len(used) == 1:
            name = next(iter(used))
            array, element = self.column[name], lambda x: Struct(x, self.kind, single=name)
        else:
            array = F.arrays_zip(*[self.column[n].alias(n) for n in used])
            element = lambda x: Struct(x, self.kind)
        for step, kind in zip(self.steps, kinds, strict=True):
            if step[0] == "filter":
                array = F.filter(array, _of_element(step[1], element, lambda v, kind=kind: _test(v, kind)))
            elif step[0] == "map":
                array = F.transform(array, _of_element(step[1], element, output))
                element = _Plain
            else:
                array = _sliced(array, *step[1:])
        return array, element


def _kind_of(value) -> T.DataType | None:
    """The type of a callback's answer over typed nulls; None where it also uses other columns."""
    if not isinstance(value, Column):
        return None
    try:
        return SparkSession.active().range(0).select(value.alias("x")).schema["x"].dataType
    except AnalysisException:
        return None


def _Plain(x: Column):
    return x


def _of_element(fn: Callable, element: Callable, finish: Callable) -> Callable:
    return lambda x: finish(fn(element(x)))


class _Accumulator:
    """The accumulator of a fold: a column itself, or fields if the first value was a dict."""

    def __new__(cls, column: Column, initial):
        if not isinstance(initial, dict):
            return column
        self = super().__new__(cls)
        self.__dict__["_column"] = column
        return self

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self._column[name]

    __getitem__ = __getattr__


def is_true(value, kind: str) -> Column:
    return truthy(value, T._parse_datatype_string(kind))


def _test(value, kind: T.DataType | None) -> Column:
    if isinstance(value, (List, Struct)):
        return output(value).isNotNull()
    if not isinstance(value, Column):
        return F.lit(bool(value))
    return truthy(value, kind or T.BooleanType())


def _sliced(array: Column, start: int, end: int | None) -> Column:
    size = F.size(array)
    low = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    high = size if end is None else F.lit(end) if end >= 0 else size + end
    return F.slice(array, low + 1, F.greatest(F.least(high, size) - low, F.lit(0)))


def wrap(column: Column, kind: T.DataType):
    if isinstance(kind, T.StructType):
        return Struct(column, kind)
    if isinstance(kind, T.ArrayType):
        return List(column, kind.elementType)
    return column


def output(value) -> Column:
    """A callback's answer as a column: dicts are structs, lists are arrays."""
    if isinstance(value, List):
        return value.lower()
    if isinstance(value, Struct):
        return value._column
    if isinstance(value, dict):
        return F.struct(*[output(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[output(v) for v in value])
    return value if isinstance(value, Column) else F.lit(value)


def recorded(fn: Callable, kind: T.StructType) -> list[Column]:
    """The columns that fn asks of rows of a kind: a dict gives its columns, anything else one column `value`."""
    answer = fn(Struct(None, kind))
    if isinstance(answer, dict):
        return [output(v).alias(k) for k, v in answer.items()]
    return [output(answer).alias("value")]


def draft(df: DataFrame, fn: Callable) -> DataFrame:
    """df projected by fn(row), called once with a recorder of the row."""
    return df.select(*recorded(fn, df.schema))


_PLANS: WeakKeyDictionary = WeakKeyDictionary()


def planned(df: DataFrame, fn: Callable) -> DataFrame:
    """draft() that records a callback once for each kind of rows; what the callback captures must not change between calls."""
    known = _PLANS.setdefault(fn, {})
    key = df.schema.json()
    if key not in known:
        known[key] = recorded(fn, df.schema)
    return df.select(*known[key])


#: Names that one look-up may ask for.
MOST_NAMES = 256


def by_name(pairs: Column, *names: str, key: str = "key", value: str = "value") -> dict[str, Column]:
    """{name: value} of a list of structs with a key and a value: the first with the name counts, null if there is none."""
    if len(names) > MOST_NAMES:
        raise ValueError(f"at most {MOST_NAMES} names")
    named = lambda name: F.filter(pairs, lambda p: p[key] == name)
    return {n: F.get(named(n), F.lit(0))[value] for n in names}


def preview(array: Column, most: int = 32) -> Column:
    """The first elements of a list as text, and how many more there are."""
    shown, more = F.slice(array, 1, most).cast("array<string>"), F.size(array) - most
    return F.when(more > 0, F.concat(shown, F.array(F.concat(F.lit("("), more.cast("string"), F.lit(" more elided)"))))).otherwise(shown)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named fields, in the order asked for; an unknown one is an error."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no fields {missing}")
    return df.select(*names)


def exploded(df: DataFrame, column: str, position: str = "rn") -> DataFrame:
    """A row for each element of a list of structs, with its place from 1."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("__at", "__x")).select(*rest, (F.col("__at") + 1).alias(position), "__x.*")
