"""What an aggregate is: keys, states, and how states are lifted, merged and finished."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 1 << 32

#: Commutative, associative merges by name; each maps a state column to an aggregate column.
MERGES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
    "set_union": lambda c: F.array_distinct(F.flatten(F.collect_set(c))),
    "hll_union": F.hll_union_agg,
    "theta_union": F.theta_union_agg,
    "kll_merge": F.kll_merge_agg_bigint,
    "uint32_sum": lambda c: F.pmod(F.sum(c), F.lit(UINT32)),
}
#: How rows are folded into a first state, where that is not the merge itself.
FIRST: dict[str, Callable[[Column], Column]] = {
    "set_union": F.collect_set,
    "hll_union": F.hll_sketch_agg,
    "theta_union": F.theta_sketch_agg,
    "kll_merge": F.kll_sketch_agg_bigint,
}


@dataclass(frozen=True)
class StateCol:
    """One state column: ``lift`` is computed from a row, ``merge`` names the fold."""

    name: str
    lift: Column
    merge: str = "sum"

    def first(self) -> Column:
        return FIRST.get(self.merge, MERGES[self.merge])(self.lift).alias(self.name)

    def again(self) -> Column:
        return MERGES[self.merge](F.col(self.name)).alias(self.name)


@dataclass(frozen=True)
class AggSpec:
    """Keys and states of an accumulator.

    ``keys`` maps the name of a key to its expression; an equality coarser than
    that of the values is said here, by a canonical expression such as
    ``lower(k)``.  ``finish`` maps output names to expressions over states,
    applied on reading; without it the states are the output.
    """

    keys: dict[str, Column]
    states: tuple[StateCol, ...]
    finish: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [*self.keys, *(s.name for s in self.states)]
        if not self.keys or not self.states:
            raise ValueError("a spec needs a key and a state")
        if len(set(names)) < len(names):
            raise ValueError(f"names of keys and states repeat: {names}")
        for s in self.states:
            if s.merge not in MERGES:
                raise ValueError(f"no merge called {s.merge!r}; known: {sorted(MERGES)}")


def register_merge(name: str, merge: Callable[[Column], Column], first: Callable[[Column], Column] | None = None) -> None:
    """Make a merge of one's own known by name.

    ``merge`` folds a column of states to one, whatever their type (a struct, or
    bytes in a format of one's own), and must be commutative and associative;
    ``first`` folds what is lifted from rows, where that is not the same.
    """
    if name in MERGES:
        raise ValueError(f"there is a merge called {name!r}")
    MERGES[name] = merge
    if first is not None:
        FIRST[name] = first


_registry: dict[str, AggSpec] = {}


def register(name: str, spec: AggSpec) -> AggSpec:
    """Make a spec known by name, as a plug-in does when it is imported."""
    if name in _registry:
        raise ValueError(f"{name!r} is registered already")
    _registry[name] = spec
    return spec


def registered(name: str) -> AggSpec:
    return _registry[name]


def load(target: str) -> AggSpec:
    """The spec of a plug-in by name, ``module:attribute``; it is registered under that name.

    The attribute is a spec, or a function without arguments that makes one.
    """
    module, _, attribute = target.partition(":")
    if not module or not attribute:
        raise ValueError(f"{target!r} is not of the form module:attribute")
    if target not in _registry:
        found = getattr(import_module(module), attribute)
        made = found if isinstance(found, AggSpec) else found()
        if not isinstance(made, AggSpec):
            raise TypeError(f"{target!r} gives no spec")
        register(target, made)
    return registered(target)


def best_by(name: str, by: Column, value: Column, largest: bool = True) -> StateCol:
    """The value at the largest (or smallest) ``by``, as a struct (by, value); ties go to the largest (smallest) value.

    Rows whose ``by`` is null count as the smallest.
    """
    return StateCol(name, F.struct(by.alias("by"), value.alias("value")), "max" if largest else "min")


def count(name: str = "n") -> StateCol:
    return StateCol(name, F.lit(1).cast("long"))


def exact_sum(column: str, name: str) -> StateCol:
    """Sum of money or quantities as decimals, so that the order of rows does not show."""
    return StateCol(name, F.col(column).cast("decimal(18,2)"))
