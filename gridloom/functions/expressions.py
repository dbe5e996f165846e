"""The equation language: Python expression syntax to trees, trees to columns and derivatives."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EquationError, VariableError
from . import numeric as n


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Op:
    """A function of the table below, applied to trees."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Whole:
    """A reduction over the whole grid of one tree."""

    name: str
    arg: object


@dataclass(frozen=True)
class Guard:
    """A tree that is refused where its condition holds; condition is one of 'zero', 'not positive'."""

    tree: object
    subject: object
    condition: str
    message: str


Tree = Num | Ref | Op | Whole | Guard


def _mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    r = F.try_mod(a, b)
    return F.when(b == 0, n.nan()).otherwise(n.or_nan(F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)))


@dataclass(frozen=True)
class Function:
    arity: int
    column: Callable[..., Column]
    value: Callable[..., float]
    native: bool = True  # has a derivative


#: All elementwise functions; ``value`` is used to see what they make of missing cells.
FUNCTIONS: dict[str, Function] = {
    "+": Function(2, lambda a, b: a + b, np.add),
    "-": Function(2, lambda a, b: a - b, np.subtract),
    "*": Function(2, lambda a, b: a * b, np.multiply),
    "/": Function(2, n.divide, np.divide),
    "**": Function(2, n.power, np.power),
    "neg": Function(1, lambda a: -a, np.negative),
    "sin": Function(1, F.sin, np.sin),
    "cos": Function(1, F.cos, np.cos),
    "tan": Function(1, F.tan, np.tan),
    "asin": Function(1, F.asin, np.arcsin),
    "acos": Function(1, F.acos, np.arccos),
    "atan": Function(1, F.atan, np.arctan),
    "atan2": Function(2, F.atan2, np.arctan2),
    "sqrt": Function(1, F.sqrt, np.sqrt),
    "abs": Function(1, F.abs, np.abs),
    "log": Function(1, n.log, np.log),
    "log10": Function(1, lambda a: n.log(a, F.log10), np.log10),
    "exp": Function(1, F.exp, np.exp),
    "np.minimum": Function(2, lambda a, b: F.when(F.isnan(a) | F.isnan(b), n.nan()).otherwise(F.least(a, b)), np.minimum, False),
    "np.maximum": Function(2, lambda a, b: F.when(F.isnan(a) | F.isnan(b), n.nan()).otherwise(F.greatest(a, b)), np.maximum, False),
    "np.floor": Function(1, lambda a: F.when(n.finite(a), F.floor(a).cast("double")).otherwise(a), np.floor, False),
    "np.ceil": Function(1, lambda a: F.when(n.finite(a), F.ceil(a).cast("double")).otherwise(a), np.ceil, False),
    "np.round": Function(1, F.rint, np.round, False),
    "np.sign": Function(1, F.signum, np.sign, False),
    "np.square": Function(1, lambda a: a * a, np.square, False),
    "np.cbrt": Function(1, F.cbrt, np.cbrt, False),
    "np.hypot": Function(2, F.hypot, np.hypot, False),
    "np.power": Function(2, n.power, np.power, False),
    "np.mod": Function(2, _mod, np.mod, False),
    "np.fmod": Function(2, lambda a, b: F.when(b == 0, n.nan()).otherwise(n.or_nan(F.try_mod(a, b))), np.fmod, False),
    "np.exp2": Function(1, lambda a: F.pow(n.lit(2), a), np.exp2, False),
    "np.log2": Function(1, lambda a: n.log(a, F.log2), np.log2, False),
    "np.log1p": Function(1, lambda a: F.when(F.isnan(a), n.nan()).when(a == -1, n.lit(-n.INF)).when(a < -1, n.nan()).otherwise(F.log1p(a)), np.log1p, False),
    "np.expm1": Function(1, F.expm1, np.expm1, False),
    "np.sinh": Function(1, F.sinh, np.sinh, False),
    "np.cosh": Function(1, F.cosh, np.cosh, False),
    "np.tanh": Function(1, F.tanh, np.tanh, False),
    "np.deg2rad": Function(1, lambda a: a * n.lit(math.pi / 180.0), np.deg2rad, False),
    "np.rad2deg": Function(1, lambda a: a * n.lit(180.0 / math.pi), np.rad2deg, False),
    "np.isnan": Function(1, lambda a: F.isnan(a).cast("double"), lambda a: float(np.isnan(a)), False),
    "np.where": Function(3, lambda c, a, b: F.when(F.isnan(c) | (c != 0), a).otherwise(b), lambda c, a, b: float(np.where(c, a, b)), False),
    "np.clip": Function(3, lambda a, lo, hi: F.when(F.isnan(a), a).otherwise(F.least(F.greatest(a, lo), hi)), np.clip, False),
    "np.nan_to_num": Function(1, lambda a: F.when(F.isnan(a), n.lit(0)).when(a == n.INF, n.lit(np.finfo(float).max)).when(a == -n.INF, n.lit(np.finfo(float).min)).otherwise(a), np.nan_to_num, False),
}
#: numpy names of functions that have a derivative.
ALIASES = {
    "np.sin": "sin", "np.cos": "cos", "np.tan": "tan", "np.arcsin": "asin", "np.arccos": "acos", "np.arctan": "atan", "np.arctan2": "atan2",
    "np.sqrt": "sqrt", "np.abs": "abs", "np.absolute": "abs", "np.log": "log", "np.log10": "log10", "np.exp": "exp",
}
#: Reductions over the whole grid; those named nan... skip missing cells, the others become NaN by them.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop, "median": F.median,
    "nanmax": F.max, "nanmin": F.min, "nanmean": F.avg, "nansum": F.sum,
}
CONSTANTS = {"pi": math.pi, "e": math.e}
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}
_COMPARE = {ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}


def _refuse(text: str, why: str) -> EquationError:
    return EquationError(text, why, "Use numbers, variables, + - * / **, parentheses, and the functions " + ", ".join(k for k in FUNCTIONS if k[0].isalpha() and k != "neg"))


def parse(text: str, variables: frozenset[str] | set[str]) -> Tree:
    """The tree of an expression; names are variables, ``pi`` or ``e``."""
    try:
        body = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise _refuse(text, f"not an expression ({error.msg})") from error

    def walk(x: ast.AST) -> Tree:
        if isinstance(x, ast.Constant) and isinstance(x.value, int | float) and not isinstance(x.value, bool):
            return Num(float(x.value))
        if isinstance(x, ast.Name):
            if x.id in CONSTANTS:
                if x.id in variables:
                    raise _refuse(text, f"{x.id} is both a constant and a variable")
                return Num(CONSTANTS[x.id])
            if x.id not in variables:
                raise VariableError(x.id, f"is not a variable, in {text!r}", "Variables are: " + ", ".join(sorted(variables)))
            return Ref(x.id)
        if isinstance(x, ast.BinOp) and type(x.op) in _BINARY:
            return Op(_BINARY[type(x.op)], (walk(x.left), walk(x.right)))
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.USub | ast.UAdd):
            inner = walk(x.operand)
            return Op("neg", (inner,)) if isinstance(x.op, ast.USub) else inner
        if isinstance(x, ast.Call):
            if x.keywords:
                raise _refuse(text, "keyword arguments")
            if isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Name) and x.func.value.id == "np":
                name = f"np.{x.func.attr}"
            elif isinstance(x.func, ast.Name):
                name = x.func.id
            else:
                raise _refuse(text, "a call of something else than a function name")
            args = tuple(walk(a) for a in x.args)
            if name.startswith("np.") and name[3:] in REDUCTIONS:
                if len(args) != 1:
                    raise _refuse(text, f"{name} takes one argument")
                return Whole(name[3:], args[0])
            name = ALIASES.get(name, name)
            if name not in FUNCTIONS or not (name[0].isalpha()) or name == "neg":
                raise _refuse(text, f"unknown function {name}")
            if len(args) != FUNCTIONS[name].arity:
                raise _refuse(text, f"{name} takes {FUNCTIONS[name].arity} arguments")
            return Op(name, args)
        raise _refuse(text, f"{type(x).__name__} is not part of the language")

    return walk(body)


def references(tree: Tree) -> frozenset[str]:
    if isinstance(tree, Ref):
        return frozenset((tree.name,))
    if isinstance(tree, Op):
        return frozenset().union(*(references(a) for a in tree.args))
    if isinstance(tree, Whole):
        return references(tree.arg)
    if isinstance(tree, Guard):
        return references(tree.tree)
    return frozenset()


def reductions(tree: Tree) -> list[Whole]:
    if isinstance(tree, Whole):
        return [tree]
    if isinstance(tree, Op):
        return [w for a in tree.args for w in reductions(a)]
    if isinstance(tree, Guard):
        return reductions(tree.tree)
    return []


def emit(tree: Tree, env: Mapping[str, Column], wholes: Mapping[Whole, Column] | None = None) -> Column:
    """The column that computes the tree."""
    if isinstance(tree, Num):
        return n.lit(tree.value)
    if isinstance(tree, Ref):
        return env[tree.name]
    if isinstance(tree, Whole):
        return wholes[tree]
    if isinstance(tree, Guard):
        subject = emit(tree.subject, env, wholes)
        bad = subject == 0 if tree.condition == "zero" else subject <= 0
        return F.when(bad & ~F.isnan(subject), F.raise_error(F.lit(tree.message)).cast("double")).otherwise(emit(tree.tree, env, wholes))
    return FUNCTIONS[tree.name].column(*(emit(a, env, wholes) for a in tree.args))


def value_at_missing(tree: Tree) -> float:
    """What the expression gives where every variable is missing."""
    if isinstance(tree, Num):
        return tree.value
    if isinstance(tree, Ref):
        return n.NAN
    if isinstance(tree, Whole):
        return 1.0
    if isinstance(tree, Guard):
        return value_at_missing(tree.tree)
    with np.errstate(all="ignore"):
        return float(FUNCTIONS[tree.name].value(*(value_at_missing(a) for a in tree.args)))


def _zero(t: Tree) -> bool:
    return t == Num(0.0)


def _add(a: Tree, b: Tree) -> Tree:
    return b if _zero(a) else a if _zero(b) else Op("+", (a, b))


def _sub(a: Tree, b: Tree) -> Tree:
    return a if _zero(b) else Op("neg", (b,)) if _zero(a) else Op("-", (a, b))


def _mul(a: Tree, b: Tree) -> Tree:
    if _zero(a) or _zero(b):
        return Num(0.0)
    return b if a == Num(1.0) else a if b == Num(1.0) else Op("*", (a, b))


def derivative(tree: Tree, name: str) -> Tree:
    """The partial derivative; a subtree without the variable is exactly 0 and never evaluated."""
    if name not in references(tree):
        return Num(0.0)
    if isinstance(tree, Ref):
        return Num(1.0)
    if isinstance(tree, Whole) or not FUNCTIONS[tree.name].native:
        raise EquationError(tree.name, "has no derivative, but an operand carries uncertainty", "Use a function of the language, or drop the uncertainty before")
    a = tree.args[0]
    da = derivative(a, name)
    div = lambda x, y: x if y == Num(1.0) else Op("/", (x, y))
    one = Num(1.0)
    if tree.name == "neg":
        return Op("neg", (da,))
    if len(tree.args) == 2:
        b = tree.args[1]
        db = derivative(b, name)
        if tree.name == "+":
            return _add(da, db)
        if tree.name == "-":
            return _sub(da, db)
        if tree.name == "*":
            return _add(_mul(da, b), _mul(a, db))
        if tree.name == "/":
            left = Num(0.0) if _zero(da) else div(da, b)
            return left if _zero(db) else _sub(left, div(_mul(a, db), _mul(b, b)))
        if tree.name == "**":
            left = _mul(_mul(b, Op("**", (a, _sub(b, one)))), da) if not _zero(da) else Num(0.0)
            if _zero(db):
                return left
            message = "the exponent carries uncertainty and the base is not positive; restrict the cells with where="
            right = Guard(_mul(_mul(tree, Op("log", (a,))), db), a, "not positive", message)
            return _add(left, right)
        square = _add(_mul(a, a), _mul(b, b))  # atan2
        return _sub(div(_mul(b, da), square), div(_mul(a, db), square))
    outer: dict[str, Callable[[], Tree]] = {
        "sin": lambda: Op("cos", (a,)),
        "cos": lambda: Op("neg", (Op("sin", (a,)),)),
        "tan": lambda: div(one, Op("**", (Op("cos", (a,)), Num(2.0)))),
        "asin": lambda: div(one, Op("sqrt", (_sub(one, _mul(a, a)),))),
        "acos": lambda: Op("neg", (div(one, Op("sqrt", (_sub(one, _mul(a, a)),))),)),
        "atan": lambda: div(one, _add(one, _mul(a, a))),
        "sqrt": lambda: div(Num(0.5), tree),
        "abs": lambda: Guard(div(a, tree), a, "zero", "abs has no derivative at 0; restrict the cells with where="),
        "log": lambda: div(one, a),
        "log10": lambda: div(one, _mul(a, Num(math.log(10.0)))),
        "exp": lambda: tree,
    }
    return _mul(outer[tree.name](), da)


def condition(text: str, env: Mapping[str, Column]) -> tuple[Column, frozenset[str]]:
    """A where-condition: comparisons, chained or joined by and, or, not."""
    try:
        body = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise _refuse(text, f"not a condition ({error.msg})") from error
    names: set[str] = set()

    def side(x: ast.AST) -> Column:
        tree = parse(ast.unparse(x), set(env))
        if reductions(tree):
            raise _refuse(text, "a reduction in a condition")
        names.update(references(tree))
        return emit(tree, env)

    def walk(x: ast.AST) -> Column:
        if isinstance(x, ast.BoolOp):
            parts = [walk(v) for v in x.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(x.op, ast.And) else (out | p)
            return out
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.Not):
            return ~walk(x.operand)
        if isinstance(x, ast.Compare) and all(type(o) in _COMPARE for o in x.ops):
            sides = [side(s) for s in (x.left, *x.comparators)]
            out = None
            for o, a, b in zip(x.ops, sides, sides[1:]):
                c = n.compare(_COMPARE[type(o)], a, b)
                out = c if out is None else out & c
            return out
        raise _refuse(text, "only comparisons joined by and, or, not make a condition")

    return walk(body), frozenset(names)
