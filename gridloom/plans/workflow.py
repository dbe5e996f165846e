"""Equation files: constants, declared uncertainties, equations and corrections in TOML."""

from __future__ import annotations

import ast
import math
import re
import tomllib
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import EquationError, WorkflowCycleError, WorkflowError, WorkflowFileError
from ..functions.expressions import CONSTANTS, parse, references

SECTIONS = ("meta", "constants", "uncertainties", "equations", "corrections")


@dataclass(frozen=True)
class Line:
    target: str
    text: str
    section: str
    reads: frozenset[str]


@dataclass(frozen=True)
class Spec:
    source: Path
    meta: Mapping[str, object]
    constants: Mapping[str, float]
    uncertainties: Mapping[str, float | str]
    lines: tuple[Line, ...] = field(default=())
    sorted: bool = False


def _names(text: str) -> set[str]:
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise EquationError(text, f"not an expression ({error.msg})", "Check its syntax") from error
    return {x.id for x in ast.walk(tree) if isinstance(x, ast.Name)}


def parse_equation_file(path, auto_sort: bool = False) -> Spec:
    """Read and check an equation file; ``auto_sort`` orders each section by dependency."""
    path = Path(path)
    try:
        body = tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise WorkflowFileError(str(path), f"cannot be read ({error})", "Pass a TOML file") from error
    unknown = [k for k in body if k not in SECTIONS]
    if unknown:
        raise WorkflowFileError(path.name, f"unknown sections {unknown}", "Sections are: " + ", ".join(SECTIONS))
    if not isinstance(body.get("meta"), dict):
        raise WorkflowFileError(path.name, "has no [meta] section", "Add one with name and version")
    for k, x in body["meta"].items():
        if k == "idempotent" and not isinstance(x, bool) or k != "idempotent" and not isinstance(x, str):
            raise WorkflowFileError(f"meta.{k}", f"{x!r}", "meta holds strings and the boolean idempotent")
    constants = body.get("constants", {})
    for k, x in constants.items():
        if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x):
            raise WorkflowFileError(f"constants.{k}", f"{x!r} is no finite number", "Constants are numbers")
        if k in CONSTANTS or not k.isidentifier():
            raise WorkflowFileError(f"constants.{k}", "the name is reserved or no identifier", "Choose another name")
    uncertainties = body.get("uncertainties", {})
    for k, x in uncertainties.items():
        if isinstance(x, bool) or not (isinstance(x, int | float) or isinstance(x, str) and re.fullmatch(r"\s*\d+(\.\d*)?\s*%\s*", x)):
            raise WorkflowFileError(f"uncertainties.{k}", f"{x!r}", "Pass a number or 'x%'")
    lines: list[Line] = []
    for section in ("equations", "corrections"):
        own: list[Line] = []
        for target, text in body.get(section, {}).items():
            if not isinstance(text, str) or not target.isidentifier():
                raise WorkflowFileError(f"{section}.{target}", f"{text!r} is no equation", "Write NAME = \"expression\"")
            if target in constants:
                raise WorkflowFileError(f"{section}.{target}", "is a constant", "Choose another name")
            names = _names(text) - set(CONSTANTS) - {"np"}
            calls = {x.func.id for x in ast.walk(ast.parse(text.strip(), mode="eval")) if isinstance(x, ast.Call) and isinstance(x.func, ast.Name)}
            tree = parse(text, names - calls)  # the converter that compute uses
            own.append(Line(target, text, section, references(tree) - set(constants)))
        lines += _ordered(own, section, auto_sort, path.name)
    if not lines:
        raise WorkflowFileError(path.name, "has no equation", "Add an [equations] section")
    return Spec(path, body["meta"], {k: float(x) for k, x in constants.items()}, uncertainties, tuple(lines), auto_sort)


def _ordered(lines: list[Line], section: str, auto_sort: bool, what: str) -> list[Line]:
    """Dependency order, ties by place in the file; cycles are refused in either case."""
    targets = {x.target: i for i, x in enumerate(lines)}
    needs = {i: {targets[r] for r in x.reads if r in targets and (r != x.target or section == "equations")} for i, x in enumerate(lines)}
    done: list[int] = []
    while len(done) < len(lines):
        ready = [i for i in range(len(lines)) if i not in done and needs[i] <= set(done)]
        if not ready:
            left = [lines[i].target for i in range(len(lines)) if i not in done]
            raise WorkflowCycleError(f"{what} [{section}]", f"equations need each other: {', '.join(left)}", "Break the cycle")
        done.append(ready[0])
    if auto_sort:
        return [lines[i] for i in done]
    for i, x in enumerate(lines):
        later = [lines[j].target for j in needs[i] if j > i]
        if later:
            raise WorkflowFileError(f"{section}.{x.target}", f"reads {', '.join(later)} before it is made", "Reorder the lines or pass auto_sort=True")
    return lines


class EquationProcessor:
    """An equation file that is applied to grids."""

    def __init__(self, spec: Spec, config: Mapping[str, float] | None = None) -> None:
        self.spec = spec
        self.constants = dict(spec.constants)
        for k, x in (config or {}).items():
            if k not in self.constants:
                raise WorkflowError(str(k), "is no constant of the file", "Constants are: " + (", ".join(self.constants) or "none"))
            if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x):
                raise WorkflowError(str(k), f"{x!r} is no finite number", "Pass a number")
            self.constants[k] = float(x)

    @property
    def name(self) -> str:
        return str(self.spec.meta.get("name") or self.spec.source.stem)

    @property
    def version(self) -> str:
        return str(self.spec.meta.get("version") or "0")

    @property
    def signature(self) -> str:
        return f"pproc {self.name} v{self.version}"

    @property
    def idempotent(self) -> bool:
        return bool(self.spec.meta.get("idempotent", False))

    @property
    def targets(self) -> list[str]:
        return list(dict.fromkeys(x.target for x in self.spec.lines))

    @property
    def required(self) -> list[str]:
        """Variables that the file reads before it makes them."""
        made: set[str] = set()
        out: dict[str, None] = {}
        for x in self.spec.lines:
            for r in sorted(x.reads):
                if r not in made:
                    out[r] = None
            made.add(x.target)
        return list(out)

    def info(self) -> None:
        print(f"{self.name} (version {self.version}), {len(self.spec.lines)} lines, " + ("sorted" if self.spec.sorted else "file order"))
        for k, x in self.constants.items():
            print(f"  {k} = {x:g}" + ("" if x == self.spec.constants[k] else f" (file: {self.spec.constants[k]:g})"))
        for x in self.spec.lines:
            print(f"  [{x.section}] {x.target} = {x.text}")

    def validate(self, grid) -> None:
        clash = [k for k in self.constants if k in grid.vars]
        if clash:
            raise WorkflowError(", ".join(clash), "are constants of the file and variables of the grid", "Rename one of them")
        missing = [r for r in self.required if r not in grid.vars]
        if missing:
            dims = [r for r in missing if r in grid.dim_names]
            raise WorkflowError(", ".join(missing), "are needed and no variables of the grid" + (f" ({', '.join(dims)} are dimensions)" if dims else ""), "Variables are: " + ", ".join(grid.vars))
        unknown = [u for u in self.spec.uncertainties if u not in grid.vars and u not in self.targets]
        if unknown:
            raise WorkflowError(", ".join(unknown), "have a declared uncertainty but are neither read nor made", "Remove them")

    def _inlined(self, text: str) -> str:
        constants = self.constants

        class Inline(ast.NodeTransformer):
            def visit_Name(self, node: ast.Name) -> ast.AST:  # noqa: N802
                if node.id not in constants:
                    return node
                x = constants[node.id]
                number: ast.AST = ast.Constant(abs(x))
                return ast.copy_location(ast.UnaryOp(ast.USub(), number) if math.copysign(1.0, x) < 0 else number, node)

        return ast.unparse(ast.fix_missing_locations(Inline().visit(ast.parse(text.strip(), mode="eval"))))

    def __call__(self, grid, *, report: object = None, comment: str | None = None, force: bool = False):
        if report is not None:
            raise WorkflowError("report", "reports are not written", "Leave it out")
        self.validate(grid)
        signed = any(e.comment == self.signature or (e.comment or "").startswith(f"{self.signature}: ") for e in grid.history)
        if all(t in grid.vars for t in self.targets):
            if signed and not (force or self.idempotent):
                raise WorkflowError(self.signature, "was applied to this grid", "Pass force=True to apply it again")
            warnings.warn(f"{self.signature}: its results are in the grid already", UserWarning, stacklevel=2)
        note = self.signature + (f": {comment}" if comment else "")
        declared = dict(self.spec.uncertainties)
        first = {k: x for k, x in declared.items() if k in grid.vars}
        if first:
            grid = grid.set_uncertainty(first, history=True, comment=note)
        written: set[str] = set()
        for x in self.spec.lines:
            grid = grid.compute(f"{x.target} = {self._inlined(x.text)}", history=True, comment=note)
            if x.target in declared and x.target not in written:
                grid = grid.set_uncertainty({x.target: declared[x.target]}, history=True, comment=note)
            written.add(x.target)
        return grid


def processor(name_or_path, *, config: Mapping[str, float] | None = None, auto_sort: bool = False):
    """A registered processor by name, or an equation file by path."""
    from .registry import make_processor, registered_processors

    text = str(name_or_path)
    if isinstance(name_or_path, Path) or (text not in registered_processors() and ("/" in text or "." in text)):
        return EquationProcessor(parse_equation_file(name_or_path, auto_sort), config)
    return make_processor(text, config)
