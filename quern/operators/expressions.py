"""String expressions for `eval` and `query`, parsed from Python syntax into columns."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import elementwise as E

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: E.divide, ast.FloorDiv: E.floor_divide, ast.Mod: E.mod, ast.Pow: lambda a, b: F.pow(a, b), ast.BitAnd: operator.and_, ast.BitOr: operator.or_}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_CALLS = {"sin", "cos", "tan", "exp", "log", "log10", "log1p", "expm1", "sqrt", "abs", "floor", "ceil", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "arctan2"}


def parse(text: str, columns: list[str], local: dict | None = None) -> tuple[str | None, Column]:
    """(name assigned to or None, column). `@name` is a local value; names in backticks may hold spaces."""
    local = dict(local or {})
    names = {}
    for i, part in enumerate(text.split("`")[1::2]):
        names[f"__c{i}"] = part
        text = text.replace(f"`{part}`", f"__c{i}", 1)
    text = text.replace("@", "__local_")
    tree = ast.parse(text.strip(), mode="exec").body[0]
    target = None
    if isinstance(tree, ast.Assign):
        target = names.get(tree.targets[0].id, tree.targets[0].id)
    return target, _build(tree.value, columns, names, local)


def _build(node, columns, names, local):
    go = lambda n: _build(n, columns, names, local)
    if isinstance(node, ast.Constant):
        return F.lit(node.value)
    if isinstance(node, ast.Name):
        if node.id.startswith("__local_"):
            v = local[node.id[8:]]
            return v if isinstance(v, list | tuple | set) else F.lit(v)
        name = names.get(node.id, node.id)
        if name not in columns:
            raise NameError(f"no column {name}")
        return F.col(f"`{name}`")
    if isinstance(node, ast.BinOp):
        return _BINARY[type(node.op)](go(node.left), go(node.right))
    if isinstance(node, ast.UnaryOp):
        x = go(node.operand)
        return {ast.USub: lambda: -x, ast.UAdd: lambda: x, ast.Not: lambda: ~x, ast.Invert: lambda: ~x}[type(node.op)]()
    if isinstance(node, ast.BoolOp):
        parts = [go(v) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.Compare):
        out, left = None, go(node.left)
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, ast.In | ast.NotIn):
                values = [e.value for e in right.elts] if isinstance(right, ast.List | ast.Tuple) else list(go(right))
                one = left.isin(values)
                one = ~one if isinstance(op, ast.NotIn) else one
            else:
                right = go(right)
                one = _COMPARE[type(op)](left, right)
                left_next = right
                left, out = left_next, one if out is None else out & one
                continue
            out = one if out is None else out & one
        return out
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS:
        return getattr(E, "abs_" if node.func.id == "abs" else node.func.id)(*[go(a) for a in node.args])
    raise SyntaxError(f"not supported: {ast.dump(node)[:80]}")


def eval_(frame: DataFrame, text: str, local: dict | None = None) -> DataFrame:
    """Lines `name = expression` as new columns; an expression alone as the column `result`."""
    for line in filter(str.strip, text.splitlines()):
        target, column = parse(line, frame.columns, local)
        frame = frame.withColumn(target or "result", column)
    return frame


def query(frame: DataFrame, text: str, local: dict | None = None) -> DataFrame:
    return frame.filter(F.coalesce(parse(text, frame.columns, local)[1], F.lit(False)))
