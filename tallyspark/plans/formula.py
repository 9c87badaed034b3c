"""F18 formula expressions: ``+ - * /``, unary minus, parentheses, names, numbers.

Parsed with Python's ``ast`` (no parser of our own) and turned into Column
arithmetic; division is ``try_divide`` so a zero divisor gives NULL.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

_BIN = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b,
        ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b)}


def parse(expr: str) -> ast.AST:
    if not expr or not expr.strip():
        raise ValueError("empty formula")
    try:
        tree = ast.parse(expr, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"invalid formula {expr!r}") from e
    _check(tree)
    return tree


def _check(node):
    if isinstance(node, ast.BinOp) and type(node.op) in _BIN:
        _check(node.left)
        _check(node.right)
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        _check(node.operand)
    elif isinstance(node, ast.Name):
        pass
    elif isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        pass
    else:
        raise ValueError(f"unsupported formula element {ast.dump(node)[:60]}")


def names(expr: str) -> set[str]:
    return {n.id for n in ast.walk(parse(expr)) if isinstance(n, ast.Name)}


def to_column(expr: str, columns: dict[str, Column]) -> Column:
    def emit(node) -> Column:
        if isinstance(node, ast.BinOp):
            return _BIN[type(node.op)](emit(node.left), emit(node.right))
        if isinstance(node, ast.UnaryOp):
            inner = emit(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.Name):
            if node.id not in columns:
                raise ValueError(f"unknown formula input {node.id!r}")
            return columns[node.id]
        return F.lit(float(node.value))
    return emit(parse(expr)).cast("double")
