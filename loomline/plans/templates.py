"""Path templates: text with ``{{ expression }}`` parts over ``execution_time``.

Expressions are a small, safe part of Python: text, ``+``, ``if`` ... ``else``, ``==`` and ``!=``, ``execution_time`` and
its ``strftime`` and ``isoformat``.
"""

from __future__ import annotations

import ast
import re
from datetime import datetime

TIME_FORMAT = "%Y-%m-%dT%H:%M:%SZ"
ANY_TIME = "*"


def parse_time(value: str | datetime | None) -> datetime | str:
    """A time from its text; ``*`` and None mean any time."""
    if value is None or value == ANY_TIME:
        return ANY_TIME
    return value if isinstance(value, datetime) else datetime.strptime(value, TIME_FORMAT)


def _value(node: ast.AST, time: datetime | str):
    match node:
        case ast.Constant(value=str() | int() as v):
            return v
        case ast.Name(id="execution_time"):
            return time
        case ast.BinOp(left=a, op=ast.Add(), right=b):
            return _value(a, time) + _value(b, time)
        case ast.IfExp(test=test, body=yes, orelse=no):
            return _value(yes if _value(test, time) else no, time)
        case ast.Compare(left=a, ops=[ast.Eq()], comparators=[b]):
            return _value(a, time) == _value(b, time)
        case ast.Compare(left=a, ops=[ast.NotEq()], comparators=[b]):
            return _value(a, time) != _value(b, time)
        case ast.Call(func=ast.Attribute(value=of, attr="strftime" | "isoformat" as name), args=args, keywords=[]):
            return getattr(_value(of, time), name)(*[_value(x, time) for x in args])
    raise ValueError(f"not allowed in a template: {ast.dump(node)}")


def render(template: str, execution_time: str | datetime | None = None) -> str:
    time = parse_time(execution_time)
    return re.sub(r"\{\{(.*?)\}\}", lambda m: str(_value(ast.parse(m[1].strip(), mode="eval").body, time)), template, flags=re.S)
