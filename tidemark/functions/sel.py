"""The small expression language: function-style conditions on top of SQL.

``IF``, ``IS_NULL``, ``IS_NOT_NULL``, ``IN(v, ...)``, ``NOT_IN(v, ...)`` and ``^`` become SQL; all
else, quoted text included, stays as it is. Nested calls, quotes and infix IN are respected.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_][A-Za-z0-9_.]*|\d+\.?\d*(?:[eE][+-]?\d+)?|\s+|<=|>=|<>|!=|==|\|\||.", re.S)
_CALLS = {"IF", "IS_NULL", "IS_NOT_NULL", "IN", "NOT_IN"}


def to_sql(text: str) -> str:
    """The expression as Spark SQL."""
    tokens = _TOKEN.findall(text)
    out, at = _until(tokens, 0, set())
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in {text!r}")
    return out.strip()


def _until(tokens: list[str], at: int, stops: set[str]) -> tuple[str, int]:
    """Translates up to a stop at this level."""
    out: list[str] = []
    while at < len(tokens) and tokens[at] not in stops:
        t = tokens[at]
        if t == ")":
            raise ValueError("unmatched )")
        after = at + 1
        while after < len(tokens) and tokens[after].isspace():
            after += 1
        call = after < len(tokens) and tokens[after] == "("
        if call and t.upper() in _CALLS and not (t.upper() == "IN" and _operand_before(out)):
            args, at = _arguments(tokens, after + 1)
            out.append(_rewritten(t.upper(), args))
        elif t == "(":
            inner, at = _until(tokens, at + 1, {")"})
            if at == len(tokens):
                raise ValueError("unmatched (")
            out.append(f"({inner})")
            at += 1
        elif t == "^":
            left = _pop_operand(out)
            right, at = _operand(tokens, at + 1)
            out.append(f"power({left}, {right})")
        else:
            out.append(t)
            at += 1
    return "".join(out), at


def _operand_before(out: list[str]) -> bool:
    """Whether what stands before is a value, so that IN is SQL's own operator."""
    words = [t for t in out if not t.isspace()]
    if not words:
        return False
    last = words[-1]
    return last.upper() == "NOT" and len(words) > 1 and _operand_before(words[:-1]) or bool(re.match(r"[\w'\"`)(]", last[0])) and last.upper() not in {"AND", "OR", "NOT", "WHEN", "THEN", "ELSE", "CASE"}


def _arguments(tokens: list[str], at: int) -> tuple[list[str], int]:
    args = []
    while True:
        arg, at = _until(tokens, at, {",", ")"})
        if at == len(tokens):
            raise ValueError("unmatched (")
        args.append(arg.strip())
        at += 1
        if tokens[at - 1] == ")":
            return args, at


def _rewritten(name: str, args: list[str]) -> str:
    need = {"IF": (3, 3), "IS_NULL": (1, 1), "IS_NOT_NULL": (1, 1)}.get(name, (2, 1 << 30))
    if not need[0] <= len(args) <= need[1] or "" in args:
        raise ValueError(f"{name} does not take {len(args)} arguments")
    if name == "IF":
        return f"(CASE WHEN {args[0]} THEN {args[1]} ELSE {args[2]} END)"
    if name.startswith("IS_"):
        return f"({args[0]} IS {'NOT ' if 'NOT' in name else ''}NULL)"
    return f"({args[0]} {'NOT ' if name == 'NOT_IN' else ''}IN ({', '.join(args[1:])}))"


def _pop_operand(out: list[str]) -> str:
    while out and out[-1].isspace():
        out.pop()
    if not out:
        raise ValueError("^ needs a left side")
    right = out.pop()
    return (out.pop() if right.startswith("(") and out and re.match(r"[A-Za-z_]", out[-1]) else "") + right


def _operand(tokens: list[str], at: int) -> tuple[str, int]:
    while at < len(tokens) and tokens[at].isspace():
        at += 1
    if at == len(tokens):
        raise ValueError("^ needs a right side")
    if tokens[at] == "(":
        inner, end = _until(tokens, at + 1, {")"})
        return f"({inner})", end + 1
    if at + 1 < len(tokens) and tokens[at + 1] == "(":
        args, end = _arguments(tokens, at + 2)
        return f"{tokens[at]}({', '.join(args)})", end
    return tokens[at], at + 1
