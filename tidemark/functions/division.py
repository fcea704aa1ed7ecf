"""Divisions that give null instead of an error, in SQL text."""

from __future__ import annotations

from .sel import _TOKEN

#: Binary operators that bind as tightly as a division.
_TIGHT = {"*", "%", "DIV"}


def guarded(text: str) -> str:
    """The expression with every a / b as try_divide(a, b), whatever the operands and however deep."""
    tokens = [t for t in _TOKEN.findall(text) if not t.isspace()]
    out, at = _level(tokens, 0)
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in {text!r}")
    return out


def _level(tokens: list[str], at: int, stop: str | None = None) -> tuple[str, int]:
    """Rewrites up to stop (a closing parenthesis or END) or the end."""
    out: list[str] = []
    term = 0  # where the product begins that a division would divide
    while at < len(tokens) and tokens[at].upper() != stop:
        t = tokens[at]
        if t == ")":
            raise ValueError("unmatched )")
        if t == "/":
            right, at = _operand(tokens, at + 1)
            out[term:] = [f"try_divide({' '.join(out[term:])}, {right})"]
        elif t.upper() in _TIGHT:
            right, at = _operand(tokens, at + 1)
            out += [t, right]
        elif _is_value(t):
            value, at = _operand(tokens, at)
            term = len(out)
            out.append(value)
        else:
            out.append(t)
            at, term = at + 1, len(out) + 1
    return " ".join(out), at


#: Words that are no values (fixed values).
_WORDS = {"AND", "OR", "NOT", "IN", "IS", "LIKE", "RLIKE", "BETWEEN", "WHEN", "THEN", "ELSE", "AS", "DISTINCT", "OVER", "INTERVAL"}


def _is_value(t: str) -> bool:
    return t == "(" or t[0] in "'\"`" or t[0].isalnum() and t.upper() not in _WORDS or t[0] == "_"


def _operand(tokens: list[str], at: int) -> tuple[str, int]:
    """One value: a name, number, text, call, CASE or parenthesis, with signs before it."""
    sign = ""
    while at < len(tokens) and tokens[at] in "+-":
        sign, at = sign + tokens[at], at + 1
    if at == len(tokens) or not _is_value(tokens[at]):
        raise ValueError("an operand is missing")
    t = tokens[at]
    if t.upper() == "CASE":
        inner, at = _level(tokens, at + 1, "END")
        value = f"{t} {inner} END"
    elif t == "(" or at + 1 < len(tokens) and tokens[at + 1] == "(":
        name, at = ("", at) if t == "(" else (t, at + 1)
        inner, at = _level(tokens, at + 1, ")")
        value = f"{name}({inner})"
    else:
        value = t
    if at == len(tokens):
        raise ValueError("an expression is not closed")
    at += 1
    while at < len(tokens) and (tokens[at] == "[" or tokens[at].upper() == "OVER"):  # what belongs to the value before it
        if tokens[at] == "[":
            inner, at = _level(tokens, at + 1, "]")
            value, at = f"{value}[{inner}]", at + 1
        else:
            inner, at = _operand(tokens, at + 1)
            value = f"{value} OVER {inner}"
    return sign + value, at
