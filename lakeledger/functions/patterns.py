"""Glob and regular-expression rules as Java regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .paths import _col

_SPECIAL = set("\\.^$|?*+()[]{}-&~#")
# Unicode classes and case folding, and only \n as a line end: what a Python pattern means.
_FLAGS = "(?iudU)"


def _literal(ch: str) -> str:
    return "\\" + ch if ch in _SPECIAL else ch


def literal(text: str) -> str:
    """A regex that matches the text itself."""
    return "".join(map(_literal, text))


def _char_class(body: str) -> str:
    negated = body.startswith("!")
    if negated:
        body = body[1:]
    items, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                items.append(f"{_literal(low)}-{_literal(high)}")
            i += 3
        else:
            items.append(_literal(body[i]))
            i += 1
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def glob_to_regex(glob: str) -> str:
    """Whole-text Java regex for a shell glob: ``*``, ``?``, ``[seq]``, ``[!seq]``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            start = i + 1 if glob[i:i + 1] == "!" else i
            # a bracket right after the opening belongs to the set
            end = glob.find("]", start + 1)
            if end < 0:
                out.append("\\[")
            else:
                out.append(_char_class(glob[i:end]))
                i = end + 1
        else:
            out.append(_literal(ch))
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def glob_match(text: Column | str, glob: str) -> Column:
    """Case-insensitive whole-text match; plain prefix, suffix and infix globs need no regex."""
    lowered, glob = F.lower(_col(text)), glob.lower()
    core = glob.strip("*")
    if not any(ch in core for ch in "*?["):
        left, right = glob.startswith("*"), glob.endswith("*")
        if core == "":
            return lowered.isNotNull() if glob else lowered == ""
        if left and right:
            return lowered.contains(core)
        if left:
            return lowered.endswith(core)
        if right:
            return lowered.startswith(core)
        return lowered == core
    return lowered.rlike(glob_to_regex(glob))


def java_regex(pattern: str) -> str:
    """A Python search pattern in Java spelling, case-insensitive."""
    return _FLAGS + re.sub(r"(\\\\)|\(\?P<|\(\?P=(\w+)\)|\\Z", _translate, pattern)


def _translate(match: re.Match) -> str:
    text = match.group(0)
    if text == "\\\\":
        return text
    if text == "(?P<":
        return "(?<"
    if text == "\\Z":
        return "\\z"
    return f"\\k<{match.group(2)}>"


def regex_match(text: Column | str, pattern: str) -> Column:
    """Unanchored case-insensitive search."""
    return _col(text).rlike(java_regex(pattern))


def python_compiles(pattern: str) -> bool:
    try:
        re.compile(pattern, re.IGNORECASE)
        return True
    except (re.error, OverflowError, RecursionError):
        return False


# What means the same to Java as to Python: ASCII text, escaped signs, dots, digits, plain sets, groups, alternatives,
# line ends and the usual repetitions. Everything else (word classes, look-arounds, set operations, ...) is left to Python.
_ATOM = r"""(?:[A-Za-z0-9 _,;:'"=!%@/<>~`&#-]|\\[.^$*+?()\[\]{}|\\/_-]|\\d|\.|\[\^?(?:[A-Za-z0-9 _.,](?:-[A-Za-z0-9])?|\\d)+\])"""
_REPEAT = r"(?:(?:[*+?]|\{\d+(?:,\d*)?\})\??)?"
_SAME = re.compile(rf"(?:{_ATOM}{_REPEAT}|\((?:\?:)?|\){_REPEAT}|\||\^|\$)*")


def same_in_java(pattern: str) -> bool:
    """Whether a pattern that Python compiles surely means the same as a Java expression."""
    return _SAME.fullmatch(pattern) is not None
