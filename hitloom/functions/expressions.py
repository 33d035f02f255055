"""What a regular expression requires of a text, and whether the engine that will run it accepts it."""

from __future__ import annotations

import re
import string

from pyspark.sql import SparkSession

_CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
# Escapes that stand for a kind of character or a place, whatever it is.
_KINDS = frozenset("dDwWsSbB")
_HEX = {"x": re.compile(r"[0-9a-fA-F]{2}"), "u": re.compile(r"[0-9a-fA-F]{4}")}


class _NotAnalysed(Exception):
    """The expression uses something whose meaning is not known here."""


def _escape(pattern: str, i: int) -> tuple[str, int]:
    """The characters that an escape at ``i`` stands for (empty if not fixed), and where it ends."""
    c = pattern[i + 1 : i + 2]
    if c in _HEX and (m := _HEX[c].match(pattern, i + 2)):
        return chr(int(m[0], 16)), m.end()
    if c == "Q":
        end = pattern.find("\\E", i + 2)
        return (pattern[i + 2 :], len(pattern)) if end < 0 else (pattern[i + 2 : end], end + 2)
    if c in _CONTROL:
        return _CONTROL[c], i + 2
    if c in _KINDS:
        return "", i + 2
    if c and not c.isalnum():
        return c, i + 2
    raise _NotAnalysed(pattern)


def _class_end(pattern: str, i: int) -> int:
    """The end of the character class that begins at ``i``; classes may lie in classes."""
    depth = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            _, i = _escape(pattern, i)
            continue
        if c == "[":
            depth += 1
            if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                raise _NotAnalysed(pattern)
        elif c == "]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise _NotAnalysed(pattern)


def _pieces(pattern: str):
    """Top-level parts (start, end, characters), characters empty where they are not fixed; ``None`` for a bar."""
    i, depth, start = 0, 0, 0
    while i < len(pattern):
        c, at, text = pattern[i], i, ""
        if c == "\\":
            text, i = _escape(pattern, i)
        elif c == "[":
            i = _class_end(pattern, i)
        else:
            i += 1
            if c == "(":
                if re.match(r"\?[a-zA-Z-]+[:)]", pattern[i:]):
                    raise _NotAnalysed(pattern)
                depth += 1
                if depth == 1:
                    start = at
                continue
            if c == ")":
                depth -= 1
                if not depth:
                    yield start, i, ""
                continue
            if c not in "|.^$*+?{}":
                text = c
        if depth:
            continue
        if c == "|":
            yield at, i, None
        elif c == "{":
            i = pattern.find("}", at) + 1
            if not i:
                raise _NotAnalysed(pattern)
            yield at, i, ""
        else:
            yield at, i, text


def alternatives(pattern: str) -> list[tuple[str, str]]:
    """Top-level alternatives, each with the longest text that every match of it contains (empty if none is sure).

    Only plain ASCII counts as sure, so the text may be compared in lower case. An expression with parts that are not
    understood is one alternative without such a text.
    """
    try:
        pieces = list(_pieces(pattern))
    except _NotAnalysed:
        return [(pattern, "")]
    out, runs, run, begin = [], [], "", 0
    for at, end, text in pieces:
        if text is None:
            out.append((pattern[begin:at], max([*runs, run], key=len)))
            runs, run, begin = [], "", end
            continue
        follows = pattern[end : end + 1]
        if text and all(c in string.printable for c in text) and follows not in ("?", "*", "{", "+"):
            run += text
            continue
        runs.append(run)
        run = ""
        if text and follows == "+" and text in string.printable:
            runs.append(text[-1])
        elif text and len(text) > 1 and follows and all(c in string.printable for c in text):
            runs.append(text[:-1])  # the quantifier belongs to the last character
    out.append((pattern[begin:], max([*runs, run], key=len)))
    return out


def check(pattern: str) -> None:
    """Raise ``ValueError`` for an expression that the Java side, which runs it, does not accept."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except Exception as e:
        raise ValueError(f"no regular expression: {pattern!r}") from e
