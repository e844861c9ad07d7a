"""Notation of counts, windows and ladders of sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of count suffixes, as written in lower case; those with an i are binary.
UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "b": 10**9, "t": 10**12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}
UNITS |= {f"{u}b": n for u, n in list(UNITS.items()) if u not in ("", "b")}
OPEN_END = 2**62


def count(text: str) -> int:
    """A count such as 1_000, 10k, 1.5m, 2gi, 64KiB, or terms in a row such as 1g24m."""
    s = text.strip().replace("_", "").lower()
    terms = re.findall(r"(\d+(?:\.\d+)?)([a-z]*)", s)
    if not terms or "".join(a + b for a, b in terms) != s:
        raise ValueError(f"cannot read the count {text!r}")
    total = 0.0
    for number, unit in terms:
        if unit not in UNITS:
            raise ValueError(f"unknown unit {unit!r} in {text!r}")
        total += float(number) * UNITS[unit] if "." in number else int(number) * UNITS[unit]
    return int(total)


def size_name(n: int) -> str:
    """The shortest exact name of a count: 10000000 is 10m."""
    for unit in ("t", "g", "m", "k"):
        if n and n % UNITS[unit] == 0:
            return f"{n // UNITS[unit]}{unit}"
    return str(n)


def windows(text: str) -> list[tuple[int, int]]:
    """Half-open ranges [a, b) of a window: ``[a,b)``, ``(a,b]``, ``a..b``, ``..b``, ``a..``, a single ordinal, or a list of them."""
    out = []
    for m in re.finditer(r"([\[(])\s*([\w.]*?)\s*(?:,|\.\.)\s*([\w.]*?)\s*([\])])|([\w]*)\.\.([\w]*)|([\w]+)", text):
        if m[1]:
            low = count(m[2]) + (m[1] == "(") if m[2] else 0
            high = count(m[3]) + (m[4] == "]") if m[3] else OPEN_END
        elif m[7]:
            low = count(m[7])
            high = low + 1
        else:
            low, high = count(m[5]) if m[5] else 0, count(m[6]) if m[6] else OPEN_END
        out.append((low, high))
    if not out:
        raise ValueError(f"cannot read the window {text!r}")
    return out


def in_windows(ordinal: Column, text: str) -> Column:
    """Plain comparisons on the ordinal, which a scan can prune by."""
    out = None
    for low, high in windows(text):
        test = ordinal >= low if high == OPEN_END else (ordinal >= low) & (ordinal < high)
        out = test if out is None else out | test
    return out


def source(text: str) -> tuple[str, str | None, str | None]:
    """(path, namespace, window) of ``path``, ``path[window]`` or ``path:namespace[window]``."""
    m = re.fullmatch(r"(?P<path>(?:[a-z0-9]+://)?[^\[:]+)(?::(?P<ns>[\w-]+))?(?P<win>[\[(].*[\])])?", text)
    if not m:
        raise ValueError(f"cannot read the source {text!r}")
    win = m["win"]
    if win and win[0] == "[" and win[-1] == "]" and "," not in win and not re.search(r"\d\]$", win):
        win = win[1:-1]
    return m["path"], m["ns"], win


def _range(text: str, base: int) -> tuple[int, int]:
    low, sep, high = text.partition("..")
    if not sep and not base:
        raise ValueError(f"the range {text!r} has no upper end and the base count is unknown")
    end = count(high) if sep else base - 1
    return count(low), min(end, base - 1) if base else end


def strata(text: str, base: int = 0) -> list[int]:
    """The sizes of a ladder, all under the base count if that is given.

    A plain count; ``step:a..b/s``, every s from a; ``parts:a..b/n``, n equal parts; ``linear:a/s``;
    ``mul:a/f``, times f; ``fib:a``, a times the Fibonacci numbers; ``decade``, powers of ten. Upper ends
    may be left out where the base count is known. A bare ``a..b/x`` steps if x has a unit, else parts.
    """
    kind, _, body = text.strip().partition(":")
    if kind.startswith("decade"):
        low, high = _range(body, base) if body else (10, base - 1)
        out, n = [], 1
        while n <= high:
            if n >= low:
                out.append(n)
            n *= 10
        return out
    if not body:
        body, kind = kind, ""
        if "/" not in body:
            n = count(body)
            return [n] if not base or n < base else []
        kind = "step" if re.search(r"[A-Za-z]\s*$", body.rsplit("/", 1)[1]) else "parts"
    span, _, by = body.partition("/")
    low, high = _range(span, base)
    out = []
    if kind in ("step", "linear"):
        if (step := count(by)) <= 0 or kind == "linear" and low <= 0:
            raise ValueError(f"steps and starts are positive in {text!r}")
        out = list(range(low, high + 1, step))
    elif kind == "parts":
        if (n := int(by)) <= 0:
            raise ValueError(f"the number of parts is positive in {text!r}")
        out = [low + (high - low) * i // n for i in range(1, n + 1)] if high >= low else []
    elif kind == "mul":
        if (factor := float(by)) <= 1 or low <= 0:
            raise ValueError(f"the factor is over 1 and the start positive in {text!r}")
        x = float(low)
        while int(x) <= high and len(out) < 100:
            out.append(int(x))
            x = max(x * factor, int(x) + 1.0)
    elif kind == "fib":
        if low <= 0:
            raise ValueError(f"the start is positive in {text!r}")
        a, b = 1, 2
        while a * low <= high:
            out.append(a * low)
            a, b = b, a + b
    else:
        raise ValueError(f"unknown ladder {text!r}")
    return list(dict.fromkeys(n for n in out if n > 0 and (not base or n < base)))
