"""String expressions (I1, I4, I5, B12, G5, A3, A4) as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import TRUNCATE_HEAD_LINES, TRUNCATE_TAIL_LINES, TRUNCATION_MARKER

# Line break rule used everywhere a text is cut into lines (A4).
LINE_BREAK = r"\r\n|[\n\r]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace (Spark ``trim``
    removes spaces only)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def split_lines(x) -> Column:
    """``str.splitlines()`` for \\n, \\r\\n and \\r: one trailing empty element
    (text ending in a newline) is dropped, '' gives []."""
    arr = F.split(_c(x), LINE_BREAK)
    return F.when(F.element_at(arr, -1) == "", F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)


def slug(x) -> Column:
    """Characters outside [a-zA-Z0-9_-] become '_', '_' stripped at both ends."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"[^a-zA-Z0-9_\-]", "_"), r"^_+|_+$", "")


def last_dotted(x) -> Column:
    """Part after the last '.'."""
    return F.element_at(F.split(_c(x), r"\."), -1)


def strip_chars(x, chars: str) -> Column:
    """``str.strip(chars)`` for a small literal set of characters."""
    cls = "".join("\\" + ch if ch in r"\^-]" else ch for ch in chars)
    return F.regexp_replace(_c(x), f"^[{cls}]+|[{cls}]+$", "")


def slice_lines(lines_arr, start, end) -> Column:
    """A3: 1-based inclusive line slice joined by '\\n'; NULL when start < 1,
    end < start or start past the end; an end past EOF is clipped."""
    lines_arr, start, end = _c(lines_arr), _c(start), _c(end)
    ok = (start >= 1) & (end >= start) & (start <= F.size(lines_arr))
    return F.when(ok, F.array_join(F.slice(lines_arr, start, end - start + 1), "\n"))


def truncate_code(code, head: int = TRUNCATE_HEAD_LINES, tail: int = TRUNCATE_TAIL_LINES) -> Column:
    """Keep the first ``head`` and last ``tail`` lines around a marker
    when the code has more than head + tail lines."""
    code = _c(code)
    arr = F.split(code, "\n")
    return F.when(F.size(arr) > head + tail, F.concat(
        F.array_join(F.slice(arr, 1, head), "\n"), F.lit(TRUNCATION_MARKER),
        F.array_join(F.slice(arr, -tail, tail), "\n"))).otherwise(code)


# FIXED VALUES: repository URL pattern and messages
GITHUB_URL_PATTERN = r"^https://github\.com/[\w.-]+/[\w.-]+/?$"


def url_owner(url) -> Column:
    """I4: owner = second to last path part of the URL."""
    return F.try_element_at(F.split(F.regexp_replace(_c(url), "/+$", ""), "/"), F.lit(-2))


def url_repo_name(url) -> Column:
    """I4: repository name = last path part with '.git' removed anywhere."""
    last = F.element_at(F.split(F.regexp_replace(_c(url), "/+$", ""), "/"), -1)
    return F.replace(last, F.lit(".git"), F.lit(""))


# FIXED VALUES: repository URL messages
URL_EMPTY_MESSAGE = "Repository URL cannot be empty."
URL_INVALID_MESSAGE = "Invalid GitHub repository URL."


def validate_repo_url(url) -> tuple[Column, Column]:
    """(valid, message) for a repository URL (stripped first)."""
    u = _c(url)
    s = py_strip(u)
    ok = F.coalesce(s.rlike("(?U)" + GITHUB_URL_PATTERN), F.lit(False))
    empty = u.isNull() | (u == "")
    valid = ~empty & ok
    msg = (F.when(empty, F.lit(URL_EMPTY_MESSAGE)).when(~ok, F.lit(URL_INVALID_MESSAGE))
           .otherwise(F.lit("")))
    return valid, msg
