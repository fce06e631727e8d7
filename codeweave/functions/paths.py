"""Path expressions (I2, I3, E3) as Spark column expressions.

All of them are JVM-side built-ins (``split``, ``aggregate``, ``slice``,
``regexp_*``) so they stay inside the query plan; none needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normpath(p) -> Column:
    """``os.path.normpath`` for '/'-separated paths: drops '.', empty parts,
    folds '..' against a previous real part; '' becomes '.'."""
    p = _c(p)
    parts = F.split(p, "/")
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when(x == "..",
              F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."),
                     F.slice(acc, 1, F.size(acc) - 1))
              .when(p.startswith("/"), acc)
              .otherwise(F.array_append(acc, x)))
        .otherwise(F.array_append(acc, x)))
    body = F.array_join(folded, "/")
    out = F.when(p.startswith("/"), F.concat(F.lit("/"), body)).otherwise(body)
    return F.when(out == "", F.lit(".")).otherwise(out)


def basename(p) -> Column:
    return F.element_at(F.split(_c(p), "/"), -1)


def dirname(p) -> Column:
    """``os.path.dirname``: '' for a bare name."""
    return F.regexp_extract(_c(p), r"^(.*)/[^/]*$", 1)


def suffix(p) -> Column:
    """``Path.suffix``: last '.x' of the final part; dot-files have none."""
    return F.regexp_extract(_c(p), r"(?<=[^/.])(\.[^./]+)$", 1)


def drop_suffix(p) -> Column:
    """``Path.with_suffix('')``: removes only the last suffix."""
    return F.regexp_replace(_c(p), r"(?<=[^/.])\.[^./]+$", "")


def suffix_keys(parts, sep: str) -> Column:
    """For parts [a, b, c] the keys 'b<sep>c', 'c' (i = 1..n-1)."""
    parts = _c(parts)
    n = F.size(parts)
    return F.when(n > 1, F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.array_join(F.slice(parts, i + 1, n - i), sep))
    ).otherwise(F.array().cast("array<string>"))


def common_prefix_len(lo, hi) -> Column:
    """Length of the common leading run of two string arrays."""
    lo, hi = _c(lo), _c(hi)
    eq = F.zip_with(lo, hi, lambda x, y: x.eqNullSafe(y))
    pos = F.array_position(eq, False)
    return F.when(pos == 0, F.least(F.size(lo), F.size(hi))).otherwise(pos - 1)


def strip_root(p, root) -> Column:
    """``os.path.relpath(p, root)`` for p under root; '' or NULL root keeps p."""
    p, root = _c(p), _c(root)
    return (F.when((root == "") | root.isNull(), p)
            .when(p == root, F.lit("."))
            .otherwise(p.substr(F.length(root) + 2, F.lit(1 << 30))))
