"""Functions by name, in two dialects: ansi (this engine's own) and spark (Spark's own behaviour).

``call("ansi", "array_frequency", col)`` or ``ansi.array_frequency(col)``.
"""

from __future__ import annotations

from pyspark.sql import Column

from . import aggregates, ansi, binary, buckets, geometry, ip, native, probability, sketches, spark_dialect, stemming

_DIALECTS = {"ansi": (ansi, aggregates, probability, binary, ip, geometry, sketches, native, stemming), "spark": (spark_dialect, native, buckets)}


def names(dialect: str) -> list[str]:
    return sorted({n for m in _DIALECTS[dialect] for n in m.FUNCTIONS})


def call(dialect: str, name: str, *args, **options) -> Column:
    for m in _DIALECTS[dialect]:
        if name in m.FUNCTIONS:
            return m.FUNCTIONS[name](*args, **options)
    raise KeyError(f"no function {name} in {dialect}")
