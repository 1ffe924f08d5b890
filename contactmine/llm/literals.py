"""Tables as literals of a plan: a JSON text that Spark folds to a value while it plans."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value: object, kind: str) -> Column:
    """``value`` as a constant of the type ``kind``, for tables of bounded size."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=True)), kind)
