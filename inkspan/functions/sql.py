"""SQL surface: ``register`` adds functions and the table function ``detect(text)`` to a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import checksums


def register(spark: SparkSession) -> None:
    """luhn_valid, iban_valid, dni_valid, nir_valid, steuer_id_valid (strings to booleans), find_all(text, value), detect(text)."""

    def put(name: str, f) -> None:
        @F.pandas_udf(T.BooleanType())
        def udf(s: pd.Series) -> pd.Series:
            def one(v):
                try:
                    return v is not None and bool(f(v))
                except (ValueError, IndexError):
                    return False

            return s.map(one)

        spark.udf.register(name, udf)

    for name in ("luhn", "iban", "dni", "nir", "steuer_id"):
        put(f"{name}_valid", getattr(checksums, f"py_{name}"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find_all(text: pd.Series, value: pd.Series) -> pd.Series:
        from inkspan.operators.spans import find_all as find

        return pd.Series([[a for a, _ in find(t or "", v or "")] for t, v in zip(text, value, strict=True)])

    spark.udf.register("find_all", find_all)

    @F.udtf(returnType="detector: string, category: string, confidence: double, start: int, end: int, value: string")
    class Detect:
        def eval(self, text: str):
            from inkspan.functions import fixed
            from inkspan.operators.detectors import detect_text

            for d in detect_text(text or "", fixed.LANGUAGES):
                yield d["detector"], d["category"], d["confidence"], d["start"], d["end"], d["text"]

    spark.udtf.register("detect", Detect)
