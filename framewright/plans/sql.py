"""SQL names for the engine's functions: ``register(spark)`` makes them usable in ``spark.sql``.

Where an expression is enough the function is a SQL one, which the optimizer inlines; kernels are Arrow UDFs; functions that give several rows are table functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..operators import media as m
from ..types import AUDIO, IMAGE, TENSOR

#: name(parameters) RETURNS type, and the expression.
EXPRESSIONS = {
    "fw_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "fw_pcm16(sample DOUBLE) RETURNS DOUBLE": "greatest(-1D, least(1D, sample / 32768D))",
    "fw_yes_probability(no DOUBLE, yes DOUBLE) RETURNS DOUBLE": "1 / (1 + exp(no - yes))",
    "fw_clock(seconds DOUBLE) RETURNS STRING": "format_string('%02d:%02d:%02d', CAST(seconds AS BIGINT) DIV 3600, CAST(seconds AS BIGINT) % 3600 DIV 60, CAST(seconds AS BIGINT) % 60)",
    "fw_crop_offset(pos DOUBLE, size INT, cut INT) RETURNS INT": "CAST(greatest(0, floor(pos * (size - cut) + 0.5D)) AS INT)",
    "fw_compress_target(n BIGINT, ratio DOUBLE) RETURNS BIGINT": "greatest(1, ceil(n * ratio))",
}
#: name(parameters), columns, and the query.
TABLES = {
    "fw_span(center BIGINT, span BIGINT, n BIGINT)": ("i BIGINT", "SELECT explode(filter(sequence(greatest(0L, center - span), greatest(0L, center + span)), x -> x < n AND x <= center + span))"),
    "fw_even_frames(n BIGINT, k BIGINT)": ("j BIGINT, i BIGINT", "SELECT j, CASE WHEN k = 1 THEN 0 ELSE j * (n - 1) DIV greatest(k - 1, 1) END FROM (SELECT explode(sequence(0L, k - 1)) AS j)"),
}


def register(spark: SparkSession) -> list[str]:
    """Register everything as temporary functions of the session, replacing older ones; returns their names."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for head, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {body}")

    def kernel(name: str, schema: str, call) -> str:
        @F.pandas_udf(schema)
        def run(value, *numbers):
            import pandas as pd

            rows = value.to_dict("records") if isinstance(value, pd.DataFrame) else value.tolist()
            return pd.DataFrame([None if r is None else call(r, *(int(n.iloc[i]) for n in numbers)) for i, r in enumerate(rows)])

        spark.udf.register(name, run)
        return name

    kernels = [
        kernel("fw_crop", IMAGE, lambda i, top, left, h, w: m.image_value(px.crop(m.image_array(i), top, left, h, w), i["origin"], i["format"])),
        kernel("fw_resize", IMAGE, lambda i, w, h: m.image_value(px.resize_bicubic(m.image_array(i), w, h), i["origin"], i["format"])),
        kernel("fw_area_resize", IMAGE, lambda i, w, h: m.image_value(px.area_resize(m.image_array(i), w, h), i["origin"], i["format"])),
        kernel("fw_to_tensor", TENSOR, lambda i: m.tensor_value(px.to_tensor(m.image_array(i)[None]), "NCHW")),
        kernel("fw_load_audio", AUDIO, lambda b, rate: dict(zip(("sample_rate", "samples"), m.au.load(b, rate)))),
    ]
    return [h.split("(")[0] for h in [*EXPRESSIONS, *TABLES]] + kernels
