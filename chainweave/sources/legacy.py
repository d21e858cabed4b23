"""The old wide layout: IR_{arm}_{n}_{field} columns and further chains as JSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.functions.values import nullify


def upgrade_schema(df: DataFrame) -> DataFrame:
    """cell_id, arm, slot, productive and the fields, one row per chain that has any value; ``extra_chains`` come as slot 0."""
    found = [m for m in (re.fullmatch(r"IR_(VJ|VDJ)_([12])_(\w+)", c) for c in df.columns) if m]
    names = list(dict.fromkeys(m[3] for m in found))
    have = {(m[1], int(m[2]), m[3]) for m in found}
    field = lambda a, n, v: (nullify(F.col(f"IR_{a}_{n}_{v}").cast("string")) if (a, n, v) in have else F.lit(None).cast("string")).alias(v)
    chains = [F.struct(F.lit(a).alias("arm"), F.lit(n).alias("slot"), *[field(a, n, v) for v in names]) for a, n in dict.fromkeys((m[1], int(m[2])) for m in found)]
    rows = df.select("cell_id", F.explode(F.array(*chains)).alias("c")).select("cell_id", "c.*")
    if "extra_chains" in df.columns:
        kind = "array<struct<" + ",".join(f"{v}:string" for v in names) + ">>"
        more = df.where(nullify(F.col("extra_chains")).isNotNull()).select("cell_id", F.explode(F.from_json("extra_chains", kind)).alias("c"))
        rows = rows.unionByName(more.select("cell_id", F.lit(None).cast("string").alias("arm"), F.lit(0).alias("slot"), "c.*"))
    return rows.where(F.coalesce(*names).isNotNull()).withColumn("productive", F.lit(True))
