"""Line packing with overlap: texts over the budget become chunks that repeat the last lines of the one before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUDGET, OVERLAP = 8000, 3


def chunk_lines(text: Column, budget: int = BUDGET, overlap: int = OVERLAP) -> Column:
    """Array of chunks. Line breaks don't count against the budget; a single line is never split."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("lines"), F.lit(0).alias("size"))

    def add(state: Column, line: Column) -> Column:
        full = (state["size"] + F.char_length(line) > budget) & (F.size(state["lines"]) > 0)
        kept = F.slice(state["lines"], F.greatest(F.lit(1), F.size(state["lines"]) - (overlap - 1)), F.lit(overlap))
        carried = F.concat(kept, F.array(line))
        return F.when(
            full, F.struct(F.concat(state["done"], F.array(F.array_join(state["lines"], "\n"))).alias("done"), carried.alias("lines"), F.aggregate(carried, F.lit(0), lambda n, x: n + F.char_length(x)).alias("size"))
        ).otherwise(F.struct(state["done"].alias("done"), F.concat(state["lines"], F.array(line)).alias("lines"), (state["size"] + F.char_length(line)).alias("size")))

    done = F.aggregate(F.split(text, "\n", -1), start, add, lambda s: F.when(F.size(s["lines"]) > 0, F.concat(s["done"], F.array(F.array_join(s["lines"], "\n")))).otherwise(s["done"]))
    return F.when(F.char_length(text) > budget, done).otherwise(F.array(text))
