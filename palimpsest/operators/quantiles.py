"""Exact quantiles of any number of values: their range is narrowed down by counting, so neither a task nor the driver holds them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins that a range is counted by, and values that are few enough to be looked at.
BINS, FEW = 4096, 10_000


def interpolated(frame: DataFrame, columns: list[str], p: float = 0.5) -> dict[str, float | None]:
    """column -> the same as ``percentile``: the value at place p (n - 1), between two places in proportion. Null and NaN are left out; None without any value.

    ``frame`` is read a few times; store what is costly. A pass counts each column's range that holds the place in BINS bins and goes on with one of them, from its
    least to its greatest value. The driver gets at most BINS rows for each range, or the values themselves once they are FEW.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    clean = frame.select(*[F.nullif(v, F.lit(float("nan"))).alias(f"v{i}") for i, v in enumerate(x.values())])
    sums = []
    for i in range(len(columns)):
        v = F.col(f"v{i}")
        finite = F.when(F.abs(v) < float("inf"), v)
        sums += [F.count(v).alias(f"n{i}"), F.count_if(v == float("-inf")).alias(f"low{i}"), F.count(finite).alias(f"fin{i}"), F.min(finite).alias(f"min{i}"), F.max(finite).alias(f"max{i}")]
    one = clean.agg(*sums).first()
    found: dict[tuple[int, int], float] = {}
    todo: dict[tuple[int, float, float, int], set[int]] = {}  # (column, least, greatest, values below) -> places
    for i in range(len(columns)):
        n, low, finite = one[f"n{i}"], one[f"low{i}"], one[f"fin{i}"]
        for place in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))} if n else ():
            if low <= place < low + finite:
                todo.setdefault((i, one[f"min{i}"], one[f"max{i}"], low), set()).add(place)
            else:
                found[i, place] = float("-inf") if place < low else float("inf")
    while todo:
        for key in [k for k in todo if k[1] == k[2]]:
            found |= {(key[0], place): key[1] for place in todo.pop(key)}
        ranges = list(todo)
        if not ranges:
            break
        inside = []
        for j, (i, least, greatest, _) in enumerate(ranges):
            v = F.col(f"v{i}")
            bin_ = F.least(F.floor((v / 2 - least / 2) / (greatest / 2 - least / 2) * BINS), F.lit(BINS - 1)).cast("int")
            inside.append(F.when(v.between(least, greatest), F.struct(F.lit(j).alias("j"), bin_.alias("bin"), v.alias("v"))))
        each = clean.select(F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("s")).select("s.*")
        bins = each.groupBy("j", "bin").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest")).orderBy("j", "bin").collect()
        narrow: dict[tuple[int, float, float, int], set[int]] = {}
        few: dict[tuple[int, float, float, int], set[int]] = {}
        for j, key in enumerate(ranges):
            below = key[3]
            for b in (b for b in bins if b["j"] == j):
                held = {place for place in todo[key] if below <= place < below + b["n"]}
                if held:
                    (few if b["n"] <= FEW else narrow).setdefault((key[0], b["least"], b["greatest"], below), set()).update(held)
                below += b["n"]
        if few:
            parts = [F.when(F.col(f"v{i}").between(least, greatest), F.struct(F.lit(j).alias("j"), F.col(f"v{i}").alias("v"))) for j, (i, least, greatest, _) in enumerate(few)]
            values: dict[int, list[float]] = {}
            for r in clean.select(F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s")).select("s.*").collect():
                values.setdefault(r["j"], []).append(r["v"])
            for j, (key, places) in enumerate(few.items()):
                held = sorted(values[j])
                found |= {(key[0], place): held[place - key[3]] for place in places}
        todo = narrow
    out: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        n = one[f"n{i}"]
        at = p * (n - 1) if n else 0.0
        low, high = math.floor(at), math.ceil(at)
        out[c] = None if not n else found[i, low] if low == high or found[i, low] == found[i, high] else (high - at) * found[i, low] + (at - low) * found[i, high]
    return out
