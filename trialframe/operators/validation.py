"""Rules that tables obey, checked while their rows pass: no scan of their own.

Rules of single rows are counted by an observation of whatever action reads or writes the table. Rules
between tables are part of the plan that joins them anyway, and raise there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numeric import is_finite


def cube_rules(n_frames: int | None = None, n_pixels: int | None = None) -> dict[str, Column]:
    """Rules of cells: keys are there and not negative, frames and pixels inside the cube, values not infinite."""
    keys = F.lit(True)
    for k in ("trial", "frame", "pixel"):
        keys = keys & F.col(k).isNotNull() & (F.col(k) >= 0)
    rules = {"trial, frame and pixel are numbers from 0": keys, "values are not infinite": F.coalesce(F.abs("value") < float("inf"), F.lit(True)) | F.isnan("value")}
    if n_frames is not None:
        rules[f"frames are below {n_frames}"] = F.col("frame") < n_frames
    if n_pixels is not None:
        rules[f"pixels are below {n_pixels}"] = F.col("pixel") < n_pixels
    return rules


def prediction_rules() -> dict[str, Column]:
    """Rules of held-out predictions: every sample has a fold, a true and a predicted label, and a finite score."""
    return {
        "every sample was tested": F.col("fold").isNotNull(),
        "labels are 0 or 1": F.col("y_true").isin(0, 1) & F.col("y_pred").isin(0, 1),
        "scores are finite": is_finite(F.col("score")),
    }


def observed(table: DataFrame, rules: dict[str, Column], some: dict[str, Column] | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """table, and a function that raises if rows broke a rule in the first action on it, which it waits for.

    Each of `rules` holds for every row (null counts as broken), each of `some` for one row at least: both
    classes are there, a value is finite. The counts are sums over tasks, one row in all. Tables made from the observed
    one by joins or limits may read fewer rows; observe what is written.
    """
    every, some = list(rules.items()), list((some or {}).items())
    seen = Observation()
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"every{i}") for i, (_, rule) in enumerate(every)]
    counts += [F.count_if(F.coalesce(rule, F.lit(False))).alias(f"some{i}") for i, (_, rule) in enumerate(some)]

    def verify() -> None:
        got = seen.get
        broken = [f"{text}: not so in {got[f'every{i}']} rows" for i, (text, _) in enumerate(every) if got[f"every{i}"]]
        broken += [f"{text}: in no row" for i, (text, _) in enumerate(some) if not got[f"some{i}"]]
        if broken:
            raise ValueError("; ".join(broken))

    return (table.observe(seen, *counts), verify) if counts else (table, lambda: None)


def require(value: Column, rule: Column, text: str) -> Column:
    """value where the rule holds; else the query fails with the text."""
    return F.when(rule, value).otherwise(F.raise_error(F.lit(text)))
