"""Least squares for many feature lists at once, from one matrix of products.

The training rows are aggregated once to the sums of products of all features and the
label; every feature list is then a part of that matrix, solved without another pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekin.operators.evaluate import regression_metrics
from lakekin.operators.pairs import quoted
from lakekin.session import fits, materialize

#: A feature of which the earlier ones leave no more than this share adds nothing.
LEAST_REST = 1e-9


def added_lists(base: Sequence[str], found: Sequence[str], most: int = 5, skips: Sequence[int] = (0, 1)) -> dict[str, list[str]]:
    """The base features with 0 to ``most`` found columns, leaving out the first ``skip`` ones."""
    return {
        f"added_{n}_skip_{skip}": [*base, *found[skip : skip + n]]
        for skip in skips
        for n in range(min(most, len(found) - skip) + 1)
    }


def per_group(rows: DataFrame, values: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the values of their group, which are sent to all tasks only if proven small."""
    if not groups:
        raise ValueError("name at least one grouping column; a constant one will do")
    written = materialize(values.withColumnsRenamed({g: f"of_{g}" for g in groups}), name)
    same = [quoted(g) == quoted(f"of_{g}") for g in groups]
    return rows.join(F.broadcast(written) if fits(written) else written, same)


def product_sums(train: DataFrame, label: str, features: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Per group ``mean_y, means`` and ``products``, the upper triangle of Z'Z in rows.

    Z holds the features and at last the label, each less its mean over the group. A
    missing feature counts as its mean; rows without a label are left out. NaN is missing.
    """
    numbers = train.select(*groups, *_numbers(label, features)).where("y IS NOT NULL")
    names = [f"x{i}" for i in range(len(features))]
    means = numbers.groupBy(*groups).agg(
        F.avg("y").alias("mean_y"), F.array(*[F.coalesce(F.avg(x), F.lit(0.0)) for x in names]).alias("means")
    )
    near = per_group(numbers, means, groups, "feature-means")
    z = [F.coalesce(F.col(x) - F.col("means")[i], F.lit(0.0)) for i, x in enumerate(names)] + [F.col("y") - F.col("mean_y")]
    # Centred before they are multiplied: differences of large sums would lose digits.
    near = near.select(*groups, "mean_y", "means", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    return near.groupBy(*groups, "mean_y", "means").agg(
        F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).alias("products")
    )


def solve(products: np.ndarray, chosen: Sequence[int], label: int) -> np.ndarray:
    """Slopes of the chosen features, by sweeping one after the other out of the matrix.

    A feature that the earlier ones explain gets the slope 0.
    """
    at = [*chosen, label]
    rest, own = products[np.ix_(at, at)].copy(), products.diagonal()[list(chosen)]
    swept = [k for k in range(len(chosen)) if _sweep(rest, k, own[k])]
    slopes = np.zeros(len(chosen))
    slopes[swept] = rest[swept, -1]
    return slopes


def _sweep(rest: np.ndarray, k: int, own: float) -> bool:
    pivot = rest[k, k]
    if not pivot > LEAST_REST * own:
        return False
    row, column = rest[k] / pivot, rest[:, k].copy()
    rest -= np.outer(column, row)
    rest[k], rest[:, k] = row, -column / pivot
    rest[k, k] = 1.0 / pivot
    return True


def fit_lists(
    train: DataFrame, label: str, configurations: Mapping[str, Sequence[str]], groups: Sequence[str]
) -> DataFrame:
    """``groups, config, start, slopes, means``: one linear model per group and feature list.

    ``slopes`` and ``means`` go through all features in the order of their first use.
    """
    features = all_features(configurations)
    chosen = {name: [features.index(f) for f in listed] for name, listed in configurations.items()}
    sums = product_sums(train, label, features, groups)
    size = len(features) + 1

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                z = np.zeros((size, size))
                z[np.triu_indices(size)] = row.pop("products")
                z = np.triu(z) + np.triu(z, 1).T
                for name, at in chosen.items():
                    slopes = np.zeros(size - 1)
                    slopes[at] = solve(z, at, size - 1)
                    start = row["mean_y"] - float(slopes @ np.asarray(row["means"], float))
                    out.append({**{g: row[g] for g in groups}, "config": name, "start": start, "slopes": slopes, "means": row["means"]})
            yield pd.DataFrame(out, columns=[*groups, "config", "start", "slopes", "means"])

    kinds = [f"`{g}` {train.schema[g].dataType.simpleString()}" for g in groups]
    return sums.mapInPandas(work, ", ".join([*kinds, "config string, start double, slopes array<double>, means array<double>"]))


def train_eval_lists(
    split: DataFrame, label: str, configurations: Mapping[str, Sequence[str]], groups: Sequence[str]
) -> DataFrame:
    """Test metrics of every feature list per group: two passes over the training rows, one over the test rows.

    A group without training rows has no models and no metrics; rows with a null in
    ``groups`` belong to no group and are left out.
    """
    models = fit_lists(split.where(F.col("split") == "train"), label, configurations, groups)
    features = all_features(configurations)
    test = split.where(F.col("split") == "test").select(*groups, *_numbers(label, features))
    both = per_group(test, models, groups, "models")
    prediction = F.col("start")
    for i in range(len(features)):
        prediction = prediction + F.col("slopes")[i] * F.coalesce(F.col(f"x{i}"), F.col("means")[i])
    scored = both.select(*groups, "config", "y", prediction.alias("prediction"))
    return regression_metrics(scored, "y", "prediction", [*groups, "config"])


def all_features(configurations: Mapping[str, Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(f for listed in configurations.values() for f in listed))


def _numbers(label: str, features: Sequence[str]):
    """Label and features as ``y, x0, x1, ..``; NaN becomes null."""
    number = lambda name: F.nanvl(quoted(name).cast("double"), F.lit(None).cast("double"))
    return [number(label).alias("y"), *[number(f).alias(f"x{i}") for i, f in enumerate(features)]]
