"""Token-classification models as a plug: any object that predicts marks.

A loader is a picklable function without arguments that returns a function
from a list of texts to a list of predictions (end, entity).  It is called
once in each Python worker, when the first batch arrives.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.functions.text import apply_predictions

PREDICTED = "array<struct<end:int,entity:string>>"
Loader = Callable[[], Callable[[list[str]], list[list[tuple[int, str]]]]]


def predictions(loader: Loader):
    """Function of a text column: predictions; null texts have none."""

    @F.pandas_udf(PREDICTED)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in batches:
            model = model or loader()
            known = [t for t in texts if t is not None]
            found = iter(model(known))
            yield pd.Series([None if t is None else [{"end": e, "entity": x} for e, x in next(found)] for t in texts], dtype=object)

    return predict


def mark_map(label_ids: dict[str, int]) -> Column:
    """Map from entity names (B- and the id) to marks; O stands for none."""
    pairs = [x for mark, i in label_ids.items() for x in (F.lit(f"B-{i}"), F.lit(mark))]
    return F.create_map(*pairs, F.lit("O"), F.lit(""))


def read_label_ids(folder: str) -> dict[str, int]:
    """label2id.json of the folder that holds the weights, or of the one above it."""
    for root, _, names in sorted(os.walk(folder)):
        if any(n.endswith(".safetensors") for n in names):
            for place in (root, os.path.dirname(root)):
                path = os.path.join(place, "label2id.json")
                if os.path.isfile(path):
                    with open(path, encoding="utf-8") as f:
                        return json.load(f)
    raise FileNotFoundError(f"no weights with labels below {folder}")


def punctuate(df: DataFrame, text: str, loader: Loader, label_ids: dict[str, int], out: str = "punctuated") -> DataFrame:
    """df with the text's predicted marks put in."""
    held = df.withColumn("_predicted", predictions(loader)(text))
    return held.withColumn(out, apply_predictions(F.col(text), F.col("_predicted"), mark_map(label_ids))).drop("_predicted")
