"""Many terms in one pass over a text."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Lists up to this length are plain expressions; longer ones are an automaton, built once in each worker.
FEW = 24
_built: dict = {}


def _automaton(name: str, terms: list[str]):
    if name not in _built:
        import ahocorasick

        _built.clear()
        made = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            made.add_word(t, k)
        made.make_automaton()
        _built[name] = made
    return _built[name]


def terms_in(spark: SparkSession, text: Column, terms: list[str]) -> Column:
    """Which of the terms stand in a text, as an ascending array of their places in the list; of equal terms the first counts, empty
    ones are nowhere. A null text holds none. The time follows the text, not the number of terms."""
    at: dict[str, int] = {}
    for k, t in enumerate(terms):
        if t:
            at.setdefault(t, k)
    if len(at) <= FEW:
        hits = [F.when(F.contains(text, F.lit(t)), F.lit(k)) for t, k in at.items()]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, list(at), list(at.values())))

    def find(texts: pd.Series) -> pd.Series:
        name, own, places = sent.value
        automaton = _automaton(name, own)
        return pd.Series([sorted({places[k] for _, k in automaton.iter(t)}) if t else [] for t in texts], dtype="object")

    return F.pandas_udf(find, "array<int>")(text)
