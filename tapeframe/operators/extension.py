"""User functions with a checked contract: feed normalisers and strategies.

Both are plain ``DataFrame -> DataFrame`` functions; what they return is typed, ordered and checked for
missing columns before anything else sees it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeframe.contracts import SIGNAL
from tapeframe.sources.lake import contracted


def normalise(raw: DataFrame, normaliser: Callable[[DataFrame], DataFrame], schema: T.StructType) -> DataFrame:
    """A feed's own rows as rows of a message contract."""
    return contracted(normaliser(raw), schema)


def strategy_signals(
    train: DataFrame, features: DataFrame, fit: Callable[[DataFrame], DataFrame],
    signals: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Signals for ``features`` by a strategy that learned from ``train`` alone.

    ``fit`` returns what it learned as a one-row table, ``signals`` turns features and that row into
    signal rows.
    """
    return contracted(signals(features, fit(train)), SIGNAL)
