"""scriptorium: Spark-native preparation and scoring of language-model training data.

Every operator is a ``DataFrame -> DataFrame`` function (usable with ``df.transform``)
or a ``Column`` builder. The heavy work runs as Spark expressions (regex, higher-order
array functions, VARIANT, joins, aggregations); Python only appears where a user hands
in a model function.
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming", "session"]
