"""featloom: behavioural feature engineering as Spark DataFrame operators.

Flat tables of user behaviour (clicks, orders, loans) become per-period
aggregates, wide per-user rows, trailing "latest n periods" columns, hashed or
dictionary-encoded training lines and a simple model/evaluation layer.  Every
operator is a ``DataFrame -> DataFrame`` function built from built-in Spark
expressions, so Catalyst plans it and no Python runs inside tasks.
"""

__version__ = "0.1.0"
