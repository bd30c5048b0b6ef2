"""tidewater — Spark-native operators for moving, checking and reporting on
relational retail data: reporting queries, bulk load, keyed upsert, change-log
apply, stock reservation, integrity checks, count parity and metric alarms.

Everything is a plain function over DataFrames; nothing runs before an action.
"""

__version__ = "0.1.0"
