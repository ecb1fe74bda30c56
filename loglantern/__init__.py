"""Log analytics as plain Spark DataFrame, Spark ML and Structured Streaming operators.

Every operator is a function ``f(df, ...) -> DataFrame``; nothing holds state between calls.
"""
