"""Training-data operators: each module holds one operator and its query.

Nothing outside this package imports it, apart from the guarded registration in
``__spark_entry__.py``.
"""
