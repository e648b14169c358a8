"""Training-data operators: each module holds one operator and its `opN_` query.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its
queries when the subpackage is present.
"""
