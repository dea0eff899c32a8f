"""Operators for preparing language-model training text on Spark.

Nothing outside this subpackage imports it. Each module holds one operator;
``registry`` turns them into the ``opN_<name>`` queries.
"""
