"""Operations for large training-data pipelines, each one a Spark job over whole tables.

Nothing else in the library imports this subpackage.
"""
