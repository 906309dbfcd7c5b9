"""Training-data operators: cleaning, deduplicating, mixing and packing text corpora on Spark.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface and the thin ``opN_*`` query that applies it to the shipped tables.
"""
