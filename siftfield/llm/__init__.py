"""Training-data operators: archives, scans, deduplication, mixing, models and tokenisers on Spark.

Every module holds one operator with a general interface.  :mod:`siftfield.llm.queries` applies
each of them to its whole intended table and derives the digest columns of the registered queries.
"""
