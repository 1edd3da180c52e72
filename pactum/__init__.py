"""pactum: clause-annotated document analytics on Spark.

Every operator takes and returns DataFrames; the heavy work is expressed
with native Spark SQL expressions so Catalyst can prune, push down and
code-generate it.
"""

__version__ = "0.1.0"
