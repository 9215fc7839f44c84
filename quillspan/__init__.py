"""quillspan: selective question answering and its analytics on Spark DataFrames.

Subpackages: ``sources`` (schemas, readers, writers), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame), ``plans`` (the named
queries with their SQL), ``streaming`` (the query log as a stream).
"""
