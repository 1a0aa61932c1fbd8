"""Retrieval evaluation for code and text search, as Spark DataFrame jobs.

The package is a library of DataFrame-to-DataFrame functions:

* ``sources``   reading record files, the dataset catalogue, tables on disk
* ``functions`` column expressions on text, token arrays and vectors
* ``operators`` collation, embedding, pooling, exact search, ranking metrics
* ``plans``     whole evaluations: one report over many datasets or languages
* ``streaming`` the embedding step over files as they arrive
"""
