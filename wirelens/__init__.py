"""Analytics over captured SQL traffic, written as Spark jobs.

Layers, each importing only from the ones above it:

``options``/``schema``  settings and row types
``functions``           Column -> Column helpers (text, wire decoding, filters)
``operators``           DataFrame -> DataFrame operators
``sources``             readers, writers, reports
``streaming``           Structured Streaming versions of the operators
``plans``               fixtures and the registered query catalogue
"""
