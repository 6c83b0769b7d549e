"""Bike-share journey analytics as Spark jobs.

``sources`` read and write landed files, ``functions`` hold column
expressions, ``operators`` turn DataFrames into DataFrames and ``plans``
chain them into the ingest, replay-export and SQL jobs.
"""
