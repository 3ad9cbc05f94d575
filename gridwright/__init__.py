"""gridwright: result-grid records on Spark.

Landed grid pages and HTML tables become clean, validated, de-duplicated
record tables, projected through export schemas and written as CSV, TSV,
JSON lines or JSON documents, with run and event logs. Every operator is a
``DataFrame -> DataFrame`` function over native Spark columns.
"""

__version__ = "0.1.0"
