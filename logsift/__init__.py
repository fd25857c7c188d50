"""logsift: syslog / CEF digest and recurrence analytics as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions``; grouped operators take ``keys`` (e.g. ``["site"]``)
so any number of sources is digested in one job.
"""

__version__ = "0.1.0"
