"""stormcell: hourly time-series preparation, classification and alerting on Spark.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions, windows, aggregates and joins.  Series may be keyed
(``keys=[...]``) or a single long series (``keys=[]``); in both cases the
window operators run on fixed-size row blocks with a halo, so no key or
series is ever pulled into one task.
"""

__version__ = "0.1.0"
