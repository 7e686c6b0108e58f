"""As-of-day analytics on Spark.

Sub-packages:

* ``functions`` – column expressions (no UDFs),
* ``sources`` / ``sinks`` – readers with quarantine, safe table replacement, export,
* ``operators`` – reusable DataFrame operators (joins, windows, SCD2, quality),
* ``plans`` – composed layers, reports and benchmark shapes,
* ``streaming`` – the scheduled snapshot tracker.
"""

from chronoframe.model import ReportingWindow

__all__ = ["ReportingWindow"]
