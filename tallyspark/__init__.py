"""tallyspark: engineering metrics as Spark DataFrame jobs.

Raw development-tool records -> latest snapshots -> canonical entities ->
daily marts and a declarative metric layer, all planned by Catalyst.
"""

__version__ = "0.1.0"
