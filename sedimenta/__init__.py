"""sedimenta - a PySpark-native engine for layered, drifting, versioned tables.

Raw JSON lines are settled into typed tables, merged by version, checked by
rules and condensed into star-schema marts.  Every operator is a function from
DataFrames to DataFrames; Catalyst picks the physical plan.
"""

__version__ = "0.1.0"
