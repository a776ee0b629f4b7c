"""leafstream: a Spark-native engine for large document dataflows.

Documents are read, cut into ordered segments, filtered, packed into bounded chunks, sent through a
pluggable map function with retry and failover, validated, and merged back, all as DataFrame plans.
"""

__version__ = "0.1.0"
