"""linkframe: a PySpark-native engine for graphs of attributed links."""

from linkframe.schema import LINK_SCHEMA

__version__ = "0.1.0"
__all__ = ["LINK_SCHEMA"]
