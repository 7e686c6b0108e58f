"""Writers: safe table replacement, export, namespaces, statistics."""

from chronoframe.sinks.export import EXPORTS, export_all, export_frame
from chronoframe.sinks.tables import (
    analyze,
    column_statistics,
    create_namespaces,
    documented,
    drop_table,
    materialise,
    noted,
    reload_partitions,
    replace_table,
    store_table,
)

__all__ = [
    "EXPORTS", "analyze", "column_statistics", "create_namespaces", "documented", "drop_table", "export_all", "export_frame",
    "materialise", "noted", "reload_partitions", "replace_table", "store_table",
]
