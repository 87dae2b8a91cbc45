from quillgraph.sources.tables import table

__all__ = ["table"]
