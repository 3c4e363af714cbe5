from tesserae.sources.tables import table

__all__ = ["table"]
