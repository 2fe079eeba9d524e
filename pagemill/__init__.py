"""A PySpark engine for scanned-document data: a document library, recogniser output, regions, text layers."""
