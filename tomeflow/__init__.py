"""tomeflow: a PySpark engine for document-library catalogs."""
