"""A PySpark engine for content-addressed, versioned file catalogs."""
