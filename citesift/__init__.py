"""PySpark engine for citation audits, registry search, request routing and token streams."""
