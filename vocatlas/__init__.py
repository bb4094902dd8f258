"""vocatlas: a PySpark engine for vocabulary-enriched text indexes over a security ontology."""
