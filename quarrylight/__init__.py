"""quarrylight: catalog search, lineage, ownership, impact and evaluation on Spark."""
