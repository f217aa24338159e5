"""Named queries over the supplied tables, each with SQL that DuckDB can run."""
