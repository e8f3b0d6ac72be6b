"""Named query registry (Spark) and the equivalent DuckDB SQL."""
