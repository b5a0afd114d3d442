"""The registered queries written a second time, as DuckDB SQL."""
