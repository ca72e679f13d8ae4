"""Pure ``Column`` functions: no DataFrame, no action, no Python UDF."""
