"""DataFrame operators. Each module covers one family and never runs an action
unless its docstring says so."""
