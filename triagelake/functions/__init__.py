"""Column functions: each takes and returns Columns, no DataFrame involved."""
