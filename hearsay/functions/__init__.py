"""Column functions: expressions only, no DataFrame is touched here."""
