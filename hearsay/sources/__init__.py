"""Reading and writing: feeds, tables, SQL stores and the run ledger."""
