"""Column -> Column building blocks; all of them are row-local and shuffle-free."""
