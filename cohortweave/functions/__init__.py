"""Column functions, ranks and the special functions that tests of significance need."""
