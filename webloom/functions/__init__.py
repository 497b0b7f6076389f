"""Column functions: URLs, markup and predicates. Everything here is built-in Catalyst expressions."""
