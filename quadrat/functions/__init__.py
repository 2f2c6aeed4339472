"""Column builders: built-in expressions and higher-order functions only."""
