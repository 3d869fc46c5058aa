"""Column functions on pixels; built-in expressions only, so they stay inside generated code."""
