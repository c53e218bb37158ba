"""Column functions: no joins, no windows, usable in any select."""
