"""Column expressions: they take and return ``Column`` and never touch data themselves."""
