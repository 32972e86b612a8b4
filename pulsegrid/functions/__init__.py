"""Column expressions and small numpy helpers."""
