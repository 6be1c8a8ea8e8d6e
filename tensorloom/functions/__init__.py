"""Functions of columns: complex arithmetic, derivatives, text."""
