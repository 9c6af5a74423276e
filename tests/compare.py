"""Rows that can be compared across engines."""


def plain(value):
    """Comparable across engines: floats to nine digits."""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)
