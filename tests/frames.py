"""Helpers shared by the tests."""


def rows(df, *cols):
    """Sorted tuples of a DataFrame, for comparison."""
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
