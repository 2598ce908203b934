"""What several test modules share."""


def rows(df, *columns):
    """The rows as sorted tuples."""
    out = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in out.collect()), key=repr)
