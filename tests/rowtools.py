"""Helpers of the tests, in a module whose name no other folder uses."""


def as_tuples(df, *columns):
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
