"""What the tests of the library share besides the session."""

from datetime import datetime

AS_OF = datetime(2024, 1, 31)


def rows(df, *order):
    """All rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=repr)


def plan_of(df) -> str:
    """Text of the executed plan, final where the query has run."""
    return df._jdf.queryExecution().executedPlan().toString()
