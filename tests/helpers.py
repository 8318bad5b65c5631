"""What several test modules share."""

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
