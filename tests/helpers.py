"""What several test modules share."""


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
