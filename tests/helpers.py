"""What several test modules share."""


def values(frame, column="value"):
    """The column's values in order of their text."""
    return sorted(row[column] for row in frame.select(column).collect())
