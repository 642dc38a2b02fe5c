"""What several test modules use."""

SMALL = "/root/testdata/sf0.001"


def dicts(df):
    return [row.asDict() for row in df.collect()]
