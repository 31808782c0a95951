"""Compares a query's rows with its oracle's, whatever their order."""


def _plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if hasattr(x, "tolist"):
        return x.tolist()
    return x


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(repr([_plain(x) for x in r]) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False))


def same(ours, theirs):
    a, b = rows(ours), rows(theirs)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1], [x for x in zip(a[1], b[1]) if x[0] != x[1]][:3]
