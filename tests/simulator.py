"""The stream semantics one step at a time, in plain Python, to hold the closed forms against."""


def watermarks(ts, lateness, interval):
    """Events and watermarks in the order in which a source sends them."""
    out, top, last, since = [], None, None, 0

    def send():
        nonlocal last
        if top is not None and top >= lateness and (last is None or top - lateness > last):
            last = top - lateness
            out.append(("wm", last))

    for i, t in enumerate(ts):
        top = t if top is None else max(top, t)
        out.append(("row", i))
        since += 1
        if since >= interval:
            send()
            since = 0
    if since:
        send()
    return out


def time_windows(steps, ts, size, advance):
    """(end, rows) per emitted window; rows by time, of equal times the latest first."""
    rows, next_end, out = [], advance, []

    def fire():
        inside = [i for i in rows if max(0, next_end - size) <= ts[i] < next_end]
        if inside:
            out.append((next_end, sorted(inside, key=lambda i: (ts[i], -i))))

    begun = False
    for kind, x in steps:
        if kind == "row":
            rows.append(x)
            begun = True
        elif begun:
            while next_end <= x:
                fire()
                next_end += advance
            rows = [i for i in rows if ts[i] >= next_end - size]
    while rows:
        fire()
        next_end += advance
        rows = [i for i in rows if ts[i] >= next_end - size]
    return out


def count_windows(n, size, advance):
    rows, out = [], []
    for i in range(n):
        rows.append(i)
        if len(rows) == size:
            out.append(list(rows))
            rows = [] if advance >= size else rows[advance:]
    if rows:
        out.append(rows)
    return out
