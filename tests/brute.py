"""Plain-Python figures of one ordered list of nets (None = missing), to compare with."""

from decimal import Decimal


def path(nets):
    """(rows, figures); rows: equity, peak, run_start per trade; relative to balance 0."""
    total, peak, rows = Decimal(0), None, []
    deepest, top = None, None
    start, last = 1, None
    runs = []
    for seq, net in enumerate(nets, start=1):
        win = net is not None and net > 0
        if win != last:
            start, last = seq, win
            runs.append([win, 0])
        runs[-1][1] += 1
        equity = None
        if net is not None:
            total += net
            equity = total
            peak = equity if peak is None else max(peak, equity)
            if deepest is None or equity - peak < deepest:
                deepest, top = equity - peak, peak
        rows.append((seq, equity, peak if equity is not None else None, start))
    return rows, {
        "n": len(nets),
        "total": total,
        "depth": None if deepest is None else -deepest,
        "peak_at_depth": top,
        "last_missing": nets[-1] is None,
        "max_win_run": max((n for w, n in runs if w), default=0),
        "max_loss_run": max((n for w, n in runs if not w), default=0),
        "current_run": runs[-1][1],
        "current_type": "win" if runs[-1][0] else "loss",
    }


def total_by_time(times, values):
    """Sum of all values up to and including each row's time; None sorts last."""
    key = lambda t: (t is None, t or 0)
    return [
        sum((v for u, v in zip(times, values) if key(u) <= key(t)), Decimal(0)) for t in times
    ]
