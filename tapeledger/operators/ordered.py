"""Ordered passes (running sum, peak, runs) that do not need a whole key in one task.

A window over one key is one task, and one strategy may hold a third of all trades. So the rows
of a key are first cut into consecutive *chunks* of a bounded size: a hash sample of the order
key supplies the cut points, so a crowded day or a crowded instant is cut as well. The windows
then run per (key, chunk); what a chunk needs to know of the chunks before it (sum so far, peak
so far, last win, last loss) is computed from one small row per chunk. The result is exact for
any choice of cut points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tapeledger.functions.numeric import listed, quoted
from tapeledger.operators.joins import join_on_keys
from tapeledger.schema import TRADE_ORDER
from tapeledger.session import durable, estimated_bytes

CHUNK = "__chunk"


@dataclass(frozen=True)
class ChunkPolicy:
    """How large a chunk may grow, and when cutting is worth its sampling scan."""

    target_rows: int = 4_000_000
    samples_per_chunk: int = 16
    max_cuts: int = 1_000_000
    small_input_bytes: int = 32 * 1024 * 1024

    @classmethod
    def spread(cls, rows: int, chunks: int = 64) -> ChunkPolicy:
        """Always cut: about ``chunks`` chunks of the input, none larger than the default."""
        return cls(target_rows=min(cls.target_rows, max(1_000, rows // chunks)), small_input_bytes=0)


DEFAULT_POLICY = ChunkPolicy()


@dataclass(frozen=True)
class Chunked:
    """Rows with a chunk number, and the columns one window partition is made of."""

    rows: DataFrame
    keys: list[str]
    order: tuple[str, ...]
    split: bool

    @property
    def parts(self) -> list[str]:
        return self.keys + [CHUNK] if self.split else list(self.keys)

    @property
    def whole(self) -> str:
        return f"OVER (PARTITION BY {listed(self.parts)})"

    @property
    def ordered(self) -> str:
        return f"OVER (PARTITION BY {listed(self.parts)} ORDER BY {ascending(self.order)})"

    @property
    def running(self) -> str:
        return self.ordered[:-1] + " ROWS UNBOUNDED PRECEDING)"


def ascending(order) -> str:
    return ", ".join(f"{name} ASC NULLS LAST" for name in quoted(order))


def _position(order) -> str:
    """One comparable value per row, in the same order as ``ascending``."""
    return f"struct({', '.join(f'{c} IS NULL, {c}' for c in quoted(order))})"


def _cut_points(rows: DataFrame, keys: list[str], order, policy: ChunkPolicy) -> DataFrame:
    """Every samples_per_chunk-th sampled order key of each key.

    The sample is a function of the row itself, so recomputing it gives the same cuts. A key
    with fewer rows than one chunk has (almost always) no cut and stays whole.
    """
    every = policy.samples_per_chunk
    stride = max(1, policy.target_rows // every)
    nth = f"row_number() OVER (PARTITION BY {listed(keys)} ORDER BY position)"
    return (
        rows.where(f"pmod(xxhash64({listed(order)}), {stride}) = 0")
        .selectExpr(*quoted(keys), f"{_position(order)} AS position")
        .selectExpr("*", f"{nth} AS sample")
        .where(f"sample % {every} = 0")
        .selectExpr(*quoted(keys), "position", f"sample div {every} AS nth")
    )


def chunk_rows(
    rows: DataFrame,
    keys: list[str],
    order=TRADE_ORDER,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> Chunked:
    """Number the chunks of each key; input that fits one task is left whole."""
    order = tuple(order)
    size = estimated_bytes(rows)
    if size is not None and size <= policy.small_input_bytes:
        return Chunked(rows, keys, order, False)

    cuts = durable(_cut_points(rows, keys, order, policy))
    total, longest = cuts.agg(F.expr("count(1)"), F.expr("max(nth)")).first()
    if not total:
        return Chunked(rows, keys, order, False)

    # The cut table is broadcast: keep it under max_cuts by widening the chunks, never by
    # dropping rows.
    keep_every = -(-total // policy.max_cuts)
    longest //= keep_every
    per_key = (
        cuts.where(f"nth % {keep_every} = 0")
        .groupBy(*keys)
        .agg(F.expr("array_sort(collect_list(position)) AS __cuts"))
    )
    located = join_on_keys(rows, F.broadcast(per_key), keys, "left").selectExpr(
        "*", f"{_position(order)} AS __at", f"0 AS `{CHUNK}`"
    )
    # binary search, one halving per step: chunk = number of cuts at or before the row
    others = [c for c in located.columns if c != CHUNK]
    step = 1 << max(longest.bit_length() - 1, 0)
    while step:
        hit = f"coalesce(get(__cuts, `{CHUNK}` + {step - 1}) <= __at, false)"
        located = located.selectExpr(
            *quoted(others), f"`{CHUNK}` + CASE WHEN {hit} THEN {step} ELSE 0 END AS `{CHUNK}`"
        )
        step >>= 1
    return Chunked(located.drop("__cuts", "__at"), keys, order, True)


# --- one pass inside the chunks ------------------------------------------------------------


def local_path(chunked: Chunked) -> DataFrame:
    """Per row, inside its chunk: position, equity, peak, position of the last loss and win.

    Equity is relative (no initial balance) and missing where the net is missing.
    """
    running = chunked.running
    return chunked.rows.selectExpr(
        "*",
        f"row_number() {chunked.ordered} AS rn",
        f"CASE WHEN net_profit IS NOT NULL THEN sum(net_profit) {running} END AS eq",
    ).selectExpr(
        "*",
        f"max(eq) {running} AS pk",
        f"max(CASE WHEN NOT is_win THEN rn END) {running} AS at_loss",
        f"max(CASE WHEN is_win THEN rn END) {running} AS at_win",
    )


_SUMMARY = [
    "count(1) AS n",
    "coalesce(sum(net_profit), 0) AS total",
    "max(eq) AS hi",
    "min(CASE WHEN eq IS NOT NULL THEN named_struct('eq', eq, 'rn', rn) END) AS lo",
    "min(CASE WHEN eq IS NOT NULL THEN named_struct('dd', eq - pk, 'rn', rn, 'eq', eq) END) "
    "AS deep",
    "max_by(net_profit IS NULL, rn) AS last_missing",
    "min(CASE WHEN NOT is_win THEN rn END) AS first_loss",
    "max(CASE WHEN NOT is_win THEN rn END) AS last_loss",
    "min(CASE WHEN is_win THEN rn END) AS first_win",
    "max(CASE WHEN is_win THEN rn END) AS last_win",
    "max(CASE WHEN is_win THEN rn - coalesce(at_loss, 0) ELSE 0 END) AS win_run",
    "max(CASE WHEN NOT is_win THEN rn - coalesce(at_win, 0) ELSE 0 END) AS loss_run",
]
PATH_FIELDS = [text.rsplit(" ", 1)[1] for text in _SUMMARY]


@dataclass(frozen=True)
class Extra:
    """One more figure of the path pass: its column, its value in a chunk, its value over the chunks."""

    name: str
    chunk: str
    merged: str
    carry: tuple[str, ...] = ()


# the first non-missing comment in close order
FIRST_COMMENT = Extra(
    "comment",
    "min_by(comment, CASE WHEN comment IS NOT NULL THEN rn END) AS comment",
    f"min_by(comment, CASE WHEN comment IS NOT NULL THEN `{CHUNK}` END) AS comment",
    ("comment",),
)


def chunk_summaries(chunked: Chunked, path: DataFrame, extras: tuple[Extra, ...] = ()) -> DataFrame:
    """One row per (key, chunk): all a later chunk or the final figures need."""
    wanted = [*_SUMMARY, *[extra.chunk for extra in extras]]
    out = path.groupBy(*chunked.parts).agg(*[F.expr(e) for e in wanted])
    return out if chunked.split else out.selectExpr("*", f"0 AS `{CHUNK}`")


def with_history(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Add to each chunk what came before it in its key."""
    before = (
        f"OVER (PARTITION BY {listed(keys)} ORDER BY `{CHUNK}` "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    return summaries.selectExpr(
        "*",
        f"coalesce(sum(n) {before}, 0) AS off_n",
        f"coalesce(sum(total) {before}, 0) AS off_sum",
    ).selectExpr(
        "*",
        f"max(off_sum + hi) {before} AS prior_peak",
        f"max(off_n + last_loss) {before} AS prior_loss",
        f"max(off_n + last_win) {before} AS prior_win",
    )


def _money(text: str) -> str:
    return f"cast({text} AS DECIMAL(38,4))"


def placed(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their figures measured from the start of the key.

    The deepest point of a chunk is either its own (peak inside the chunk) or its lowest equity
    measured from the peak before the chunk; of equal depths the earlier row counts.
    """
    return with_history(summaries, keys).selectExpr(
        "*",
        f"{_money('off_sum + lo.eq')} AS low",
        "off_n + lo.rn AS low_at",
        "CASE WHEN deep IS NOT NULL THEN named_struct("
        f"'dd', {_money('deep.dd')}, 'rn', off_n + deep.rn, 'eq', {_money('off_sum + deep.eq')}"
        ") END AS inside",
        # a run that reaches into this chunk exists only where the chunk starts with that outcome
        "CASE WHEN first_win = 1 THEN "
        "off_n + coalesce(first_loss - 1, n) - coalesce(prior_loss, 0) ELSE 0 END AS lead_win",
        "CASE WHEN first_loss = 1 THEN "
        "off_n + coalesce(first_win - 1, n) - coalesce(prior_win, 0) ELSE 0 END AS lead_loss",
    ).selectExpr(
        "*",
        "CASE WHEN prior_peak IS NOT NULL AND low IS NOT NULL THEN named_struct("
        f"'dd', {_money('low - prior_peak')}, 'rn', low_at, 'eq', low) END AS carried",
    )


# over the rows of ``placed``
FOLDED_PATH = [
    "sum(n) AS n",
    f"{_money('sum(total)')} AS total",
    f"{_money('max(off_sum + hi)')} AS hi",
    "min(CASE WHEN low IS NOT NULL THEN named_struct('eq', low, 'rn', low_at) END) AS lo",
    "min(least(inside, carried)) AS deep",
    f"max_by(last_missing, `{CHUNK}`) AS last_missing",
    "min(off_n + first_loss) AS first_loss",
    "max(off_n + last_loss) AS last_loss",
    "min(off_n + first_win) AS first_win",
    "max(off_n + last_win) AS last_win",
    "max(greatest(win_run, lead_win)) AS win_run",
    "max(greatest(loss_run, lead_loss)) AS loss_run",
]


def merge(summaries: DataFrame, keys: list[str], extras: tuple[Extra, ...] = ()) -> DataFrame:
    """Fold the chunks of a key, in chunk order, into one summary of the same shape."""
    wanted = [*FOLDED_PATH, *[extra.merged for extra in extras]]
    return placed(summaries, keys).groupBy(*keys).agg(*[F.expr(e) for e in wanted])


def figures(summary: DataFrame, keys: list[str], extras: tuple[Extra, ...] = ()) -> DataFrame:
    """Path figures of a merged summary."""
    ends_in_win = "coalesce(last_win = n, false)"
    return summary.selectExpr(
        *quoted(keys),
        "n",
        "total",
        "last_missing",
        "-deep.dd AS depth",
        "deep.eq - deep.dd AS peak_at_depth",
        "win_run AS max_win_run",
        "loss_run AS max_loss_run",
        f"n - coalesce(CASE WHEN {ends_in_win} THEN last_loss ELSE last_win END, 0) AS current_run",
        f"CASE WHEN {ends_in_win} THEN 'win' ELSE 'loss' END AS current_type",
        *[extra.name for extra in extras],
    )


def path_summary(
    prepared: DataFrame,
    keys: list[str],
    policy: ChunkPolicy = DEFAULT_POLICY,
    extras: tuple[Extra, ...] = (),
) -> DataFrame:
    """The merged path summary of every key, one row each.

    The rows of a chunk are sorted for its windows, so extras cost neither a scan nor a sort.
    """
    carried = quoted(dict.fromkeys(c for extra in extras for c in extra.carry))
    rows = prepared.selectExpr(*quoted(keys), *quoted(TRADE_ORDER), "net_profit", "is_win", *carried)
    chunked = chunk_rows(rows, keys, policy=policy)
    return merge(chunk_summaries(chunked, local_path(chunked), extras), keys, extras)


def path_figures(
    prepared: DataFrame,
    keys: list[str],
    policy: ChunkPolicy = DEFAULT_POLICY,
    extras: tuple[Extra, ...] = (),
) -> DataFrame:
    """Drawdown and run figures of every key, one row each."""
    return figures(path_summary(prepared, keys, policy, extras), keys, extras)


def path_rows(
    prepared: DataFrame,
    keys: list[str],
    carry: list[str] | None = None,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Every trade with its position and path in its key.

    Columns: keys, close_time, id, carry, net_profit, is_win, seq (1..n), n_total, equity and
    peak (relative to the initial balance), run_start (seq of the first trade of its run).
    """
    extra = [c for c in (carry or []) if c not in keys + list(TRADE_ORDER)]
    base = [*quoted(keys), *quoted(TRADE_ORDER), *quoted(extra), "net_profit", "is_win"]
    chunked = chunk_rows(prepared.selectExpr(*base), keys, policy=policy)
    path = local_path(chunked)
    sized = path.selectExpr("*", f"count(1) {chunked.whole} AS size")
    if chunked.split:
        per_key = f"OVER (PARTITION BY {listed(keys)})"
        # chunks of cut keys only: at most two per cut point, hence bounded by max_cuts
        before = (
            with_history(chunk_summaries(chunked, path), keys)
            .selectExpr("*", f"sum(n) {per_key} AS key_n", f"count(1) {per_key} AS chunks")
            .where("chunks > 1")
            .selectExpr(
                *quoted(keys), f"`{CHUNK}`", "off_n", "off_sum", "prior_peak", "prior_loss",
                "prior_win", "key_n",
            )
        )
        sized = join_on_keys(sized, F.broadcast(before), keys + [CHUNK], "left")
        off_n, off_sum = "coalesce(off_n, 0L)", "coalesce(off_sum, 0)"
        total, prior = "coalesce(key_n, size)", ["prior_peak", "prior_loss", "prior_win"]
    else:
        off_n, off_sum, total = "0L", "0", "size"
        prior = ["cast(NULL AS DECIMAL(38,4))", "cast(NULL AS BIGINT)", "cast(NULL AS BIGINT)"]
    last_loss = f"coalesce({off_n} + at_loss, {prior[1]}, 0)"
    last_win = f"coalesce({off_n} + at_win, {prior[2]}, 0)"
    return sized.selectExpr(
        *base,
        f"{off_n} + rn AS seq",
        f"{total} AS n_total",
        f"{_money(f'{off_sum} + eq')} AS equity",
        f"CASE WHEN eq IS NOT NULL THEN greatest({_money(prior[0])}, {_money(f'{off_sum} + pk')}) "
        "END AS peak",
        f"CASE WHEN is_win THEN {last_loss} ELSE {last_win} END + 1 AS run_start",
    )


def running_total_by_time(
    rows: DataFrame,
    keys: list[str],
    value: str,
    time: str = "close_time",
    tiebreak: str = "id",
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Add ``cumulative``: sum of value over all rows of the key up to and including this time.

    Rows of one instant share their value, also where a cut falls inside the instant.
    """
    chunked = chunk_rows(rows, keys, (time, tiebreak), policy)
    upto = f"OVER (PARTITION BY {listed(chunked.parts)} ORDER BY {ascending([time])} RANGE UNBOUNDED PRECEDING)"
    local = chunked.rows.selectExpr("*", f"sum(`{value}`) {upto} AS cumulative")
    if not chunked.split:
        return local

    at = f"struct(`{time}` IS NULL, `{time}`)"
    spans = [
        "min(at) AS first_at",
        "max(at) AS last_at",
        f"sum(`{value}`) AS total",
        "min_by(cumulative, at) AS lead",
    ]
    in_order = f"PARTITION BY {listed(keys)} ORDER BY `{CHUNK}`"
    before = f"OVER ({in_order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    same_start = (
        f"OVER (PARTITION BY {listed(keys)}, first_at ORDER BY `{CHUNK}` "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    )
    # An instant at which chunks begin is complete at the head of the last of them: ``reached``.
    # A chunk that ends in such an instant takes its total from itself or from its successor.
    info = (
        local.selectExpr("*", f"{at} AS at")
        .groupBy(*chunked.parts)
        .agg(*[F.expr(e) for e in spans])
        .selectExpr(
            "*",
            f"sum(total) {before} AS off_sum",
            f"count(1) OVER (PARTITION BY {listed(keys)}) AS chunks",
        )
        .where("chunks > 1")
        .selectExpr("*", "coalesce(off_sum, 0) + coalesce(lead, 0) AS head")
        .selectExpr("*", f"last(head) {same_start} AS reached")
        .selectExpr(
            "*",
            f"lead(first_at) OVER ({in_order}) AS next_at",
            f"lead(reached) OVER ({in_order}) AS next_reached",
        )
        .selectExpr(
            *quoted(keys),
            f"`{CHUNK}`",
            "off_sum",
            "last_at",
            "CASE WHEN last_at = first_at THEN reached WHEN next_at = last_at THEN next_reached END "
            "AS instant_total",
        )
    )
    joined = join_on_keys(local, F.broadcast(info), keys + [CHUNK], "left")
    return joined.selectExpr(
        *quoted(rows.columns),
        f"CASE WHEN instant_total IS NOT NULL AND {at} = last_at THEN instant_total "
        "WHEN off_sum IS NOT NULL THEN off_sum + coalesce(cumulative, 0) "
        "ELSE cumulative END AS cumulative",
    )
