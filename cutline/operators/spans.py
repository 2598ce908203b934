"""Ordered windows that stay bounded when one key holds most of the rows.

A plain `partitionBy(key).orderBy(ord)` window sorts all rows of a key in one
task. Here a key with many rows is first cut into spans of its ordering value.
Windows then run per (key, span), and what earlier spans contribute is carried
in: totals for expanding aggregates, the last n rows for trailing ones, the last
row for as-of lookups. Where no key is large the plan is the plain window.

Cuts only place the borders, so they come from a sample; results never depend
on them. Rows with the same ordering value always share a span.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

LIMIT_KEY = "spark.cutline.spanRows"
DEFAULT_LIMIT = 2_000_000
SAMPLES_PER_SPAN = 20
MAX_BROADCAST_CUTS = 2_000_000
SPAN, CARRIED = "_span", "_carried"


def span_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_KEY, str(DEFAULT_LIMIT)))


@dataclass(frozen=True)
class Spans:
    """The cuts of an ordering column, per key. `cuts` is None where no key is large."""

    keys: tuple[str, ...]
    order: str
    cuts: DataFrame | None = None
    broadcast_cuts: bool = True

    @property
    def group(self) -> list[str]:
        return [*self.keys, SPAN] if self.cuts is not None else list(self.keys)

    def _cut_side(self) -> DataFrame:
        return F.broadcast(self.cuts) if self.broadcast_cuts else self.cuts

    def large_keys(self) -> DataFrame:
        """The keys that are cut."""
        keys = self.cuts.select(*self.keys)
        return F.broadcast(keys) if self.broadcast_cuts else keys

    def tag(self, df: DataFrame) -> DataFrame:
        """Add the span number. Two-level cuts keep the search near the square
        root of their count."""
        if self.cuts is None:
            return df
        value = F.col(self.order).cast("double")
        chunk = F.size(F.filter("_heads", lambda h: h <= value))
        inside = F.size(F.filter(F.element_at("_chunks", F.greatest(chunk, F.lit(1))), lambda c: c <= value))
        span = F.when(F.col("_heads").isNull() | (chunk == 0), 0).otherwise(
            (chunk - 1) * F.size(F.element_at("_chunks", 1)) + inside
        )
        return (
            df.join(self._cut_side(), list(self.keys), "left")
            .withColumn(SPAN, F.coalesce(span, F.lit(0)).cast("int"))
            .drop("_heads", "_chunks")
        )

    def every_span(self) -> DataFrame:
        """One row per (large key, span)."""
        count = F.aggregate("_chunks", F.lit(0), lambda n, c: n + F.size(c))
        return self.cuts.select(*self.keys, F.explode(F.sequence(F.lit(0), count)).alias(SPAN))


def plan_spans(
    df: DataFrame, keys: Sequence[str], order: str, rows: int | None = None, limit: int | None = None
) -> Spans:
    """Find keys with more rows than a window partition should hold and cut them.

    `rows` is an upper bound on the rows of `df`, where the caller knows one (the
    row count of a source table, say). Below the limit no job runs at all.
    Otherwise one pass samples about twenty rows per span; the cuts collected
    number at most total rows / limit.
    """
    limit = limit or span_limit(df)
    spans = Spans(tuple(keys), order)
    if rows is not None and rows <= limit:
        return spans
    fraction = min(1.0, SAMPLES_PER_SPAN / limit)
    nth = max(1, round(limit * fraction))
    sample = (
        df.select(*keys, F.col(order).cast("double").alias("_cut"))
        .where(F.col("_cut").isNotNull())
        .sample(fraction, seed=7)
        .select(*keys, "_cut", F.row_number().over(Window.partitionBy(*keys).orderBy("_cut")).alias("_n"))
        .where((F.col("_n") % nth == 0) & reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True)))
        .select(*keys, "_cut")
        .distinct()
        .toPandas()
    )
    if sample.empty:
        return spans
    rows_out = []
    for key, group in sample.groupby(list(keys), sort=False):
        cuts = sorted(group["_cut"].tolist())
        width = max(1, int(len(cuts) ** 0.5))
        chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
        rows_out.append((*key, [c[0] for c in chunks], chunks))
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _heads array<double>, _chunks array<array<double>>"
    clean = [tuple(v.item() if hasattr(v, "item") else v for v in r[: len(keys)]) + r[len(keys) :] for r in rows_out]
    cuts_df = df.sparkSession.createDataFrame(clean, schema)
    return Spans(tuple(keys), order, cuts_df, broadcast_cuts=len(sample) <= MAX_BROADCAST_CUTS)


_MERGE: dict[str, Callable] = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge_pair(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return (F.least if kind == "min" else F.greatest)(left, right)


def expanding(
    df: DataFrame,
    spans: Spans,
    aggregates: dict[str, tuple[str, Column]],
    inclusive: bool = False,
    order_by: Sequence[Column] | None = None,
) -> DataFrame:
    """Add aggregates over all rows of the key before this row's ordering value.

    `aggregates` maps a new column to ("sum" | "min" | "max", expression). Rows
    with an equal ordering value see none of each other, unless `inclusive`: then
    all of them are seen, or, with `order_by`, those up to the row itself. Without
    `order_by` the ordering column must be a whole number. An empty sum is 0.
    """
    if order_by is None and dict(df.dtypes)[spans.order] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{spans.order} is not a whole number: give a total order by `order_by`")
    tagged = spans.tag(df)
    group = Window.partitionBy(*spans.group)
    if order_by is not None:
        frame = group.orderBy(spans.order, *order_by).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1)
    else:
        frame = group.orderBy(spans.order).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = {name: _MERGE[kind](expr).over(frame) for name, (kind, expr) in aggregates.items()}
    if spans.cuts is None:
        return tagged.select("*", *[
            (F.coalesce(c, F.lit(0)) if aggregates[n][0] == "sum" else c).alias(n) for n, c in local.items()
        ])
    with_local = tagged.select("*", *[c.alias(f"_l_{n}") for n, c in local.items()])
    before = Window.partitionBy(*spans.keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tagged.join(spans.large_keys(), list(spans.keys), "left_semi")
        .groupBy(*spans.group)
        .agg(*[_MERGE[kind](expr).alias(n) for n, (kind, expr) in aggregates.items()])
        .select(*spans.group, *[
            _MERGE[kind](n).over(before).alias(f"_c_{n}") for n, (kind, _) in aggregates.items()
        ])
    )
    if spans.broadcast_cuts:
        carried = F.broadcast(carried)
    joined = with_local.join(carried, spans.group, "left")
    merged = [
        _merge_pair(kind, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (kind, _) in aggregates.items()
    ]
    return joined.select(*df.columns, *merged)


def _carry_in(tagged: DataFrame, spans: Spans, n: int, ties: Sequence[Column]) -> DataFrame:
    """The last n rows before each span of a large key, tagged with that span.

    Only the last n rows of every span can be among them, so the windows here
    see n rows per span."""
    columns = [c for c in tagged.columns if c != SPAN]
    backwards = [F.col(spans.order).desc(), *[t.desc() for t in ties]]
    tails = (
        tagged.join(spans.large_keys(), list(spans.keys), "left_semi")
        .withColumn("_back", F.row_number().over(Window.partitionBy(*spans.group).orderBy(*backwards)))
        .where(F.col("_back") <= n)
    )
    in_order = Window.partitionBy(*spans.keys).orderBy(F.col(SPAN), F.col("_back").desc())
    recent = tails.select(
        *spans.group, (-F.col("_back")).alias("_at"),
        F.collect_list(F.struct(*columns)).over(in_order.rowsBetween(-(n - 1), 0)).alias("_recent"),
    )
    markers = spans.every_span().select(
        *spans.group, F.lit(-2147483647).alias("_at"), F.lit(None).cast(recent.schema["_recent"].dataType).alias("_recent")
    )
    so_far = Window.partitionBy(*spans.keys).orderBy(SPAN, "_at").rowsBetween(Window.unboundedPreceding, -1)
    at_marker = (
        recent.select(*markers.columns, F.lit(False).alias("_marker"))
        .unionByName(markers.withColumn("_marker", F.lit(True)))
        .withColumn("_carry", F.last("_recent", ignorenulls=True).over(so_far))
        .where("_marker AND _carry IS NOT NULL")
    )
    return at_marker.select(SPAN, F.explode("_carry").alias("_row")).select("_row.*", SPAN)


def trailing(
    df: DataFrame,
    spans: Spans,
    n: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add columns computed over up to n preceding rows of the key.

    `columns` receives the ordered window without a frame and returns the new
    columns; no frame in it may reach more than n rows back.
    """
    tie_columns = [F.col(t) for t in ties]
    tagged = spans.tag(df)
    window = Window.partitionBy(*spans.group).orderBy(F.col(spans.order), *tie_columns)
    new = [c.alias(name) for name, c in columns(window).items()]
    if spans.cuts is None:
        return tagged.select("*", *new)
    carried = _carry_in(tagged, spans, n, tie_columns)
    both = tagged.withColumn(CARRIED, F.lit(False)).unionByName(carried.withColumn(CARRIED, F.lit(True)))
    return both.select("*", *new).where(~F.col(CARRIED)).drop(CARRIED, SPAN)


def numbered(
    df: DataFrame, spans: Spans, name: str, ties: Sequence[Column] = (), kind: str = "row_number",
    peers_name: str | None = None,
) -> DataFrame:
    """Row number or rank per key, and on request how many rows share the ordering value.
    Rows of earlier spans are counted in; equal values always share a span."""
    tagged = spans.tag(df)
    order_by = [F.col(spans.order), *(ties if kind == "row_number" else [])]
    window = Window.partitionBy(*spans.group).orderBy(*order_by)
    local = {"row_number": F.row_number, "rank": F.rank}[kind]().over(window)
    peers = [] if peers_name is None else [
        F.count("*").over(Window.partitionBy(*spans.group).orderBy(spans.order).rangeBetween(0, 0)).alias(peers_name)]
    if spans.cuts is None:
        return tagged.select("*", local.cast("bigint").alias(name), *peers)
    before = Window.partitionBy(*spans.keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.join(spans.large_keys(), list(spans.keys), "left_semi")
        .groupBy(*spans.group).count()
        .select(*spans.group, F.sum("count").over(before).alias("_offset"))
    )
    if spans.broadcast_cuts:
        offsets = F.broadcast(offsets)
    return (
        tagged.select("*", local.alias("_local"), *peers)
        .join(offsets, spans.group, "left")
        .select(*df.columns, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("bigint").alias(name),
                *([peers_name] if peers_name else []))
    )


@dataclass(frozen=True)
class Right:
    """One right side of an as-of join: its payload columns, and integer columns
    that order rows sharing an ordering value."""

    df: DataFrame
    payload: tuple[str, ...]
    ties: tuple[str, ...] = ()


def latest_before(left: DataFrame, rights: Sequence[Right], spans: Spans, strict: bool = True) -> DataFrame:
    """As-of join: the latest row of each right side with an ordering value below
    (or, if not strict, up to) the left row's.

    All sides carry `spans.keys` and `spans.order`. However many right sides there
    are, it is one shuffle on the key: the sides are interleaved in order and the
    last row of each is read forward. A payload travels as one struct, so a null
    inside it stays a null instead of showing an older value.
    """
    side = 0 if strict else 1
    depth = max(len(r.ties) for r in rights)
    base = [*spans.keys, spans.order]
    left_type = left.select(F.struct(*left.columns).alias("_left")).schema["_left"].dataType
    types = [r.df.select(F.struct(*r.payload).alias("_r")).schema["_r"].dataType for r in rights]

    def interleaved(df: DataFrame, which: int | None, ties: tuple[str, ...]) -> DataFrame:
        own = [F.struct(*rights[i].payload) if i == which else F.lit(None).cast(t) for i, t in enumerate(types)]
        return df.select(
            *base, F.lit(side if which is None else 1 - side).alias("_side"),
            (F.struct(*left.columns) if which is None else F.lit(None).cast(left_type)).alias("_left"),
            *[c.alias(f"_r{i}") for i, c in enumerate(own)],
            *[(F.col(ties[i]).cast("bigint") if i < len(ties) else F.lit(None).cast("bigint")).alias(f"_t{i}")
              for i in range(depth)],
        )

    both = interleaved(left, None, ())
    for i, r in enumerate(rights):
        keyed = r.df.where(reduce(lambda a, k: a & F.col(k).isNotNull(), spans.keys, F.lit(True)))
        both = both.unionByName(interleaved(keyed, i, r.ties))
    both = spans.tag(both)
    order_by = [F.col(spans.order), F.col("_side"), *[F.col(f"_t{i}") for i in range(depth)]]
    window = Window.partitionBy(*spans.group).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    names = [f"_r{i}" for i in range(len(rights))]
    is_left = F.col("_side") == side
    found = both.select(*base, *([SPAN] if spans.cuts is not None else []), "_side", "_left",
                        *[F.last(n, ignorenulls=True).over(window).alias(n) for n in names]).where(is_left)
    if spans.cuts is not None:
        last_in_span = (
            both.where(~is_left)
            .join(spans.large_keys(), list(spans.keys), "left_semi")
            .groupBy(*spans.group)
            .agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order_by))).alias(n) for n in names])
        )
        before = Window.partitionBy(*spans.keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
        carried = spans.every_span().join(last_in_span, spans.group, "left").select(
            *spans.group, *[F.last(n, ignorenulls=True).over(before).alias(f"_c{n}") for n in names])
        if spans.broadcast_cuts:
            carried = F.broadcast(carried)
        found = found.join(carried, spans.group, "left")
        for n in names:
            found = found.withColumn(n, F.coalesce(n, f"_c{n}"))
    return found.select("_left.*", *[F.col(n)[c].alias(c) for n, r in zip(names, rights) for c in r.payload])
