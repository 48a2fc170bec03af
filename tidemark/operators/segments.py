"""Ordered computations over keyed series whose keys may be arbitrarily large.

A window over `(symbol, session)` puts a whole key into one task, and one hot key may hold a
third of a very large table. A `Segmentation` therefore cuts each key that has too many rows,
and only those, along its order column, where its own counts say: a burst of one key leaves all
other keys whole. `KeyedSeries` makes ordered results exact across the cuts:

* trailing frames (`lag`, the previous n rows) see a *halo*: copies of the last n rows before
  the segment, flagged and dropped at the end;
* running results add a *carry*: one small row per segment with the totals of all earlier
  segments, joined back on `(keys, segment)`, never on the hot key alone.

Both are made from the rows of cut keys alone. There is one plan for inputs of every size; where
no key is cut, adaptive execution finds the table of cuts empty and drops these branches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "__segment"
#: Whether a row's key is cut.
CUT = "__cut"
GHOST = "__ghost"
MICROS_PER_MINUTE = 60_000_000
#: Rows that a segment should hold; a key with no more is not cut.
SEGMENT_ROWS = 1_000_000
#: Steps of the search in a key's bounds: fewer than 2^30 of them.
_STEPS = 29


@dataclass(frozen=True)
class Segmentation:
    """Where keys are cut: by a fixed number of minutes, at counted bounds, or nowhere."""

    minutes: int | None = None
    keys: tuple[str, ...] = ()
    bounds: DataFrame | None = None

    @classmethod
    def for_input(
        cls,
        df: DataFrame,
        keys: Sequence[str],
        order: Column,
        *,
        cell: int = MICROS_PER_MINUTE,
        rows: int = SEGMENT_ROWS,
    ) -> Segmentation:
        """Bounds from the rows really present, for each key with more than `rows` of them.

        Rows are counted per key and cell of the order column (a minute of microseconds unless
        said otherwise), on the map side first. A bound stands where a key's running count passes
        a multiple of `rows`; a cell that alone holds more is cut evenly. Give the input before it
        is joined to anything, since it is read once more for this.

        The table of bounds has at most two bounds for every `rows` rows of the input, which is the
        proof that it may be sent to all tasks.
        """
        names = [f"__k{i}" for i in range(len(keys))]
        counts = df.groupBy(
            *[F.col(key).alias(name) for key, name in zip(keys, names)],
            F.floor(order / F.lit(cell)).cast("long").alias("__cell"),
        ).agg(F.count("*").alias("__n"))
        whole = Window.partitionBy(*names)
        upto = F.sum("__n").over(whole.orderBy("__cell"))
        many = counts.withColumn("__all", F.sum("__n").over(whole)).where(F.col("__all") > rows)
        passed = many.withColumn("__upto", upto).where(
            (F.floor(F.col("__upto") / rows) > F.floor((F.col("__upto") - F.col("__n")) / rows)) | (F.col("__n") > rows)
        )
        parts = F.greatest(F.lit(1), F.ceil(F.col("__n") / rows)).cast("int")
        width = F.lit(cell).cast("long")
        part = F.floor(F.col("__i") * width / F.col("__parts")).cast("long")
        bounds = (
            passed.withColumn("__parts", parts)
            .withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__parts") - F.when(F.col("__parts") > 1, 0).otherwise(1))))
            .groupBy(*names)
            .agg(F.array_sort(F.collect_set(F.col("__cell") * width + part)).alias("__bounds"))
        )
        return cls(None, tuple(keys), bounds)

    def attach(self, df: DataFrame, order: Column) -> DataFrame:
        """`df` with the segment of each row and whether its key is cut."""
        if self.bounds is None:
            cut = self.minutes is not None
            segment = F.floor(order / F.lit((self.minutes or 1) * MICROS_PER_MINUTE)).cast("long")
            return df.withColumns({CUT: F.lit(cut), SEGMENT: segment if cut else F.lit(0).cast("long")})
        same = F.lit(True)
        for i, key in enumerate(self.keys):
            same = same & F.col(key).eqNullSafe(F.col(f"__k{i}"))
        joined = df.join(F.broadcast(self.bounds), same, "left")
        # How many bounds are at or below the order value, found by halving.
        found = F.aggregate(
            F.sequence(F.lit(_STEPS), F.lit(0), F.lit(-1)),
            F.lit(0).cast("long"),
            lambda at, step: F.when(
                F.try_element_at("__bounds", (at + F.pow(F.lit(2), step)).cast("int")) <= order,
                (at + F.pow(F.lit(2), step)).cast("long"),
            ).otherwise(at),
        )
        placed = joined.withColumns({CUT: F.col("__bounds").isNotNull(), SEGMENT: F.when(F.col("__bounds").isNotNull(), found).otherwise(F.lit(0).cast("long"))})
        return placed.drop("__bounds", *[f"__k{i}" for i in range(len(self.keys))])


class KeyedSeries:
    """A DataFrame of series identified by `keys` and ordered by `order`.

    `order` are column names; the first must be a long in the unit of the segmentation. Order
    values must be unique inside a key for a deterministic result. Where only running sums, maxima
    and minima are asked for, later ones may be sort expressions.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str | Column],
        segmentation: Segmentation,
        *,
        halo: int = 0,
    ) -> None:
        self.keys = list(keys)
        self.order = list(order)
        self.segmentation = segmentation
        frame = segmentation.attach(df, F.col(self.order[0]))
        self.df = self._with_halo(frame, halo)

    @property
    def local(self) -> Window:
        """Rows of one segment (with its halo) in order."""
        return Window.partitionBy(*self._segment).orderBy(*self.order)

    @property
    def _segment(self) -> list[str]:
        # With the flag among them, a filter on cut keys goes below the windows to the scan.
        return [*self.keys, CUT, SEGMENT]

    @property
    def running(self) -> Window:
        return self.local.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def trailing(self, first: int, last: int) -> Window:
        return self.local.rowsBetween(first, last)

    def _with_halo(self, frame: DataFrame, rows: int) -> DataFrame:
        if rows == 0:
            return frame.withColumn(GHOST, F.lit(False))
        columns = frame.columns
        newest = Window.partitionBy(*self._segment).orderBy(
            *[F.col(name).desc() for name in self.order]
        )
        # row_number <= n is pushed below the shuffle as a per-task group limit.
        tails = (
            frame.filter(CUT).withColumn("__rn", F.row_number().over(newest))
            .filter(F.col("__rn") <= rows)
            .drop("__rn")
        )
        across = Window.partitionBy(*self.keys).orderBy(*self.order)
        ghosts = (
            tails.withColumn("__next", F.lead(SEGMENT).over(across))
            .withColumn(
                "__last",
                F.collect_list(F.struct(*columns)).over(across.rowsBetween(-(rows - 1), 0)),
            )
            .filter(F.col("__next") > F.col(SEGMENT))
            .select(F.col("__next"), F.explode("__last").alias("__row"))
            .select(
                *[
                    F.col("__next").alias(name) if name == SEGMENT else F.col(f"__row.{name}")
                    for name in columns
                ]
            )
        )
        return frame.withColumn(GHOST, F.lit(False)).unionByName(
            ghosts.withColumn(GHOST, F.lit(True))
        )

    def with_columns(self, columns: Mapping[str, Column]) -> KeyedSeries:
        self.df = self.df.withColumns(dict(columns))
        return self

    def accumulate(
        self,
        *,
        sums: Mapping[str, Column] | None = None,
        firsts: Mapping[str, Column] | None = None,
        lasts: Mapping[str, Column] | None = None,
        maxima: Mapping[str, Column] | None = None,
        minima: Mapping[str, Column] | None = None,
        key_maxima: Mapping[str, Column] | None = None,
        key_minima: Mapping[str, Column] | None = None,
        key_sums: Mapping[str, Column] | None = None,
        emas: Mapping[str, tuple[Column, int]] | None = None,
    ) -> KeyedSeries:
        """Add results that depend on all earlier rows (or all rows) of the key.

        sums, maxima, minima and lasts are running up to the current row (`lasts` is the
        latest non-null value); firsts is the first row's value; key_maxima, key_minima and
        key_sums are over the whole key; emas maps a name to (value, span), see `ema`. Asking for
        everything in one call shares one carry table and one join.
        """
        emas = dict(emas or {})
        # A span of one is the value itself.
        self.with_columns({n: v.cast("double") for n, (v, span) in emas.items() if span <= 1})
        emas = {n: (v, span) for n, (v, span) in emas.items() if span > 1}
        spans = {name: span for name, (_, span) in emas.items()}
        if spans:
            self._local_emas(emas)
        kinds = {
            "sum": dict(sums or {}),
            "first": dict(firsts or {}),
            "last": dict(lasts or {}),
            "max": dict(maxima or {}),
            "min": dict(minima or {}),
            "key_max": dict(key_maxima or {}),
            "key_min": dict(key_minima or {}),
            "key_sum": dict(key_sums or {}),
        }
        inputs = {
            name: F.when(~F.col(GHOST), expr)
            for group in kinds.values()
            for name, expr in group.items()
        }
        frame = self.df.withColumns({f"__in_{name}": expr for name, expr in inputs.items()})

        def source(name: str) -> Column:
            return F.col(f"__in_{name}")

        local: dict[str, Column] = {}
        for name in kinds["sum"]:
            local[name] = F.sum(source(name)).over(self.running)
        for name in kinds["max"]:
            local[name] = F.max(source(name)).over(self.running)
        for name in kinds["min"]:
            local[name] = F.min(source(name)).over(self.running)
        for name in kinds["last"]:
            local[name] = F.last(source(name), ignorenulls=True).over(self.running)
        # Results over the whole of a key that is not cut.
        whole = self.local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for name in kinds["first"]:
            local[f"__w_{name}"] = F.first(source(name)).over(self.running)
        for name in kinds["key_max"]:
            local[f"__w_{name}"] = F.max(source(name)).over(whole)
        for name in kinds["key_min"]:
            local[f"__w_{name}"] = F.min(source(name)).over(whole)
        for name in kinds["key_sum"]:
            local[f"__w_{name}"] = F.sum(source(name)).over(whole)
        at = F.struct(*self.order)
        totals = []
        for name in (*kinds["sum"], *kinds["key_sum"]):
            totals.append(F.sum(source(name)).alias(f"__c_{name}"))
        for name in (*kinds["max"], *kinds["key_max"]):
            totals.append(F.max(source(name)).alias(f"__c_{name}"))
        for name in (*kinds["min"], *kinds["key_min"]):
            totals.append(F.min(source(name)).alias(f"__c_{name}"))
        for name in kinds["first"]:
            totals.append(F.min_by(F.struct(source(name)), at).alias(f"__c_{name}"))
        for name in kinds["last"]:
            totals.append(
                F.max_by(source(name), F.when(source(name).isNotNull(), at)).alias(f"__c_{name}")
            )
        for name in spans:
            totals.append(F.max_by(f"__e_{name}", "__i").alias(f"__c_end_{name}"))
            totals.append(F.min_by(f"__x_{name}", "__i").alias(f"__c_seed_{name}"))
        if spans:
            totals.append(F.count("*").cast("double").alias("__c_rows"))
        segments = frame.filter(F.col(CUT) & ~F.col(GHOST)).groupBy(*self._segment).agg(*totals)
        across = Window.partitionBy(*self.keys).orderBy(SEGMENT)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        whole_key = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        def carry(name: str) -> Column:
            return F.col(f"__c_{name}")

        carried: dict[str, Column] = {}
        for name in kinds["sum"]:
            carried[f"__p_{name}"] = F.sum(carry(name)).over(before)
        for name in kinds["max"]:
            carried[f"__p_{name}"] = F.max(carry(name)).over(before)
        for name in kinds["min"]:
            carried[f"__p_{name}"] = F.min(carry(name)).over(before)
        for name in kinds["last"]:
            carried[f"__p_{name}"] = F.last(carry(name), ignorenulls=True).over(before)
        for name in kinds["first"]:
            carried[f"__p_{name}"] = F.first(carry(name)).over(whole_key)
        for name in kinds["key_max"]:
            carried[f"__p_{name}"] = F.max(carry(name)).over(whole_key)
        for name in kinds["key_min"]:
            carried[f"__p_{name}"] = F.min(carry(name)).over(whole_key)
        for name in kinds["key_sum"]:
            carried[f"__p_{name}"] = F.sum(carry(name)).over(whole_key)
        for name, span in spans.items():
            carried[f"__p_{name}"] = self._ema_carry(name, span, across, whole_key)
        carries = segments.select(
            *self._segment, *[expr.alias(name) for name, expr in carried.items()]
        )

        joined = frame.withColumns(local).join(carries, self._segment, "left")
        final: dict[str, Column] = {}
        for name in kinds["sum"]:
            past, here = F.col(f"__p_{name}"), F.col(name)
            final[name] = F.when(past.isNull(), here).otherwise(past + F.coalesce(here, F.lit(0)))
        for name in kinds["max"]:
            final[name] = F.greatest(F.col(f"__p_{name}"), F.col(name))
        for name in kinds["min"]:
            final[name] = F.least(F.col(f"__p_{name}"), F.col(name))
        for name in kinds["last"]:
            final[name] = F.coalesce(F.col(name), F.col(f"__p_{name}"))
        for name in kinds["first"]:
            carried_first = F.col(f"__p_{name}").getField(f"__in_{name}")
            final[name] = F.when(F.col(CUT), carried_first).otherwise(F.col(f"__w_{name}"))
        for name in (*kinds["key_max"], *kinds["key_min"], *kinds["key_sum"]):
            final[name] = F.when(F.col(CUT), F.col(f"__p_{name}")).otherwise(F.col(f"__w_{name}"))
        for name, span in spans.items():
            past = F.when(F.col(CUT), F.col(f"__p_{name}")).otherwise(F.col(f"__s_{name}"))
            final[name] = F.col(f"__e_{name}") + _past_weight(span) * past
        self.df = joined.withColumns(final).drop(
            *[f"__in_{name}" for name in inputs], *[name for name in local if name.startswith("__w_")],
            *carried, *self._ema_columns(spans),
        )
        return self

    def ema(self, name: str, value: Column, span: int) -> KeyedSeries:
        """Recursive exponential mean, alpha = 2 / (span + 1), seeded by the first value."""
        return self.accumulate(emas={name: (value, span)})

    def _ema_columns(self, spans: Mapping[str, int]) -> list[str]:
        return ["__i", *[f"__{kind}_{name}" for name in spans for kind in ("x", "e", "s")]]

    def _local_emas(self, emas: Mapping[str, tuple[Column, int]]) -> None:
        """Mean of the segment's own rows, as if everything before it were zero.

        Closed form in blocks short enough that the powers stay in double range; the end of
        the previous block enters with its decayed weight (earlier blocks are below double
        precision). The seed is the same as a past mean equal to the first value, so it is
        added with the carry.
        """
        own = Window.partitionBy(*self._segment, GHOST).orderBy(*self.order)
        frame = self.df.withColumns(
            {
                "__i": (F.row_number().over(own) - 1).cast("double"),
                **{f"__x_{name}": value.cast("double") for name, (value, _) in emas.items()},
            }
        )
        for name, (_, span) in emas.items():
            keep = _keep(span)
            block = _ema_block(span)
            x = F.col(f"__x_{name}")
            in_block = (
                Window.partitionBy(*self._segment, GHOST, "__block")
                .orderBy(*self.order)
                .rowsBetween(Window.unboundedPreceding, 0)
            )
            earlier = own.rowsBetween(Window.unboundedPreceding, -1)
            decay = F.pow(F.lit(keep), F.col("__pos"))
            ended = F.when(F.col("__pos") == block - 1, F.col("__s"))
            frame = (
                frame.withColumns(
                    {
                        "__block": F.floor(F.col("__i") / block),
                        "__pos": F.pmod(F.col("__i"), F.lit(float(block))),
                    }
                )
                .withColumn("__s", decay * F.sum((1 - keep) * x / decay).over(in_block))
                .withColumn("__prev", F.last(ended, ignorenulls=True).over(earlier))
                .withColumn(
                    f"__e_{name}",
                    F.col("__s") + F.coalesce(decay * keep * F.col("__prev"), F.lit(0.0)),
                )
                .withColumn(f"__s_{name}", F.first(x).over(own.rowsBetween(Window.unboundedPreceding, 0)))
                .drop("__block", "__pos", "__s", "__prev")
            )
        self.df = frame

    def _ema_carry(self, name: str, span: int, across: Window, whole_key: Window) -> Column:
        """Mean at the end of all earlier segments; the first value before the first one.

        Every segment decays its past at least once, so going `block` segments back is
        already below double precision.
        """
        keep = _keep(span)
        back = across.rowsBetween(-_ema_block(span), -1)
        seed = F.first(F.col(f"__c_seed_{name}")).over(whole_key)
        parts = F.collect_list(
            F.struct(F.col(f"__c_end_{name}").alias("end"), F.col("__c_rows").alias("rows"))
        ).over(back)
        return F.aggregate(
            parts, seed, lambda total, part: total * F.pow(F.lit(keep), part["rows"]) + part["end"]
        )

    def finish(self) -> DataFrame:
        return self.df.filter(~F.col(GHOST)).drop(SEGMENT, CUT, GHOST)


def _keep(span: int) -> float:
    return 1.0 - 2.0 / (span + 1)


def _past_weight(span: int) -> Column:
    """Weight of the mean before a segment at its i-th row."""
    return F.pow(F.lit(_keep(span)), F.col("__i") + 1)


def _ema_block(span: int) -> int:
    """Rows after which the past weighs less than 1e-40 while the powers stay in range."""
    return max(2, ceil(log(1e-40) / log(_keep(span))))
