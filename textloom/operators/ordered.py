"""Work that follows an order inside groups, safe for groups of any size.

A window gives each group to one task.  That is right for groups of up to
``chunk_rows`` rows.  Larger groups, and an order over a whole table, are
sorted by range over all tasks, written to the shared folder, and cut into
chunks of at most ``chunk_rows`` consecutive rows.  Each chunk is worked on by
itself; one summary row per chunk then carries positions, sums or values on to
the chunks after it.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.lookup import hot_keys, small
from textloom.session import written

CHUNK_ROWS = 1_000_000
PAGE_BYTES = 64 << 20
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def split_by_size(
    df: DataFrame, keys: Sequence[str], limit: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of groups within ``limit``, and rows of larger groups; None for no such rows."""
    if not keys:
        return None, df
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df, None
    hot = small(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    match = F.lit(True)
    for k in keys:
        match = match & df[k].eqNullSafe(hot[f"_hot_{k}"])
    return df.join(hot, match, "left_anti"), df.join(hot, match, "left_semi")


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence, rows: int) -> DataFrame:
    """Sort by range and number the rows.

    Adds ``_key`` (the group, never null), ``_at`` (place in the whole order)
    and ``_chunk`` (at most ``rows`` consecutive places).
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    df = df.withColumn("_key", key)
    placed = df.orderBy("_key", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "chunks")
    inside = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return placed.withColumn("_chunk", F.col("_at") - inside % rows)


class Ordered:
    """A frame seen in groups of ``keys`` ordered by ``order``, which must be a total order.

    With no keys the whole table is one group.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str | Column],
        chunk_rows: int = CHUNK_ROWS,
    ):
        self.keys = list(keys)
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        self.columns = df.columns
        self.added = 0
        self.whole, large = split_by_size(df, self.keys, chunk_rows)
        self.chunks = None if large is None else in_chunks(large, self.keys, self.order, chunk_rows)

    def _window(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @staticmethod
    def _inside() -> Window:
        return Window.partitionBy("_key", "_chunk").orderBy("_at")

    def _carried(self, summary: Column, combine) -> DataFrame:
        """One row per chunk of a group, with ``combine`` of the summaries before it."""
        earlier = (
            Window.partitionBy("_key")
            .orderBy("_chunk")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        per_chunk = self.chunks.groupBy("_key", "_chunk").agg(summary.alias("_summary"))
        return per_chunk.select(
            "_key", "_chunk", combine(F.col("_summary")).over(earlier).alias("_carry")
        )

    def _add(self, name: str, whole: Column, inside: Column, summary: Column, combine, merge):
        if self.whole is not None:
            self.whole = self.whole.withColumn(name, whole)
        if self.chunks is not None:
            if self.added:  # chunks are read twice below; without this, each column would double that
                self.chunks = written(self.chunks, "chunks")
            own = self.chunks.withColumn("_own", inside)
            joined = own.join(self._carried(summary, combine), ["_key", "_chunk"])
            self.chunks = joined.withColumn(name, merge(F.col("_own"), F.col("_carry"))).drop(
                "_own", "_carry"
            )
        self.added += 1
        self.columns = self.columns + [name]
        return self

    def position(self, name: str) -> "Ordered":
        """1, 2, 3, … inside each group."""
        if not self.keys:
            return self._place_in_table(name)
        return self._add(
            name,
            F.row_number().over(self._window()).cast("bigint"),
            F.row_number().over(self._inside()).cast("bigint"),
            F.count(F.lit(1)),
            F.sum,
            lambda own, carry: own + F.coalesce(carry, F.lit(0)),
        )

    def _place_in_table(self, name: str) -> "Ordered":
        """Place inside the sorted partition plus the size of the partitions before it.

        The rows are not shuffled again; the sizes are one row per partition.
        """
        part = F.shiftright("_at", _LOCAL_BITS)
        inside = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
        before = (
            Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        )
        sizes = self.chunks.groupBy("_key", part.alias("_part")).agg(
            F.count(F.lit(1)).alias("_size")
        )
        starts = sizes.select(
            "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
        )
        placed = self.chunks.withColumn("_part", part).join(F.broadcast(starts), "_part")
        self.chunks = placed.withColumn(name, F.col("_start") + inside + 1).drop("_part", "_start")
        self.added += 1
        self.columns = self.columns + [name]
        return self

    def running_sum(self, amount: Column, name: str) -> "Ordered":
        """Sum up to and with each row."""
        until = (Window.unboundedPreceding, Window.currentRow)
        return self._add(
            name,
            F.sum(amount).over(self._window().rowsBetween(*until)),
            F.sum(amount).over(self._inside().rowsBetween(*until)),
            F.sum(amount),
            F.sum,
            lambda own, carry: F.coalesce(own + carry, own, carry),
        )

    def previous(self, value: Column, name: str, where: Column | None = None) -> "Ordered":
        """``value`` of the nearest earlier row, or of the nearest one that meets ``where``.

        ``value`` itself must not be null; wrap nullable columns in a struct.
        """
        value = value if where is None else F.when(where, value)
        before = (Window.unboundedPreceding, -1)
        return self._add(
            name,
            F.last(value, ignorenulls=True).over(self._window().rowsBetween(*before)),
            F.last(value, ignorenulls=True).over(self._inside().rowsBetween(*before)),
            F.max_by(value, F.when(value.isNotNull(), F.col("_at"))),
            lambda summary: F.last(summary, ignorenulls=True),
            lambda own, carry: F.coalesce(own, carry),
        )

    def frame(self) -> DataFrame:
        parts = [p.select(*self.columns) for p in (self.whole, self.chunks) if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "position",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Number the rows of each group, or of the whole table when ``keys`` is empty."""
    return Ordered(df, keys, order, chunk_rows).position(name).frame()


def pages(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    item: Column,
    page_rows: int = 1000,
    separator: str = "\n",
    chunk_rows: int = CHUNK_ROWS,
    page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """Each group's items in order, joined into pages of at most ``page_rows`` items.

    Nothing is left out: a group of any size just has more pages.  A page also
    ends once it has passed another ``page_bytes`` of the group's items; a number
    is skipped where both limits are met at one item.
    """
    keys = list(keys)
    own = F.coalesce(F.octet_length("_item"), F.lit(0)) + len(separator.encode())
    ordered = Ordered(df.withColumn("_item", item).withColumn("_size", own), keys, order, chunk_rows)
    placed = ordered.position("_position").running_sum(F.col("_size"), "_bytes").frame()
    before = F.col("_bytes") - F.col("_size")
    page = F.floor((F.col("_position") - 1) / page_rows) + F.floor(before / page_bytes)
    placed = placed.withColumn("page", page)
    entries = F.sort_array(F.collect_list(F.struct("_position", "_item")))
    return placed.groupBy(*keys, "page").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_join(F.transform(entries, lambda e: e["_item"]), separator).alias("items"),
    )
