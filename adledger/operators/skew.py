"""Building blocks that keep one hot key from landing in one task.

All are exact. They cost an extra narrow shuffle compared with the plain window
or join, and in return no task ever holds more than about ``1/SALTS`` of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 512
POSITIONS_PER_BLOCK = 65_536


def salt_of(*columns: str | Column) -> Column:
    """Deterministic salt from a row's own identity."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def has_partner(key: Column, row_id: str) -> tuple[dict[str, Column], Column]:
    """Is there another row with the same ``key``? (null keys: no)

    Two windows in place of one. The first counts inside (key, salt). The second
    lets one row per (key, salt) meet the others of its key; the remaining rows,
    which already know a partner, stay where they are. A window group thus has at
    most ``SALTS`` rows or a ``1/SALTS`` share of the key.

    Returns the columns to add first and the answer built on them.
    """
    salt = F.when(key.isNull(), F.xxhash64(row_id)).otherwise(salt_of(row_id).cast("bigint"))
    # one order for both, hence one sort
    local = W.partitionBy(key, salt).orderBy(row_id)
    whole = local.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    steps = {
        "_local_n": F.count("*").over(whole), "_local_rn": F.row_number().over(local),
    }
    spread = F.when(key.isNotNull() & (F.col("_local_rn") == 1), F.lit(-1).cast("bigint"))
    meeting = W.partitionBy(key, F.coalesce(spread, F.xxhash64(row_id)))
    answer = key.isNotNull() & (
        (F.col("_local_n") > 1) | (F.count("*").over(meeting) > 1)
    )
    return steps, answer


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the data and must never be sent through the driver.

    A few columns of a wide table with many constant ones look far smaller than they are: Spark
    takes their share of the row of the compressed file and would broadcast millions of ids.
    """
    return side.hint("merge")


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], row_id: str | Column, tasks: int | None = None) -> DataFrame:
    """Left join of ``rows`` with a ``table`` that has one row per key.

    Looks up each distinct (key, salt) once and brings the hits back to the rows
    on (key, salt), so the rows of a hot key are spread over ``SALTS`` tasks
    without copying the table. ``tasks`` bounds the tasks of each step, for small tables.
    """
    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(tasks) if tasks else df

    keys = [key] if isinstance(key, str) else list(key)
    salted = rows.withColumn("_salt", salt_of(row_id))
    hits = few(few(salted.select(*keys, "_salt").distinct()).join(table, keys))
    return few(salted.join(hits, [*keys, "_salt"], "left")).drop("_salt")


def lag_in_blocks(
    df: DataFrame, key: str, block: Column, order: list[Column], lags: dict[str, Column],
    *, first_flag: str,
) -> DataFrame:
    """``lag`` per key where long keys are cut into blocks along the order.

    ``block`` must not decrease along ``order``. Inside a block the previous row is
    found by an ordinary window; the first row of a block finds it in a second window
    over the first and last rows of the blocks only. Adds each of ``lags`` (name ->
    value) and ``first_flag``, true for the very first row of the key.
    """
    df = df.withColumn("_block", block)
    inside = W.partitionBy(key, "_block").orderBy(*order)
    packed = F.struct(*[value.alias(name) for name, value in lags.items()])
    df = df.withColumns({
        "_now": packed,
        "_prev": F.lag(packed).over(inside),
        "_rn": F.row_number().over(inside),
        "_last": F.lead(F.lit(1)).over(inside).isNull(),
    })
    edge = (F.col("_rn") == 1) | F.col("_last")
    across = W.partitionBy(key, F.when(edge, F.lit(None)).otherwise(F.col("_block")), edge).orderBy(
        *order
    )
    df = df.withColumns({
        "_edge_prev": F.lag("_now").over(across),
        "_edge_rn": F.row_number().over(across),
    })
    previous = F.when(F.col("_rn") == 1, F.col("_edge_prev")).otherwise(F.col("_prev"))
    return df.withColumns({
        **{name: previous[name] for name in lags},
        first_flag: (F.col("_rn") == 1) & (F.col("_edge_rn") == 1),
    }).drop("_block", "_now", "_prev", "_rn", "_last", "_edge_prev", "_edge_rn")


def pos_block(pos: str) -> Column:
    return F.floor(F.col(pos) / POSITIONS_PER_BLOCK)
