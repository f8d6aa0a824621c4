"""Writing chosen values back into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from placebook.operators.joins import lookup
from placebook.operators.latest import last_per_id
from placebook.session import BROADCAST_ROWS, fits_broadcast


def update_by_id(
    target: DataFrame, updates: DataFrame, columns: Sequence[str], order: Sequence[str], limit: int = BROADCAST_ROWS
) -> DataFrame:
    """The target with the named columns overwritten in rows whose id occurs in `updates`; '' and null overwrite too.

    The last update of an id by `order` wins, so the target keeps its number of rows. Ids unknown to the target are
    ignored. Few updates are broadcast, and the target is then not shuffled.
    """
    fits = fits_broadcast(updates.select("id", *columns), limit)
    fresh = last_per_id(updates, order).select("id", F.struct(*columns).alias("_new"))
    types = {field.name: field.dataType for field in target.schema.fields}
    return lookup(target, fresh, ["id"], fits=fits).select(
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new")[name].cast(types[name])).otherwise(F.col(name)).alias(name)
            if name in columns
            else F.col(name)
            for name in target.columns
        ]
    )
