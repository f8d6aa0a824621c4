"""Coordinates for rows whose address needs them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from placebook.functions.cells import has_number, is_filled
from placebook.operators.joins import skew_join
from placebook.operators.update import update_by_id
from placebook.session import BROADCAST_ROWS, fits_broadcast, materialize


def geocode_candidates(df: DataFrame) -> DataFrame:
    """Rows (id, Longitude, Geocode, Address and, where mapped, GeocodedAddress) that need coordinates.

    Needed: the switch is on, there is an address, and the coordinates are missing or belong to another address.
    An address that was tried before is not tried again.
    """
    if "Geocode" not in df.columns or "Address" not in df.columns:
        return df.where(F.lit(False))
    wanted = is_filled("Geocode", df.schema["Geocode"].dataType) & (F.col("Address") != "")
    missing = ~has_number("Longitude")
    if "GeocodedAddress" not in df.columns:
        return df.where(wanted & missing)
    tried = F.coalesce(F.col("GeocodedAddress"), F.lit(""))
    return df.where(wanted & F.when(tried == "", missing).otherwise(tried != F.col("Address")))


def first_points(gazetteer: DataFrame) -> DataFrame:
    """One point per address of a gazetteer (address, lat, lng): the first by latitude and longitude."""
    return gazetteer.groupBy("address").agg(F.min(F.struct("lat", "lng")).alias("point"))


def geocode(candidates: DataFrame, gazetteer: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Candidates with `lng` and `lat` of their address, null where the gazetteer (address, lat, lng) lacks it.

    A gazetteer within the size limits is broadcast. Otherwise, if the distinct addresses are, it is reduced to those in
    place. Otherwise both are shuffled, the rows of a frequent address over several tasks.
    """
    fits = fits_broadcast(gazetteer, limit)
    if not fits:
        candidates = materialize(candidates, "candidates")
        wanted = candidates.select(F.col("Address").alias("address")).distinct()
        fits = fits_broadcast(wanted, limit)
        gazetteer = gazetteer.join(F.broadcast(wanted) if fits else wanted, "address", "left_semi")
    points = first_points(gazetteer).withColumnRenamed("address", "Address")
    found = skew_join(candidates, points, ["Address"], "left", fits=fits)
    return found.select(*candidates.columns, F.col("point.lng").alias("lng"), F.col("point.lat").alias("lat"))


def geocode_updates(geocoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """What to write back for geocoded candidates: coordinates and, where that column exists, the address used."""
    updates = [F.col("lng").alias("Longitude"), F.col("lat").alias("Latitude")]
    if "GeocodedAddress" in geocoded.columns:
        updates.append(F.col("Address").alias("GeocodedAddress"))
    return geocoded.select("id", *updates, *keep)


def geocode_table(df: DataFrame, gazetteer: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The whole table with coordinates filled in where they were needed."""
    updates = materialize(geocode_updates(geocode(geocode_candidates(df), gazetteer, limit)), "geocoded")
    columns = [name for name in updates.columns if name != "id"]
    return update_by_id(df, updates, columns, columns, limit=limit)
