"""From clean charger rows and two site feeds to augmented rows and an audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.operators.matching import Radii, cascade
from terrasift.operators.relational import left_join_once


def augment(chargers: DataFrame, records: DataFrame, elements: DataFrame, radii: Radii = Radii()) -> tuple[DataFrame, DataFrame]:
    """Every charger with its match, if any, and the audit. Only DC chargers are matched, and only with DC sites that have
    a place; the second feed sees what the first left."""
    direct = chargers.where(F.col("charger_type") == "DC").select("charger_id", "operator", "station_address", "postcode", "latitude", "longitude")
    sites = lambda s: s.where(F.col("has_dc") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    matches, audit = cascade(direct, [("open_charge_map", sites(records)), ("openstreetmap", sites(elements))], radii)
    return left_join_once(chargers, matches, "charger_id"), audit
