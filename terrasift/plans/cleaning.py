"""From raw delimited rows to clean charger rows with a region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions import text as T
from terrasift.functions.geo import albers
from terrasift.operators import relational as R
from terrasift.operators.spatial import first_region, nearest, within

# Required and output columns, renames, the duplicate key, valid coordinates, and the cap in metres.
REQUIRED = ["objectid", "station_name", "station_address", "operator", "number_of_plugs", "charger_type", "charger_rating", "latitude", "longitude", "lganame", "pcode", "source"]
RENAMES = {"objectid": "source_objectid", "lganame": "lga_name", "pcode": "postcode"}
SAME_CHARGER = ["latitude", "longitude", "operator", "charger_type"]
LATITUDES, LONGITUDES = (-45.0, -9.0), (105.0, 160.0)
NEAREST_M = 2000.0
CLEAN = ["charger_id", "source_objectid", "station_name", "station_address", "latitude", "longitude", "lga_name", "postcode", "source", "operator", "number_of_plugs", "charger_type", "status", "charger_rating_raw", "charger_rating_kw", "sa4_code", "sa4_name", "sa4_assignment", "sa4_distance_m"]


def tidy_text(raw: DataFrame, address: str = "station_address", order: str = "row_idx") -> DataFrame:
    return raw.select(*(F.col(c) if c == order else (T.one_line if c == address else T.squash)(F.col(c)).alias(c) for c in raw.columns))


def typed(df: DataFrame) -> DataFrame:
    """Numbers, status, type and rating; places outside the valid box are dropped."""
    kind = F.upper("charger_type")
    df = df.withColumnsRenamed(RENAMES).withColumns(
        {
            "latitude": T.number(F.col("latitude")),
            "longitude": T.number(F.col("longitude")),
            "source_objectid": T.whole(F.col("source_objectid")),
            "number_of_plugs": T.whole(F.col("number_of_plugs")).try_cast("int"),
            "operator": T.canonical_name(F.col("operator")),
            "status": F.when(F.lower("charger_type") == "upcoming", "upcoming").otherwise("existing"),
            "charger_type": F.when(kind.isin("AC", "DC"), kind),
            "charger_rating_raw": F.col("charger_rating"),
            "charger_rating_kw": T.rating_kw(F.col("charger_rating")),
        }
    )
    return df.where(F.col("latitude").between(*LATITUDES) & F.col("longitude").between(*LONGITUDES)).drop("charger_rating")


def assign_region(df: DataFrame, regions: DataFrame, key: str = "charger_id") -> DataFrame:
    """regions(sa4_code, sa4_name, rings in degrees). Inside first, in degrees; only what is inside none goes to the nearest
    within NEAREST_M, in metres; the rest has no region."""
    inside = first_region(within(df.select(key, "longitude", "latitude"), regions, "sa4_code", "longitude", "latitude"), key, "sa4_code")
    inside = inside.select(key, "sa4_code", F.lit("within").alias("sa4_assignment"), F.lit(0.0).alias("sa4_distance_m"))
    out = df.select(key, "longitude", "latitude").join(inside, key, "left_anti")
    x, y = albers(F.col("longitude"), F.col("latitude"))

    def metres(point):
        px, py = albers(point["x"], point["y"])
        return F.struct(px.alias("x"), py.alias("y"))

    flat = regions.withColumn("rings", F.transform("rings", lambda r: F.transform(r, metres)))
    near = nearest(out.withColumns({"x": x, "y": y}), flat, key, "sa4_code", NEAREST_M)
    near = near.select(key, "sa4_code", F.lit("nearest").alias("sa4_assignment"), F.col("distance").alias("sa4_distance_m"))
    found = inside.unionByName(near).join(regions.select("sa4_code", "sa4_name"), "sa4_code", "left")
    return df.join(found, key, "left")


def clean(raw: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows (CLEAN, numbered in input order) and the completeness of the raw and the clean columns."""
    data = [c for c in raw.columns if c != "row_idx"]
    tidy = typed(R.distinct_rows(tidy_text(raw), "row_idx"))
    merged = R.merge_duplicates(tidy, SAME_CHARGER, "station_name", "row_idx")
    numbered = R.number_rows(merged, ["row_idx"], "charger_id").drop("row_idx")
    out = assign_region(numbered, regions).select(CLEAN)
    return out, R.completeness(raw, "raw", data).unionByName(R.completeness(out, "cleaned", CLEAN))
