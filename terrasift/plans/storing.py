"""The normalised tables, their rules, their views, and checks after loading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrasift.operators import relational as R
from terrasift.operators.matching import PAYLOAD
from terrasift.operators.quality import Rules, require_columns, violations
from terrasift.operators.spatial import agreement

# The tables' columns and types (ids are wider than 32 bits on purpose), their rules, what the store needs of
# the augmented rows, and how far a region's border may move, in degrees.
RING = "array<array<struct<x: double, y: double>>>"
TYPES = {
    "sa4_regions": f"sa4_code string, sa4_name string, gcc_name string, state_name string, area_sqkm double, geom {RING}",
    "operators": "operator_id bigint, operator_name string",
    "locations": "location_id bigint, address string, postcode string, lga_name string, geom struct<x: double, y: double>, sa4_code string, sa4_assignment string",
    "chargers": "charger_id bigint, location_id bigint, operator_id bigint, station_name string, charger_type string, status string, charger_rating_kw double, number_of_plugs int, source string",
    "plug_types": "plug_type_id bigint, plug_type_name string",
    "charger_matches": "charger_id bigint, augmentation_source string, match_method string, match_distance_m double, source_poi_id string, ext_operator_id bigint, ext_name string, ext_address string, ext_postcode string, usage_cost string, price_per_kwh double, num_points int, num_connectors int, rate_kw double",
    "charger_plug_types": "charger_id bigint, plug_type_id bigint",
}
NEEDED = [
    "charger_id", "station_name", "station_address", "latitude", "longitude", "lga_name", "postcode", "source", "operator", "number_of_plugs", "charger_type", "status",
    "charger_rating_kw", "sa4_code", "sa4_assignment", "augmentation_source", "match_method", "match_distance_m", *PAYLOAD,
]
SIMPLIFY_DEG = 0.0005
RULES = {
    "sa4_regions": Rules(("sa4_code",), required=("sa4_name", "geom", "state_name")),
    "operators": Rules(("operator_id",), (("operator_name",),), ("operator_name",)),
    "locations": Rules(("location_id",), required=("geom",), checks={"sa4_assignment": "sa4_assignment in ('within', 'nearest')"}, references={"sa4_code": ("sa4_regions", "sa4_code")}),
    "chargers": Rules(
        ("charger_id",),
        required=("location_id", "operator_id", "status"),
        checks={"charger_type": "charger_type in ('AC', 'DC')", "status": "status in ('existing', 'upcoming')", "charger_rating_kw": "charger_rating_kw > 0", "number_of_plugs": "number_of_plugs > 0"},
        references={"location_id": ("locations", "location_id"), "operator_id": ("operators", "operator_id")},
    ),
    "plug_types": Rules(("plug_type_id",), (("plug_type_name",),), ("plug_type_name",)),
    "charger_matches": Rules(
        ("charger_id",),
        required=("augmentation_source", "match_method", "match_distance_m", "source_poi_id"),
        checks={"augmentation_source": "augmentation_source in ('open_charge_map', 'openstreetmap')", "match_method": "match_method in ('operator_and_distance', 'distance_only')", "price_per_kwh": "price_per_kwh >= 0", "rate_kw": "rate_kw > 0"},
        references={"charger_id": ("chargers", "charger_id"), "ext_operator_id": ("operators", "operator_id")},
    ),
    "charger_plug_types": Rules(("charger_id", "plug_type_id"), references={"charger_id": ("charger_matches", "charger_id"), "plug_type_id": ("plug_types", "plug_type_id")}),
}


def _with_id(df: DataFrame, column: str, table: DataFrame, id_name: str, value_name: str, as_name: str | None = None) -> DataFrame:
    """The value's id in place of the column; NULL for NULL."""
    ids = table.select(F.col(id_name).alias(as_name or id_name), F.col(value_name).alias(column))
    return df.join(ids, column, "left").drop(column)


def build_tables(augmented: DataFrame, regions: DataFrame) -> dict[str, DataFrame]:
    """regions(sa4_code, sa4_name, gcc_name, state_name, area_sqkm, rings). Missing columns are named; each table has the
    columns and types of TYPES, in their order."""
    require_columns(augmented, NEEDED)
    require_columns(regions, ["sa4_code", "sa4_name", "gcc_name", "state_name", "area_sqkm", "rings"])
    names = augmented.select(F.col("operator").alias("name")).unionByName(augmented.select(F.col("ext_operator").alias("name")))
    operators = R.lookup(names, "name", "operator_id", "operator_name")
    placed = R.number_groups(augmented, ["latitude", "longitude"], "location_id")
    locations = R.first_per_group(placed, ["location_id"], ["charger_id"]).select(
        "location_id", F.col("station_address").alias("address"), "postcode", "lga_name", F.when(F.col("longitude").isNotNull() & F.col("latitude").isNotNull(), F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y"))).alias("geom"), "sa4_code", "sa4_assignment"
    )
    chargers = _with_id(placed, "operator", operators, "operator_id", "operator_name")
    chargers = chargers.select("charger_id", "location_id", "operator_id", "station_name", "charger_type", "status", "charger_rating_kw", "number_of_plugs", "source")
    matched = augmented.where(F.col("augmentation_source").isNotNull())
    matches = _with_id(matched.select("charger_id", "augmentation_source", "match_method", "match_distance_m", *PAYLOAD), "ext_operator", operators, "operator_id", "operator_name", "ext_operator_id")
    plugs = R.split_rows(matched.select("charger_id", "plug_types"), "plug_types")
    plug_types = R.lookup(plugs, "plug_types", "plug_type_id", "plug_type_name")
    made = {
        "sa4_regions": regions.where(F.col("rings").isNotNull()).withColumnRenamed("rings", "geom"),
        "operators": operators,
        "locations": locations,
        "chargers": chargers,
        "plug_types": plug_types,
        "charger_matches": matches.select(
            "charger_id", "augmentation_source", "match_method", "match_distance_m", "source_poi_id", "ext_operator_id", "ext_name", "ext_address", "ext_postcode", "usage_cost", "price_per_kwh", "num_points", "num_connectors", "rate_kw"
        ),
        "charger_plug_types": _with_id(plugs, "plug_types", plug_types, "plug_type_id", "plug_type_name").distinct(),
    }
    return {name: conform(df, TYPES[name]) for name, df in made.items()}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns that ddl names, in its order and of its types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)))


def charger_view(t: dict[str, DataFrame]) -> DataFrame:
    """Each charger with its operator, place and region, if it has one."""
    joined = t["chargers"].join(t["operators"], "operator_id").join(t["locations"], "location_id").join(t["sa4_regions"].select("sa4_code", "sa4_name", "state_name"), "sa4_code", "left")
    return joined.select(
        "charger_id", "station_name", "operator_name", "charger_type", "status", "charger_rating_kw", "number_of_plugs", "source",
        "address", "postcode", "lga_name", F.col("geom.y").alias("latitude"), F.col("geom.x").alias("longitude"), "sa4_code", "sa4_name", "state_name",
    )


def coverage_view(t: dict[str, DataFrame]) -> DataFrame:
    """Every region with its existing chargers, none too."""
    existing = t["chargers"].where(F.col("status") == "existing").select("charger_id", "charger_type", "location_id")
    joined = t["sa4_regions"].join(t["locations"].select("sa4_code", "location_id"), "sa4_code", "left").join(existing, "location_id", "left")
    return joined.groupBy("sa4_code", "sa4_name", "state_name", "area_sqkm").agg(
        F.count("charger_id").alias("existing_chargers"), F.count(F.when(F.col("charger_type") == "DC", F.col("charger_id"))).alias("existing_dc_chargers")
    )


def store_tables(tables: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Each written over what was there, and read again; the views are registered."""
    out = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")
        out[name].createOrReplaceTempView(name)
    charger_view(out).createOrReplaceTempView("v_chargers")
    coverage_view(out).createOrReplaceTempView("v_sa4_coverage")
    return out


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).parquet(f"{root}/{name}") for name, ddl in TYPES.items()}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()))


def verify(tables: dict[str, DataFrame], rows: int | None = None, strict: bool = False) -> DataFrame:
    """problem, n: broken rules, a wrong number of chargers, and places outside their region (those assigned to the nearest
    one only if strict)."""
    found = [violations(name, tables, rules) for name, rules in RULES.items()]
    if rows is not None:
        found.append(tables["chargers"].agg(F.count("*").alias("n")).where(F.col("n") != rows).select(F.lit(f"chargers: not {rows} rows").alias("problem"), "n"))
    placed = tables["locations"].select("sa4_code", "sa4_assignment", "geom.x", "geom.y")
    place = agreement(placed, tables["sa4_regions"].select("sa4_code", F.col("geom").alias("rings")), "sa4_code", "sa4_assignment")
    outside = place.where((F.col("sa4_assignment") == "within") | F.lit(strict)).withColumn("n", F.col("points") - F.col("inside")).where("n > 0")
    found.append(outside.select(F.concat(F.lit("locations outside their region: "), F.coalesce("sa4_assignment", F.lit("none"))).alias("problem"), "n"))
    return reduce(DataFrame.unionByName, found)


def coverage(tables: dict[str, DataFrame], state: str) -> DataFrame:
    """One row: a state's regions, those without a charger and without a DC charger, and of all DC chargers those matched."""
    view = coverage_view(tables).where(F.col("state_name") == state)
    gaps = view.agg(F.count("*").alias("regions"), F.count_if(F.col("existing_chargers") == 0).alias("without_charger"), F.count_if(F.col("existing_dc_chargers") == 0).alias("without_dc_charger"))
    direct = tables["chargers"].agg(F.count_if(F.col("charger_type") == "DC").alias("dc_chargers"))
    matched = tables["charger_matches"].agg(F.count("*").alias("matched"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(gaps).join(one(direct), "__one").join(one(matched), "__one").drop("__one").withColumn("share", R.ratio(F.col("matched").cast("double"), F.col("dc_chargers").cast("double")))
