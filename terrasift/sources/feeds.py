"""Site feeds as JSON, flattened to one shape of candidate sites by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.functions.text import canonical_name, first_filled, joined, or_null, postcode, price_per_kwh, street_address, strip

RECORDS = """array<struct<ID:bigint,UsageCost:string,NumberOfPoints:int,OperatorInfo:struct<Title:string>,
AddressInfo:struct<Title:string,AddressLine1:string,AddressLine2:string,Postcode:variant,Latitude:double,Longitude:double>,
Connections:array<struct<ConnectionType:struct<Title:string>,CurrentType:struct<Title:string>,PowerKW:double,Quantity:int>>>>"""
ELEMENTS = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>"

# Titles and tags of direct-current connectors, and tags' plug names.
DC_TITLES = ("CCS", "CHAdeMO", "Tesla")
DC_SOCKETS = ("chademo", "tesla_supercharger", "tesla_supercharger_ccs", "type1_combo", "type2_combo")
PLUG_NAMES = {
    "type2_combo": "CCS (Type 2)",
    "type1_combo": "CCS (Type 1)",
    "chademo": "CHAdeMO",
    "tesla_supercharger": "Tesla (Model S/X)",
    "tesla_supercharger_ccs": "CCS (Type 2)",
    "type2": "Type 2 (Socket Only)",
    "type1": "Type 1 (J1772)",
    "tesla": "Tesla (Model S/X)",
    "as3112": "Type I (AS 3112)",
}
WATTS_ABOVE = 1000


def read_json(spark: SparkSession, path: str, schema: str, member: str | None = None) -> DataFrame:
    """A row per record of JSON documents, one per file, each an array or an object that has one. A document is read by one
    task and must fit into its memory; what is to be split is kept as Parquet after the first read."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    return parsed.select(F.explode(F.col(f"j.{member}") if member else F.col("j")).alias("r")).select("r.*")


def flatten_records(records: DataFrame) -> DataFrame:
    """Sites from records with connections (RECORDS)."""
    connections = F.coalesce("Connections", F.array().cast("array<struct<ConnectionType:struct<Title:string>,CurrentType:struct<Title:string>,PowerKW:double,Quantity:int>>"))
    titles = F.transform(connections, lambda c: strip(F.coalesce(c["ConnectionType"]["Title"], F.lit(""))))
    direct = F.exists(connections, lambda c: F.coalesce(c["CurrentType"]["Title"] == "DC", F.lit(False)))
    named = F.exists(titles, lambda t: t.rlike("^(?:" + "|".join(DC_TITLES) + ")"))
    plugs = F.aggregate(connections, F.lit(0), lambda n, c: n + F.when(F.coalesce(c["Quantity"], F.lit(0)) == 0, 1).otherwise(c["Quantity"]))
    cost = or_null(strip(F.col("UsageCost")))
    a = "AddressInfo"
    return records.select(
        F.col("ID").cast("string").alias("source_poi_id"),
        canonical_name(F.col("OperatorInfo.Title")).alias("ext_operator"),
        F.col(f"{a}.Title").alias("ext_name"),
        street_address(F.col(f"{a}.AddressLine1"), F.col(f"{a}.AddressLine2")).alias("ext_address"),
        postcode(F.when(F.schema_of_variant(F.col(f"{a}.Postcode")) == "STRING", F.variant_get(F.col(f"{a}.Postcode"), "$", "string"))).alias("ext_postcode"),  # text only, no number
        cost.alias("usage_cost"),
        price_per_kwh(cost).alias("price_per_kwh"),
        joined(titles).alias("plug_types"),
        F.col("NumberOfPoints").alias("num_points"),
        F.nullif(plugs, F.lit(0)).alias("num_connectors"),
        F.array_max(F.transform(connections, lambda c: c["PowerKW"])).alias("rate_kw"),
        (direct | named).alias("has_dc"),
        F.col(f"{a}.Latitude").alias("lat"),
        F.col(f"{a}.Longitude").alias("lon"),
    )


def flatten_elements(elements: DataFrame) -> DataFrame:
    """Sites from tagged elements (ELEMENTS): nodes with their own place, others with their centre's."""
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    sockets = F.filter(F.map_entries(tags), lambda e: e["key"].rlike("^socket:[^:]*\\z"))
    keys = F.transform(sockets, lambda e: F.substring_index(e["key"], ":", -1))
    table = F.create_map(*(F.lit(x) for pair in PLUG_NAMES.items() for x in pair))
    whole = lambda v: F.when(strip(v).rlike(r"^[+-]?[0-9]+\z"), strip(v).try_cast("int"))
    plugs = F.aggregate(sockets, F.lit(0), lambda n, e: n + F.coalesce(whole(e["value"]), F.lit(1)))
    outputs = F.filter(F.map_entries(tags), lambda e: e["key"].endswith(":output"))
    rates = F.flatten(F.transform(outputs, lambda e: F.transform(F.regexp_extract_all(e["value"], F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.try_cast("double"))))
    kilowatts: Column = F.transform(rates, lambda r: F.when(r > WATTS_ABOVE, r / 1000).otherwise(r))
    tag = lambda k: F.element_at(tags, F.lit(k))
    street = or_null(strip(F.concat(F.coalesce(tag("addr:housenumber"), F.lit("")), F.lit(" "), F.coalesce(tag("addr:street"), F.lit("")))))
    node = F.col("type") == "node"
    return elements.select(
        F.concat("type", F.lit("/"), F.col("id").cast("string")).alias("source_poi_id"),
        canonical_name(first_filled(tag("operator"), tag("brand"))).alias("ext_operator"),
        tag("name").alias("ext_name"),
        street.alias("ext_address"),
        postcode(tag("addr:postcode")).alias("ext_postcode"),
        F.lit(None).cast("string").alias("usage_cost"),
        F.lit(None).cast("double").alias("price_per_kwh"),
        joined(F.transform(keys, lambda k: F.element_at(table, k))).alias("plug_types"),
        F.when(tag("capacity").rlike(r"^[0-9]+\z"), tag("capacity").try_cast("int")).alias("num_points"),
        F.nullif(plugs, F.lit(0)).alias("num_connectors"),
        F.array_max(kilowatts).alias("rate_kw"),
        F.arrays_overlap(keys, F.array(*map(F.lit, DC_SOCKETS))).alias("has_dc"),
        F.when(node, F.col("lat")).otherwise(F.col("center.lat")).alias("lat"),
        F.when(node, F.col("lon")).otherwise(F.col("center.lon")).alias("lon"),
    )
