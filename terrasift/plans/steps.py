"""The three steps as calls: inputs by path, outputs written to a folder, and a report of one row per figure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators import matching as M
from terrasift.operators.quality import raise_all
from terrasift.operators.relational import release
from terrasift.operators.simplify import simplify
from terrasift.plans import augmenting, cleaning, storing
from terrasift.sources import delimited, feeds, shapefile

# The outputs' names, the boundary file's attributes, and the columns' types when outputs are read again.
CLEANED, COMPLETENESS, AUGMENTED, AUDIT = "ev_chargers_cleaned", "data_completeness", "ev_chargers_augmented", "augmentation_audit"
SHAPES = {"SA4_CODE26": "sa4_code", "SA4_NAME26": "sa4_name", "GCC_NAME26": "gcc_name", "STE_NAME26": "state_name", "AREASQKM26": "area_sqkm"}
CLEANED_TYPES = (
    "charger_id bigint, source_objectid bigint, station_name string, station_address string, latitude double, longitude double, lga_name string, postcode string, source string, operator string, number_of_plugs int, "
    "charger_type string, status string, charger_rating_raw string, charger_rating_kw double, sa4_code string, sa4_name string, sa4_assignment string, sa4_distance_m double"
)
PAYLOAD_TYPES = (
    "augmentation_source string, source_poi_id string, ext_operator string, ext_name string, ext_address string, ext_postcode string, usage_cost string, price_per_kwh double, plug_types string, "
    "num_points int, num_connectors int, rate_kw double, match_method string, match_distance_m double"
)
COMPLETENESS_TYPES = "stage string, column string, non_null bigint, total bigint, pct_complete double"
AUDIT_TYPES = (
    "charger_id bigint, operator string, station_address string, postcode string, source string, decision string, match_method string, distance_m double, candidate_operator string, candidate_address string, "
    "candidate_postcode string, reject_reason string"
)


def _figures(df: DataFrame, **figures: Column) -> DataFrame:
    """figure, n: aggregates of df in one scan."""
    counted = df.agg(*(c.alias(k) for k, c in figures.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("figure"), F.col(k).cast("bigint").alias("n")) for k in figures))).alias("r")).select("r.*")


def _counts(df: DataFrame, what: str, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{what}: "), F.col(column)).alias("figure"), "n")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return shapefile.read_shapes(spark, path, list(SHAPES)).withColumnsRenamed(SHAPES).where(F.col("rings").isNotNull())


def clean_step(spark: SparkSession, raw_csv: str, shapes: str, out: str) -> DataFrame:
    """Writes the clean rows and the completeness of both stages below out; reports rows before and after, assignments and
    statuses."""
    raw = delimited.read_text(spark, raw_csv, cleaning.REQUIRED)
    rows, share = cleaning.clean(raw, read_regions(spark, shapes))
    delimited.write_text(rows.orderBy("charger_id"), f"{out}/{CLEANED}")
    delimited.write_text(share, f"{out}/{COMPLETENESS}")
    release()
    again = read_cleaned(spark, out)
    parts = [
        _figures(raw, raw_rows=F.count("*")), _figures(again, clean_rows=F.count("*"), without_region=F.count_if(F.col("sa4_code").isNull())),
        _counts(again, "region", "sa4_assignment"), _counts(again, "status", "status"),
    ]
    return reduce(DataFrame.unionByName, parts)


def read_cleaned(spark: SparkSession, out: str) -> DataFrame:
    return delimited.read_typed(spark, f"{out}/{CLEANED}", CLEANED_TYPES)


def augment_step(spark: SparkSession, records_json: str, elements_json: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Reads the clean rows below out and writes the augmented rows and the audit there. Reports figures, and per operator
    of interest how many DC chargers there are and how many were matched."""
    chargers = read_cleaned(spark, out)
    first = feeds.flatten_records(feeds.read_json(spark, records_json, feeds.RECORDS))
    second = feeds.flatten_elements(feeds.read_json(spark, elements_json, feeds.ELEMENTS, "elements"))
    rows, audit = augmenting.augment(chargers, first, second)
    delimited.write_text(audit, f"{out}/{AUDIT}")
    delimited.write_text(rows.orderBy("charger_id"), f"{out}/{AUGMENTED}")
    release()
    again, trail = read_augmented(spark, out), read_audit(spark, out)
    direct = again.where(F.col("charger_type") == "DC")
    matched = direct.where(F.col("augmentation_source").isNotNull())
    per_source = M.decisions(trail).unpivot("source", ["accepted", "rejected", "no_candidate"], "decision", "n").select(F.concat_ws(" ", "source", "decision").alias("figure"), "n")
    figures = _figures(direct, dc_chargers=F.count("*"), matched=F.count("augmentation_source")).unionByName(_figures(M.only_conflicting(trail), only_conflicting=F.count("*")))
    return figures.unionByName(per_source), M.focus_coverage(direct, matched)


def read_augmented(spark: SparkSession, out: str) -> DataFrame:
    return delimited.read_typed(spark, f"{out}/{AUGMENTED}", f"{CLEANED_TYPES}, {PAYLOAD_TYPES}")


def read_audit(spark: SparkSession, out: str) -> DataFrame:
    return delimited.read_typed(spark, f"{out}/{AUDIT}", AUDIT_TYPES)


def store_step(spark: SparkSession, out: str, shapes: str, root: str, state: str = "New South Wales") -> DataFrame:
    """Reads the augmented rows below out and builds the tables at root, with simplified regions. Raises if a rule is
    broken; reports the state's coverage in one row."""
    rows = read_augmented(spark, out)
    regions = simplify(read_regions(spark, shapes), storing.SIMPLIFY_DEG)
    tables = storing.store_tables(storing.build_tables(rows, regions), root)
    release()
    raise_all(storing.verify(tables, rows=rows.count(), strict=False))
    return storing.coverage(tables, state)
