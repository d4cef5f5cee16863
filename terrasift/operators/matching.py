"""Audited matching of DC chargers with sites of an external source, by distance, operator, postcode and street number."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geo import albers, round1
from terrasift.functions.text import number_range, range_gap
from terrasift.operators.relational import hold
from terrasift.operators.spatial import distance_join

# What a match carries over, and the audit's columns.
PAYLOAD = ["source_poi_id", "ext_operator", "ext_name", "ext_address", "ext_postcode", "usage_cost", "price_per_kwh", "plug_types", "num_points", "num_connectors", "rate_kw"]
AUDIT = ["charger_id", "operator", "station_address", "postcode", "source", "decision", "match_method", "distance_m", "candidate_operator", "candidate_address", "candidate_postcode", "reject_reason"]
FOCUS = ["Evie", "JOLT", "Chargefox", "Exploren", "Ampol", "BP", "Tesla", "NRMA"]


@dataclass(frozen=True)
class Radii:
    operator: float = 500.0
    alone: float = 50.0
    trust: float = 50.0
    street_numbers: int = 10


def true(c: Column) -> Column:
    """NULL as false: two missing values are never the same."""
    return F.coalesce(c, F.lit(False))


# What decides about a charger and about a site: rows that agree in these are one kind.
OWN = ["longitude", "latitude", "operator", "postcode", "numbers"]
STATED = ["longitude", "latitude", "operator", "postcode", "station_address"]
THEIRS = ["lon", "lat", "ext_operator", "ext_postcode", "ext_numbers"]


def candidate_pairs(chargers: DataFrame, sites: DataFrame, radii: Radii = Radii()) -> DataFrame:
    """Pairs within the operators' radius, measured in the plane, with their flags. Radii other than the join's hold the
    distance rounded to one decimal. Chargers come with numbers and sites with ext_numbers, the ranges of their addresses."""
    x, y = albers(F.col("longitude"), F.col("latitude"))
    sx, sy = albers(F.col("lon"), F.col("lat"))
    pairs = distance_join(chargers.withColumns({"x": x, "y": y}), sites.withColumns({"sx": sx, "sy": sy}), radii.operator)
    pairs = pairs.withColumn("distance_m", round1(F.col("d"))).drop("x", "y", "sx", "sy", "d")
    same = true(F.col("operator") == F.col("ext_operator"))
    pairs = pairs.withColumns(
        {
            "same_operator": same,
            "postcode_conflict": true(F.col("postcode") != F.col("ext_postcode")),
            "street_conflict": true(range_gap(F.col("numbers"), F.col("ext_numbers")) > radii.street_numbers) & (F.col("distance_m") > radii.trust),
            "match_method": F.when(same, "operator_and_distance").otherwise("distance_only"),
        }
    )
    conflict = F.col("postcode_conflict") | F.col("street_conflict")
    return pairs.withColumn("conflict", conflict).where(F.col("same_operator") | (F.col("distance_m") <= radii.alone))


def _best(pair: Column) -> tuple[Column, Column]:
    """What a pair without a conflict, and one with, comes in the order of; NULL for the others, which are passed over."""
    near = [pair["distance_m"].alias("distance_m"), pair["source_poi_id"].alias("source_poi_id")]
    return F.when(~pair["conflict"], F.struct((~pair["same_operator"]).alias("other"), *near)), F.when(pair["conflict"], F.struct(*near))


def _alike(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """left with what right has besides columns, where they agree in these (NULL equals NULL)."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in columns})
    both = left.join(right, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns)))
    return both.drop(*(f"__{c}" for c in columns))


def verdicts(chargers: DataFrame, sites: DataFrame, radii: Radii = Radii(), broadcast_rows: int = 100_000) -> DataFrame:
    """Per charger that has pairs (charger_id) the best pair without a conflict (good): the same operator first, then the
    nearest; and the nearest conflicting one (bad). Of equally good ones the site with the smallest id counts.

    Chargers and sites meet by kind, however many rows are of one: chargers at a place differ in their id alone, and of a kind
    of sites only the smallest id can be the best. A kind's verdict is then each of its chargers'. Only ids that repeat are
    brought together. The chargers' different rows are held; up to broadcast_rows of them their verdicts are broadcast."""
    own = chargers.select("charger_id", *STATED)
    # Held, or Spark would work the projection out for every charger to drop those without a place.
    stated = hold(own.select(*STATED).distinct())
    few = stated.count() <= broadcast_rows
    kinds = stated.withColumn("numbers", number_range(F.col("station_address")))
    theirs = sites.withColumn("ext_numbers", number_range(F.col("ext_address")))
    rest = F.struct(*(c for c in theirs.columns if c not in THEIRS))
    theirs = theirs.groupBy(*THEIRS).agg(F.min_by(rest, F.struct("source_poi_id")).alias("site")).select(*THEIRS, "site.*")
    pairs = candidate_pairs(kinds.select(*OWN).distinct(), theirs, radii)
    pairs = pairs.select(*OWN, F.struct(*(c for c in pairs.columns if c not in OWN)).alias("p"))
    clean, conflicting = _best(F.col("p"))
    of_kind = pairs.groupBy(*OWN).agg(F.min_by("p", clean).alias("good"), F.min_by("p", conflicting).alias("bad"))
    found = _alike(kinds, of_kind, OWN).select(*STATED, "good", "bad")
    each = lambda rows: _alike(rows, F.broadcast(found) if few else found, STATED).select("charger_id", "good", "bad")
    again = own.groupBy(F.col("charger_id").alias("__id")).count().where("count > 1").select("__id")
    if again.isEmpty():
        return each(own)
    repeats = F.col("charger_id").eqNullSafe(F.col("__id"))
    merged = each(own.join(again, repeats, "left_semi")).groupBy("charger_id").agg(F.min_by("good", _best(F.col("good"))[0]).alias("good"), F.min_by("bad", _best(F.col("bad"))[1]).alias("bad"))
    return each(own.join(again, repeats, "left_anti")).unionByName(merged)


def accepted(verdicts: DataFrame) -> DataFrame:
    """Per charger the best pair without a conflict."""
    return verdicts.where(F.col("good").isNotNull()).select("charger_id", "good.*")


def _reason(pair: Column) -> Column:
    return F.concat_ws("+", F.when(pair["postcode_conflict"], "postcode_conflict"), F.when(pair["street_conflict"], "address_conflict"))


def rejected(verdicts: DataFrame) -> DataFrame:
    """Per charger that has pairs, but only conflicting ones, the nearest of them."""
    return verdicts.where(F.col("good").isNull()).select("charger_id", "bad.*", _reason(F.col("bad")).alias("reject_reason"))


def match(chargers: DataFrame, sites: DataFrame, source: str, radii: Radii = Radii()) -> tuple[DataFrame, DataFrame]:
    """Matches (charger_id, augmentation_source, payload, method, distance) and the audit, one row per charger of which
    each is accepted, rejected or has no candidate. Both are typed and complete for empty inputs too. The verdicts, a row
    per charger with pairs, are held: both results and the next source read them."""
    held = hold(verdicts(chargers, sites, radii))
    good = held.where(F.col("good").isNotNull())
    matches = good.select("charger_id", F.lit(source).alias("augmentation_source"), *(F.col(f"good.{c}").alias(c) for c in (*PAYLOAD, "match_method")), F.col("good.distance_m").alias("match_distance_m"))
    found = held.select("charger_id", F.coalesce("good", "bad").alias("p"), F.col("good").isNotNull().alias("yes"))
    values = {
        "source": F.lit(source),
        "decision": F.when(F.col("yes"), "accepted").when(~F.col("yes"), "rejected").otherwise("no_candidate"),
        "match_method": F.col("p.match_method"), "distance_m": F.col("p.distance_m"), "candidate_operator": F.col("p.ext_operator"),
        "candidate_address": F.col("p.ext_address"), "candidate_postcode": F.col("p.ext_postcode"), "reject_reason": F.when(~F.col("yes"), _reason(F.col("p"))),
    }
    own = chargers.select("charger_id", "operator", "station_address", "postcode")
    return matches, own.join(found, "charger_id", "left").select(*(values[c].alias(c) if c in values else c for c in AUDIT))


def cascade(chargers: DataFrame, sources: list[tuple[str, DataFrame]], radii: Radii = Radii()) -> tuple[DataFrame, DataFrame]:
    """Each source is held against what those before it left unmatched."""
    left, matches, audits = chargers, None, None
    for name, sites in sources:
        m, a = match(left, sites, name, radii)
        left = left.join(m.select("charger_id"), "charger_id", "left_anti")
        matches = m if matches is None else matches.unionByName(m)
        audits = a if audits is None else audits.unionByName(a)
    return matches, audits


def decisions(audit: DataFrame) -> DataFrame:
    """Per source how many chargers had each decision."""
    return audit.groupBy("source").agg(*(F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "rejected", "no_candidate")))


def only_conflicting(audit: DataFrame) -> DataFrame:
    """Chargers that some source rejected and none accepted."""
    ids = lambda d: audit.where(F.col("decision") == d).select("charger_id").distinct()
    return ids("rejected").join(ids("accepted"), "charger_id", "left_anti")


def focus_coverage(chargers: DataFrame, matches: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per operator of a fixed list (FOCUS), with none left out: total and matched."""
    spark = chargers.sparkSession
    listed = spark.createDataFrame([(n,) for n in (FOCUS if names is None else names)], "operator string")
    flagged = chargers.join(matches.select("charger_id", F.lit(1).alias("__m")), "charger_id", "left")
    counts = flagged.groupBy("operator").agg(F.count("*").alias("total"), F.count("__m").alias("matched"))
    return F.broadcast(listed).join(counts, "operator", "left").fillna(0, ["total", "matched"])
