"""Operators on hand-made rows, against brute force and against plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.functions import text as T
from terrasift.operators import matching as M
from terrasift.operators import quality as Q
from terrasift.operators import relational as R
from terrasift.operators import spatial as S
from terrasift.operators.simplify import simplify

RINGS = "code string, rings array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def square(x, y, n):
    return ring((x, y), (x + n, y), (x + n, y + n), (x, y + n))


def test_merge_duplicates(spark):
    rows = [
        (1, 1, None, "a", 1), (1, 1, "x", None, 2), (2, 2, "x", "a", 3), (2, 2, "y", "b", 4), (3, 3, "A", None, 5), (3, 3, "A", None, 6), (3, 3, "B", None, 7), (None, 4, "n", None, 8), (None, 4, None, "c", 9),
    ]
    df = spark.createDataFrame(rows, "k int, j int, name string, v string, i int")
    got = {tuple(r) for r in R.merge_duplicates(df, ["k", "j"], "name", "i").collect()}
    assert got == {(1, 1, "x", "a", 1), *rows[2:7], (None, 4, "n", "c", 8)}


def test_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 101, None if i % 5 == 0 else i % 3) for i in range(101)], "v int, g int").repartition(4)
    assert [(r.v, r.id) for r in R.number_rows(df, ["v"], "id").orderBy("v").collect()] == [(i, i + 1) for i in range(101)]
    groups = R.number_groups(df, ["g"], "id").select("g", "id").distinct().collect()
    assert {(r.g, r.id) for r in groups} == {(None, 1), (0, 2), (1, 3), (2, 4)}
    assert R.number_rows(df.limit(0), ["v"], "id").count() == 0
    with pytest.raises(ValueError):
        R.left_join_once(df, df.select("v"), "g")


def test_held_rows_are_released(spark):
    df = spark.range(50).select(F.col("id").alias("v"))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert R.number_rows(df, [F.desc("v")], "id").where("id = 50 - v").count() == 50
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) > before
    R.release()
    assert not R._HELD


def test_albers_reference_point(spark):
    x, y = geo.albers(F.lit(151.2), F.lit(-33.87))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 1760115.358) < 0.001 and abs(r.y + 3828753.558) < 0.001


def test_distance_join_is_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.randrange(40) * 100.0, rng.randrange(40) * 100.0) for i in range(200)]
    b = [(i, rng.randrange(40) * 100.0, rng.randrange(40) * 100.0) for i in range(150)]
    got = S.distance_join(spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, sx double, sy double"), 500.0)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = [(r.i, r.j) for r in got.collect()]
    assert sorted(pairs) == sorted((i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 500)


def test_within_and_nearest(spark):
    regions = spark.createDataFrame(
        [("hole", [square(0, 0, 10), square(4, 4, 2)]), ("parts", [square(20, 0, 2), square(30, 0, 2)]), ("bent", [ring((0, 20), (10, 20), (10, 30), (5, 22), (0, 30))]), ("over", [square(21, 1, 3)])], RINGS
    )
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 0.0, 5.0), (4, 31.0, 1.0), (5, 5.0, 28.0), (6, 1.0, 26.0), (7, 21.5, 1.5), (8, -1.0, 5.0), (9, -50.0, 0.0)], "k int, x double, y double")
    found = S.within(points, regions, "code", size=3.0)
    assert sorted((r.k, r.code) for r in found.collect()) == [(1, "hole"), (4, "parts"), (6, "bent"), (7, "over"), (7, "parts")]
    assert [r.code for r in S.first_region(found, "k", "code").where("k = 7").collect()] == ["over"]
    near = S.nearest(points.where("k in (3, 8, 9)"), regions, "k", "code", 2.0)
    assert sorted((r.k, r.code, r.distance) for r in near.collect()) == [(3, "hole", 0.0), (8, "hole", 1.0)]


def test_nearest_and_within_are_brute_force(spark):
    """Long, steep and level edges; many points; cells much smaller than the regions."""
    rng = random.Random(3)
    shapes = {f"r{i}": [[(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(rng.randrange(3, 8))]] for i in range(5)} | {"box": [[(0, -60), (0, 60), (5, 60), (5, -60)]]}
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(300)] + [(900, 0.0, 1.0), (901, 5.0, 60.0), (902, 2.0, 0.0)]
    regions = spark.createDataFrame([(c, [ring(*r) for r in rings]) for c, rings in shapes.items()], RINGS)
    df = spark.createDataFrame(points, "k int, x double, y double")

    def away(x, y, a, b):
        (ax, ay), (bx, by) = a, b
        square = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square)) if square else 0.0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    edges = {c: [(a, b) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)] for c, rings in shapes.items()}
    inside = {(k, c) for k, x, y in points for c, es in edges.items() if min(away(x, y, a, b) for a, b in es) > 0 and sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in es) % 2}
    assert {(r.k, r.code) for r in S.within(df, regions, "code", size=7.0).collect()} == inside and (902, "box") in inside
    least = {k: min((min(away(x, y, a, b) for a, b in es), c) for c, es in edges.items()) for k, x, y in points}
    assert {r.k: (r.code, r.distance) for r in S.nearest(df, regions, "k", "code", 3.0).collect()} == {k: (c, round(d, 1)) for k, (d, c) in least.items() if d <= 3}


def test_simplify(spark):
    wave = [(i / 10, 0.0001 * (i % 2)) for i in range(100)]
    regions = spark.createDataFrame([("a", [ring(*wave, (5, 9))]), ("b", None)], RINGS)
    out = {r.code: r.rings for r in simplify(regions, 0.01).collect()}
    assert len(out["a"][0]) == 4 and out["b"] is None


CHARGERS = "charger_id int, operator string, station_address string, postcode string, latitude double, longitude double"
METRE = 1 / 110900  # degrees north, near enough for the cases


def _site(i, operator, metres, at, postcode=None, address=None):
    return (str(i), operator, None, address, postcode, None, None, None, None, None, None, -33.0 - at + metres * METRE, 151.0)


def test_matching_cases(spark):
    sites, chargers, expected = [], [], {}

    def case(decision, method, operator, *candidates, reason=None):
        k = len(chargers) + 1
        chargers.append((k, operator, "1 Main St", "2000", -33.0 - k / 10, 151.0))
        sites.extend(_site(100 * k + n, o, m, k / 10, **more) for n, (o, m, more) in enumerate(candidates))
        expected[k] = (decision, method, reason)

    case("accepted", "operator_and_distance", "A", ("A", 400, {}), ("B", 10, {}))
    case("accepted", "distance_only", "A", ("A", 300, {"address": "90 Main St"}), ("B", 20, {}))
    case("rejected", "operator_and_distance", "A", ("A", 1.7, {"postcode": "2001"}), reason="postcode_conflict")
    case("accepted", "operator_and_distance", "A", ("A", 30, {"address": "90 Main St"}))
    case("rejected", "operator_and_distance", "A", ("A", 454, {"postcode": "2001", "address": "90 X"}), reason="postcode_conflict+address_conflict")
    case("no_candidate", None, "A", ("B", 60, {}))
    case("no_candidate", None, None, (None, 100, {}))
    case("no_candidate", None, "A")
    schema = "source_poi_id string, ext_operator string, ext_name string, ext_address string, ext_postcode string, usage_cost string, price_per_kwh double, plug_types string, num_points int, num_connectors int, rate_kw double, lat double, lon double"
    chargers, feed = spark.createDataFrame(chargers, CHARGERS), spark.createDataFrame(sites, schema)
    matches, audit = M.match(chargers, feed, "feed")
    assert {r.charger_id: (r.decision, r.match_method, r.reject_reason) for r in audit.collect()} == expected
    assert matches.count() == 3
    matches, audit = M.cascade(chargers, [("none", feed.limit(0)), ("feed", feed)])
    assert M.decisions(audit).where("source = 'none'").first()["no_candidate"] == len(expected)
    assert {r.charger_id for r in M.only_conflicting(audit).collect()} == {3, 5}
    assert M.match(chargers.limit(0), feed, "feed")[1].count() == 0


def test_matching_meets_by_kind(spark, monkeypatch):
    """However many chargers and sites are alike, one of each kind is paired; results are those of all pairs."""
    rng, met = random.Random(4), []
    join = M.distance_join
    monkeypatch.setattr(M, "distance_join", lambda left, right, radius: met.append((left.count(), right.count())) or join(left, right, radius))
    chargers = [(i, rng.choice(["A", "B", None]), rng.choice(["1 Main St", "1 Main Street", "40 Side St", None]), rng.choice(["2000", None]), -33.0 - rng.choice([0, 100, 480]) * METRE, 151.0) for i in range(300)]
    chargers += [(0, "A", "1 Main St", "2000", -33.0, 151.0), (301, "A", None, None, None, 151.0)]  # an id twice; no place
    sites = [_site(i, rng.choice(["A", "B", None]), rng.choice([0, 20, 400]), 0, rng.choice(["2000", "2001", None]), rng.choice(["1 Main St", "90 Main St", "90 Main Rd"])) for i in range(300)]
    schema = "source_poi_id string, ext_operator string, ext_name string, ext_address string, ext_postcode string, usage_cost string, price_per_kwh double, plug_types string, num_points int, num_connectors int, rate_kw double, lat double, lon double"
    own, feed = spark.createDataFrame(chargers, CHARGERS), spark.createDataFrame(sites, schema)
    verdicts = M.verdicts(own, feed)
    number = lambda address: address and address.split()[0]
    assert met == [(len({(o, number(a), p, y, x) for _, o, a, p, y, x in chargers}), len({(s[1], number(s[3]), s[4], s[11], s[12]) for s in sites}))]

    def best(rows, order):
        out = {}
        for r in rows:
            if r.charger_id not in out or order(r) < order(out[r.charger_id]):
                out[r.charger_id] = r
        return out

    numbers = {"numbers": T.number_range(F.col("station_address"))}
    pairs = M.candidate_pairs(own.withColumns(numbers), feed.withColumn("ext_numbers", T.number_range(F.col("ext_address")))).collect()
    good = best((r for r in pairs if not r.conflict), lambda r: (not r.same_operator, r.distance_m, r.source_poi_id))
    bad = best((r for r in pairs if r.charger_id not in good), lambda r: (r.distance_m, r.source_poi_id))
    assert good and bad
    assert sorted((r.charger_id, r.source_poi_id, r.ext_address, r.distance_m, r.match_method) for r in M.accepted(verdicts).collect()) == sorted((k, r.source_poi_id, r.ext_address, r.distance_m, r.match_method) for k, r in good.items())
    assert sorted((r.charger_id, r.source_poi_id, r.distance_m) for r in M.rejected(verdicts).collect()) == sorted((k, r.source_poi_id, r.distance_m) for k, r in bad.items())


@pytest.mark.parametrize("rows", [100_000, 0])
def test_chargers_are_not_brought_together(spark, rows):
    """Chargers read their kind's verdict where they are; only ids that repeat meet."""
    chargers = [(i, "A", f"{i % 7 * 10} Main St", "2000", -33.0, 151.0) for i in range(50)]
    schema = "source_poi_id string, ext_operator string, ext_name string, ext_address string, ext_postcode string, usage_cost string, price_per_kwh double, plug_types string, num_points int, num_connectors int, rate_kw double, lat double, lon double"
    feed = spark.createDataFrame([_site(1, "A", 100, 0, "2000", "20 Main St"), _site(2, "A", 100, 0, "2001", "60 Main St")], schema)
    plain = M.verdicts(spark.createDataFrame(chargers, CHARGERS), feed, broadcast_rows=rows)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "key=[charger_id" not in plan and "keys=[charger_id" not in plan
    twice = M.verdicts(spark.createDataFrame([*chargers, (0, "A", "20 Main St", "2000", -33.0, 151.0), (None, "A", "60 Main St", "2000", -33.0, 151.0), (None, "A", "20 Main St", "2000", -33.0, 151.0)], CHARGERS), feed, broadcast_rows=rows)
    good = lambda v: {r.charger_id: r.source_poi_id for r in M.accepted(v).collect()}
    bad = lambda v: {r.charger_id: (r.source_poi_id, r.reject_reason) for r in M.rejected(v).collect()}
    near = {i for i in range(50) if abs(i % 7 * 10 - 20) <= 10}
    assert good(plain) == dict.fromkeys(near, "1") and bad(plain) == {i: ("1", "address_conflict") for i in range(50) if i not in near}
    assert good(twice) == dict.fromkeys([*near, 0, None], "1") and bad(twice) == {i: ("1", "address_conflict") for i in range(1, 50) if i not in near}
    assert M.accepted(twice).count() == len(near) + 2
    R.release()


def test_expectations(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, 1, 5.0), (1, 9, -1.0), (None, None, None)], "k int, ref int, v double")
    rules = Q.Rules(("k",), (), ("v",), {"v": "v > 0"}, {"ref": ("parent", "id")})
    found = {r.problem: r.n for r in Q.violations("child", {"child": child, "parent": parent}, rules).collect()}
    assert found == {"child.k is NULL": 1, "child.v is NULL": 1, "child(k) repeats": 1, "child.v: not v > 0": 1, "child.ref not in parent.id": 1}
    with pytest.raises(ValueError, match="missing columns: z"):
        Q.require_columns(child, ["k", "z"])
