"""The three steps end to end on small inputs, and the sources."""

import email.message
import io
import json
import struct
import zipfile
from urllib.error import HTTPError
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from terrasift.operators.quality import raise_all
from terrasift.plans import augmenting, cleaning, steps, storing
from terrasift.sources import delimited, download, feeds, shapefile

HEAD = "ObjectID,Station Name,Station Address,Operator,Number of Plugs,Charger Type,Charger Rating,Latitude,Longitude,LGAName,PCode,Source\r\n"
ROWS = [
    '1,One,"1 Main St \n Town",BP Pulse (AU),2,DC,2x50kW,-33.05,151.05,L,0200,s',
    ',,"1 Main St, Town","BP",2,DC,50,-33.05,151.05,L,0200,t',
    '1,One,"1 Main St \n Town",BP Pulse (AU),2,DC,2x50kW,-33.05,151.05,L,0200,s',
    '696.0,"Say ""hi""",9 High St,Evie Networks,1.0,Upcoming,22 kW,-33.5,151.0051,NULL,2000,s',
    "4,Far,8 Sea St,JOLT,n/a,ac,,10,151,L,2000,s",
]


def _shapefile(path, regions, names=(b"CODE", b"NAME", b"GCC", b"STATE", b"AREA")):
    """A polygon .shp with .shx and .dbf; a region without points is a null shape."""
    records, index, at = b"", b"", 50
    for i, (_, _, rings) in enumerate(regions):
        points = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        content = struct.pack("<i", 0) if not points else struct.pack("<i4dii", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">ii", i + 1, len(content) // 2) + content
        index += struct.pack(">ii", at, len(content) // 2)
        at += 4 + len(content) // 2
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(records) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    path.with_suffix(".shp").write_bytes(head + records)
    path.with_suffix(".shx").write_bytes(head + index)
    fields = [(names[0], b"C", 5, 0), (names[1], b"C", 10, 0), (names[2], b"C", 8, 0), (names[3], b"C", 16, 0), (names[4], b"N", 8, 2)]
    size = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<BBBBIHH20x", 3, 26, 1, 1, len(regions), 32 + 32 * len(fields) + 1, size)
    dbf += b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields) + b"\r"
    dbf += b"".join(b" " + c.encode().ljust(5) + n.encode().ljust(10) + b"G".ljust(8) + b"New South Wales ".ljust(16) + b"%8.2f" % (i + 0.5) for i, (c, n, _) in enumerate(regions))
    path.with_suffix(".dbf").write_bytes(dbf)


def _square(x, y, n):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]


@pytest.fixture(scope="module")
def regions(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("shapes") / "r.shp"
    _shapefile(path, [("101", "North", [_square(151.0, -33.1, 0.1)]), ("102", "South", [_square(150.9, -33.6, 0.1), _square(150.93, -33.57, 0.02)]), ("999", "None", [])])
    read = shapefile.read_shapes(spark, str(path), ["CODE", "NAME", "AREA"])
    assert [(r.CODE, r.AREA, r.rings and len(r.rings)) for r in read.orderBy("CODE").collect()] == [("101", 0.5, 1), ("102", 1.5, 2), ("999", 2.5, None)]
    assert shapefile.read_shapes(spark, str(path), ["NAME"]).columns == ["NAME", "rings"]
    return read.where("rings is not null").select(F.col("CODE").alias("sa4_code"), F.col("NAME").alias("sa4_name"), F.lit("G").alias("gcc_name"), F.lit("S").alias("state_name"), F.col("AREA").alias("area_sqkm"), "rings")


@pytest.fixture(scope="module")
def cleaned(spark, tmp_path_factory, regions):
    path = tmp_path_factory.mktemp("csv") / "raw.csv"
    path.write_bytes(("﻿" + HEAD + "\r\n".join(ROWS) + "\r\n").encode())
    raw = delimited.read_text(spark, str(path), cleaning.REQUIRED)
    assert raw.count() == 5 and raw.columns[0] == "objectid"
    out, share = cleaning.clean(raw, regions)
    return out.persist(), share


def test_clean(cleaned):
    out, share = cleaned
    rows = [r.asDict() for r in out.orderBy("charger_id").collect()]
    assert [(r["charger_id"], r["station_name"], r["operator"], r["charger_type"], r["status"], r["charger_rating_kw"], r["postcode"]) for r in rows] == [
        (1, "One", "BP", "DC", "existing", 50.0, "0200"),
        (2, 'Say "hi"', "Evie", None, "upcoming", 22.0, "2000"),
    ]
    assert rows[0]["station_address"] == "1 Main St, Town" and rows[0]["sa4_code"] == "101" and rows[0]["sa4_assignment"] == "within"
    assert rows[0]["sa4_distance_m"] == 0.0 and rows[0]["number_of_plugs"] == 2 and rows[1]["source_objectid"] == 696
    assert rows[1]["sa4_code"] == "102" and rows[1]["sa4_assignment"] == "nearest" and 400 < rows[1]["sa4_distance_m"] < 550
    counts = {(r.stage, r.column): (r.non_null, r.total, r.pct_complete) for r in share.collect()}
    assert counts["raw", "objectid"] == (4, 5, 80.0) and counts["cleaned", "charger_type"] == (1, 2, 50.0)


def test_feeds_and_store(spark, tmp_path, cleaned, regions):
    poi = {"ID": 7, "UsageCost": " $0.55/kWh ", "NumberOfPoints": 2, "OperatorInfo": {"Title": "BP Pulse (AU)"}, "Connections": [{"ConnectionType": {"Title": "CCS (Type 2)"}, "CurrentType": None, "PowerKW": 50, "Quantity": None}, {"ConnectionType": {"Title": "Unknown"}, "PowerKW": "75", "Quantity": 3}]}
    poi["AddressInfo"] = {"Title": "t", "AddressLine1": "Shop", "AddressLine2": "1 Main St", "Postcode": "0200", "Latitude": -33.0501, "Longitude": 151.05}
    numeric = {"ID": 8, "AddressInfo": {"Postcode": 2630, "Latitude": 1.0, "Longitude": 1.0}}
    node = {"type": "node", "id": 1, "lat": -33.0, "lon": 151.0, "tags": {"socket:chademo": "2", "socket:type2": "yes", "socket:type2:output": "22 kW;250000", "capacity": "4", "brand": "Evie Networks", "operator": "", "addr:street": "X St"}}
    way = {"type": "way", "id": 2, "center": {"lat": -33.0, "lon": 151.0}, "tags": {"socket:type2": "1"}}
    (tmp_path / "a.json").write_text(json.dumps([poi, numeric]))
    (tmp_path / "b.json").write_text(json.dumps({"elements": [node, way, {"type": "node", "id": 3, "lat": 1.0, "lon": 1.0}]}))
    first = feeds.flatten_records(feeds.read_json(spark, str(tmp_path / "a.json"), feeds.RECORDS))
    second = feeds.flatten_elements(feeds.read_json(spark, str(tmp_path / "b.json"), feeds.ELEMENTS, "elements"))
    assert first.where("source_poi_id = '8'").first().ext_postcode is None
    r = first.where("source_poi_id = '7'").first()
    assert (r.source_poi_id, r.ext_operator, r.ext_address, r.price_per_kwh, r.plug_types, r.num_connectors, r.rate_kw, r.has_dc) == ("7", "BP", "1 Main St", 0.55, "CCS (Type 2)", 4, 50.0, True)
    a, b, c = second.orderBy("source_poi_id").collect()[0], *second.orderBy("source_poi_id").collect()[1:]
    assert (a.ext_operator, a.ext_address, a.plug_types, a.num_points, a.num_connectors, a.rate_kw, a.has_dc) == ("Evie", "X St", "CHAdeMO, Type 2 (Socket Only)", 4, 3, 250.0, True)
    assert (b.source_poi_id, b.has_dc, b.num_connectors) == ("node/3", False, None) and (c.lat, c.has_dc) == (-33.0, False)

    augmented, audit = augmenting.augment(cleaned[0], first, second)
    assert [(x.charger_id, x.augmentation_source) for x in augmented.orderBy("charger_id").collect()] == [(1, "open_charge_map"), (2, None)]
    assert audit.count() == 1
    tables = storing.store_tables(storing.build_tables(augmented, regions), str(tmp_path / "db"))
    assert {x.table: x.n for x in storing.table_counts(tables).collect()} == {"sa4_regions": 2, "operators": 2, "locations": 2, "chargers": 2, "plug_types": 1, "charger_matches": 1, "charger_plug_types": 1}
    raise_all(storing.verify(tables, rows=2))
    with pytest.raises(ValueError, match="nearest"):
        raise_all(storing.verify(tables, strict=True))
    with pytest.raises(ValueError, match="not 3 rows"):
        raise_all(storing.verify(tables, rows=3))
    cover = {x.sa4_code: (x.existing_chargers, x.existing_dc_chargers) for x in spark.table("v_sa4_coverage").collect()}
    assert cover == {"101": (1, 1), "102": (0, 0)}
    assert len(spark.table("v_chargers").columns) == 16


class _Answer(io.BytesIO):
    def __init__(self, body, status=200, kind="application/octet-stream"):
        super().__init__(body)
        self.status, self.headers = status, email.message.Message()
        self.headers["Content-Type"] = kind


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_download(spark, tmp_path):
    land = download.Landing(spark, f"file://{tmp_path}/in")
    whole = _zip(a=b"1" * 100, sub__b=b"2" * 100)
    damaged = whole.replace(b"1" * 100, b"1" * 99 + b"9")
    send = lambda body, **kw: lambda request, timeout: _Answer(body, **kw)

    def lost(request, timeout):
        raise TimeoutError("too late")

    for name, how in (("x.zip", send(b"no archive")), ("x.zip", send(damaged)), ("x.csv", send(b"<html>", kind="text/html")), ("x.csv", lost)):
        with pytest.raises(download.Refused):
            download.fetch(land, "http://h/x", name, send=how)
    assert land.names() == []
    assert download.fetch(land, "http://h/x", "x.csv", send=send(b"a,b")) and not download.fetch(land, "http://h/x", "x.csv", send=lost)
    assert download.fetch(land, "http://h/x", "x.csv", refresh=True, send=send(b"c,d", kind="text/csv")) and land.get("x.csv").read() == b"c,d"
    download.fetch(land, "http://h/z", "z.zip", send=send(whole))
    assert download.unpack(land, "z.zip") == ["a", "sub/b"] and land.get("sub/b").read() == b"2" * 100 and "z.zip" not in land.names()
    land.put("bad.zip", [damaged])
    with pytest.raises(download.Refused, match="damaged"):
        download.unpack(land, "bad.zip")
    land.put("out.zip", [_zip(**{"..__up": b"x"})])
    with pytest.raises(download.Refused, match="leads out"):
        download.unpack(land, "out.zip")


def test_requests(spark, tmp_path, monkeypatch):
    land, asked = download.Landing(spark, f"file://{tmp_path}/in"), []
    answers = [HTTPError("u", 429, "busy", {}, None), _Answer(b"{}", status=202), _Answer(b"no json"), _Answer(b'{"elements": [1]}')]

    def send(request, timeout):
        asked.append(request)
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert download.ask_elements(land, "e.json", "http://h/api", waits=(0, 0, 0), send=send) and json.load(land.get("e.json")) == {"elements": [1]}
    query = parse_qs(asked[0].data.decode())["data"][0]
    assert query.startswith("[out:json]") and "way[\"amenity\"=\"charging_station\"](-45.0,105.0,-9.0,160.0);" in query and query.endswith("out center tags;") and asked[0].get_header("User-agent")
    assert not download.ask_elements(land, "e.json", "http://h/api", send=None)
    with pytest.raises(download.Refused, match="2 attempts"):
        download.ask_elements(land, "f.json", "http://h/api", waits=(0,), send=lambda r, timeout: _Answer(b"[]", status=504))
    monkeypatch.delenv("A_KEY", raising=False)
    with pytest.raises(download.Refused, match="A_KEY"):
        download.ask_records(land, "r.json", "http://h/r", "A_KEY")
    monkeypatch.setenv("A_KEY", " k ")
    answers.append(_Answer(b"[]"))
    assert download.ask_records(land, "r.json", "http://h/r", "A_KEY", send=send)
    assert parse_qs(asked[-1].full_url.partition("?")[2]) == {"output": ["json"], "countrycode": ["AU"], "maxresults": ["100000"], "compact": ["false"], "verbose": ["false"], "key": ["k"]}


def test_steps_write_what_can_be_read_again(spark, tmp_path):
    out, raw, shapes = str(tmp_path / "out"), tmp_path / "raw.csv", tmp_path / "s.shp"
    raw.write_bytes(("\ufeff" + HEAD + "\r\n".join(ROWS) + "\r\n").encode())
    wavy = [(151.0 + i / 1000, -33.1 + 0.0001 * (i % 2)) for i in range(100)] + [(151.1, -33.1), (151.1, -33.0), (151.0, -33.0), (151.0, -33.1)]
    _shapefile(shapes, [("101", "North", [wavy]), ("102", "South", [_square(150.9, -33.6, 0.1)]), ("103", "None", [_square(140.0, -20.0, 0.1)])], (b"SA4_CODE26", b"SA4_NAME26", b"GCC_NAME26", b"STE_NAME26", b"AREASQKM26"))
    figures = {r.figure: r.n for r in steps.clean_step(spark, str(raw), str(shapes), out).collect()}
    assert figures == {"raw_rows": 5, "clean_rows": 2, "without_region": 0, "region: within": 1, "region: nearest": 1, "status: existing": 1, "status: upcoming": 1}
    share = delimited.read_typed(spark, f"{out}/{steps.COMPLETENESS}", steps.COMPLETENESS_TYPES)
    assert share.where("stage = 'cleaned' and column = 'charger_type'").first().pct_complete == 50.0 and share.count() == 12 + 19
    poi = {"ID": 7, "UsageCost": "$0.55/kWh\n\"peak\"", "OperatorInfo": {"Title": "BP"}, "Connections": [{"ConnectionType": {"Title": "CCS (Type 2)"}, "PowerKW": 50}], "AddressInfo": {"Title": "t", "AddressLine1": "1 Main St", "Postcode": "0200", "Latitude": -33.0501, "Longitude": 151.05}}
    (tmp_path / "a.json").write_text(json.dumps([poi]))
    (tmp_path / "b.json").write_text(json.dumps({"elements": []}))
    figures, focus = steps.augment_step(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"), out)
    assert {r.figure: r.n for r in figures.collect()} == {"dc_chargers": 1, "matched": 1, "only_conflicting": 0, "open_charge_map accepted": 1, "open_charge_map rejected": 0, "open_charge_map no_candidate": 0}
    assert {r.operator: (r.total, r.matched) for r in focus.collect() if r.total} == {"BP": (1, 1)}
    row = steps.read_augmented(spark, out).where("charger_id = 1").first()
    assert (row.postcode, row.sa4_code, row.ext_postcode, row.price_per_kwh, row.usage_cost, row.sa4_distance_m) == ("0200", "101", "0200", 0.55, '$0.55/kWh\n"peak"', 0.0)
    assert steps.read_audit(spark, out).first().decision == "accepted"
    report = steps.store_step(spark, out, str(shapes), str(tmp_path / "db")).first()
    assert (report.regions, report.without_charger, report.without_dc_charger, report.dc_chargers, report.matched, report.share) == (3, 2, 2, 1, 1, 1.0)
    tables = storing.load_tables(spark, str(tmp_path / "db"))
    assert {k: v.dtypes for k, v in tables.items()} == {k: spark.createDataFrame([], ddl).dtypes for k, ddl in storing.TYPES.items()}
    shape = tables["sa4_regions"].where("sa4_code = '101'").first().geom
    assert len(shape[0]) < 12 and tables["locations"].where("location_id = 1").first().geom.asDict().keys() == {"x", "y"}
    with pytest.raises(ValueError, match="missing columns: .*ext_name"):
        storing.build_tables(steps.read_cleaned(spark, out), steps.read_regions(spark, str(shapes)))
