from __future__ import annotations

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from phyllary.sources.image_files import prune_images
from phyllary.schema import RECORD_FIELDS
from phyllary.sources import archives, html_pages, image_files, json_pages, requests
from phyllary.sources.common import PAGE, page_of, union_components


def pages(spark, query, *bodies, url="https://x.example/list", source="s"):
    return spark.createDataFrame([(source, query, i, url, b if isinstance(b, str) else json.dumps(b, ensure_ascii=False)) for i, b in enumerate(bodies)], PAGE)


def test_gbif(spark):
    body = {"results": [
        {"key": 7, "occurrenceID": "o7", "scientificName": "Pteris vittata L.", "decimalLatitude": 1.5, "decimalLongitude": 2, "hasGeospatialIssue": False, "media": [{"type": "StillImage", "format": "image/jpeg", "identifier": "https://a.example/s.jpg"}, {"type": "StillImage", "format": "image/jpeg", "identifier": "https://a.example/original/b.jpg", "license": "cc0"}, {"identifier": "https://a.example/page"}]},
        {"key": 8, "acceptedScientificName": "Pteris sp.", "verbatimEventDate": "1905", "elevation": 20},
    ]}
    p = pages(spark, "Pteris vittata", body, {"results": []}, "no json")
    best, every = json_pages.gbif(p).orderBy("item_no").collect(), json_pages.gbif(p, all_media=True).collect()
    assert [c for c in json_pages.gbif(p).columns if c in RECORD_FIELDS] == RECORD_FIELDS
    assert (best[0].image_url, best[0].image_license, best[0].coordinate_status, best[0].source_record_url, best[0].download_status) == ("https://a.example/original/b.jpg", "cc0", "coordinates_ok", "o7", "pending")
    assert (best[1].image_url, best[1].scientific_name, best[1].event_date, best[1].elevation, best[1].source_record_url, best[1].coordinate_status) == ("", "Pteris sp.", "1905", "20", "https://www.gbif.org/occurrence/8", "missing_coordinates")
    assert len(best) == 2 and len(every) == 3


def test_ala_nhm_jabot(spark):
    ala = {"occurrences": [{"uuid": "u1", "raw_scientificName": "Pteris vittata", "scientificName": "X", "basisOfRecord": "PRESERVED_SPECIMEN", "collectors": ["A", "", "B"], "eventDate": -2024956800000, "year": "1905", "month": 11, "geospatialKosher": "false", "decimalLatitude": 1, "decimalLongitude": 2, "imageUrls": ["https://a.example/1.jpg"]},
                           {"uuid": "u2", "scientificName": "Pteris vittata", "basisOfRecord": "HUMAN_OBSERVATION"}, {"uuid": "u3", "scientificName": "Other name"}]}
    (r,) = json_pages.ala(pages(spark, "Pteris vittata", ala)).collect()
    assert (r.source_record_id, r.recorded_by, r.event_date, r.coordinate_status, r.image_url) == ("u1", "A; B", "1905-11", "coordinates_geospatial_issue", "https://a.example/1.jpg")
    nhm = {"result": {"records": [{"_id": 5, "scientificName": "Y z", "determinationNames": ["Pteris vittata"], "associatedMedia": [{"identifier": "https://a.example/thumbnail.jpg"}, {"identifier": "https://a.example/large.jpg", "license": "l"}]}]}}
    (r,) = json_pages.nhm(pages(spark, "Pteris vittata", nhm)).collect()
    assert (r.source_record_url, r.image_url, r.image_license, r.identified_by) == ("https://data.nhm.ac.uk/object/5", "https://a.example/large.jpg", "l", "Pteris vittata")
    (r,) = json_pages.jabot(pages(spark, "any name", [{"codespecime": 9, "siglacolecao": "RB", "numtombo": 12, "anocoleta": 1950, "mescoleta": 3, "altitude": "20", "siglaunidmed": "m"}])).collect()
    assert (r.source_record_id, r.event_date, r.elevation, r.download_status) == ("9", "1950-03", "20 m", "no_image_url")


def test_cvh_joins_details(spark):
    body = {"rows": [{"collectionID": "1", "institutionCode": "PE", "collectionCode": "001", "formattedName": "<i>Pteris</i> vittata", "withPhoto": "1", "year": "1950"}, {"collectionID": ""}, {"collectionID": "2", "isType": "1"}]}
    details = spark.createDataFrame([("1", json.dumps({"rows": {"recordedBy": "A", "country": "China", "county": "X", "locality": "Y"}}))], "key string, body string")
    a, b = json_pages.cvh(pages(spark, "Pteris vittata", body), details).orderBy("item_no").collect()
    assert (a.image_url, a.scientific_name, a.recorded_by, a.locality, a.event_date) == ("https://image.cvh.ac.cn/files/l/PE/001.jpg", "Pteris vittata", "A", "China X Y", "1950") and b.type_status == "type"


def test_jacq(spark):
    item = {"dwc": {"dwc:catalogNumber": "B 20 0160165", "dwc:scientificName": "Pteris vittata L."}, "jacq": {"jacq:specimenID": 44, "jacq:OwnerOrganizationAbbrev": "B"}}
    images = spark.createDataFrame([("44", json.dumps({"download": {"europeana": [], "full": ["https://a.example/iiif/x/full/1200,/0/default.jpg"]}}))], "key string, body string")
    (r,) = json_pages.jacq(pages(spark, "Pteris vittata", {"result": [item, {"dwc": {"scientificName": "Other name"}}]}), images).collect()
    assert (r.catalog_number, r.institution_code, r.source_record_url) == ("B 20 0160165", "B", "https://api.jacq.org/v1/objects/specimens/44") and "/1200,/" in r.image_url


def test_nmnh_naturalis(spark):
    item = {"_id": "99", "admuu": "0123456789abcdef0123456789abcdef", "biopr": ["A", "B"], "darcx": "US  854020", "darcn": "654", "idefa": {"ideqn": "Pteris vittata"}, "mulmm": [{"mulmt": "Image", "mulid": "5"}], "coldv": {"coled": "1914-01-02"}}
    (r,) = json_pages.nmnh(pages(spark, "Pteris vittata", {"records": [item]})).collect()
    assert (r.catalog_number, r.record_number, r.recorded_by, r.occurrence_id, r.event_date) == ("US 854020", "654", "A; B", "http://n2t.net/ark:/65665/301234567-89ab-cdef-0123-456789abcdef", "1914-01-02") and "irn=5" in r.image_url
    item = {"id": "i", "unitID": "L.1", "identifications": [{"scientificName": {"fullScientificName": "No"}}, {"preferred": True, "scientificName": {"fullScientificName": "Pteris vittata"}}], "gatheringEvent": {"dateTimeBegin": "1911-04-03T00:00:00Z", "gatheringPersons": [{"fullName": "A"}, {"agentText": "B"}], "siteCoordinates": {"latitudeDecimal": 1.25, "longitudeDecimal": 3}}, "associatedMultiMediaUris": [{"accessUri": "https://a.example/1.jpg", "format": "image/jpeg"}]}
    (r,) = json_pages.naturalis(pages(spark, "Pteris vittata", {"resultSet": [{"item": item}, {"x": 1}]})).collect()
    assert (r.recorded_by, r.event_date, r.decimal_latitude, r.image_url, r.source_record_url) == ("A; B", "1911-04-03", "1.25", "https://a.example/1.jpg", "https://data.biodiversitydata.nl/naturalis/specimen/L.1")


def test_symbiota(spark):
    listing = "<input name='occid[]' type='checkbox' value='20'><a onclick='openIndPU(3)'>x</a><a href='?occid=3'>"
    ids = json_pages.symbiota_ids(pages(spark, "Pteris vittata", listing))
    assert [r.occid for r in ids.collect()] == ["3", "20"]
    html = '<img src="/imglib/a_web.jpg"><b>Rights Holder:</b><span>Museum</span><a href="http://creativecommons.org/licenses/by/4.0/">.'
    rows = [("s", "Pteris vittata", 0, "https://p.example/i?occid=3", "3", json.dumps([{"basisOfRecord": "PreservedSpecimen", "sciname": "Pteris vittata", "institutionCode": "NY", "catalogNumber": "3", "country": "Cuba", "locality": "X"}]), html),
            ("s", "Pteris vittata", 0, "u", "4", json.dumps([{"basisOfRecord": "HumanObservation", "sciname": "Pteris vittata"}]), ""), ("s", "Pteris vittata", 0, "u", "5", "[]", "")]
    d = spark.createDataFrame(rows, "source string, query_name string, page_no int, url string, key string, body string, html string")
    (r,) = json_pages.symbiota(d).collect()
    assert (r.locality, r.image_url, r.rights_holder, r.image_license) == ("Cuba X", "https://p.example/imglib/a_web.jpg", "Museum", "http://creativecommons.org/licenses/by/4.0/")
    assert json_pages.symbiota(d, institutions=["MICH"]).count() == 0


def test_html_tables(spark):
    tns = "<input id='image_v' value='true'><table><tr><th>標本登録番号 (TNS-VS-)</th><td>255550</td></tr><tr><th>学名</th><td>Haplopteris mediosora</td></tr><tr><th>採集年月日</th><td>1968/6/11</td></tr><tr><th>採集地(国名)[英]</th><td>Japan</td></tr></table>"
    (r,) = html_pages.tns(pages(spark, "Haplopteris mediosora", tns, url="https://db.kahaku.go.jp/webmuseum/detail?cls=c1&pkey=9")).collect()
    assert (r.catalog_number, r.event_date, r.country, r.image_url) == ("TNS-VS-255550", "1968-06-11", "Japan", "https://db.kahaku.go.jp/webmuseum/rest/media/S?cls=c1&pkey=9&c2510")
    ti = "<table><tr><td>TI CODE</td><td>TI00203898</td></tr><tr><td>Scientific Name</td><td>Pteris vittata</td></tr><tr><td>Type Status</td><td>lectotype</td></tr><tr><td>Locality</td><td>TAIWAN: Mt. X</td></tr></table><a onclick=\"disp('abc')\">"
    (r,) = html_pages.ti(pages(spark, "Pteris vittata", ti, url="https://umdb.example/d")).collect()
    assert (r.catalog_number, r.type_status, r.country, r.locality) == ("TI00203898", "lectotype", "TAIWAN", "Mt. X") and r.image_url.endswith("/abc_2048_.jpg")
    taif = "<div class='pure-g'><div>Herbarium No.:</div><div>TAIF1</div></div><div class='pure-g'><div>Altitude</div><div>(n/a)</div></div><span id='spnSPName'><i>Pteris</i> vittata</span><script>createViewer('a', 'b', '/t/', 'p_', 400, 300)</script>"
    (r,) = html_pages.taif(pages(spark, "q", taif, url="https://t.example/type/specimen.php?id=1")).collect()
    assert (r.catalog_number, r.scientific_name, r.type_status, r.elevation) == ("TAIF1", "Pteris vittata", "Type", "") and r.image_url.startswith("taif_tiles://image?base=https%3A%2F%2Ft.example%2Ft%2F&prefix=p_&width=400")


def test_kag(spark):
    row = "<tr><td><a name='TXNDET1'></a></td><td>KAG022683</td><td>f</td><td>Pteris</td><td>vittata</td><td>Holotype</td><td>site</td><td>j</td><td>C</td><td><input name='specimen_id' value='KAG022683'></td></tr>"
    detail = "<table><tr><th>Specimen_ID</th><td>KAG022683</td></tr><tr><th>Note</th><td>Lat=28.01 Lon=129.26 Alt. 101 m</td></tr><tr><th>Collector date</th><td>2019/10/31</td></tr></table><a href='picture/KAG022683P.jpg'>p</a><a href='picture/KAG022683.jpg'>f</a>"
    details = spark.createDataFrame([("KAG022683", "https://k.example/m/s.php", detail)], "key string, url string, body string")
    (r,) = html_pages.kag(pages(spark, "Pteris vittata", f"<table>{row}<tr><td>x</td></tr></table>"), details).collect()
    assert (r.decimal_latitude, r.decimal_longitude, r.elevation, r.event_date, r.type_status, r.image_url) == ("28.01", "129.26", "101 m", "2019-10-31", "Holotype", "https://k.example/m/picture/KAG022683.jpg")


def test_tai2_rbge_brahms(spark):
    rows = [{"TAIID": 271441, "species": "Pteris vittata", "collno": "5", "note": "alt 2700 m", "date": "1998/12/25", "locinfo": {"loc": "a", "locE": "b", "X": "121.1", "Y": "24.2"}, "img": "i m/1.jpg", "label": "l.jpg"}, {"TAIID": 2, "species": "Other name"}]
    p = pages(spark, "Pteris vittata", "<script>var spcm=" + json.dumps(rows) + ";</script>", url="https://t.example/p/")
    (r,) = html_pages.tai2(p).collect()
    assert (r.catalog_number, r.event_date, r.elevation, r.locality, r.image_url, r.notes) == ("271441", "1998-12-25", "2700 m", "b", "https://t.example/p/i%20m/1.jpg", "alt 2700 m; label_image=https://t.example/p/l.jpg")
    assert html_pages.tai2(p, {"Pteris vittata": ["Other name"]}).count() == 2
    rdf = "<rdf:RDF><dwc:catalogNumber>E00001</dwc:catalogNumber><dwc:scientificName>Pteris\n vittata</dwc:scientificName><x href='https://iiif.rbge.org.uk/herb/iiif/E00001/full/600,/0/default.jpg'/></rdf:RDF>"
    (r,) = html_pages.rbge(pages(spark, "Pteris vittata", rdf)).collect()
    assert (r.scientific_name, r.image_url, r.occurrence_id) == ("Pteris vittata", "https://iiif.rbge.org.uk/herb/iiif/E00001/full/2400,/0/default.jpg", "E:E00001")
    site = pages(spark, "Pteris vittata", "<img src='/m/1.jpg'><img src='/m/2.jpg'><a href='/rec/7'>", url="https://b.example/x")
    got = html_pages.brahms(site, "https://b.example", "OXF", r"/rec/\d+").orderBy("item_no").collect()
    assert [(r.source_record_url, r.image_url) for r in got] == [("https://b.example/rec/7", "https://b.example/m/1.jpg"), ("https://b.example/x", "https://b.example/m/2.jpg")]
    assert html_pages.brahms(site, "https://other.example", "OXF").count() == 0


def test_archive(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("occurrence.txt", "id\toccurrenceID\tscientificName\tinstitutionCode\ttype\tisland\n1\tBO:1347954\tPteris vittata\tBO\tHolotype\tJava\n2\t\tOther name\tBO\t\t\n3\t\tPteris vittata\tBO\t\t\n")
        z.writestr("multimedia.txt", "id\tidentifier\tlicense\nBO:1347954\thttps://a.example/large.jpg\tcc-by\n1\thttps://a.example/1.jpg\tx\n\thttps://a.example/2.jpg\ty\n")
    (tmp_path / "a.zip").write_bytes(b.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    rows = archives.read_archives(spark, str(tmp_path), ["occurrence.txt", "multimedia.txt"])
    a, c = archives.dwca(rows, "bo", "Pteris vittata", record_url="https://r.example/{occurrenceID}").orderBy("item_no").collect()
    assert (a.catalog_number, a.type_status, a.state_province, a.image_url, a.image_license, a.source_record_url) == ("BO:1347954", "Holotype", "Java", "https://a.example/large.jpg", "cc-by", "https://r.example/BO%3A1347954") and c.image_url == ""


def test_limits_and_unions(spark):
    body = {"results": [{"key": i, "scientificName": "Pteris vittata"} for i in range(5)]}
    one = json_pages.gbif(pages(spark, "Pteris vittata", body, body))
    assert [r.source_record_id for r in page_of(one, 2, 4).orderBy("page_no", "item_no").collect()] == ["2", "3", "4", "0"]
    both = union_components([one, one], "portal", 12)
    assert both.count() == 12 and {r.source for r in both.collect()} == {"portal"} and union_components([one, one], "portal").count() == 20


def test_links_and_labels(spark):
    html = "<a href='/a/5#x'>t</a><a href='/b/5'>t</a> see https://x.example/a/7"
    assert html_pages.links(html, "https://x.example/", r"/a/\d+") == ["https://x.example/a/5", "https://x.example/a/7"]
    assert html_pages.labelled("<dl><dt>Rights:</dt><dd>Me</dd></dl>", "Rights") == "Me" and html_pages.labelled("<p><b>Rights</b> Me</p>", "Rights") == "Me" and html_pages.labelled("", "x") == html_pages.labelled(None, "x") == ""
    assert html_pages.images("<img src='logo.jpg'><img src='/a.jpg'><img data-src='b/media/3'>", "https://x.example/") == ["https://x.example/a.jpg", "https://x.example/b/media/3"]
    links = html_pages.detail_links(pages(spark, "q", html, html, url="https://x.example/"), r"/a/\d+").collect()
    assert sorted((r.detail_url, r.page_no) for r in links) == [("https://x.example/a/5", 0), ("https://x.example/a/7", 0)]
    assert html_pages.label_map("<table>" * 3000 + "<tr><td>A<td>1") == {"a": "1"}


def test_requests():
    p = requests.aggregator_parameters("Pteris vittata", "specimens", "with-coordinates")
    assert (p["basisOfRecord"], p["hasCoordinate"], p["hasGeospatialIssue"]) == ("PRESERVED_SPECIMEN", "true", "false")
    with pytest.raises(ValueError):
        requests.aggregator_parameters("x", "nothing")
    assert requests.source_names(["GBIF", "UC/JEPS", "uc", " gbif "]) == ["gbif", "ucjeps"]
    assert requests.parse_environment("# c\nA=1\nexport B = 'x y'\n\nbad") == {"A": "1", "B": "x y"}
    assert requests.pyramid_levels(1000, 400, 512) == [{"id": 1, "width": 500, "height": 200}, {"id": 0, "width": 1000, "height": 400}]
    assert requests.settings_with_profile({"a": 1, "profiles": {"low": {"a": 2}}}, "low") == {"a": 2}


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 2400, 1800) + b"\0" * 300_000
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"abcd" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 900, 800) + b"\0" * 40
    for n, c in (("a.png", png), ("b.jpg", jpeg), ("c.jpg", b"\xff\xd8\xff"), ("d.txt", b"text")):
        (tmp_path / n).write_bytes(c)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.status) for r in image_files.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (2400, 1800, "image_available"), "b.jpg": (800, 900, "review_low_resolution_for_label_reading"), "c.jpg": (None, None, "image_dimensions_unknown"), "d.txt": (None, None, "image_dimensions_unknown")}
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "path string")
    assert image_files.image_accounts(a, a.where("path = 'x'")).first() == (1, 1)
    url = spark.range(1).select(image_files.cache_address(F.lit("3019930399"), F.lit("https://a.example/x.jpg")).alias("u")).first().u
    assert url.startswith("https://api.gbif.org/v1/image/cache/occurrence/3019930399/media/") and len(url.rsplit("/", 1)[1]) == 32


def test_unreferenced_images_are_pruned(spark, tmp_path):
    for name in ("a/1.jpg", "a/2.jpg", "3.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    refs = spark.createDataFrame([("a/1.jpg",), ("",), (None,)], "path string")
    assert prune_images(spark, str(tmp_path), refs.where("path = ''")).count() == 0
    assert sorted((r.path, r.removed) for r in prune_images(spark, str(tmp_path), refs).collect()) == [("3.png", True), ("a/2.jpg", True)]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.*g")) == ["a/1.jpg"]
