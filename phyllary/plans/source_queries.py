"""Every source adapter over pages that are built from the records, with SQL for what must come out of them again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.text import text
from phyllary.schema import as_records
from phyllary.session import table
from phyllary.sources import html_pages, json_pages

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Adapter -> (list path or "", record field -> path in an item). Paths of several steps become nested objects.
JSON = {
    "gbif": (json_pages.gbif, "results", {"source_record_id": "key", "catalog_number": "catalogNumber", "recorded_by": "recordedBy", "locality": "locality", "decimal_latitude": "decimalLatitude", "image_url": "media.identifier"}),
    "ala": (lambda p: json_pages.ala(p, exact=False, specimens=False), "occurrences", {"source_record_id": "uuid", "catalog_number": "raw_catalogNumber", "recorded_by": "collector", "locality": "locality", "decimal_longitude": "decimalLongitude", "image_url": "imageUrl"}),
    "nhm": (lambda p: json_pages.nhm(p, exact=False), "result.records", {"source_record_id": "_id", "catalog_number": "catalogNumber", "identified_by": "determinationNames", "country": "country", "image_url": "associatedMedia.identifier"}),
    "jabot": (json_pages.jabot, "", {"source_record_id": "codespecime", "catalog_number": "numtombo", "recorded_by": "coletor", "locality": "descrlocal", "type_status": "nat_typus"}),
    "jacq": (None, "result", {"source_record_id": "jacq.jacq:specimenID", "scientific_name": "dwc.dwc:scientificName", "recorded_by": "jacq.jacq:collectorTeam", "country": "dwc.dwc:country", "image_url": "jacq.jacq:downloadImage"}),
    "nmnh": (lambda p: json_pages.nmnh(p, exact=False), "records", {"source_record_id": "_id", "scientific_name": "idefa.ideqn", "recorded_by": "biopc", "locality": "darlc", "state_province": "darst", "decimal_latitude": "darlt"}),
    "naturalis": (lambda p: json_pages.naturalis(p, exact=False), "resultSet", {"source_record_id": "item.id", "record_number": "item.collectorsFieldNumber", "locality": "item.gatheringEvent.locality", "decimal_latitude": "item.gatheringEvent.siteCoordinates.latitudeDecimal"}),
    "cvh": (None, "rows", {"source_record_id": "collectionID", "catalog_number": "collectionCode", "recorded_by": "recordedBy", "state_province": "stateProvince"}),
}
#: Adapter -> record field -> label in a table of a detail page.
HTML = {
    "tns": (lambda p: html_pages.tns(p, exact=False), {"scientific_name": "学名", "recorded_by": "採集者名[英]", "record_number": "採集番号", "country": "採集地(国名)[英]"}),
    "ti": (lambda p: html_pages.ti(p, exact=False), {"catalog_number": "TI CODE", "scientific_name": "Scientific Name", "type_status": "Type Status", "recorded_by": "Collector"}),
    "taif": (html_pages.taif, {"catalog_number": "Herbarium No.", "recorded_by": "Collector(s)", "locality": "Location", "elevation": "Altitude", "type_status": "Type Status"}),
}


def _item(fields: dict[str, str]) -> Column:
    """The JSON object of a record's fields at their paths."""
    tree: dict = {}
    for field, path in fields.items():
        *steps, last = path.split(".")
        at = tree
        for s in steps:
            at = at.setdefault(s, {})
        at[last] = F.col(field)

    def build(t: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])

    return F.to_json(build(tree))


def _pages(spark, d: str, body: Column) -> DataFrame:
    records = as_records(table(spark, d, "specimen_records"), "seq").withColumn("source_record_id", F.col("seq").cast("string"))
    return records.select(F.lit("s").alias("source"), "query_name", F.col("seq").cast("int").alias("page_no"), F.lit("https://x.example/").alias("url"), body.alias("body"))


#: Items of a landed page.
ITEMS = 25


def _listed_pages(spark, d: str, item: Column, head: str, tail: str) -> DataFrame:
    """Pages of ITEMS records each, as sources deliver them."""
    records = as_records(table(spark, d, "specimen_records"), "seq").withColumn("source_record_id", F.col("seq").cast("string"))
    pages = records.groupBy(F.floor(F.col("seq") / ITEMS).cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items"))
    body = F.concat(F.lit(head + "["), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("]" + tail))
    return pages.select(F.lit("s").alias("source"), F.lit("").alias("query_name"), "page_no", F.lit("https://x.example/").alias("url"), body.alias("body"))


def _json(name: str) -> Callable:
    adapter, path, fields = JSON[name]

    def run(spark, d: str) -> DataFrame:
        head = "".join(f'{{"{k}":' for k in path.split(".")) if path else ""
        pages = _listed_pages(spark, d, _item(fields), head, "}" * (path.count(".") + 1 if path else 0))
        none = spark.createDataFrame([], "key string, body string")
        out = json_pages.jacq(pages, none, exact=False) if name == "jacq" else json_pages.cvh(pages, none) if name == "cvh" else adapter(pages)
        return out.select(F.col("source_record_id").cast("long").alias("seq"), *fields)

    return run


def _html(name: str) -> Callable:
    adapter, fields = HTML[name]

    def escaped(c: str) -> Column:
        return F.replace(F.replace(text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def run(spark, d: str) -> DataFrame:
        rows = [F.concat(F.lit(f"<tr><th>{label}</th><td>"), escaped(f), F.lit("</td></tr>")) for f, label in fields.items()]
        return adapter(_pages(spark, d, F.concat(F.lit("<table>"), *rows, F.lit("</table>")))).select(F.col("page_no").cast("long").alias("seq"), *fields)

    return run


def _sql(fields, clean: bool) -> str:
    def column(f: str) -> str:
        if f == "source_record_id":
            return "seq::varchar as source_record_id"
        x = f"coalesce({f}, '')"
        return f"regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^ | $', '', 'g') as {f}" if clean else f"{x} as {f}"

    return f"select seq, {', '.join(map(column, fields))} from specimen_records"


for _n, (_, _, _f) in JSON.items():
    QUERIES[f"scan_{_n}"], SQL[f"scan_{_n}"] = _json(_n), _sql(_f, False)
for _n, (_, _f) in HTML.items():
    QUERIES[f"scan_{_n}"], SQL[f"scan_{_n}"] = _html(_n), _sql(_f, True)


def scan_rbge(spark, d: str) -> DataFrame:
    fields = {"scientific_name": "scientificName", "recorded_by": "recordedBy", "country": "country", "decimal_latitude": "decimalLatitude"}
    body = F.concat(F.lit("<rdf>"), *[F.concat(F.lit(f"<dwc:{t}>"), text(f), F.lit(f"</dwc:{t}>")) for f, t in fields.items()], F.lit("</rdf>"))
    return html_pages.rbge(_pages(spark, d, body), exact=False).select(F.col("page_no").cast("long").alias("seq"), *fields)


QUERIES["scan_rbge"], SQL["scan_rbge"] = scan_rbge, _sql(["scientific_name", "recorded_by", "country", "decimal_latitude"], True)


def html_label_value(spark, d: str) -> DataFrame:
    """The text behind a label in a page."""
    body = F.concat(F.lit("<div><b>Rights Holder:</b> <span>"), F.replace(text("rights_holder"), F.lit("&"), F.lit("&amp;")), F.lit("</span></div>"))
    pages = _pages(spark, d, body)
    return pages.select(F.col("page_no").cast("long").alias("seq"), html_pages.labelled_text(F.col("body"), "Rights Holder").alias("rights_holder"))


QUERIES["html_label_value"], SQL["html_label_value"] = html_label_value, _sql(["rights_holder"], True)


def html_images(spark, d: str) -> DataFrame:
    """The likely specimen images in a page."""
    body = F.concat(F.lit('<img src="logo.png"><img src="'), text("image_url"), F.lit('"><a href="/x">'))
    pages = _pages(spark, d, body)
    return pages.select(F.col("page_no").cast("long").alias("seq"), F.array_join(html_pages.image_urls(F.col("body"), F.col("url")), " ").alias("image_url"))


QUERIES["html_images"], SQL["html_images"] = html_images, _sql(["image_url"], False)


def html_links(spark, d: str) -> DataFrame:
    """The links in a page that fit a pattern."""
    body = F.concat(F.lit('<a href="'), text("source_record_url"), F.lit('#top">x</a><a href="/other">'))
    pages = _pages(spark, d, body)
    return pages.select(F.col("page_no").cast("long").alias("seq"), F.array_join(html_pages.link_urls(F.col("body"), F.col("url"), r"https://\S+?/occ/\d+"), " ").alias("source_record_url"))


QUERIES["html_links"], SQL["html_links"] = html_links, _sql(["source_record_url"], False)


def image_prefix_match(spark, d: str) -> DataFrame:
    """The first image file whose name begins with a record's catalogue number."""
    from phyllary.sources.image_files import image_for_code

    records = table(spark, d, "specimen_records")
    files = table(spark, d, "label_reads").select(F.concat(F.lit("images/"), F.regexp_replace(text("catalog_number"), "[^A-Za-z0-9]", "-"), F.lit("_"), F.col("label_seq").cast("string"), F.lit(".jpg")).alias("path"))
    return image_for_code(records.select("seq", "catalog_number"), files, "seq", F.col("catalog_number"))


_STEM = "lower(regexp_replace(coalesce(catalog_number, ''), '[^A-Za-z0-9]', '', 'g'))"
QUERIES["image_prefix_match"] = image_prefix_match
SQL["image_prefix_match"] = f"""with c as (select seq, {_STEM} as code from specimen_records where {_STEM} <> ''), f as (select 'images/' || regexp_replace(coalesce(catalog_number, ''), '[^A-Za-z0-9]', '-', 'g') || '_' || label_seq || '.jpg' as path, {_STEM} || label_seq as stem from label_reads)
select seq, min(path) as path from c join f on starts_with(stem, code) group by seq"""


def download_cascade(spark, d: str) -> DataFrame:
    """Addresses to try for each image."""
    from phyllary.sources.image_files import download_urls

    r = as_records(table(spark, d, "specimen_records"), "seq")
    return r.select("seq", F.array_join(download_urls(F.col("source_record_id"), F.col("image_url")), " ").alias("urls"))


QUERIES["download_cascade"] = download_cascade
SQL["download_cascade"] = """select seq, case when coalesce(image_url, '') = '' then '' when regexp_full_match(coalesce(source_record_id, ''), '[0-9]+') then image_url || ' https://api.gbif.org/v1/image/cache/1200x/occurrence/' || source_record_id || '/media/' || md5(image_url)
 || ' https://api.gbif.org/v1/image/cache/occurrence/' || source_record_id || '/media/' || md5(image_url) else image_url end as urls from specimen_records"""
