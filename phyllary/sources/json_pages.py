"""Adapters for sources that answer in JSON. Field paths are the public interfaces' own names (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllary.functions.images import best_image, media_rank
from phyllary.functions.partial_dates import date_from_any, date_from_parts
from phyllary.functions.text import first_filled, institution_allowed, name_matches, safe_token, text
from phyllary.sources.common import SPECIMEN, coordinate_state, entries, finish, listed, matching, value

#: Darwin Core terms as they are named in JSON, for the record fields that keep their name.
CORE = {
    "occurrence_id": "occurrenceID", "institution_code": "institutionCode", "collection_code": "collectionCode", "catalog_number": "catalogNumber", "scientific_name": "scientificName", "recorded_by": "recordedBy", "record_number": "recordNumber",
    "event_date": "eventDate", "country": "country", "state_province": "stateProvince", "locality": "locality", "verbatim_locality": "verbatimLocality", "decimal_latitude": "decimalLatitude", "decimal_longitude": "decimalLongitude",
    "elevation": "verbatimElevation", "identified_by": "identifiedBy", "type_status": "typeStatus", "basis_of_record": "basisOfRecord", "rights_holder": "rightsHolder", "image_license": "license",
}


def items(pages: DataFrame, path: str) -> DataFrame:
    """One row for each object of the list under the path of a page's body: the page's columns without the body, item_no, item."""
    rows = F.from_json(value(F.col("body"), path) if path else F.col("body"), "array<string>")
    return pages.select("source", "query_name", "page_no", "url", F.posexplode(rows).alias("item_no", "item")).where(F.col("item").startswith("{"))


def _core(item: Column, **other: list[str]) -> dict:
    return {f: value(item, *other.get(f, [term])) for f, term in CORE.items()}


def gbif(pages: DataFrame, all_media: bool = False) -> DataFrame:
    """Occurrence search pages: a record for the best image of each occurrence, or for every image, or without one."""
    rows = items(pages, "results")
    item = F.col("item")

    def media_url(m: Column) -> Column:
        from phyllary.functions.images import is_image_url

        own, ref = F.trim(value(m, "identifier")), F.trim(value(m, "references"))
        return F.when((own != "") & is_image_url(own), own).when((ref != "") & is_image_url(ref), ref).otherwise("")

    pictured = F.filter(entries(item, "media"), lambda m: media_url(m) != "")
    best = F.array_max(F.transform(pictured, lambda m: F.struct(media_rank(media_url(m), value(m, "type"), value(m, "format")).alias("rank"), m.alias("m"))))["m"]
    chosen = pictured if all_media else F.filter(F.array(best), lambda m: m.isNotNull())
    rows = rows.withColumn("media", F.explode_outer(chosen)).withColumn("media", F.coalesce("media", F.lit("{}")))
    m, key = F.col("media"), value(item, "key")
    made = _core(item, scientific_name=["scientificName", "acceptedScientificName"], event_date=["eventDate", "verbatimEventDate"], elevation=["verbatimElevation", "elevation"])
    made |= {
        "source_record_id": key,
        "source_record_url": first_filled(value(item, "references"), value(item, "occurrenceID"), F.when(key != "", F.concat(F.lit("https://www.gbif.org/occurrence/"), key))),
        "image_url": media_url(m),
        "image_license": first_filled(value(m, "license"), value(item, "license")),
        "rights_holder": first_filled(value(m, "rightsHolder"), value(item, "rightsHolder")),
        "coordinate_status": coordinate_state(value(item, "decimalLatitude"), value(item, "decimalLongitude"), value(item, "hasGeospatialIssue") == "true"),
    }
    return finish(rows, made)


def ala(pages: DataFrame, record_url: str = "https://avh.ala.org.au/occurrences/{}", exact: bool = True, specimens: bool = True) -> DataFrame:
    """Occurrence search pages of the atlases: values as delivered count before processed ones; specimens only."""
    rows = items(pages, "occurrences")
    i = F.col("item")
    rows = matching(rows, value(i, "raw_scientificName"), value(i, "scientificName"), value(i, "species"), exact=exact)
    basis = value(i, "basisOfRecord", "raw_basisOfRecord")
    if specimens:
        rows = rows.where((basis == "") | F.lower(basis).contains("specimen") | F.lower(basis).contains("preserved"))
    uuid = value(i, "uuid")
    before, after = record_url.split("{}")
    made = _core(i)
    for f in ("institution_code", "collection_code", "catalog_number", "scientific_name"):
        made[f] = value(i, f"raw_{CORE[f]}", CORE[f])
    made |= {
        "source_record_id": uuid,
        "source_record_url": F.concat(F.lit(before), uuid, F.lit(after)),
        "recorded_by": listed(i, "recordedBy", "collectors", "collector"),
        "event_date": date_from_any(value(i, "raw_eventDate", "eventDate"), value(i, "year"), value(i, "month"), value(i, "day")),
        "verbatim_locality": value(i, "raw_verbatimLocality", "locality"),
        "elevation": value(i, "verbatimElevation", "raw_verbatimElevation"),
        "identified_by": "",
        "type_status": value(i, "typeStatus", "raw_typeStatus"),
        "basis_of_record": basis,
        "coordinate_status": coordinate_state(value(i, "decimalLatitude"), value(i, "decimalLongitude"), F.lower(value(i, "geospatialKosher")) == "false"),
        "image_url": best_image(F.concat(F.array(value(i, "largeImageUrl")), entries(i, "imageUrls"), F.array(value(i, "imageUrl"), value(i, "thumbnailUrl")))),
        "rights_holder": value(i, "rightsHolder", "institutionName"),
    }
    return finish(rows, made)


def nhm(pages: DataFrame, record_url: str = "https://data.nhm.ac.uk/object/{}", exact: bool = True) -> DataFrame:
    """Pages of a CKAN datastore: the best of the media; names of determinations count for the query too."""
    rows = items(pages, "result.records")
    i = F.col("item")
    rows = matching(rows, value(i, "scientificName"), listed(i, "determinationNames"), exact=exact)
    from phyllary.functions.images import size_class

    media = entries(i, "associatedMedia")
    ranked = F.transform(media, lambda m, n: F.struct(size_class(value(m, "identifier")).alias("s"), F.length(value(m, "identifier")).alias("l"), (-n).alias("n"), m.alias("m")))
    rows = rows.withColumn("media", F.coalesce(F.array_max(ranked)["m"], F.lit("{}")))
    m, key = F.col("media"), value(i, "_id", "occurrenceID")
    before, after = record_url.split("{}")
    made = _core(i) | {
        "source_record_id": key, "source_record_url": F.concat(F.lit(before), key, F.lit(after)), "recorded_by": listed(i, "recordedBy"), "record_number": value(i, "recordNumber", "fieldNumber"), "verbatim_locality": value(i, "locality"),
        "identified_by": listed(i, "determinationNames"), "image_url": value(m, "identifier"), "image_license": value(m, "license"), "rights_holder": value(m, "rightsHolder"),
    }
    return finish(rows, made)


def jabot(pages: DataFrame, record_url: str = "https://reflora.jbrj.gov.br/?idTestemunho={}") -> DataFrame:
    """A plain list of vouchers; no images and no filter by name."""
    rows, i = items(pages, ""), F.col("item")
    key = value(i, "codtestemunho", "codespecime")
    before, after = record_url.split("{}")
    made = {
        "source_record_id": key, "source_record_url": F.concat(F.lit(before), key, F.lit(after)), "institution_code": value(i, "siglacolecao"), "catalog_number": value(i, "numtombo"), "scientific_name": value(i, "taxoncompleto"), "recorded_by": value(i, "coletor"),
        "record_number": value(i, "numcoleta"), "event_date": date_from_parts(value(i, "anocoleta"), value(i, "mescoleta"), value(i, "diacoleta")), "country": value(i, "pais"), "state_province": value(i, "estado_prov"), "locality": value(i, "descrlocal"),
        "verbatim_locality": value(i, "descrlocal"), "decimal_latitude": value(i, "latitude"), "decimal_longitude": value(i, "longitude"), "elevation": F.concat_ws(" ", F.nullif(value(i, "altitude"), F.lit("")), F.nullif(value(i, "siglaunidmed"), F.lit(""))),
        "identified_by": value(i, "determinador"), "type_status": value(i, "nat_typus"), "basis_of_record": SPECIMEN, "notes": "metadata_from_jabot_api; image_endpoint_not_public_in_api",
    }
    return finish(rows, made)


def cvh(pages: DataFrame, details: DataFrame, image_url: str = "https://image.cvh.ac.cn/files/l/{}/{}.jpg", detail_url: str = "https://www.cvh.ac.cn/spms/detail.php?id={}", image_license: str = "http://creativecommons.org/licenses/by-nc-nd/4.0/") -> DataFrame:
    """List pages and detail pages (details: key, body): a detail's value counts before the list's."""
    rows = items(pages, "rows").withColumn("key", value(F.col("item"), "collectionID")).where("key <> ''")
    rows = rows.join(details.select("key", value(F.col("body"), "rows").alias("detail")), "key", "left").withColumn("detail", F.when(F.col("detail").startswith("{"), F.col("detail")).otherwise("{}"))
    i, d, key = F.col("item"), F.col("detail"), F.col("key")

    def both(*names: str) -> Column:
        return first_filled(*[value(c, n) for n in names for c in (d, i)])

    institution, catalog = both("institutionCode"), both("collectionCode")
    pictured = both("withPhoto").isin("1", "true", "True") & (institution != "") & (catalog != "")
    a, b, c = image_url.split("{}")
    before, after = detail_url.split("{}")
    locality = F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (both("country"), both("stateProvince"), value(d, "county"), value(d, "locality"))])
    made = {
        "source_record_id": key, "source_record_url": F.concat(F.lit(before), key, F.lit(after)), "institution_code": institution, "catalog_number": catalog, "scientific_name": first_filled(F.trim(F.regexp_replace(both("formattedName"), "<[^>]+>", "")), both("canonicalName")),
        "recorded_by": both("recordedBy"), "record_number": both("recordNumber"), "event_date": first_filled(value(d, "verbatimEventDate", "year"), value(i, "year")), "country": both("country"), "state_province": both("stateProvince"), "locality": locality,
        "verbatim_locality": locality, "elevation": value(d, "elevation"), "type_status": first_filled(value(d, "typeStatus"), F.when(value(i, "isType") == "1", "type")), "basis_of_record": SPECIMEN, "coordinate_status": "missing_coordinates",
        "image_url": F.when(pictured, F.concat(F.lit(a), institution, F.lit(b), catalog, F.lit(c))).otherwise(""), "image_license": image_license, "rights_holder": first_filled(value(d, "institution"), value(i, "institutionCode")),
    }
    return finish(rows, made)


def jacq(pages: DataFrame, images: DataFrame, preferred: str = "europeana", exact: bool = True) -> DataFrame:
    """Specimen pages and image lists (images: key, body): the preferred size of image first, then smaller, then what is shown."""
    rows = items(pages, "result")
    dwc, jq = (lambda *n: value(F.col("item"), *[f"dwc.{p}{x}" for x in n for p in ("dwc:", "")])), (lambda *n: value(F.col("item"), *[f"jacq.{x}" for x in n]))
    rows = rows.withColumn("key", jq("jacq:specimenID", "specimenID")).join(images.select("key", F.col("body").alias("image")), "key", "left")
    im = F.coalesce("image", F.lit("{}"))
    listed_image = first_filled(*[best_image(entries(im, f"download.{k}")) for k in dict.fromkeys([preferred, "europeana", "full", "thumb"])], best_image(entries(im, "show")))
    key, institution = F.col("key"), jq("jacq:OwnerOrganizationAbbrev", "OwnerOrganizationAbbrev")
    catalog = F.trim(first_filled(dwc("catalogNumber"), jq("jacq:HerbNummer")))
    collection = first_filled(dwc("collectionCode"), institution)
    url = first_filled(jq("jacq:stableIdentifier", "stableIdentifier"), dwc("materialSampleID"), F.when(key != "", F.concat(F.lit("https://api.jacq.org/v1/objects/specimens/"), F.url_encode(key))))
    lat, lon = first_filled(dwc("decimalLatitude"), jq("jacq:decimalLatitude")), first_filled(dwc("decimalLongitude"), jq("jacq:decimalLongitude"))
    place = first_filled(dwc("locality"), jq("jacq:Fundort"))
    reference = value(F.col("item"), "dc.dc:IsReferencedBy")
    made = {
        "source_record_id": first_filled(key, catalog, safe_token(url)), "source_record_url": url, "occurrence_id": first_filled(dwc("materialSampleID"), url), "institution_code": first_filled(institution, collection), "collection_code": collection, "catalog_number": catalog,
        "scientific_name": first_filled(dwc("scientificName"), jq("jacq:scientificName")), "recorded_by": first_filled(dwc("recordedBy"), jq("jacq:collectorTeam")), "record_number": first_filled(dwc("fieldNumber"), jq("jacq:alt_number", "jacq:Nummer", "jacq:CollNummer")),
        "event_date": first_filled(dwc("eventDate"), jq("jacq:created")), "country": first_filled(dwc("country"), jq("jacq:nation_engl")), "locality": place, "verbatim_locality": place, "decimal_latitude": lat, "decimal_longitude": lon, "elevation": dwc("verbatimElevation"),
        "type_status": first_filled(dwc("typeStatus"), jq("jacq:typeInformation")), "basis_of_record": first_filled(dwc("basisOfRecord"), F.lit(SPECIMEN)), "image_url": first_filled(listed_image, jq("jacq:downloadImage", "downloadImage")),
        "image_license": jq("jacq:LicenseURI", "LicenseURI"), "rights_holder": first_filled(institution, F.lit("JACQ consortium")), "notes": F.concat(F.lit("metadata_from_jacq_api"), F.when(reference != "", F.concat(F.lit("; references="), reference)).otherwise("")),
    }
    return matching(finish(rows, made), "scientific_name", exact=exact)


def nmnh(pages: DataFrame, image_width: int = 1600, exact: bool = True, with_images: bool = False) -> DataFrame:
    """Search pages in the museum's short field names; earlier determinations count for the query too."""
    rows, i = items(pages, "records"), F.col("item")
    rows = rows.withColumn("media", F.coalesce(F.get(entries(i, "mulmm"), 0), F.lit("{}")))
    m, key, w = F.col("media"), value(i, "_id"), str(image_width)
    uuid, mid = F.trim(value(m, "muluu")), F.trim(value(m, "mulid"))
    image = F.when(F.lower(value(m, "mulmt")) != "image", "").when((value(m, "siids") == "true") & (uuid != ""), F.concat(F.lit("https://ids.si.edu/ids/deliveryService/id/ark:/65665/m3"), uuid, F.lit(f"/{w}")))
    image = image.when(mid != "", F.concat(F.lit(f"https://ids.si.edu/ids/deliveryService?max={w}&id=https://collections.nmnh.si.edu/media/?irn="), mid)).otherwise("")
    plain = F.regexp_replace(F.lower(value(i, "admuu")), "[^0-9a-f]", "")
    ark = F.when(F.length(plain) == 32, F.concat(F.lit("http://n2t.net/ark:/65665/3"), F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))).otherwise("")
    catalog = F.trim(F.regexp_replace(value(i, "darcx", "catnb.catnc"), r"[\s ]+", " "))
    others = F.array_join(F.transform(entries(i, "ideon"), lambda e: value(e, "ideoq")), " | ")
    name = value(i, "idefa.ideqn", "darsn")
    rows = matching(rows, name, value(i, "darsn"), others, exact=exact)
    made = {
        "source_record_id": first_filled(key, catalog), "source_record_url": F.when(key != "", F.concat(F.lit("https://collections.nmnh.si.edu/search/botany/?irn="), F.url_encode(key))).otherwise(""), "occurrence_id": first_filled(ark, key),
        "institution_code": first_filled(value(i, "daric"), F.lit("US")), "collection_code": first_filled(value(i, "catct"), F.lit("Botany")), "catalog_number": catalog, "scientific_name": name, "recorded_by": first_filled(listed(i, "biopr"), value(i, "darcr", "biopc")),
        "record_number": value(i, "darcn", "biopn"), "event_date": value(i, "coldv.coled", "coldv.colvd"), "country": value(i, "darct"), "state_province": value(i, "darst"), "locality": value(i, "darlc"), "verbatim_locality": value(i, "darhg", "darlc"),
        "decimal_latitude": value(i, "darlt"), "decimal_longitude": value(i, "darln"), "elevation": value(i, "darel.darem", "darel.darve"), "identified_by": value(i, "idefa.ideib"), "type_status": value(i, "darts"), "basis_of_record": SPECIMEN, "image_url": image,
        "image_license": value(m, "detrs"), "rights_holder": value(m, "detrg"), "notes": "metadata_from_nmnh_public_search",
    }
    out = finish(rows, made)
    return out.where("image_url <> ''") if with_images else out


def naturalis(pages: DataFrame, exact: bool = True) -> DataFrame:
    """Query results: the preferred identification, else the first; all gathering persons."""
    rows = items(pages, "resultSet").withColumn("item", value(F.col("item"), "item")).where(F.col("item").startswith("{"))
    i = F.col("item")
    known = entries(i, "identifications")
    preferred = F.get(F.filter(known, lambda e: value(e, "preferred") == "true"), 0)
    rows = rows.withColumn("identification", F.coalesce(preferred, F.get(known, 0), F.lit("{}")))
    g = lambda *n: value(i, *[f"gatheringEvent.{x}" for x in n])
    persons = F.filter(F.transform(entries(i, "gatheringEvent.gatheringPersons"), lambda p: value(p, "fullName", "agentText")), lambda p: p != "")
    pictures = F.transform(F.filter(entries(i, "associatedMultiMediaUris"), lambda m: F.lower(value(m, "format")).startswith("image/")), lambda m: value(m, "accessUri"))
    unit, date = value(i, "unitID", "sourceSystemId", "id"), F.trim(g("dateTimeBegin", "dateText"))
    site = F.coalesce(F.get(entries(i, "gatheringEvent.siteCoordinates"), 0), F.lit("{}"))
    made = {
        "source_record_id": first_filled(value(i, "id"), unit), "source_record_url": first_filled(value(i, "unitGUID"), F.when(unit != "", F.concat(F.lit("https://data.biodiversitydata.nl/naturalis/specimen/"), unit))), "occurrence_id": value(i, "unitGUID", "id"),
        "institution_code": "L", "catalog_number": unit, "scientific_name": value(F.col("identification"), "scientificName.fullScientificName"), "recorded_by": F.array_join(persons, "; "), "record_number": value(i, "collectorsFieldNumber"),
        "event_date": F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(date, 1, 10)).otherwise(date), "country": g("country"), "state_province": g("provinceState"), "locality": g("locality"), "verbatim_locality": g("localityText", "locality"),
        "decimal_latitude": value(site, "latitudeDecimal"), "decimal_longitude": value(site, "longitudeDecimal"), "elevation": F.concat_ws(" ", F.nullif(g("altitude"), F.lit("")), F.nullif(g("altitudeUnifOfMeasurement"), F.lit(""))),
        "basis_of_record": first_filled(value(i, "recordBasis"), F.lit(SPECIMEN)), "image_url": best_image(pictures), "image_license": value(i, "license"), "rights_holder": value(i, "owner", "sourceInstitutionID"),
    }
    return matching(finish(rows, made), "scientific_name", exact=exact)


def symbiota(details: DataFrame, institutions: list[str] | None = None, exact: bool = True, specimens: bool = True) -> DataFrame:
    """Occurrences of a portal. details: source, query_name, page_no, url (of the public page), key (occid), body (the interface's JSON
    list), html (the public page). Observations are left out; limits apply to what is kept, so use page_of on the result."""
    from phyllary.sources.html_pages import image_urls, labelled_text

    rows = details.withColumn("item", F.get(F.from_json("body", "array<string>"), 0)).where(F.col("item").startswith("{")).withColumn("item_no", F.col("key").try_cast("long"))
    i = F.col("item")
    if specimens:
        rows = rows.where(~F.lower(value(i, "basisOfRecord")).contains("observation"))
    if exact:
        rows = rows.where(name_matches("query_name", value(i, "sciname"), value(i, "scientificName"), value(i, "taxoncompleto")))
    institution = value(i, "institutionCode", "ownerInstitutionCode")
    rows = rows.where(institution_allowed(institutions or [], institution, value(i, "collectionCode"), value(i, "ownerInstitutionCode")))
    place = F.concat_ws(" ", *[F.nullif(value(i, n), F.lit("")) for n in ("country", "stateProvince", "county", "locality")])
    made = _core(i, scientific_name=["sciname", "scientificName"], record_number=["recordNumber", "fieldNumber"], elevation=["verbatimElevation", "minimumElevationInMeters"]) | {
        "source_record_id": F.col("key"), "source_record_url": F.col("url"), "institution_code": institution, "event_date": first_filled(value(i, "eventDate"), date_from_parts(value(i, "year"), value(i, "month"), value(i, "day"))), "locality": place, "verbatim_locality": place,
        "basis_of_record": first_filled(value(i, "basisOfRecord"), F.lit(SPECIMEN)), "image_url": best_image(image_urls(F.col("html"), F.col("url"))), "image_license": F.regexp_replace(F.regexp_extract(text("html"), r"(?i)(https?://creativecommons\.org/[^\s\"'<>]+)", 1), "[.,;]+$", ""),
        "rights_holder": labelled_text(F.col("html"), "Rights Holder"),
    }
    return finish(rows, made)


def symbiota_ids(pages: DataFrame) -> DataFrame:
    """The occurrence ids in a portal's list pages: source, query_name, occid, each once, in the order of the numbers."""
    patterns = [r"(?i)openIndPU\(\s*(\d+)", r"(?i)name=[\"']occid\[\][\"'][^>]+value=[\"'](\d+)", r"(?i)[?&]occid=(\d+)"]
    found = F.flatten(F.array(*[F.regexp_extract_all("body", F.lit(p), 1) for p in patterns]))
    return pages.select("source", "query_name", F.explode(F.array_distinct(found)).alias("occid")).distinct().orderBy("source", "query_name", F.col("occid").cast("decimal(38,0)"))
