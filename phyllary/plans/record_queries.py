"""Queries over records: keys, merging, exports, joins and rankings; each with SQL for DuckDB on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phyllary.operators.report import source_totals
from phyllary.sources.image_files import image_accounts
from phyllary.sources.archives import under_keys
from phyllary.sources.common import page_of, union_components
from phyllary.functions.images import best_image, media_rank
from phyllary.functions.partial_dates import date_from_any, date_from_parts, epoch_date
from phyllary.functions.text import (
    appended_value,
    broad_locality,
    cache_key,
    first_filled,
    institution_allowed,
    name_matches,
    normal_url,
    redacted,
    safe_token,
    script_languages,
    text,
    type_token,
)
from phyllary.operators.export import darwin_core, sidecar
from phyllary.operators.identity import identity_key, image_basename, numbered_names, with_codes
from phyllary.operators.merge import duplicate_gatherings, first_seen, merged_records, ordered_values
from phyllary.schema import EXPORT_FIELDS, RECORD_FIELDS, as_records
from phyllary.session import table

ALLOWED = ["KJV", "AGJU", "UFZ"]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return as_records(table(spark, d, "specimen_records"), "seq")


# ---- SQL building blocks


def t(c: str) -> str:
    return f"coalesce({c}, '')"


def code_sql(c: str) -> str:
    return f"regexp_replace(upper({t(c)}), '[^A-Z0-9]+', '', 'g')"


def inst_sql(c: str) -> str:
    return f"(case {code_sql(c)} when 'MNHN' then 'P' when 'NHMUK' then 'BM' when 'BRITISHMUSEUM' then 'BM' else {code_sql(c)} end)"


def words_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def type_sql(c: str) -> str:
    plain = f"(' ' || regexp_replace(lower({t(c)}), '[^a-z]+', ' ', 'g') || ' ')"
    names = ["isolectotype", "isoneotype", "isoholotype", "lectotype", "holotype", "neotype", "syntype", "isotype", "paratype", "epitype", "type"]
    return "(case " + " ".join(f"when contains({plain}, ' {n} ') then '{n}'" for n in names) + " else '' end)"


def url_sql(c: str) -> str:
    p = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]+)?[?]?(#.*)?$"
    x = f"trim({t(c)})"
    g = lambda i: f"regexp_extract({x}, '{p}', {i})"
    return f"(case when regexp_matches({x}, '{p}') then lower({g(1)}) || '://' || lower({g(2)}) || regexp_replace({g(3)}, '/+', '/', 'g') || {g(4)} else {x} end)"


#: Records with holder (h), catalogue (cat), keys and codes.
KEYED = f"""r as (select seq, {", ".join(f"{t(f)} as {f}" for f in RECORD_FIELDS)} from specimen_records),
c as (select *, {inst_sql("institution_code")} as inst, {code_sql("collection_code")} as coll, {code_sql("catalog_number")} as cat from r),
h as (select *, case when regexp_full_match(coll, '[A-Z][A-Z0-9]{{0,7}}') and starts_with(cat, coll) then coll when inst <> '' and starts_with(cat, inst) then inst
  when regexp_full_match(coll, '[A-Z][A-Z0-9]{{0,7}}') then coll else inst end as h from c),
k as (select *, sha256(case when h <> '' and cat <> '' then 'institution_catalog|' || h || '|' || cat
  when occurrence_id <> '' then 'occurrence|' || case when h <> '' then h || '|' else '' end || lower(regexp_replace(trim(occurrence_id), '\\s+', ' ', 'g'))
  when image_url <> '' then {url_sql("image_url")} when source_record_url <> '' then {url_sql("source_record_url")}
  else source || '|' || source_record_id || '|' || query_name end) as key from h)"""


def event_sql() -> str:
    who, num, date = (words_sql(c) for c in ("recorded_by", "record_number", "event_date"))
    where = words_sql("country || ' ' || state_province || ' ' || locality")
    return f"(case when {who} <> '' and {date} <> '' and {where} <> '' then sha256('collection_event|' || {who} || '|' || {num} || '|' || {date} || '|' || {where}) else '' end)"


SPECIMEN_CODE = f"""(case when cat <> '' and (h = '' or starts_with(cat, h)) then cat when h <> '' and cat <> '' then h || cat
 when h <> '' and {code_sql("case when source_record_id <> '' then source_record_id else occurrence_id end")} <> '' and not starts_with({code_sql("case when source_record_id <> '' then source_record_id else occurrence_id end")}, h)
   then h || {code_sql("case when source_record_id <> '' then source_record_id else occurrence_id end")}
 when {code_sql("case when source_record_id <> '' then source_record_id else occurrence_id end")} <> '' then
   case when {inst_sql("source")} = '' or starts_with({code_sql("case when source_record_id <> '' then source_record_id else occurrence_id end")}, {inst_sql("source")}) then '' else {inst_sql("source")} end
   || {code_sql("case when source_record_id <> '' then source_record_id else occurrence_id end")}
 else case when {inst_sql("source")} = '' then 'SPECIMEN' else {inst_sql("source")} end || 'UNKNOWN' end)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {KEYED} select seq, key as physical_key, h as holder_code from k")
def identity_keys(spark, d):
    return with_codes(_records(spark, d)).select("seq", identity_key().alias("physical_key"), F.col("__holder").alias("holder_code"))


_PRIO = f"({type_sql('type_status')} <> '') desc, (image_url <> '') desc, (decimal_latitude <> '' and decimal_longitude <> '') desc, length(locality) + length(recorded_by) + length(event_date) desc, seq"
_BASE = ["source", "source_record_id", "source_record_url", "download_url", "local_image_path", "image_sha256", "download_status", "notes"]
_FIELDS = [f for f in RECORD_FIELDS if f not in ("physical_specimen_key", "collection_event_key", "merged_from_sources", "merged_record_count")]
_MERGED = f"""with {KEYED}, p as (select *, row_number() over (partition by key order by {_PRIO}) as rn from k),
g as (select key, min(seq) as first_seq, count(*)::varchar as merged_record_count,
  {", ".join(f"arg_min({f}, rn) as {f}" if f in _BASE else f"coalesce(arg_min({f}, rn) filter (where {f} <> ''), '') as {f}" for f in _FIELDS)} from p group by key),
s as (select key, string_agg(source, '; ' order by o) as merged_from_sources from (select key, source, min(seq) as o from k where source <> '' group by all) group by key)"""


@query(f"""{_MERGED} select first_seq, key as physical_specimen_key, {event_sql()} as collection_event_key, coalesce(merged_from_sources, '') as merged_from_sources, merged_record_count, {", ".join(_FIELDS)}
from g left join s using (key)""")
def survivorship_merge(spark, d):
    return merged_records(_records(spark, d)).select("first_seq", "physical_specimen_key", "collection_event_key", "merged_from_sources", "merged_record_count", *_FIELDS)


_SQL_EXPORT = {
    "occurrenceID": "case when occurrence_id <> '' then occurrence_id when source_record_url <> '' then source_record_url else source_record_id end",
    "catalogNumber": SPECIMEN_CODE,
    "otherCatalogNumbers": f"case when trim(catalog_number) <> '' and trim(catalog_number) <> {SPECIMEN_CODE} then trim(catalog_number) else '' end",
    "datasetName": "case when merged_from_sources <> '' then merged_from_sources else source end",
    "acceptedNameUsage": "query_name",
    "associatedMedia": "array_to_string(list_filter([local_image_path, case when regexp_matches(download_url, '^https?://') and download_url <> local_image_path then download_url else '' end, case when regexp_matches(image_url, '^https?://') and image_url <> download_url and image_url <> local_image_path then image_url else '' end], lambda x: x <> ''), ' | ')",
}


def _export_sql(column: str) -> str:
    from phyllary.operators.export import PLAIN

    return f"{_SQL_EXPORT.get(column) or PLAIN[column]} as \"{column}\""


@query(f"with {KEYED} select seq, {', '.join(map(_export_sql, EXPORT_FIELDS))} from k")
def darwin_core_rows(spark, d):
    return darwin_core(_records(spark, d), F.col("query_name"), "seq")


@query(f"with {KEYED} select collection_event_key, count(*) as specimens from (select {event_sql()} as collection_event_key from k) where collection_event_key <> '' group by 1 having count(*) > 1")
def gatherings_with_duplicates(spark, d):
    return duplicate_gatherings(_records(spark, d))


@query("select sha256(text) as key, min(doc_id) as first, count(*) as copies from documents where text <> '' group by 1")
def dedup_first_seen(spark, d):
    docs = table(spark, d, "documents")
    return first_seen(docs, F.when(F.col("text") != "", F.sha2("text", 256)), "doc_id")


@query("""with a as (select text, source, min(doc_id) as o from documents where text <> '' and source is not null group by all)
select sha256(text) as text_key, string_agg(source, '; ' order by o) as sources from a group by 1 having count(*) > 1""")
def merged_sources_ordered_distinct(spark, d):
    docs = table(spark, d, "documents").where("text <> '' and source is not null").select(F.sha2("text", 256).alias("text_key"), "source", "doc_id")
    return ordered_values(docs, ["text_key"], "source", "doc_id", "s").where(F.size("s") > 1).select("text_key", F.array_join("s", "; ").alias("sources"))


_NAME_TOKEN = "coalesce(nullif(array_to_string(list_slice(regexp_extract_all(query_name, '[A-Za-z][A-Za-z-]*'), 1, 2), '_'), ''), 'Unknown_taxon')"


@query(f"""with {KEYED}, b as (select seq, {SPECIMEN_CODE} || '_' || {_NAME_TOKEN} || case when {type_sql("type_status")} <> '' then '_' || {type_sql("type_status")} else '' end as base from k)
select seq, base || case when row_number() over (partition by base order by seq) > 1 then '_' || row_number() over (partition by base order by seq) else '' end as file_name from b""")
def file_suffix_nth(spark, d):
    return numbered_names(with_codes(_records(spark, d)), image_basename("query_name"), "seq").select("seq", "file_name")


@query(f"select seq, {type_sql('type_status')} as type_token from specimen_records")
def type_token_cascade(spark, d):
    return _records(spark, d).select("seq", type_token("type_status").alias("type_token"))


_BINOMIAL = f"regexp_extract({words_sql(t('query_name'))}, '^(\\S+ \\S+)', 1)"


@query(f"select seq, {_BINOMIAL} = '' or contains({words_sql(t('scientific_name'))}, {_BINOMIAL}) as matches from specimen_records")
def name_match_filter(spark, d):
    return _records(spark, d).select("seq", name_matches("query_name", "scientific_name").alias("matches"))


@query(f"""with v as (select seq, unnest(list_concat([{t('institution_code')}, {t('collection_code')}], list_concat(regexp_split_to_array({t('institution_code')}, '[:/;,()\\s-]+'), regexp_split_to_array({t('collection_code')}, '[:/;,()\\s-]+')))) as x from specimen_records)
select seq, coalesce(bool_or(regexp_replace(upper(x), '[^A-Z0-9]+', '', 'g') in ({", ".join(f"'{a}'" for a in ALLOWED)})), false) as allowed from v group by seq""")
def institution_overlap(spark, d):
    return _records(spark, d).select("seq", institution_allowed(ALLOWED, "institution_code", "collection_code").alias("allowed"))


@query("""select seq, query_name, source, n as place from (select r.seq, r.query_name, r.source, row_number() over (partition by r.query_name order by p.trust_rank, r.source, r.seq) as n
from specimen_records r join source_profiles p using (source)) where n <= 50""")
def source_union_budget(spark, d):
    """Components of a federated source in their order share one budget of records for each name (the feature: a per-query limit)."""
    records = table(spark, d, "specimen_records").select("seq", "query_name", "source")
    ranked = records.join(F.broadcast(table(spark, d, "source_profiles").select("source", "trust_rank")), "source")
    # pages of a component are its sources by trust, items their records
    items = ranked.select("seq", "query_name", F.col("source").alias("own"), F.col("trust_rank").alias("page_no"), F.struct(F.col("source").alias("s"), "seq").alias("item_no"), "source")
    out = union_components([items.where("page_no <= 3"), items.where("page_no > 3")], "federated", 50, number="place")
    return out.select("seq", "query_name", F.col("own").alias("source"), "place")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 100 offset 200")
def page_offset_limit(spark, d):
    """One page of an ordered scan (the feature: paging)."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit("orders").alias("source"), F.lit("all").alias("query_name"))
    return page_of(orders, 200, 100, ("o_orderkey",)).select("o_orderkey", "o_totalprice")


@query("""with m as (select trim(catalog_number) as id, image_path, label_seq from label_reads where trim(catalog_number) <> ''),
k as (select seq, trim(coalesce(catalog_number, '')) as k1, trim(coalesce(source_record_id, '')) as k2 from specimen_records),
j as (select k.seq, m.image_path, m.label_seq from k join m on m.id = k.k1 where k.k1 <> '' union all select k.seq, m.image_path, m.label_seq from k join m on m.id = k.k2 where k.k2 <> '' and k.k2 <> k.k1)
select k.seq, count(j.label_seq) as media, coalesce(min(j.image_path), '') as first_path from k left join j using (seq) group by k.seq""")
def media_left_join_two_keys(spark, d):
    """Media of a record under its catalogue number and, where that differs, under its source's id."""
    media = table(spark, d, "label_reads").select(F.trim("catalog_number").alias("mid"), "image_path", "label_seq").where("mid <> ''")
    core = table(spark, d, "specimen_records").select("seq", F.trim(text("catalog_number")).alias("k1"), F.trim(text("source_record_id")).alias("k2"))
    held = under_keys(core, media, ["seq"], F.array("k1", "k2"), {"n": F.count("*"), "path": F.min("image_path")})
    per = held.groupBy("seq").agg(F.sum("n").alias("media"), F.min("path").alias("first_path"))
    return core.select("seq").join(per, "seq", "left").select("seq", F.coalesce("media", F.lit(0)).alias("media"), F.coalesce("first_path", F.lit("")).alias("first_path"))


_MEDIA_URL, _MEDIA_KIND, _MEDIA_FORMAT = "case when label_seq % 4 = 0 then 'https://a.example/full/' || image_width || ',/x' when label_seq % 4 = 1 then 'https://a.example/originals/' || image_path else image_path end", "case when label_seq % 3 = 0 then 'StillImage' else 'Sound' end", "case when label_seq % 2 = 0 then 'image/jpeg' else '' end"


@query(f"""with m as (select trim(catalog_number) as catalog_number, label_seq, coalesce({_MEDIA_URL}, '') as url, {_MEDIA_KIND} as kind, {_MEDIA_FORMAT} as fmt from label_reads where trim(catalog_number) <> ''),
r as (select *, case when kind = 'StillImage' then 2 else 0 end + case when fmt like 'image/%' then 1 else 0 end as k, case when regexp_matches(url, '/full/[0-9]+,') then regexp_extract(url, '/full/([0-9]+),', 1)::int when contains(lower(url), '/originals/') then 10000
 when regexp_matches(lower(url), '[.](jpg|jpeg|png|tif|tiff|webp)($|[?])') then 1000 else 0 end as size from m)
select catalog_number, arg_max(label_seq, {{'k': k, 's': size, 'u': url, 'l': -label_seq}}) as best_label, count(*) as reads from r group by 1""")
def best_media(spark, d):
    """The best of the media items of each catalogue number, the first of equals."""
    reads = table(spark, d, "label_reads").withColumn("catalog_number", F.trim("catalog_number")).where("catalog_number <> ''")
    rank = F.struct(media_rank(F.expr(_MEDIA_URL), F.expr(_MEDIA_KIND), F.expr(_MEDIA_FORMAT)).alias("r"), (-F.col("label_seq")).alias("l"))
    return reads.groupBy("catalog_number").agg(F.max_by("label_seq", rank).alias("best_label"), F.count("*").alias("reads"))


_LABEL_FIELDS = {"locality": "locality_text", "event_date": "event_date_text", "recorded_by": "collector_text", "elevation": "elevation_text"}


@query(f"""with s as (select key, arg_min(rw, label_seq) as rw from (select trim(catalog_number) as key, label_seq, {{{", ".join(f"'{b}': {t(b)}" for b in _LABEL_FIELDS.values())}, 'n': label_seq}} as rw from label_reads where trim(catalog_number) <> '') group by key)
select r.seq, {", ".join(f"case when {t('s.rw.' + b)} <> '' then s.rw.{b} else {t('r.' + a)} end as {b}" for a, b in _LABEL_FIELDS.items())}, case when s.key is null then 'dwc_text' else 'sidecar_tsv' end as label_source
from specimen_records r left join s on s.key = trim(coalesce(r.catalog_number, ''))""")
def sidecar_first_wins_join(spark, d):
    """A record's label texts from the side table, whose first row for a key counts, else from the record."""
    labels = table(spark, d, "label_reads").select("catalog_number", "label_seq", *_LABEL_FIELDS.values())
    side = sidecar(labels, "label_seq", "catalog_number")
    records = _records(spark, d).withColumn("__k", F.trim("catalog_number"))
    side = side.select("sidecar_key", *[F.col(b).alias(f"__{b}") for b in _LABEL_FIELDS.values()])
    out = records.join(side, F.col("__k") == F.col("sidecar_key"), "left")
    return out.select("seq", *[first_filled(f"__{b}", a).alias(b) for a, b in _LABEL_FIELDS.items()], F.when(F.col("sidecar_key").isNull(), "dwc_text").otherwise("sidecar_tsv").alias("label_source"))


@query("""with l as (select distinct image_path from label_reads where image_path <> ''), c as (select distinct image_path from coordinate_candidates where image_path <> '')
select 'referenced' as kind, count(*) as files from l where image_path in (select image_path from c) union all select 'unreferenced', count(*) from l where image_path not in (select image_path from c)""")
def semi_anti_accounting(spark, d):
    """Files that other rows refer to, and files that none does."""
    files = table(spark, d, "label_reads").select(F.col("image_path").alias("path")).where("path <> ''")
    both = image_accounts(files, table(spark, d, "coordinate_candidates").select(F.col("image_path").alias("path")))
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("files")) for k in ("referenced", "unreferenced")])).alias("x")).select("x.*")


_Y, _M, _D = "year(o_orderdate)::varchar", "case when o_orderkey % 5 = 0 then '' else month(o_orderdate)::varchar end", "case when o_orderkey % 3 = 0 then '' else day(o_orderdate)::varchar end"


@query(f"""select o_orderkey, case when m = '' then y when d = '' then y || '-' || lpad(m, 2, '0') else y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') end as event_date
from (select o_orderkey, {_Y} as y, {_M} as m, {_D} as d from orders)""")
def partial_dates(spark, d):
    o = table(spark, d, "orders")
    month = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.month("o_orderdate").cast("string"))
    day = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.dayofmonth("o_orderdate").cast("string"))
    return o.select("o_orderkey", date_from_parts(F.year("o_orderdate"), month, day).alias("event_date"))


@query("""select event_id, case when event_id % 4 = 0 then strftime(ts, '%Y') else strftime(ts, '%Y-%m-%d') end as event_date from events""")
def epoch_millis_date(spark, d):
    """Milliseconds as a date; where a year is given beside them, that counts."""
    e = table(spark, d, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    year = F.when(F.col("event_id") % 4 == 0, F.year("ts").cast("string")).otherwise("")
    return e.select("event_id", date_from_any(millis, year, F.lit(""), F.lit("")).alias("event_date"))


@query(f"select seq, {url_sql('image_url')} as image_url, {url_sql('source_record_url')} as record_url from specimen_records")
def url_normalise(spark, d):
    return _records(spark, d).select("seq", normal_url("image_url").alias("image_url"), normal_url("source_record_url").alias("record_url"))


@query(r"""select cand_seq, regexp_replace('https://api.test/x?a=1&key=' || cand_seq || '&Token=' || coalesce(catalog_number, '') || '&b=2', '([?&](?:api_key|apikey|key|token|access_token|password|client_secret)=)[^&\s)]+', '\1REDACTED', 'gi') as url from coordinate_candidates""")
def url_redact(spark, d):
    url = F.concat(F.lit("https://api.test/x?a=1&key="), F.col("cand_seq").cast("string"), F.lit("&Token="), text("catalog_number"), F.lit("&b=2"))
    return table(spark, d, "coordinate_candidates").select("cand_seq", redacted(url).alias("url"))


@query(r"""select seq, coalesce(nullif(left(regexp_replace(regexp_replace(coalesce(locality, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 140), ''), 'unknown') as token from specimen_records""")
def safe_tokens(spark, d):
    return _records(spark, d).select("seq", safe_token("locality").alias("token"))


@query("""with u as (select seq, image_url as a, replace(image_url, '.jpg', '_tn.jpg') as b, download_url as c from specimen_records),
x as (select seq, unnest([a, b, c]) as url, unnest([1, 2, 3]) as i from u),
s as (select seq, i, url, case when contains(lower(url), '/full/full/') or contains(lower(url), 'original') then 5000 when contains(lower(url), 'large') or regexp_matches(lower(url), '\\bfs\\b|_fs\\.') then 4000
 when contains(lower(url), '!1920') or contains(lower(url), '2400') then 3000 when contains(lower(url), '_web.') or contains(lower(url), 'medium') then 2000
 when contains(lower(url), '_tn.') or contains(lower(url), 'thumbnail') or contains(lower(url), 'small') then 100 else 1000 end as size from x where regexp_matches(lower(url), '\\.(?:jpe?g|png|tiff?|webp)(?:$|\\?)'))
select r.seq, coalesce(arg_min(url, {'a': -size, 'b': -length(url), 'c': i}), '') as best from specimen_records r left join s using (seq) group by r.seq""")
def best_image_of_several(spark, d):
    r = _records(spark, d)
    return r.select("seq", best_image(F.array("image_url", F.replace("image_url", F.lit(".jpg"), F.lit("_tn.jpg")), "download_url")).alias("best"))


@query(r"""select doc_id, array_to_string(case when len(x) = 0 then ['und'] else x end, ' | ') as languages from (select doc_id, list_filter([case when regexp_matches(t, '[\x{3040}-\x{30ff}]') then 'ja' end,
 case when regexp_matches(t, '[\x{4e00}-\x{9fff}]') then case when regexp_matches(t, '[\x{3040}-\x{30ff}]') then 'ja/zh' else 'zh' end end, case when regexp_matches(t, '[A-Za-z]') then 'en/la' end], lambda v: v is not null) as x
 from (select doc_id, coalesce(text, '') as t from documents))""")
def language_script(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(script_languages("text"), " | ").alias("languages"))


_LOC = r"regexp_replace(lower(trim({})), '\s+', ' ', 'g')"
_TOK = r"regexp_extract_all({}, '[A-Za-z\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}0-9]+')"
_DETAIL = " or ".join(f"contains(loc, '{w}')" for w in ["mt.", "mount", "mountain", "river", "stream", "valley", "trail", "village", "mura", "gun", "county", "forest", "road", "km"])


@query(rf"""with a as (select seq, {_LOC.format("concat_ws(' ', nullif(verbatim_locality, ''), nullif(locality, ''))")} as loc, {_LOC.format(t('country'))} as cou, {_LOC.format(t('state_province'))} as sta from specimen_records),
b as (select *, regexp_replace(loc, '^[ .,:;]+|[ .,:;]+$', '', 'g') as bare, list_filter({_TOK.format('loc')}, lambda w: w not in ('pref', 'province', 'county', 'country')) as inf, list_concat({_TOK.format('cou')}, {_TOK.format('sta')}) as adm from a)
select seq, case when loc = '' and (cou <> '' or sta <> '') then 'Only country/state-level locality is available.' when loc = '' then 'No locality text is available.'
 when bare in ('china', 'japan', 'taiwan', 'chinese taipei', 'philippines', 'nepal', 'india', 'vietnam', 'thailand', 'malaysia', 'indonesia') or bare = cou or bare = sta or (len(inf) > 0 and len(adm) > 0 and len(list_filter(inf, lambda w: not list_contains(adm, w))) = 0)
 then 'Locality is too broad for georeferencing: ' || bare || '.'
 when (contains(loc, 'prefecture') or contains(loc, 'province') or contains(loc, 'pref.')) and not ({_DETAIL}) and len(inf) <= 2 then 'Only broad administrative locality is available.' else '' end as reason from b""")
def locality_sufficiency(spark, d):
    r = _records(spark, d)
    locality = F.concat_ws(" ", F.nullif("verbatim_locality", F.lit("")), F.nullif("locality", F.lit("")))
    return r.select("seq", broad_locality(locality, F.col("country"), F.col("state_province")).alias("reason"))


@query("select label_seq, sha256(concat('label', chr(0), coalesce(catalog_number, ''), chr(0), coalesce(label_transcription, ''), chr(0))) as key from label_reads")
def cache_keys(spark, d):
    return table(spark, d, "label_reads").select("label_seq", cache_key(F.lit("label"), "catalog_number", "label_transcription").alias("key"))


@query(f"""with a as (select coalesce(source, '') as source, {type_sql('type_status')} <> '' as is_type, coalesce(decimal_latitude, '') <> '' and coalesce(decimal_longitude, '') <> '' as located, coalesce(image_url, '') <> '' as pictured, coalesce(download_status, '') as st from specimen_records)
select case when grouping(source) = 1 then '(all)' else source end as source, count(*) as records, count(*) filter (where located) as located, count(*) filter (where pictured) as pictured, count(*) filter (where is_type) as types,
 count(*) filter (where st = 'downloaded') as downloaded, count(*) filter (where st = 'failed') as failed from a group by rollup (source)""")
def run_summary(spark, d):
    """Totals of a run for each source and in all, in one pass."""
    return source_totals(_records(spark, d))


@query("select event_id, coalesce(props ->> '$.page', '') as page, coalesce(props ->> '$.session', '') as session, coalesce(props ->> '$.missing', '') as missing from events")
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", *[F.coalesce(F.get_json_object("props", f"$.{k}"), F.lit("")).alias(k) for k in ("page", "session", "missing")])


@query(r"""with p as (select cand_seq, unnest(split(coalesce(evidence_layers, ''), '|') || ['audited']) as x, generate_subscripts(split(coalesce(evidence_layers, ''), '|') || ['audited'], 1) as i from coordinate_candidates),
f as (select cand_seq, trim(x) as x, min(i) as i from p where trim(x) <> '' group by all) select cand_seq, string_agg(x, ' | ' order by i) as layers from f group by 1""")
def audit_append(spark, d):
    """A value appended to a packed list, each value once."""
    return table(spark, d, "coordinate_candidates").select("cand_seq", appended_value("evidence_layers", F.lit("audited")).alias("layers"))
