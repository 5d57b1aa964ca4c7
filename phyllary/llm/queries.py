"""Queries of the subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllary.llm.canonical import entries_within, map_to_list
from phyllary.llm.mixing import LISTED, mix_report, mix_sources
from phyllary.llm.name_variants import link_names, variant_pairs
from phyllary.llm.packing import pack_items, packing_report
from phyllary.llm.sentences import split_sentences
from phyllary.llm.survivors import NO_PLACE, Bundle, catalogue_key, choose_survivors, names_place, usable_latitude
from phyllary.llm.tokens import token_count
from phyllary.operators.packed import split_packed
from phyllary.plans.core_queries import known_names
from phyllary.session import durable, spread, table

PLACE_FIELDS = {"country": "country", "state_province": "state_province", "institution_code": "institution_code"}


def _grouped(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Records with their catalogue key and the trust rank of their source (24 sources, one row each)."""
    records = table(spark, d, "specimen_records").select("seq", "source", "institution_code", "catalog_number", "accessed_at", *columns)
    ranks = F.broadcast(table(spark, d, "source_profiles").select("source", "trust_rank"))
    return catalogue_key(records, table(spark, d, "canonical_entries")).where("number is not null").join(ranks, "source", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    bundles = [Bundle("decimal_latitude", ["decimal_latitude"], usable_latitude(F.col("decimal_latitude"))), Bundle("locality", ["locality"], names_place(F.col("locality")))]
    chosen = choose_survivors(_grouped(spark, d, "decimal_latitude", "locality"), ["holder", "number"], bundles, "trust_rank", "accessed_at", "seq")
    fields = F.explode(F.array(*[F.struct(F.lit(b.name).alias("field_name"), F.col(f"{b.name}_seq").alias("seq")) for b in bundles])).alias("f")
    return chosen.select("group_seq", fields).select("group_seq", "f.field_name", "f.seq").where("seq is not null")


def p4_bundles(spark: SparkSession, d: str) -> DataFrame:
    """The surviving bundles of each specimen: places together, coordinates together, gathering together; a locality goes only with a
    country and state that a record gives it."""

    def any_filled(*columns: str):
        return F.length(F.trim(F.concat_ws("", *columns))) > 0

    bundles = [
        Bundle("locality", ["locality"], names_place(F.col("locality"))),
        Bundle("region", ["country", "state_province"], any_filled("country", "state_province")),
        Bundle("coordinates", ["decimal_latitude", "decimal_longitude"], usable_latitude(F.col("decimal_latitude"))),
        Bundle("gathering", ["recorded_by", "record_number", "event_date"], any_filled("recorded_by", "event_date")),
    ]
    columns = [c for b in bundles for c in b.columns]
    return choose_survivors(_grouped(spark, d, *columns), ["holder", "number"], bundles, "trust_rank", "accessed_at", "seq", [("locality", "region")])


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling in recorded_by and identified_by, with how often it occurs."""
    records = table(spark, d, "specimen_records")
    known = known_names(spark, d)
    split = split_packed(records.select("recorded_by"), "recorded_by", "name", known, single=True).select(F.col("item_text").alias("name"))
    determiners = records.select(F.trim("identified_by").alias("name")).where("name <> ''")
    return split.unionByName(determiners).groupBy("name").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(link_names(durable(_names(spark, d))))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the one that stands for it."""
    return link_names(durable(_names(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "specimen_records").select("seq", *PLACE_FIELDS)
    mapped = map_to_list(records, PLACE_FIELDS, table(spark, d, "canonical_entries"), "country")
    return mapped.where("map_status in ('mapped', 'none')").select("seq", "field_name", "entry_id")


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of values without an entry, or with several: how often each is typed."""
    records = table(spark, d, "specimen_records").select(*PLACE_FIELDS)
    mapped = map_to_list(records, PLACE_FIELDS, table(spark, d, "canonical_entries"), "country")
    return mapped.where("map_status in ('none', 'ambiguous')").groupBy("field_name", "field_text", "map_status").agg(F.count("*").alias("n"))


def p7_within(spark: SparkSession, d: str) -> DataFrame:
    """Every entry within the distance of each typed value: how many records have the value."""
    records, entries = table(spark, d, "specimen_records"), table(spark, d, "canonical_entries")
    typed = records.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("field_text")) for c in PLACE_FIELDS])).alias("f")).select("f.*").groupBy("field_name", "field_text").agg(F.count("*").alias("n"))
    parts = [entries_within(typed.where(F.col("field_name") == c), "field_text", k, entries) for c, k in PLACE_FIELDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their size in tokens; each text is encoded once."""
    return durable(spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", token_count(F.col("text")).alias("n_tokens")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text larger than the capacity, in its container, for each run."""
    return pack_items(_sized(spark, d), "doc_id", "n_tokens", table(spark, d, "pack_capacities"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p8_containers(spark, d), table(spark, d, "pack_capacities"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """A mixture as large as all listed texts: every source has its share of that, or all it can give with max_repeats."""
    return mix_sources(_sized(spark, d), "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"), total=LISTED)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(durable(p9_mixture(spark, d)), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), "doc_id", "text", lang="lang")


QUERIES = {"p6_found": p6_found, "p6_clusters": p6_clusters, "p4_found": p4_found, "p4_bundles": p4_bundles, "p7_found": p7_found, "p7_unmatched": p7_unmatched, "p7_within": p7_within, "p8_containers": p8_containers, "p8_report": p8_report, "p9_mixture": p9_mixture, "p9_report": p9_report, "p10_found": p10_found}
def _holder_sql(c: str) -> str:
    """An institution as typed, made comparable: small letters without accents, usual additions and marks, short words written out."""
    x = f"lower(strip_accents({c}))"
    for short, long in (("univ[.]", "university"), ("nat[.]", "natural"), ("hist[.]", "history"), ("bot[.]", "botanic"), ("gard[.]", "garden"), ("roy[.]", "royal"), ("mus[.]", "museum"), ("inst[.]", "institute"), ("acad[.]", "academy"), ("sci[.]", "sciences"), ("soc[.]", "society"), ("natl[.]", "national"), ("dept[.]", "department")):
        x = f"regexp_replace({x}, '(^|[^a-z]){short}', '\\1{long} ', 'g')"
    x = f"trim(regexp_replace(regexp_replace({x}, '^ *(the|herb[.]?|herbarium) | *[(]?(herbarium|herb[.])[)]? *$', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    return f"case when regexp_full_match({c}, '[ ]*([A-Za-z][ ]*[.][ ]*)+[A-Za-z]?[ ]*') then replace({x}, ' ', '') else {x} end"


_LATITUDE = "(case when regexp_full_match(trim(decimal_latitude), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(decimal_latitude) as double) end)"
_NO_PLACE = ", ".join("'" + p.replace("'", "''") + "'" for p in NO_PLACE)
P4_SQL = f"""with w as (select entry_id, entry_code, unnest([entry_name, entry_code, aliases]) as word from canonical_entries where kind = 'institution_code'),
l as (select distinct entry_id, entry_code, {_holder_sql("word")} as word from w where word is not null),
t as (select distinct institution_code as typed, {_holder_sql("institution_code")} as word from specimen_records where trim(coalesce(institution_code, '')) <> ''),
m as (select typed, entry_id, entry_code, min(damerau_levenshtein(t.word, l.word)) as d from t, l
 where damerau_levenshtein(t.word, l.word) <= case when length(t.word) <= 4 then 0 when length(t.word) < 12 then 1 else 2 end group by all),
h as (select typed, min(entry_code) as code from (select *, min(d) over (partition by typed) as best from m) where d = best group by typed having count(distinct entry_id) = 1),
c as (select *, replace(replace(upper(coalesce(catalog_number, '')), 'N°', ' '), 'Nº', ' ') as up from specimen_records where regexp_matches(catalog_number, '[0-9]')),
n as (select *, coalesce(nullif(ltrim(regexp_replace(regexp_extract(up, '[0-9][0-9\\s./-]*'), '[^0-9]', '', 'g'), '0'), ''), '0') as number,
 array_to_string(list_filter(regexp_extract_all(regexp_extract(up, '^[^0-9]*'), '\\p{{L}}+'), lambda x: x not in ('NO', 'NR', 'NUM', 'NUMBER')), '') as letters from c),
g as (select n.*, coalesce(nullif(letters, ''), h.code) as holder, coalesce(p.trust_rank, 999999) as trust from n left join h on h.typed = n.institution_code left join source_profiles p using (source)),
k as (select holder, number, min(seq) as group_seq from g where holder is not null group by all having count(*) > 1),
u as (select group_seq, seq, trust, coalesce(accessed_at, '') as seen, unnest(['decimal_latitude', 'locality']) as field_name,
 unnest([coalesce({_LATITUDE} between -90 and 90 and {_LATITUDE} <> 0, false), lower(trim(coalesce(locality, ''))) not in ({_NO_PLACE}) and regexp_matches(coalesce(locality, ''), '\\p{{L}}')]) as usable from g join k using (holder, number))
select group_seq, field_name, seq from (select *, row_number() over (partition by group_seq, field_name order by trust, seen desc, seq) as rn from u where usable) where rn = 1"""

SQL: dict[str, str] = {"p4_found": P4_SQL}
