"""The core's queries for the data problems (p1, p2, p3, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllary.operators.packed import known_values, split_packed
from phyllary.operators.proximity import pairs_within
from phyllary.operators.timestamps import normalise_times
from phyllary.operators.units import agreed_altitude, normalise_altitudes
from phyllary.session import durable, table


def _sources(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """source_profiles: one row for each configured source, fixed at 24."""
    return F.broadcast(table(spark, d, "source_profiles").select("source", *columns))


def known_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand alone: every determiner (that field has one), and collectors' fields without a mark."""
    records = table(spark, d, "specimen_records")
    one = records.select(F.trim("identified_by").alias("value")).where("value <> ''").distinct()
    return one.union(known_values(records, "recorded_by", "name")).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "specimen_records").select(F.lit("specimen_records").alias("table_name"), F.col("seq").alias("row_id"), F.lit("recorded_by").alias("field_name"), F.col("recorded_by").alias("text"))
    candidates = table(spark, d, "coordinate_candidates")
    fields = [
        candidates.select(F.lit("coordinate_candidates").alias("table_name"), F.col("cand_seq").alias("row_id"), F.lit(name).alias("field_name"), F.col(name).alias("text"))
        for name in ("source_urls", "detected_languages")
    ]
    parts = [
        split_packed(records, "text", "name", known_names(spark, d)),
        split_packed(fields[0], "text", "address", known_values(candidates, "source_urls", "address")),
        split_packed(fields[1], "text", "language", known_values(candidates, "detected_languages", "language")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "specimen_records").select("source", F.lit("specimen_records").alias("table_name"), F.col("seq").alias("row_id"), F.col("event_date").alias("text"))
    records = records.join(_sources(spark, d, "time_zone", "date_order"), "source", "left").drop("source")
    labels = table(spark, d, "label_reads").select(F.lit("label_reads").alias("table_name"), F.col("label_seq").alias("row_id"), F.col("event_date_text").alias("text"))
    both = records.unionByName(labels, allowMissingColumns=True)
    out = normalise_times(both, "text", "date_order", "time_zone")
    return out.where("normal_text is not null and normal_text <> text").select("table_name", "row_id", "normal_text")


def p2_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """How the rows of each source were read: counts by status."""
    records = table(spark, d, "specimen_records").select("source", "event_date").join(_sources(spark, d, "time_zone", "date_order"), "source", "left")
    return normalise_times(records, "event_date", "date_order", "time_zone").groupBy("source", "time_status").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "specimen_records")
    candidates = table(spark, d, "coordinate_candidates")
    return pairs_within(records, candidates, "seq", "cand_seq", ("decimal_latitude", "decimal_longitude"), ("candidate_latitude", "candidate_longitude"), 500.0)


def _altitudes(spark: SparkSession, d: str) -> DataFrame:
    """The altitudes of records and labels. A record's number without unit may have any unit that some source writes without saying so;
    which one it has follows from the altitude on the label of its catalogue number, else from its source."""
    labels = table(spark, d, "label_reads").select(F.lit("label_reads").alias("table_name"), F.col("label_seq").alias("row_id"), "catalog_number", F.col("elevation_text").alias("text"))
    # read once, used twice
    read = durable(normalise_altitudes(labels, "text"))
    # 24 sources, so a handful of units
    units = sorted(r[0] for r in _sources(spark, d, "elevation_unit").select(F.lower("elevation_unit")).where("elevation_unit is not null").distinct().collect())
    records = table(spark, d, "specimen_records").select("source", F.lit("specimen_records").alias("table_name"), F.col("seq").alias("row_id"), "catalog_number", F.col("elevation").alias("text"))
    records = records.join(_sources(spark, d, "elevation_unit"), "source", "left").drop("source")
    # only figures without a unit need the label
    bare = F.coalesce(F.col("text").rlike(r"^[^\p{L}'′’]*\d[^\p{L}'′’]*$"), F.lit(False))
    # as many as there are labels: never broadcast; a catalogue number that many records share is split by adaptive execution
    evidence = agreed_altitude(read, "catalog_number", "low_m").hint("merge")
    lone = normalise_altitudes(records.where(bare).join(evidence, "catalog_number", "left"), "text", "elevation_unit", units, "evidence_m").drop("evidence_m")
    rest = normalise_altitudes(records.where(~bare), "text", "elevation_unit", units)
    return rest.unionByName(lone).unionByName(read, allowMissingColumns=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = _altitudes(spark, d)
    return out.where(F.col("low_m").isNotNull() & ~F.col("text").rlike(r"^-?\d+ m$")).select("table_name", "row_id", "low_m", "high_m")


def p5_choices(spark: SparkSession, d: str) -> DataFrame:
    """How the units of the altitudes were found, for each table: read, of these not unique, and the greatest residual of an identity."""
    out = _altitudes(spark, d).where("low_m is not null")
    return out.groupBy("table_name").agg(F.count("*").alias("altitudes"), F.count_if(~F.col("unit_unique")).alias("not_unique"), F.count_if(F.col("unit_residual") > 0).alias("by_identity"), F.round(F.max("unit_residual"), 6).alias("greatest_residual"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_status_counts": p2_status_counts, "p3_found": p3_found, "p5_found": p5_found, "p5_choices": p5_choices}


def _degrees(c: str) -> str:
    return f"(case when regexp_full_match(trim({c}), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') then try_cast(trim({c}) as double) end)"


#: Altitudes in SQL: numbers, words of units with their metres, spans and single altitudes.
_NUM = r"-?[0-9]{1,3}(?:[, ][0-9]{3})+|-?[0-9]+(?:[.,][0-9]+)?"
_UNITS = {"kilometres km": 1000, "metres mètres meters metre meter masl метров м 公尺 メートル 米 m": 1, "feet foot pieds pied Fuß Fuss pies pie ped фут 英尺 ft '": 0.3048, "yards yard yds yd": 0.9144}
_UNIT = "|".join(sorted((w for words in _UNITS for w in words.split()), key=len, reverse=True))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_SPAN = _quoted(rf"(?i)({_NUM})\s*(?:({_UNIT})\.?(?:\s*(?:a\.s\.l\.|s\.n\.m\.|s\.m\.|ü\. M\.|над ур\. м\.|above sea level))?)?\s*(?:-|–|to|and)\s*({_NUM})\s*({_UNIT})")
_ONE = _quoted(rf"(?i)({_NUM})\s*({_UNIT})(?:[^a-zA-Zа-яА-Я]|$|\s)")


def _figure(c: str) -> str:
    return f"(case when regexp_full_match({c}, '-?[0-9]{{1,3}}(?:[, ][0-9]{{3}})+') then replace(replace({c}, ',', ''), ' ', '') else replace({c}, ',', '.') end)::decimal(18,6)"


def _factor(c: str) -> str:
    return "case " + " ".join(f"when regexp_full_match({c}, '(?i)(?:{_quoted('|'.join(words.split()))})') then {f}" for words, f in _UNITS.items()) + " end"


P5_SQL = f"""with s as (select 'specimen_records' as table_name, seq as row_id, elevation as text, elevation_unit as unit from specimen_records left join source_profiles using (source)
 union all select 'label_reads', label_seq, elevation_text, null from label_reads),
c as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^Sheet [0-9]+ of [0-9]+[.] ', ''), '; [0-9]+ plants seen$', ''), '^Slope [0-9]+°, |, trunk [0-9]+ cm thick$', '', 'g'), '^[0-9]+ km N of bridge; ', '') as t
 from s where regexp_matches(text, '[0-9]')),
p as (select *, regexp_matches(t, '{_SPAN}') as pair, regexp_matches(t, '{_ONE}') as one, regexp_full_match(t, '{_NUM}') as bare, regexp_matches(t, 'below sea level') as below from c),
n as (select table_name, row_id, text, case when pair then regexp_extract(t, '{_SPAN}', 1) when one then regexp_extract(t, '{_ONE}', 1) when bare then t end as a,
 case when pair then coalesce(nullif(regexp_extract(t, '{_SPAN}', 2), ''), regexp_extract(t, '{_SPAN}', 4)) when one then regexp_extract(t, '{_ONE}', 2) when bare then unit end as ua,
 case when pair then regexp_extract(t, '{_SPAN}', 3) end as b, case when pair then regexp_extract(t, '{_SPAN}', 4) end as ub, regexp_extract(t, '[(]({_NUM}) m[)]', 1) as metric, below from p),
v as (select *, floor((case when metric <> '' then {_figure("metric")} else {_figure("a")} * {_factor("ua")} * case when below then -1 else 1 end end)::decimal(18,6) + 0.5)::bigint as lo,
 floor(({_figure("b")} * {_factor("ub")})::decimal(18,6) + 0.5)::bigint as hi from n where ua is not null)
select table_name, row_id, least(lo, coalesce(hi, lo)) as low_m, greatest(lo, coalesce(hi, lo)) as high_m from v where lo is not null and not regexp_full_match(text, '-?[0-9]+ m')"""

SQL = {
    "p5_found": P5_SQL,
    "p3_found": f"""with r as (select seq, {_degrees("decimal_latitude")} as a, {_degrees("decimal_longitude")} as o from specimen_records),
c as (select cand_seq, {_degrees("candidate_latitude")} as b, {_degrees("candidate_longitude")} as p from coordinate_candidates),
x as (select *, pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(p - o) / 2), 2) as h from r join c on abs(a - b) < 0.0046
 where a between -90 and 90 and o between -180 and 180 and not (a = 0 and o = 0) and b between -90 and 90 and p between -180 and 180 and not (b = 0 and p = 0))
select seq, cand_seq from x where 2 * 6371008.8 * atan2(sqrt(h), sqrt(greatest(1 - h, 0))) <= 500"""
}
