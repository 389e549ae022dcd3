"""Row-wise columns of the plan, camp and residence tables (no shuffle anywhere)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from convoyspark.functions import text as t
from convoyspark.plans import schema as s


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _cell(df: DataFrame, *names: str) -> Column:
    """First non-null of the named columns that exist (text null if none does)."""
    found = [F.col(f"`{n}`") for n in names if _has(df, n)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _filled_cell(df: DataFrame, *names: str) -> Column:
    """First non-null, non-empty of the named columns that exist."""
    found = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if _has(df, n)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


# -- canonical tables --------------------------------------------------------


def canonical_plans(df: DataFrame, fill: bool = False) -> DataFrame:
    """Coalesce the alternate headings onto the canonical columns and cast the numbers.

    With ``fill``, canonical columns that are absent altogether are added as nulls.
    """
    aliased = {name: _cell(df, name, other) for name, other in s.PLAN_ALIASES.items()
               if _has(df, name) or _has(df, other)}
    numeric = {}
    types = dict(df.dtypes)
    for name in s.DOUBLE_COLUMNS:
        source = aliased.get(name, F.col(name) if _has(df, name) else None)
        if source is None:
            continue
        source_type = types.get(name, types.get(s.PLAN_ALIASES.get(name, ""), "string"))
        numeric[name] = t.parse_number(source) if source_type == "string" else source.cast("double")
    drop = [other for name, other in s.PLAN_ALIASES.items() if other in df.columns and other.lower() != name.lower()]
    columns = {**aliased, **numeric}
    if fill:
        for name in s.REQUIRED_COLUMNS:
            if name not in columns and not _has(df, name):
                columns[name] = F.lit(None).cast("double" if name in s.DOUBLE_COLUMNS else "string")
    return df.withColumns(columns).drop(*drop)


def canonical_camps(df: DataFrame) -> DataFrame:
    """Camp assignments: alias fallbacks, blank for missing text, numbers cast."""
    transport = next((c for c in df.columns if " ".join(c.split()).lower() == "transport_mode"), None)
    blank = lambda *names: F.coalesce(_cell(df, *names), F.lit(""))
    return df.select(
        blank("camp_label").alias("camp_label"),
        blank("service_company_name", "owner_company_name").alias("service_company_name"),
        blank("office_number", "owner_office_number").alias("office_number"),
        blank("nationality").alias("nationality"),
        blank("service_center_name", "office_number").alias("service_center_name"),
        blank("piligrim_type").alias("piligrim_type"),
        (F.coalesce(F.col(f"`{transport}`"), F.lit("")) if transport else F.lit("")).alias("transport_mode"),
        blank("platform_name").alias("platform_name"),
        F.coalesce(
            t.parse_number(_cell(df, "number_of_piligrim", "number_of_pilgrim", "number_of_haj").cast("string")),
            F.lit(0.0),
        ).alias("number_of_piligrim"),
        *[F.col(c) for c in (s.ROW, s.SUB) if _has(df, c)],
    )


def canonical_residences(df: DataFrame) -> DataFrame:
    """Residence assignments: the first non-empty of each pair of headings, trimmed."""
    txt = lambda *names: t.text_or_blank(_filled_cell(df, *names))
    num = lambda *names: F.coalesce(t.parse_number(_filled_cell(df, *names)), F.lit(0.0))
    return df.select(
        txt("License Number", "license_number").alias("license_number"),
        txt("Name", "name").alias("residence_name"),
        num("Pilgrims_count", "pilgrims_count").alias("pilgrims_count"),
        txt("Service_company", "service_company").alias("service_company"),
        txt("Service_center_name", "service_center_name").alias("service_center_name"),
        txt("Service_center_number", "service_center_number").alias("service_center_number"),
        num("Tarwiyah_count", "tarwiyah_count").alias("tarwiyah_count"),
        num("Taseed_count", "taseed_count").alias("taseed_count"),
        *[F.col(c) for c in (s.ROW, s.SUB) if _has(df, c)],
    )


# -- keys --------------------------------------------------------------------


def center_number_value(c: Column) -> Column:
    """Trimmed center number; a missing number or a zero becomes blank."""
    return F.when(t.truthy(c), t.trim_ws(c)).otherwise(F.lit(""))


def company_key(c: Column) -> Column:
    return t.text_key(c)


def center_key(company: Column, number: Column) -> Column:
    return F.concat_ws("|", company_key(company), center_number_value(number))


def center_number_key(number: Column) -> Column:
    return F.concat(F.lit("*|"), center_number_value(number))


def with_entity_keys(df: DataFrame, company: str = "owner_company_name", number: str = "owner_office_number") -> DataFrame:
    """Add ``company_key``, ``center_number``, ``center_key`` and ``center_number_key``."""
    keyed = df.withColumns({
        "company_key": company_key(F.col(company)),
        "center_number": center_number_value(F.col(number)),
    })
    return keyed.withColumns({
        "center_key": F.concat_ws("|", "company_key", "center_number"),
        "center_number_key": F.concat(F.lit("*|"), F.col("center_number")),
    })


def with_assignment_key(df: DataFrame) -> DataFrame:
    """Add ``assignment_key``: company, center and camp of one allocation."""
    if not (_has(df, "service_company_name") or _has(df, "office_number")) and _has(df, "center_key"):
        owner = F.col("center_key")
    else:
        owner = center_key(
            F.coalesce(_cell(df, "service_company_name", "owner_company_name"), F.lit("")),
            F.coalesce(_cell(df, "office_number", "owner_office_number"), F.lit("")),
        )
    return df.withColumn("assignment_key", F.concat_ws("|", owner, t.text_or_blank(F.col("camp_label"))))


def with_keys(df: DataFrame) -> DataFrame:
    """All four entity keys of a plan row."""
    return with_assignment_key(with_entity_keys(df))


# -- measures ----------------------------------------------------------------


def with_allocated(df: DataFrame) -> DataFrame:
    """Add ``allocated``: the first non-null of the allocation columns, as a number."""
    names = [n for n in ("allocated_haj", "allocated_hajj", "number_of_piligrim", "number_of_haj") if _has(df, n)]
    types = dict(df.dtypes)
    cells = [t.parse_number(F.col(n)) if types[n] == "string" else F.col(n).cast("double") for n in names]
    return df.withColumn("allocated", t.finite_or_zero(F.coalesce(*cells)))


def trip_factor(transport: Column) -> Column:
    """Trips one bus makes for a transport type (1 when the type is not listed)."""
    name = t.text_or_blank(transport)
    known = reduce(
        lambda acc, kv: acc.when(name == kv[0], F.lit(kv[1])),
        ((k, v) for k, v in s.TRANSPORT_TRIPS.items() if v != 1),
        F,
    )
    return known.otherwise(F.lit(1))


def with_measures(df: DataFrame) -> DataFrame:
    """Add the three chart measures ``pilgrims``, ``buses`` and ``trips``."""
    measured = df
    if _has(df, "number_of_haj"):
        measured = measured.withColumn("pilgrims", t.finite_or_zero(F.col("number_of_haj")))
    if _has(df, "number_of_buses"):
        measured = measured.withColumn("buses", t.finite_or_zero(F.col("number_of_buses")))
        if _has(df, "transport_type_name"):
            measured = measured.withColumn("trips", F.col("buses") * trip_factor(F.col("transport_type_name")))
    return measured


def metric_column(metric: str) -> str:
    """Measure behind a chart selection; anything unknown means pilgrims."""
    return metric if metric in ("buses", "trips") else "pilgrims"


# -- classifications ---------------------------------------------------------


def class_of_key(key: Column) -> Column:
    """Class of a plan type, by what its matching key contains; the first rule wins."""
    # Class -> marks in the text, most specific class first.
    marks = (
        ("direct_taseed", ("direct_taseed", "تصعيد مباشر")),
        ("taseed_tarwia", ("taseed_tarwia", "تصعيد تروية")),
        ("tarwia", ("tarwia", "tarwiya", "تروية")),
        ("efada", ("efada", "افاضة")),
        ("nafra", ("nafra", "نفرة")),
    )
    rules = F
    for name, words in marks:
        rules = rules.when(reduce(lambda a, b: a | b, (key.contains(w) for w in words)), F.lit(name))
    return rules.otherwise(key)


def plan_type_class(c: Column) -> Column:
    """Class of a plan type text."""
    return class_of_key(t.text_key(c))


def plan_type_rank(c: Column) -> Column:
    """Position of a plan-type class in the display order; unknown classes come last."""
    position = F.array_position(F.array(*[F.lit(x) for x in s.PLAN_TYPE_ORDER]), plan_type_class(c))
    return F.when(position > 0, (position - 1).cast("int")).otherwise(F.lit(len(s.PLAN_TYPE_ORDER)))


def is_headline_type(code: Column, name: Column) -> Column:
    """Exact test for the plan types of the headline total."""
    return (t.text_or_blank(code).isin(*s.HEADLINE_TYPE_CODES)
            | t.text_or_blank(name).isin(*s.HEADLINE_TYPE_NAMES))


def is_denominator_type(plan_types: Iterable[str]) -> Column:
    """Rows behind the headline denominator: the selected plan types, else the fixed ones."""
    chosen = sorted(plan_types)
    if chosen:
        return F.coalesce(F.col("plan_type_name").isin(*chosen), F.lit(False))
    return is_headline_type(F.col("plan_type_code"), F.col("plan_type_name"))


def plan_type_code_or_name() -> Column:
    return t.text_or_blank(t.first_filled(F.col("plan_type_code"), F.col("plan_type_name")))


def residence_name() -> Column:
    """Residence a plan starts from, else the one it ends at, else blank."""
    side = lambda end: F.when(
        F.col(f"{end}_point_type") == "residence", F.nullif(F.col(f"{end}_point_name"), F.lit("")))
    return t.text_or_blank(F.coalesce(side("start"), side("end")))


def with_residence(df: DataFrame) -> DataFrame:
    """Add ``residence_name`` and its matching key ``residence_key`` (blank when none)."""
    return df.withColumn("residence_name", residence_name()).withColumn(
        "residence_key", t.text_key(F.col("residence_name")))


# -- labels ------------------------------------------------------------------


def camp_label_parts(c: Column) -> Column:
    """Struct of the two parts around the first slash; null when there is no slash."""
    label = t.text_or_blank(c)
    parts = F.split(label, "/")
    return F.when(label.contains("/"), F.struct(
        t.trim_ws(parts.getItem(0)).alias("numerator"), t.trim_ws(parts.getItem(1)).alias("denominator")))


def entrance_label(missing: str = s.NO_ENTRANCE) -> Column:
    return t.first_filled(F.col("entrance_name"), F.col("entrance_asm_code"), missing)


def path_label(missing: str = s.NO_PATH) -> Column:
    return t.first_filled(F.col("path_name"), missing)


def district_label(missing: str = s.NO_DISTRICT) -> Column:
    return t.first_filled(F.col("start_point_district"), missing)


def period_label(missing: str = s.UNKNOWN) -> Column:
    return t.first_filled(F.col("period"), missing)


def company_label(c: Column) -> Column:
    return t.first_filled(t.trim_ws(c), s.UNKNOWN)


def center_label(given: Column, catalog: Column, number: Column) -> Column:
    """Given name, else catalog name, else the number, else "no center"."""
    return t.trim_ws(t.first_filled(given, catalog, center_number_value(number), s.NO_CENTER))


def completion_percent(planned: Column, total: Column) -> Column:
    """Planned as a percentage of the total; 0 when there is no total."""
    return F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(planned / total * 100)


def completion_text(value: Column) -> Column:
    """Percentage clamped to 0-100 with one decimal, and none at 100."""
    clamped = F.least(F.greatest(t.finite_or_zero(value), F.lit(0.0)), F.lit(100.0))
    return F.when(clamped >= 100, F.lit("100%")).otherwise(F.format_string("%.1f%%", clamped))


def share_percent(value: Column, total: Column) -> Column:
    """Whole-number share of the total, halves rounded up; 0 when either is 0."""
    return F.when((F.coalesce(total, F.lit(0.0)) == 0) | (F.coalesce(value, F.lit(0.0)) == 0), F.lit(0)).otherwise(
        F.floor(value / total * 100 + 0.5)).cast("bigint")


def plan_list(df: DataFrame) -> DataFrame:
    """Columns of the plan list with its own placeholders."""
    return with_measures(df).select(
        "plan_id",
        t.first_filled(F.col("owner_company_name"), s.UNKNOWN).alias("company"),
        F.coalesce("timing_start_at", F.lit("")).alias("starts_at"),
        F.coalesce("timing_end_at", F.lit("")).alias("ends_at"),
        F.col("number_of_buses").alias("buses"),
        "trips",
        t.first_filled(F.col("plan_type_name"), F.col("plan_type_code"), s.UNKNOWN).alias("plan_type"),
        t.first_filled(F.col("transport_type_name"), s.UNKNOWN).alias("transport"),
        F.col("number_of_haj").alias("pilgrims"),
        F.coalesce("period", F.lit("")).alias("period"),
        t.first_filled(F.col("start_point_name"), s.NOT_AVAILABLE).alias("from_point"),
        t.first_filled(F.col("end_point_name"), s.NOT_AVAILABLE).alias("to_point"),
        F.coalesce("owner_office_number", F.lit("")).alias("center"),
        *[F.col(c) for c in (s.ROW, s.SUB) if _has(df, c)],
    )
