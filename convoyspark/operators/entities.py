"""Company and center tables: catalog, planned and target metrics, ranking and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convoyspark.functions import text as t
from convoyspark.operators import derive as d
from convoyspark.operators.filters import PlanFilter, with_layers, without_domestic
from convoyspark.plans import schema as s


def _first(value: str, order: str) -> Column:
    """Value of the earliest row; the smaller value where rows tie."""
    return F.min_by(value, F.struct(order, value))


def first_wins(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """First and last value per key in source order.

    Rows are first reduced to distinct (key, value) pairs with their earliest
    and latest position, which a hash aggregate does map-side; only the pairs
    are ranked.
    """
    pairs = df.groupBy(key.alias("key"), value.alias("value")).agg(
        F.min(s.ROW).alias("first_row"), F.max(s.ROW).alias("last_row"))
    return pairs.groupBy("key").agg(
        _first("value", "first_row").alias("first_value"),
        F.max_by("value", F.struct("last_row", "value")).alias("last_value"))


def entity_catalog(plans: DataFrame) -> DataFrame:
    """Companies by first name given, and centers by last name given, as one long table."""
    keyed = d.with_entity_keys(plans)
    companies = first_wins(
        keyed.where(t.present(F.col("owner_company_name"))), F.col("company_key"), d.company_label(F.col("owner_company_name")),
    ).select(F.lit("company").alias("level"), "key", F.col("first_value").alias("name"))
    named = t.truthy(F.col("owner_office_number")) & (F.col("center_number") != "")
    centers = first_wins(keyed.where(named), F.col("center_key"), F.col("center_number")).select(
        F.lit("center").alias("level"), "key", F.col("last_value").alias("name"))
    return companies.unionByName(centers)


def _two_levels(fine: DataFrame, *aggs: Column) -> DataFrame:
    """Company and center grain of a pre-aggregated table in one pass."""
    company, center = F.col("company_key"), F.col("center_key")
    return fine.groupingSets([[company], [company, center]], company, center).agg(
        F.when(F.grouping_id("company_key", "center_key") == 0, "center").otherwise("company").alias("level"), *aggs)


_TWO_LEVEL_COLUMNS = ("level", "company_key", "center_key")


def camp_totals(camps: DataFrame) -> DataFrame:
    """Pilgrims and distinct nationalities of the camp table per company and per center (no domestic rows)."""
    keyed = d.with_entity_keys(without_domestic(camps), "service_company_name", "office_number")
    fine = keyed.groupBy(
        "company_key", "center_key", F.nullif(t.text_key(F.col("nationality")), F.lit("")).alias("nationality_key"),
    ).agg(F.sum("number_of_piligrim").alias("pilgrims"))
    return _two_levels(fine, F.sum("pilgrims").alias("pilgrims"), F.count_distinct("nationality_key").alias("nationalities")).select(
        *_TWO_LEVEL_COLUMNS, "pilgrims", "nationalities")


def planned_metrics(filtered: DataFrame) -> DataFrame:
    """Planned pilgrims, distinct plan types and distinct residences per company and per center."""
    keyed = d.with_residence(d.with_measures(d.with_entity_keys(filtered)))
    fine = keyed.groupBy(
        "company_key", "center_key",
        F.nullif(d.plan_type_code_or_name(), F.lit("")).alias("plan_type"),
        F.nullif("residence_key", F.lit("")).alias("residence_key"),
    ).agg(F.sum("pilgrims").alias("pilgrims"))
    return _two_levels(
        fine, F.sum("pilgrims").alias("pilgrims"), F.count_distinct("plan_type").alias("plan_types"),
        F.count_distinct("residence_key").alias("residences"),
    ).select(*_TWO_LEVEL_COLUMNS, "pilgrims", "plan_types", "residences")


def _allocation_and_residences(allocations: DataFrame, names: DataFrame) -> DataFrame:
    """Join the two sides of the assignment metrics at both levels."""
    per_assignment = allocations.groupBy("company_key", "center_key", "assignment_key").agg(
        F.max("allocated").alias("allocated"))
    # An assignment lies under one company and one center unless the row names a
    # second owner, so the company grain takes its own maximum.
    company = (
        per_assignment.groupBy("company_key", "assignment_key").agg(F.max("allocated").alias("allocated"))
        .groupBy("company_key").agg(F.sum(F.greatest(F.lit(0.0), "allocated")).alias("allocated"))
        .select(F.lit("company").alias("level"), "company_key", F.lit(None).cast("string").alias("center_key"), "allocated")
    )
    center = per_assignment.groupBy("company_key", "center_key").agg(
        F.sum(F.greatest(F.lit(0.0), "allocated")).alias("allocated")
    ).select(F.lit("center").alias("level"), "company_key", "center_key", "allocated")
    totals = company.unionByName(center)
    counted = _two_levels(
        names.groupBy("company_key", "center_key", "residence").agg(F.count(F.lit(1)).alias("n")),
        F.count_distinct("residence").alias("residences"),
    ).select(*_TWO_LEVEL_COLUMNS, "residences")
    match = (totals["level"] == counted["level"]) & (totals["company_key"] == counted["company_key"]) & \
        totals["center_key"].eqNullSafe(counted["center_key"])
    return totals.join(counted, match, "full_outer").select(
        *[F.coalesce(totals[c], counted[c]).alias(c) for c in _TWO_LEVEL_COLUMNS],
        F.coalesce("allocated", F.lit(0.0)).alias("allocated"),
        F.coalesce("residences", F.lit(0)).alias("residences"),
    )


def assignment_metrics(base: DataFrame) -> DataFrame:
    """Deduplicated allocation and distinct residence names (as written) per company and per center."""
    rows = d.with_residence(d.with_allocated(d.with_keys(base))).select(
        "company_key", "center_key", "assignment_key", "allocated",
        F.nullif("residence_name", F.lit("")).alias("residence"))
    return _allocation_and_residences(rows, rows)


def assignment_metrics_from_tables(plans: DataFrame, residence_facts: DataFrame, residence_file: DataFrame) -> DataFrame:
    """The same metrics from all plans with a center, their residence facts, and the residence file.

    A residence of the file counts under ``license|name``, or its name when it has no license.
    """
    camps = d.with_allocated(d.with_keys(plans)).where(t.truthy(F.col("owner_office_number"))).select(
        "company_key", "center_key", "assignment_key", "allocated")
    from_plans = residence_facts.select(
        "company_key", "center_key", F.nullif("residence_name", F.lit("")).alias("residence"))
    from_file = d.with_entity_keys(residence_file, "service_company", "service_center_number").select(
        "company_key", "center_key", F.nullif(residence_file_key(), F.lit("")).alias("residence"))
    none = camps.select("company_key", "center_key", F.lit(None).cast("string").alias("residence"))
    return _allocation_and_residences(camps, from_plans.unionByName(from_file).unionByName(none))


def residence_file_key() -> Column:
    return F.when(F.col("license_number") != "", F.concat_ws("|", "license_number", "residence_name")).otherwise(
        F.col("residence_name"))


def company_totals(base: DataFrame) -> DataFrame:
    """Pilgrims of the headline plan types per company, with the first name given."""
    rows = d.with_measures(d.with_entity_keys(base)).where(
        d.is_headline_type(F.col("plan_type_code"), F.col("plan_type_name")) & (F.col("company_key") != ""))
    named = rows.groupBy("company_key", d.company_label(F.col("owner_company_name")).alias("name")).agg(
        F.sum("pilgrims").alias("pilgrims"), F.min(s.ROW).alias("first_row"))
    return named.groupBy("company_key").agg(_first("name", "first_row").alias("name"), F.sum("pilgrims").alias("pilgrims"))


# -- the two tables of the dashboard -----------------------------------------


def _rank(rows: DataFrame) -> DataFrame:
    """Completion first, then total, then the label in Arabic collation."""
    return rows.orderBy(F.desc("completion"), F.desc("total_pilgrims"), F.collate("label", "ar"))


def company_table(plans: DataFrame, flt: PlanFilter = PlanFilter(), mix: DataFrame | None = None) -> DataFrame:
    """Company rows: headline total and residences of the base layer, completion of the filtered one.

    The three layers a company row draws on (all plans for its name, *base* for
    its totals, *filtered* for what is planned) are flags on one DataFrame.  So
    the table is two hash aggregates over a single scan: first to (company,
    name, residence), then to company - no joins of metric tables.
    """
    rows = d.with_residence(d.with_measures(with_layers(plans, flt, mix)))
    headline = d.is_headline_type(F.col("plan_type_code"), F.col("plan_type_name"))
    fine = rows.groupBy(
        "company_key",
        d.company_label(F.col("owner_company_name")).alias("name"),
        F.when(F.col("in_base"), F.nullif("residence_name", F.lit(""))).alias("residence"),
    ).agg(
        F.min(s.ROW).alias("first_row"),
        F.sum(F.when(F.col("in_filtered"), F.col("pilgrims"))).alias("planned"),
        F.sum(F.when(F.col("in_base") & headline, F.col("pilgrims"))).alias("total"),
        F.max(F.col("in_filtered") | t.present(F.col("owner_company_name"))).alias("listed"),
    )
    grouped = fine.groupBy("company_key").agg(
        _first("name", "first_row").alias("label"),
        F.coalesce(F.sum("planned"), F.lit(0.0)).alias("planned"),
        F.when(F.col("company_key") == "", F.lit(0.0)).otherwise(F.coalesce(F.sum("total"), F.lit(0.0))).alias("total_pilgrims"),
        F.count_distinct("residence").alias("residences"),
        F.max("listed").alias("listed"),
    )
    return _rank(grouped.where("listed").select(
        "company_key", "label", "total_pilgrims", "residences",
        d.completion_percent(F.col("planned"), F.col("total_pilgrims")).alias("completion")))


def center_table(plans: DataFrame, flt: PlanFilter = PlanFilter(), mix: DataFrame | None = None) -> DataFrame:
    """Center rows: deduplicated allocation and residences of the base layer, completion of the filtered one.

    Names come from the filtered rows where there are any, else from the base
    rows; limited to the selected companies.  As with companies, one scan feeds
    everything: rows are reduced to (center, name, assignment, residence) and
    the three kinds of figures are taken from that.
    """
    rows = d.with_residence(d.with_measures(d.with_allocated(d.with_assignment_key(with_layers(plans, flt, mix)))))
    if flt.companies:
        rows = rows.where(F.col("company_key").isin(*sorted(flt.companies)))
    # Keys that are made of others are not shuffled beside them.
    own = not {"service_company_name", "office_number"} & set(plans.columns)
    allocation = t.text_or_blank(F.col("camp_label")).alias("camp") if own else F.col("assignment_key")
    fine = rows.where("in_base").groupBy(
        "company_key", "center_number", d.company_label(F.col("owner_company_name")).alias("company"), allocation,
        F.nullif("residence_name", F.lit("")).alias("residence"),
    ).agg(
        F.min(s.ROW).alias("first_row"),
        F.min(F.when(F.col("in_filtered"), F.col(s.ROW))).alias("first_filtered"),
        F.sum(F.when(F.col("in_filtered"), F.col("pilgrims"))).alias("planned"),
        F.max("allocated").alias("allocated"),
    )
    part = "camp" if own else "assignment_key"
    keyed = lambda df: df.withColumn("center_key", F.concat_ws("|", "company_key", "center_number"))
    totals = keyed(fine.groupBy("company_key", "center_number", part).agg(F.max("allocated").alias("allocated"))).groupBy("center_key", part).agg(
        F.max("allocated").alias("allocated")).groupBy("center_key").agg(F.sum(F.greatest(F.lit(0.0), "allocated")).alias("total_pilgrims"))
    named = keyed(fine.groupBy("company_key", "center_number").agg(
        F.coalesce(
            F.min_by(F.when(F.col("first_filtered").isNotNull(), F.col("company")),
                     F.when(F.col("first_filtered").isNotNull(), F.struct("first_filtered", "company"))),
            _first("company", "first_row"),
        ).alias("sublabel"),
        F.coalesce(F.sum("planned"), F.lit(0.0)).alias("planned"),
    ))
    # Residences are told apart without the figures, which would go through that shuffle with each of them.
    homes = fine.select("company_key", "center_number", "residence").distinct().groupBy("company_key", "center_number").agg(
        F.count("residence").alias("residences"))
    named = named.join(homes, ["company_key", "center_number"])
    return _rank(named.join(totals, "center_key").select(
        "company_key", "center_key", "center_number",
        t.first_filled(F.col("center_number"), s.NO_CENTER).alias("label"), "sublabel",
        "total_pilgrims", "residences",
        d.completion_percent(F.col("planned"), F.col("total_pilgrims")).alias("completion")))


def sort_entities(rows: DataFrame, sort_key: str = "completion", descending: bool = True) -> DataFrame:
    """User-chosen order; ties go by label in Arabic collation, then by key.

    Figures sort by value.  Center numbers sort by value where they are numbers
    (thousands separators dropped) and in natural order otherwise, all numbers
    first.  Other text sorts in natural order on its folded form.
    """
    if sort_key in ("total_pilgrims", "residences", "completion"):
        keys = [F.coalesce(F.col(sort_key).cast("double"), F.lit(0.0))]
    elif sort_key == "center_number":
        value = t.text_or_blank(F.col(sort_key))
        number = F.regexp_replace(value, ",", "")
        plain = F.when(t.present(number) & ~t.is_not_numeric(number), number.try_cast("double"))
        keys = [plain.isNull().cast("int"), plain, t.natural_key(t.text_key(value))]
    else:
        keys = [F.collate(t.natural_key(t.text_key(F.col(sort_key))), "ar")]
    ordered = [k.desc() if descending else k.asc() for k in keys]
    key = "center_key" if "center_key" in rows.columns else "company_key"
    return rows.orderBy(*ordered, F.collate("label", "ar"), key)


def camp_names_of_centers(camps: DataFrame, centers: DataFrame) -> DataFrame:
    """Display name of each center of the camp table: its own name, the catalog's, its number, or "no center"."""
    keyed = d.with_entity_keys(camps, "service_company_name", "office_number")
    first = first_wins(keyed, F.col("center_key"), F.col("service_center_name"))
    catalog = centers.where("level = 'center'").select("key", F.col("name").alias("catalog_name"))
    return first.join(catalog, "key", "left").select(
        F.col("key").alias("center_key"),
        d.center_label(F.col("first_value"), F.col("catalog_name"), F.substring_index("key", "|", -1)).alias("label"))
