"""Six hand-worked plans: every figure was derived on paper."""

from pyspark.sql import functions as F

from six_plans import KEY_A, KEY_B

from convoyspark.functions import text
from convoyspark.operators import assignments, breakdowns, derive, entities, filters, kpis, lookups, residences, sampling
from convoyspark.operators.filters import PlanFilter


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def table(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_allocation_falls_back_to_pilgrims(plans):
    assert table(derive.with_allocated(plans), "_row", "allocated")[6] == (15.0,)


def test_headline(plans):
    r = kpis.headline_kpis(plans).head()
    assert (r.pilgrims, r.buses, r.trips, r.plans, r.camps, r.residences, r.centers) == (205, 12, 27, 6, 3, 3, 3)


def test_headline_of_nothing(plans):
    r = kpis.headline_kpis(plans.where("false")).head()
    assert tuple(r) == (0.0, 0.0, 0.0, 0, 0, 0, 0)


def test_periods_sort_as_text(plans):
    assert rows(breakdowns.by_period(plans), "period", "pilgrims") == [("1", 105), ("10", 60), ("2", 40)]


def test_districts_are_not_folded_in_the_breakdown(plans):
    got = table(breakdowns.by_district(plans), "district", "pilgrims")
    assert got == {"حى الزهراء": (40,), "حي الزهراء": (50,), "حي كدي": (10,), "بدون حي": (105,)}


def test_districts_are_folded_on_the_map(plans):
    got = table(lookups.district_intensity(filters.residence_starts(plans)), "district_key", "name", "pilgrims", "plans", "color")
    assert got["حي الزهراء"][:3] == ("حى الزهراء", 90, 2) and got["حي الزهراء"][3] == "rgb(128,0,38)"
    assert got["حي كدي"][1:3] == (10, 1)


def test_camp_statistics(plans):
    r = kpis.camp_stats(plans).head()
    assert (r.numerators, r.denominators, r.assignments, r.labels, r.centers, r.allocated) == (3, 3, 5, 3, 3, 195)


def test_assignment_totals_keep_the_blank_camp(plans):
    got = {(r.key, r.plan_type): r.total for r in assignments.assignment_totals(plans).where("level = 'center'").collect()}
    assert got == {
        (f"{KEY_A}|11", None): 120, (f"{KEY_A}|11", "tarwia"): 120, (f"{KEY_A}|11", "direct_taseed"): 90,
        (f"{KEY_A}|12", None): 15, (f"{KEY_A}|12", "tarwia"): 15,
        (f"{KEY_B}|7", None): 85, (f"{KEY_B}|7", "efada"): 60, (f"{KEY_B}|7", "taseed_tarwia"): 25,
    }


def test_running_maximum_gives_the_same_totals(plans):
    totals = table(assignments.assignment_totals(plans).where("level = 'center' and plan_type is null"), "key", "total")
    for block in (1, 2, 1000):
        assert table(assignments.running_max_totals(plans, block), "center_key", "total") == totals


def test_completion(plans):
    totals = assignments.assignment_totals(plans)
    got = table(assignments.completion(plans, totals), "type_code", "planned", "target")
    assert got == {"tarwia": (105, 135), "direct_taseed": (30, 90), "efada": (60, 60), "taseed_tarwia": (10, 25)}


def test_completion_ring_shares(plans):
    ring = assignments.completion_ring(plans, assignments.assignment_totals(plans), PlanFilter(plan_types=frozenset(["نفرة"])))
    got = rows(ring, "type_code", "share_percent", "completion")
    assert got == [("tarwia", 60, 77.8), ("direct_taseed", 40, 33.3), ("taseed_tarwia", 11, 40.0), ("efada", 27, 100.0), ("nafra", 0, 0.0)]


def test_target_falls_back_to_the_number(spark, plans):
    totals = assignments.assignment_totals(plans)
    stranger = spark.createDataFrame([("other", "7", "efada", None), ("other", "99", "efada", None)],
                                     "owner_company_name string, owner_office_number string, plan_type_code string, plan_type_name string")
    got = table(assignments.target_lookup(stranger, totals), "owner_office_number", "target")
    assert got == {"7": (60,), "99": (0,)}


def test_residence_mix_counts_a_double_type_twice(plans):
    r = residences.residence_mix(residences.residence_facts(plans)).head()
    assert tuple(r) == (3, 1, 1, 1)


def test_mix_filter_and_flags_agree(plans):
    mix = residences.residence_classes(residences.residence_facts(plans))
    flt = PlanFilter(residence_mix="tarwiyah")
    kept = rows(filters.keep_residence_mix(plans, mix, flt), "_row")
    flagged = rows(filters.with_layers(plans, flt, mix).where("in_base"), "_row")
    assert sorted(kept) == sorted(flagged) == [(1,), (2,), (6,)]


def test_company_table(plans):
    got = table(entities.company_table(plans), "company_key", "label", "total_pilgrims", "residences", "completion")
    assert got == {KEY_A: ("شركة مكه", 135, 2, 100.0), KEY_B: ("يسر", 0, 2, 0)}


def test_company_table_mixes_layers(plans):
    got = table(entities.company_table(plans, PlanFilter(plan_types=frozenset(["تروية"]))), "company_key", "completion")
    assert round(got[KEY_A][0], 2) == 77.78 and got[KEY_B] == (0,)


def test_center_table(plans):
    got = table(entities.center_table(plans), "center_key", "total_pilgrims", "residences", "completion")
    assert got[f"{KEY_A}|11"] == (120, 2, 100.0) and got[f"{KEY_A}|12"] == (15, 1, 100.0)
    assert got[f"{KEY_B}|7"][:2] == (85, 2) and round(got[f"{KEY_B}|7"][2], 2) == 82.35


def test_entity_search_and_sort(plans):
    centers = entities.center_table(plans)
    assert rows(filters.search_entities(centers, "82.4%", "center_key"), "center_number") == [("7",)]
    assert rows(entities.sort_entities(centers, "center_number", descending=False), "center_number") == [("7",), ("11",), ("12",)]


def test_stratified_sample(plans):
    assert sorted(rows(sampling.stratified_sample(plans, 4), "_row")) == [(1,), (3,), (4,), (5,)]
    assert sorted(rows(sampling.stratified_sample(plans, 5), "_row")) == [(1,), (2,), (3,), (4,), (5,)]
    assert sampling.stratified_sample(plans, 6).count() == 6


def test_breakdowns_agree_with_the_headline(plans):
    total = kpis.headline_kpis(plans).head().pilgrims
    got = breakdowns.breakdowns(plans).groupBy("dimension").agg(F.sum("value").alias("v"))
    assert {r.v for r in got.collect()} == {total}


def test_coverage_adds_up(plans):
    r = residences.residence_coverage(plans, residences.residence_facts(plans)).head()
    assert r.assigned + r.missing == r.total == 3


def test_keys(spark):
    df = spark.createDataFrame([(" شركة  مكه ", "0"), ("شركة مكة", " 5"), (None, None)], "c string, n string")
    got = rows(derive.with_entity_keys(df, "c", "n"), "center_key")
    assert got == [("شركة مكة|",), ("شركة مكة|5",), ("|",)]


def test_totals_hold_no_row_four_times(plans):
    """Each level has its own aggregate; levels by type leave out rows without one, and the overall ones keep them."""
    untyped = plans.withColumns({c: F.when(F.col("_row") > 3, F.col(c)) for c in ("plan_type_code", "plan_type_name")})
    totals = assignments.assignment_totals(untyped)
    assert "Expand" not in totals._jdf.queryExecution().optimizedPlan().toString()
    whole = {(r.level, r.key): r.total for r in assignments.assignment_totals(plans).where("plan_type is null").collect()}
    assert {(r.level, r.key): r.total for r in totals.where("plan_type is null").collect()} == whole
    assert all(r.plan_type for r in totals.where("plan_type is not null").collect())


def test_residence_filter_folds_no_names(plans):
    plan = residences.residence_facts(plans)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lower(" in line or "translate(" in line for line in plan.splitlines() if "Filter" in line)


def test_key_of_a_name_with_inner_blanks(spark):
    names = ["  Ab  c ", "a b", "a \t b", "وجه ثان ه", "ههه", "أ إ ى", "x y", "", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.text_key(F.col("n"))).collect()
    assert [r[0] for r in got] == ["ab c", "a b", "a b", "وجة ثان ة", "ههة", "ا ا ي", "x y", "", ""]
    regexes = text.text_key(F.lit("x y"))._jc.toString()
    assert "rlike" not in regexes.lower()


def test_center_table_shuffles_no_key_beside_its_parts(plans):
    """Rows are dealt by company, number, camp and residence; the keys made of them are built afterwards."""
    plan = entities.center_table(plans.repartition(4))._jdf.queryExecution().executedPlan().toString()
    dealt = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert any(x.startswith("company_key#") and x.count("#") == 5 for x in dealt)
    assert not any("assignment_key#" in x or "center_key#" in x and x.count("#") > 2 for x in dealt)
