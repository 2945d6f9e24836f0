"""Roll-ups, index dates, look-back windows, panels and matching on hand-made fixtures."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimweave.operators import claims, cohort, describe, history, matching, ordered, panel
from claimweave.plans import case_control, treatment_cohort

KEY = case_control.CLAIM_KEY


def d(text):
    return dt.date.fromisoformat(text)


def claim(n, hosp="H", ym="201405"):
    return {"hosp_id": hosp, "fee_ym": ym, "appl_date": "20140601", "appl_type": "1", "case_type": "1", "seq_no": str(n)}


def frame(spark, rows, columns):
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))


IPD = ["id", "in_date", *case_control.IPD_SLOTS, "e_bed_day", "s_bed_day", *KEY]
IPO = ["order_code", *KEY]


def stays(spark, heads, lines):
    return case_control.first_stays(frame(spark, heads, IPD), frame(spark, lines, IPO)).collect()


def test_stay_rollup_undoes_fan_out_and_adds_bills(spark):
    base = {"id": "p", "in_date": "20140510", "icd9cm_1": "434"}
    heads = [
        base | {"e_bed_day": "3", "s_bed_day": "5"} | claim(1),
        base | {"e_bed_day": "4", "s_bed_day": "0"} | claim(2),
        base | {"e_bed_day": "2", "s_bed_day": "1"} | claim(3, ym="201406"),
        base | {"e_bed_day": "9", "s_bed_day": "9"} | claim(4, ym="201407"),
    ]
    lines = [{"order_code": "47017C"} | claim(1), {"order_code": "X"} | claim(1), {"order_code": "X"} | claim(2),
             {"order_code": "X"} | claim(3, ym="201406")]
    (row,) = stays(spark, heads, lines)
    assert (row.e_bed_day, row.s_bed_day, row.bed_day, row.isk, row.ng_tube, row.urin_cath) == (6.0, 6.0, 12.0, 1, 1, 0)


def test_first_stay_tie_goes_to_lower_hospital(spark):
    heads = [{"id": "p", "in_date": "20140510", "icd9cm_1": "430", "e_bed_day": "3", "s_bed_day": "1"} | claim(1, h) for h in "BA"]
    (row,) = stays(spark, heads, [{"order_code": "X"} | claim(1, h) for h in "AB"])
    assert (row.hosp_id, row.hsk) == ("A", 1)


@pytest.mark.parametrize(
    "index, months, expected",
    [("2014-05-10", ["201403", "201405", "201406", "2014XX"], "2014-05-01"), ("2014-05-01", ["201403", "201405"], "2014-03-01")],
)
def test_latest_enrolment_is_strictly_before_index(spark, index, months, expected):
    people = spark.createDataFrame([("p", d(index))], "id string, index_date date")
    rec = spark.createDataFrame([("p", m) for m in months], "id string, ym string")
    from claimweave.functions.clean import parse_month

    out = cohort.latest_before(rec.withColumn("m", parse_month("ym")), people, "id", "m", "index_date", [("ym", "asc")])
    assert [r.m for r in out.collect()] == [d(expected)]


def test_lookback_window_is_half_open(spark):
    people = spark.createDataFrame([("p", d("2014-05-01"))], "id string, i date")
    rec = spark.createDataFrame([("p", d(x)) for x in ("2014-01-30", "2014-01-31", "2014-04-30", "2014-05-01")], "id string, d date")
    kept = sorted(r.d for r in cohort.records_in_window(rec, people, "id", "d", "i", 90).collect())
    assert kept == [d("2014-01-31"), d("2014-04-30")]


def run_history(spark, out_rows, in_rows, dedupe):
    people = spark.createDataFrame([("p", d("2014-05-01"))], "id string, i date")
    schema = "id string, d date, c1 string, c2 string"
    out, inp = spark.createDataFrame(out_rows, schema), spark.createDataFrame(in_rows, schema)
    labels = case_control.DISEASES
    sources = [(out, "d", ["c1", "c2"], 1), (inp, "d", ["c1", "c2"], 2)]
    rows = history.history(sources, people, "id", "i", labels, dedupe=dedupe).collect()
    return {k for k, v in rows[0].asDict().items() if v == 1} if rows else set()


def test_history_dedupe_by_disease_or_code(spark):
    two_codes = [("p", d("2014-04-01"), "4019", "4011")]
    assert run_history(spark, two_codes, [], "dx") == set()
    assert run_history(spark, two_codes, [], "code") == {"htn"}


def test_history_weights(spark):
    out = [("p", d("2014-04-01"), "25000", None), ("p", d("2014-04-02"), "25000", ""), ("p", d("2014-04-03"), "585", None)]
    inp = [("p", d("2014-04-05"), "486", None), ("p", d("2014-04-03"), None, "585")]
    assert run_history(spark, out, inp, "dx") == {"dm", "pneumonia", "ckd"}


def panel_of(spark, index, start="2014-01-01", end="2014-12-31"):
    people = spark.createDataFrame([("p", d(index))], "id string, index_date date")
    return panel.person_periods(people, "id", "index_date", start, end)


@pytest.mark.parametrize("days, expected", [(3.0, ["201403", "201404"]), (None, None)])
def test_exposure_months(spark, days, expected):
    ep = spark.createDataFrame([("p", 1, d("2014-03-30"), days)], "id string, insulin int, s date, days double")
    ep = claims.episodes(ep, "s", "days")
    assert ep.first().end_date == (d("2014-04-01") if days else None)
    months = panel_of(spark, "2014-03-30")
    out = panel.period_exposure(months, ep, "id", "insulin", "2014-01-01", "2014-12-31").collect()
    assert len(out) == 10
    on = sorted(r.obs_ym for r in out if r.insulin == 1)
    assert on == (expected or sorted(r.obs_ym for r in out))


def test_events_per_month_and_study_bounds(spark):
    months = panel_of(spark, "2014-03-30", start="2014-01-15")
    ev = spark.createDataFrame([("p", d("2014-04-01")), ("p", d("2014-04-30")), ("q", d("2014-04-02"))], "id string, ot_date date")
    out = panel.period_events(months, ev, "id", "2014-01-15", "2014-12-31").collect()
    assert {r.obs_ym: r.ot for r in out if r.ot} == {"201404": 2} and len(out) == 10
    early = panel_of(spark, "2014-01-02", start="2014-01-15")
    ev = spark.createDataFrame([("p", d("2014-01-10")), ("p", d("2014-01-15"))], "id string, ot_date date")
    out = panel.period_events(early, ev, "id", "2014-01-15", "2014-12-31").orderBy("obs_ym").first()
    assert (out.obs_date_on, out.ot) == (d("2014-01-15"), 1)


def test_follow_up_and_washout(spark):
    people = spark.createDataFrame(
        [("a", d("2014-06-01")), ("b", d("2014-06-01")), ("c", d("2014-06-01")), ("e", d("2014-12-31"))], "id string, index_date date"
    )
    ev = spark.createDataFrame([("a", d("2014-06-10"), 1), ("c", d("2014-06-01"), 1)], "id string, ot_date date, ot int")
    framed = cohort.analytic_frame(people, "id", ev, study_end="2014-12-31")
    kept, attrition = cohort.select_cohort(framed, [("washout", ~(F.col("ot_date") <= F.col("index_date")))])
    assert sorted((r.id, r.ft, r.ot) for r in kept.collect()) == [("a", 9.0, 1), ("b", 213.0, 0)]
    assert [(r.n, r.n_dropped) for r in attrition.orderBy("step").collect()] == [(4, 0), (2, 2)]


def test_frequency_matching_counts(spark):
    sizes = {"a": (3, 10), "b": (5, 7), "c": (0, 4), "d": (2, 0), "e": (2, 1)}
    rows = [(f"{s}{k}{i}", s, k) for s, both in sizes.items() for k, n in ((1, both[0]), (0, both[1])) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id string, s string, y int")
    out = matching.frequency_match(df, "y", ["s"], 2, 407, "id").collect()
    kept = Counter((r.s, r.y) for r in out)
    assert kept == {("a", 1): 3, ("a", 0): 6, ("b", 1): 3, ("b", 0): 6}
    sets = Counter((r.gg, r.y) for r in out)
    assert all(sets[g, 1] == 1 and sets[g, 0] == 2 for g, _ in sets)
    again = matching.frequency_match(df.repartition(7), "y", ["s"], 2, 407, "id").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def greedy_pairs(rows, caliper, seed=0):
    """Serial rule on single persons: highest score first, nearest free control, higher score on equal distance."""
    import hashlib

    key = lambda r: (hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest(), r[0])
    treated = sorted((r for r in rows if r[1] == 1), key=lambda r: (-r[2], key(r)))
    free, pairs = [r for r in rows if r[1] == 0], {}
    for t in treated:
        best = min(free, key=lambda c: (abs(c[2] - t[2]), -c[2], key(c)), default=None)
        if best is not None and abs(best[2] - t[2]) <= caliper:
            free.remove(best)
            pairs[t[0]] = best[0]
    return pairs


@pytest.mark.parametrize("seed, per_segment, treated", [(1, 1000, 0.4), (2, 7, 0.4), (3, 5, 0.7), (4, 9, 0.5)])
def test_nearest_neighbour_equals_serial_rule(spark, seed, per_segment, treated):
    rng = random.Random(seed)
    rows = [(f"p{i}", int(rng.random() < treated), round(rng.betavariate(2, 3) * 64) / 64) for i in range(160)]
    df = spark.createDataFrame(rows, "id string, t int, ps double").repartition(5)
    out = matching.ps_match(df, "id", "t", "ps", caliper=3 / 64, per_segment=per_segment, chunk=2).collect()
    got = {r.pair_id: r.id for r in out if r.t == 0}
    assert got == greedy_pairs(rows, 3 / 64)
    assert len(out) == 2 * len(got) and len({r.id for r in out}) == len(out)


def test_nearest_neighbour_with_one_score_for_a_third_of_all(spark):
    rng = random.Random(9)
    rows = [(f"p{i}", i % 3 == 0, 0.5 if i % 3 == 1 or i % 9 == 0 else rng.random()) for i in range(300)]
    rows = [(a, int(b), c) for a, b, c in rows]
    df = spark.createDataFrame(rows, "id string, t int, ps double")
    out = matching.ps_match(df, "id", "t", "ps", caliper=0.02, per_segment=20, chunk=3).collect()
    assert {r.pair_id: r.id for r in out if r.t == 0} == greedy_pairs(rows, 0.02)


@pytest.mark.parametrize("treated_above", [True, False])
def test_groups_stay_bounded_where_controls_run_out(spark, monkeypatch, treated_above):
    """All treated on one side of all controls: long exhausted ranges, yet no group beyond the set bound."""
    sizes, solve = [], matching._segment_flows

    def noting(groups, caliper):
        sizes.append(groups.groupBy("seg").count().agg({"count": "max"}).first()[0])
        return solve(groups, caliper)

    monkeypatch.setattr(matching, "_segment_flows", noting)
    rows = [(f"t{i}", 1, (200 + i if treated_above else i) / 512) for i in range(120)]
    rows += [(f"c{i}", 0, (i if treated_above else 200 + i) / 512) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, t int, ps double")
    per_segment, wave = 12, 3
    out = matching.ps_match(df, "id", "t", "ps", caliper=0.45, per_segment=per_segment, wave=wave).collect()
    assert {r.pair_id: r.id for r in out if r.t == 0} == greedy_pairs(rows, 0.45)
    assert len(sizes) > 5 and max(sizes) <= 2 * per_segment + 2 * wave * 2 * per_segment


def test_steps_grow_with_scores_not_with_persons(spark, monkeypatch):
    """Every score has more treated than a segment has scores; the steps are those of as many scores with one person each."""
    waves, solve = [], matching._solve_wave
    monkeypatch.setattr(matching, "_heavy_flows", None)
    monkeypatch.setattr(matching, "_solve_wave", lambda *a: waves.append(a[2]) or solve(*a))
    rng = random.Random(11)
    rows = [(f"p{i}", int(rng.random() < 0.5), rng.randrange(30) / 32) for i in range(700)]
    df = spark.createDataFrame(rows, "id string, t int, ps double")
    out = matching.ps_match(df, "id", "t", "ps", caliper=3 / 32, per_segment=8, wave=4).collect()
    assert {r.pair_id: r.id for r in out if r.t == 0} == greedy_pairs(rows, 3 / 32)
    assert sum(waves) <= 2 * 30 / 8 + 1 and len(waves) <= 2


@pytest.mark.parametrize("seed, caliper, wave", [(1, 0.6, 1), (2, float("inf"), 2)])
def test_hot_scores_among_many_controls_see_bounded_groups(spark, monkeypatch, seed, caliper, wave):
    """Scores with many treated and few equals: those that would see too many scores are steps of their own."""
    sizes, steps, solve, serve = [], [], matching._segment_flows, matching._heavy_flows

    def noting(groups, limit):
        sizes.append(groups.groupBy("seg").count().agg({"count": "max"}).first()[0] or 0)
        return solve(groups, limit)

    monkeypatch.setattr(matching, "_segment_flows", noting)
    monkeypatch.setattr(matching, "_heavy_flows", lambda *a: steps.append(a[1]) or serve(*a))
    rng, per_segment = random.Random(seed), 2
    rows = [(f"c{i}", 0, rng.randrange(128) / 128) for i in range(90)] + [(f"t{i}", 1, rng.randrange(128) / 128) for i in range(4)]
    rows += [(f"h{i}", 1, (0.5, 63 / 128)[i % 2]) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, t int, ps double").repartition(3)
    out = matching.ps_match(df, "id", "t", "ps", caliper=caliper, per_segment=per_segment, wave=wave, chunk=7).collect()
    assert {r.pair_id: r.id for r in out if r.t == 0} == greedy_pairs(rows, caliper)
    assert steps and max(sizes) <= (4 * wave + 3) * per_segment + 3


def test_small_caliper_example(spark):
    rows = [("T1", 1, 0.80), ("T2", 1, 0.78), ("C1", 0, 0.79), ("C2", 0, 0.70)]
    out = matching.ps_match(spark.createDataFrame(rows, "id string, t int, ps double"), "id", "t", "ps", caliper=0.1).collect()
    assert {r.pair_id: r.id for r in out if r.t == 0} == {"T1": "C1", "T2": "C2"}


def test_random_rank_is_a_permutation_per_group(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 3))
    ranked = ordered.random_rank(df, ["g"], ["id"], 5).collect()
    for g in (0, 1, 2):
        ranks = sorted(r["rank"] for r in ranked if r.g == g)
        assert ranks == list(range(1, len(ranks) + 1))


def test_running_sums_over_many_buckets(spark):
    df = spark.range(1, 501).select((F.col("id") * 1.5).alias("v"), F.pmod("id", F.lit(2)).alias("g"), F.col("id").alias("n"))
    cut = ordered.value_buckets(df, "v", 16)
    up = ordered.running_sums(cut, ["g"], "v", {"s": "n"}).collect()
    down = ordered.running_sums(cut, ["g"], "v", {"s": "n"}, descending=True, inclusive=False).collect()
    for r in up:
        assert r.s == sum(k for k in range(1, r.n + 1) if k % 2 == r.g)
    for r in down:
        assert r.s == sum(k for k in range(r.n + 1, 501) if k % 2 == r.g)
    assert len({r._bucket for r in up}) > 8


def test_kth_timeline(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (5, 1)], "id int, insulin int")
    shown = cohort.timeline_of_kth(df, "id", F.col("insulin") == 1, 2, [("insulin", "desc")])
    assert [tuple(r) for r in shown.collect()] == [(3, 1), (3, 0)]
    assert cohort.timeline_of_kth(df, "id", F.col("insulin") == 1, 4, [("insulin", "desc")]).count() == 0


def test_iptw_values(spark):
    from claimweave.operators import weights

    df = spark.createDataFrame([(1, 0.5)] * 2 + [(0, 0.5)] * 3, "t int, ps double")
    got = {r.t: r.iptw for r in weights.iptw(df, "t", "ps").collect()}
    assert got[1] == pytest.approx(0.8) and got[0] == pytest.approx(1.2)


def test_exposure_formula_matches_pairwise_rule(spark):
    """Random episodes, some with unknown ends: expanded months against the literal overlap test."""
    rng = random.Random(3)
    day = lambda: d("2014-01-01") + dt.timedelta(rng.randrange(-30, 400))
    eps = []
    for i in range(60):
        start = day()
        end = None if rng.random() < 0.1 else start + dt.timedelta(rng.randrange(-2, 90))
        eps.append((rng.randrange(12), int(rng.random() < 0.6), start, end))
    people = [(i, day()) for i in range(14)]
    months = panel.person_periods(
        spark.createDataFrame(people, "id int, index_date date"), "id", "index_date", "2014-01-01", "2014-12-31"
    )
    ep = spark.createDataFrame(eps, "id int, insulin int, start_date date, end_date date")
    got = {(r.id, r.obs_ym): r.insulin for r in panel.period_exposure(months, ep, "id", "insulin", "2014-01-01", "2014-12-31").collect()}
    want = {}
    for r in months.collect():
        for i, flag, start, end in eps:
            if i == r.id:
                on = flag == 1 and (end is None or r.obs_date_on <= end) and start <= r.obs_date_off
                want[r.id, r.obs_ym] = max(want.get((r.id, r.obs_ym), 0), int(on))
    assert got == want


def test_treatment_visits_and_index_day(spark):
    opd = ["id", "func_date", "func_type", "prsn_id", "drug_day", *KEY]
    head = {"id": "p", "func_date": "20140401", "func_type": "01", "drug_day": "28"}
    heads = [head | {"prsn_id": "a"} | claim(1, "B"), head | {"prsn_id": "b"} | claim(2, "A"), head | {"prsn_id": "c", "drug_day": "bad"} | claim(3, "A")]
    lines = [{"drug_no": "D1"} | claim(1, "B"), {"drug_no": "D1"} | claim(1, "B"), {"drug_no": "D2"} | claim(2, "A"), {"drug_no": "D2"} | claim(3, "A")]
    phe = ["id", "func_date", "r_hosp_id", "func_type", "prsn_id", "drug_day", *KEY]
    pharm = [head | {"r_hosp_id": "A", "prsn_id": "b", "drug_day": "10"} | claim(9, "Z")]
    tables = {
        "outpatient": frame(spark, heads, opd),
        "outpatient_orders": frame(spark, lines, ["drug_no", *KEY]),
        "pharmacy": frame(spark, pharm, phe),
        "pharmacy_orders": frame(spark, [{"drug_no": "D2"} | claim(9, "Z")], ["drug_no", *KEY]),
        "drug_list": spark.createDataFrame([("D1", "A10AB01"), ("D2", "A10BA02"), ("D3", "C01")], "drug_no string, atc_code string"),
    }
    ep = treatment_cohort.treatment_episodes(tables)
    rows = {(r.hosp_id, r.prsn_id): (r.insulin, r.drug_day, r.end_date) for r in ep.collect()}
    assert rows == {
        ("B", "a"): (1, 28.0, d("2014-04-28")),
        ("A", "b"): (0, 38.0, d("2014-05-08")),
        ("A", "c"): (0, None, None),
    }
    (first,) = treatment_cohort.index_dates(ep).collect()
    assert (first.index_date, first.insulin) == (d("2014-04-01"), 0)


def test_supplies_without_days_count_in_their_month(spark):
    """A supply that ends the day before it starts, or earlier, is exposed in a month that holds both days."""
    import datetime as dt

    from claimweave.operators import panel

    day = dt.date
    people = spark.createDataFrame([(1, day(2014, 1, 1)), (2, day(2014, 1, 1)), (3, day(2014, 1, 1))], "id long, index_date date")
    periods = panel.person_periods(people, "id", "index_date", "2014-01-01", "2014-12-31")
    episodes = spark.createDataFrame(
        [(1, 1, day(2014, 3, 10), day(2014, 3, 9)), (2, 1, day(2014, 3, 1), day(2014, 2, 28)), (3, 1, day(2014, 3, 10), day(2014, 3, 8))],
        "id long, drug int, start_date date, end_date date",
    )
    out = panel.period_exposure(periods, episodes, "id", "drug", "2014-01-01", "2014-12-31")
    assert sorted((r.id, r.obs_ym) for r in out.filter("drug = 1").collect()) == [(1, "201403"), (3, "201403")]


def test_large_means_leave_the_smd_as_it_is(spark):
    from pyspark.sql import functions as F

    from claimweave.operators import describe

    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("t"), (F.sin("id") + F.col("id") % 2).alias("x"), (1 + F.col("id") % 3).cast("double").alias("w"))
    for weight in (None, "w"):
        near = describe.baseline_smd(df, "t", ["x"], [], weight).first()
        far = describe.baseline_smd(df.withColumn("x", F.col("x") + 1e8), "t", ["x"], [], weight).first()
        assert abs(near.smd - far.smd) < 1e-6 and near.smd > 1


def test_smd_of_constant_columns(spark):
    """Groups of one value each have standard deviation 0 and no standardised difference, weighted or not."""
    rows = [(0, 1.1, 1e9 + 0.1, 0.3 + i) for i in range(7)] + [(1, 2.3, 1e9 + i, 0.7) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, u double, v double, w double")
    for weight in (None, "w"):
        out = {r.variable: r for r in describe.baseline_smd(df, "g", ["u", "v"], [], weight).collect()}
        assert (out["u"].sd_0, out["u"].sd_1, out["u"].smd, out["u"].mean_0, out["u"].mean_1) == (0.0, 0.0, None, 1.1, 2.3)
        assert out["v"].sd_0 == 0.0 and out["v"].sd_1 == pytest.approx(1.5811388, abs=1e-6) and out["v"].smd == pytest.approx(1.9 / (1.25**0.5), abs=1e-6)
