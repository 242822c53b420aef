"""Fusion of the evidence into ranked suspects, and the calibrated decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.nulls import share
from wakeline.operators.evidence import gap_overlaps

TIERS = ("strongly consistent", "consistent", "weak", "not supported")


def relative(x: str, group: str = "cluster_id") -> Column:
    """Share of the group's largest value; 0 if that is not positive."""
    most = F.max(x).over(Window.partitionBy(group))
    return F.when(most > 0, F.col(x) / most).otherwise(0.0)


def fuse(robust: DataFrame, forward: DataFrame, geometry: DataFrame, behaviour: DataFrame, motion: DataFrame, sar: DataFrame | None = None, min_point: float = 0.135, top3: float = 0.5, top5: float = 0.5, fresh_h: float = 3.0, sar_km: float = 2.0) -> DataFrame:
    """Star of left joins around the entities that pass the funnel, relative scores, tier, flags and rank by event.

    An entity that was not simulated forward counts as 0 but stays marked; unknown flags are false. ``sar`` (from
    ``matching.sar_evidence``: cluster_id, mmsi, sar_label, sar_dist_km) adds its columns and a flag for an entity that is
    silent at T0 but seen near the slick.
    """
    j = robust.filter("passes_funnel").join(forward, ["cluster_id", "mmsi"], "left").join(geometry, ["cluster_id", "mmsi"], "left").join(behaviour, "mmsi", "left").join(motion, "mmsi", "left")
    if sar is not None:
        seen = (F.col("sar_label") == "ais_silent_at_t0") & (F.col("sar_dist_km") <= sar_km)
        j = j.join(sar, ["cluster_id", "mmsi"], "left").withColumn("flag_ais_silent_seen_by_sar_near_slick", F.coalesce(seen, F.lit(False)))
    j = j.withColumn("fwd_evaluated", F.col("fwd_f").isNotNull()).withColumn("fwd_f", F.coalesce("fwd_f", F.lit(0.0))).withColumn("motion_state", F.coalesce("motion_state", F.lit("not in table")))
    j = j.withColumn("bwd_rel", relative("bwd_weighted")).withColumn("fwd_rel", relative("fwd_f")).withColumn("combined", F.sqrt(F.col("bwd_rel") * F.col("fwd_rel")))
    no = lambda c: F.coalesce(c, F.lit(False))
    skilful, bwd_ok = no(F.col("fss_skilful")), no(F.col("bwd_point") >= min_point)
    strong = skilful & bwd_ok & (F.col("bwd_top3_fraction") >= top3)
    consistent = skilful | (bwd_ok & (F.col("bwd_top5_fraction") >= top5))
    ordinal = F.when(strong, 0).when(consistent, 1).when(F.col("combined") > 0, 2).otherwise(3)
    fw = F.col("fwd_f") > 0
    j = j.withColumn("_tier", ordinal).withColumn("tier", F.element_at(F.array(*map(F.lit, TIERS)), F.col("_tier") + 1)).withColumns({
        "flag_fresh_discharge_match": no((F.col("geo_fresh_discharge") >= 0.5) & (F.col("window_end_h") <= fresh_h)), "flag_ais_gap_in_release_window": gap_overlaps(F.col("gaps"), F.col("window_start_h"), F.col("window_end_h")),
        "flag_identity_anomaly": ~F.coalesce("mmsi_standard", F.lit(True)) | (F.coalesce("ais_speed_jumps", F.lit(0)) > 0), "flag_window_at_48h_boundary": no(fw & (F.col("window_end_h") >= 47)),
        "direction_agreement": F.when(fw & bwd_ok, "forward+backward").when(bwd_ok & ~F.col("fwd_evaluated"), "backward only (forward not evaluated)").when(bwd_ok, "backward only").when(fw, "forward only").otherwise("neither"),
    })
    w = Window.partitionBy("cluster_id").orderBy("_tier", F.round("combined", 6).desc(), "mmsi")
    return j.withColumn("suspect_rank", F.row_number().over(w)).drop("_tier")


def supported(f_min: Column | float, point_min: Column | float, support_min: Column | float) -> Column:
    """Whether a suspect passes all absolute thresholds; an unknown support counts as 0."""
    f_min = f_min if isinstance(f_min, Column) else F.lit(float(f_min))
    return F.coalesce((F.col("fwd_f") >= f_min) & (F.col("bwd_point") >= point_min) & (F.coalesce("member_support", F.lit(0.0)) >= support_min) & ((F.col("fwd_f") > 0) | (f_min == 0)), F.lit(False))


def _two_best(group: list[str]) -> list[Column]:
    """The two largest forward scores of each group with their entities: the runner-up to any entity is one of them."""
    w = Window.partitionBy(*group).orderBy(F.desc("fwd_f"), "mmsi").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return [F.first("mmsi").over(w).alias("best_mmsi"), F.first("fwd_f").over(w).alias("best_f"), F.nth_value("fwd_f", 2).over(w).alias("second_f")]


def runner_up(group: list[str], df: DataFrame) -> DataFrame:
    """``df`` with ``runner_f``: the largest forward score of any other entity of the group (0 without one)."""
    out = df.select("*", *_two_best(group))
    return out.withColumn("runner_f", F.coalesce(F.when(F.col("mmsi") == F.col("best_mmsi"), F.col("second_f")).otherwise(F.col("best_f")), F.lit(0.0))).drop("best_mmsi", "best_f", "second_f")


def decide(suspects: DataFrame, f_min: float = 0.7, point_min: float = 0.7, support_min: float = 0.5, margin: float = 1.0) -> DataFrame:
    """The calibrated decision: a supported suspect that leads its event's supported ones and beats every other entity,
    supported or not, by the margin is flagged."""
    s = runner_up(["cluster_id"], suspects.withColumn("v31_supported", supported(f_min, point_min, support_min)))
    lead = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("v31_supported"), F.round("combined", 6).desc(), "mmsi")) == 1
    flagged = F.col("v31_supported") & lead & (F.col("fwd_f") >= margin * F.col("runner_f"))
    return s.withColumn("v31_decision", F.when(flagged, "high-confidence flag (calibrated)").when(F.col("v31_supported"), "supported").otherwise("lead only")).drop("runner_f")


def sweep_rules(suspects: DataFrame, cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Metrics of each rule (a: forward, b: point, c: support, m: margin) by split.

    ``suspects`` of case_id, mmsi, fwd_f, bwd_point, member_support, combined; ``cases`` of case_id, truth, split. A rule
    accuses the leading supported entity if it beats all others by the margin; the hidden variant leaves the truth out.
    """
    s = suspects.join(cases, "case_id")
    present = runner_up(["case_id"], s).withColumn("hidden", F.lit(False))
    absent = runner_up(["case_id"], s.filter(F.col("mmsi") != F.col("truth"))).withColumn("hidden", F.lit(True))
    crossed = present.unionByName(absent).join(F.broadcast(rules))
    ok = crossed.withColumn("ok", supported(F.col("a"), F.col("b"), F.col("c")))
    first = F.struct((~F.col("ok")).alias("no"), (-F.round("combined", 6)).alias("less"), "mmsi")
    rule = ["rule_id"]
    by_case = ok.groupBy(*rule, "case_id", "split", "truth", "hidden", "m").agg(
        F.count_if("ok").alias("n_supported"), F.bool_or(F.col("ok") & (F.col("mmsi") == F.col("truth"))).alias("truth_supported"), F.min_by(F.struct("mmsi", "fwd_f", "runner_f", "ok"), first).alias("top"),
    )
    accused = F.col("top.ok") & (F.col("top.fwd_f") >= F.col("m") * F.col("top.runner_f"))
    by_case = by_case.withColumn("accused", F.when(accused, F.col("top.mmsi")))
    here, gone = by_case.filter("not hidden"), by_case.filter("hidden")
    m1 = here.groupBy(*rule, "split").agg(F.count("*").alias("n"), share(F.col("accused") == F.col("truth")).alias("correct_attribution"), share(F.col("truth_supported")).alias("truth_supported"), share(F.col("n_supported") == 0).alias("no_accusation_when_present"))
    m2 = gone.groupBy(*rule, "split").agg(F.count_if(F.col("accused").isNotNull()).alias("n_false"))
    return m1.join(m2, [*rule, "split"], "left").withColumn("false_accusation", F.coalesce("n_false", F.lit(0)) / F.col("n")).drop("n_false").join(F.broadcast(rules), "rule_id")


def choose_rule(swept: DataFrame, max_false: float = 0.10) -> DataFrame:
    """The best rule on the calibration split: among those with few false accusations the most correct, then fewest
    false, largest margin and thresholds; without one, the fewest false."""
    own = swept.filter("split = 'calibration'").withColumn("within", F.col("false_accusation") <= max_false)
    order = [F.desc("within"), F.when(F.col("within"), F.col("correct_attribution")).desc_nulls_last(), F.asc("false_accusation"), F.desc("correct_attribution"), F.desc("m"), F.desc("a"), F.desc("b"), F.desc("c")]
    return own.orderBy(*order).limit(1)


def score_cases(cases: DataFrame, suspects: DataFrame) -> DataFrame:
    """Rank, tier and window error of the truth of each case (case_id, truth, tau_start_h, tau_end_h)."""
    w = Window.partitionBy("cluster_id")
    s = suspects.select(
        F.col("cluster_id").alias("case_id"), "mmsi", "tier", "suspect_rank", "fwd_f", "window_start_h", "window_end_h", F.rank().over(w.orderBy(F.round("bwd_weighted", 6).desc())).alias("rank_backward"),
        F.rank().over(w.orderBy(F.round("fwd_f", 6).desc())).alias("rank_forward"),
    )
    n = s.groupBy("case_id").agg(F.count("*").alias("n_suspects"), F.min_by("tier", "suspect_rank").alias("top_tier"), F.min_by("mmsi", "suspect_rank").alias("top_vessel"))
    t = s.withColumnRenamed("mmsi", "truth")
    j = cases.join(n, "case_id", "left").join(t, ["case_id", "truth"], "left")
    seen = F.col("fwd_f") > 0
    overlap = F.greatest(F.lit(0.0), F.least(F.col("window_end_h"), F.col("tau_start_h")) - F.greatest(F.col("window_start_h"), F.col("tau_end_h")))
    return j.select(
        "case_id", "truth", "stratum", "moving", F.coalesce("n_suspects", F.lit(0)).alias("n_suspects"), F.col("tier").isNotNull().alias("truth_passes_funnel"), F.col("suspect_rank").alias("rank_fused"), F.coalesce("tier", F.lit("not in funnel")).alias("tier_truth"),
        F.col("rank_backward").alias("rank_backward_only"), F.when(seen, F.col("rank_forward")).alias("rank_forward_only"), F.coalesce("top_tier", F.lit("none")).alias("top_tier"), "top_vessel",
        F.when(seen, overlap).alias("window_overlap_h"), F.when(seen, F.abs((F.col("window_start_h") + F.col("window_end_h")) / 2 - (F.col("tau_start_h") + F.col("tau_end_h")) / 2)).alias("window_mid_error_h"),
    )


def skill_table(results: DataFrame) -> DataFrame:
    """Skill over overlapping subsets: all, each stratum, moving or stationary. A missing rank counts as 999."""
    subsets = F.array(F.lit("all"), F.col("stratum"), F.when(F.col("moving"), "moving").otherwise("stationary"))
    r = results.withColumn("subset", F.explode(subsets))
    tops = [share(F.coalesce(f"rank_{m}", F.lit(999)) <= k).alias(f"top{k}_{m}") for m in ("fused", "backward_only", "forward_only") for k in (1, 3, 5)]
    return r.groupBy("subset").agg(F.count("*").alias("n"), share(F.col("truth_passes_funnel")).alias("funnel_recall"), *tops, share(F.col("tier_truth").isin(*TIERS[:2])).alias("truth_consistent_or_better"), F.median("window_mid_error_h").alias("median_window_mid_error_h"))


def hide(suspects: DataFrame, cases: DataFrame) -> DataFrame:
    """Suspects without the truth of their case."""
    return suspects.join(cases.select(F.col("case_id").alias("cluster_id"), F.col("truth").alias("mmsi")), ["cluster_id", "mmsi"], "left_anti")
