"""Rule tables over one row of facts: checks, severities, roll-ups, missing files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig

#: Severities from worst to best.
SEVERITY = ("fail", "warn", "pass")


def evaluate(facts: DataFrame, rules: Sequence[tuple[str, Column, str]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, check, status) for each rule (name, predicate, status if it does not hold); null does not hold."""
    checks = F.array(*(F.struct(F.lit(n).alias("check"), F.when(p, "pass").otherwise(bad).alias("status")) for n, p, bad in rules))
    return facts.select(*keys, F.explode(checks).alias("c")).select(*keys, "c.*")


def overall(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The worst status: any fail, else any warn, else pass."""
    order = F.array(*map(F.lit, SEVERITY))
    return checks.groupBy(*keys).agg(F.get(order, F.min(F.array_position(order, F.col("status"))).cast("int") - 1).alias("status"))


_TIER = "struct<accuracy:double,all_normal_baseline_accuracy:double,auc:double,recall:double,false_alarms_per_hour:double,event_level:struct<event_count:long,detected_events:long,event_sensitivity:double,event_sensitivity_ci95_low:double,event_sensitivity_ci95_high:double>>"
#: What the rules read of a detection result document; a field that a document lacks is null.
DETECTION_SCHEMA = f"""pipeline_version string, status string, split_strategy string, evaluation_scope string, claim_scope string, standard_mode {_TIER}, pro_mode {_TIER},
product_allocation_selection struct<selection_split:string>, best_science_model map<string,string>, best_product_model map<string,string>,
matched_false_alarm_operating_point struct<validation_alarm_budget:double,fixed_validation_alarm_budgets:array<double>>,
label_policy struct<offset_policy:string,seizure_duration_seconds:double,merge_gap_seconds:double,detection_window_seconds:double,detection_stride_seconds:double>,
sensor_policy struct<synthetic_signals:boolean>, run_config struct<selected_session_count:long>,
model_provenance struct<retrained_from_scratch_all_variants:boolean,variants:map<string,struct<checkpoint_path:string,resumed_from_checkpoint:boolean>>>"""
#: What the rules read of a prediction result document.
PREDICTION_SCHEMA = """pipeline_version string, status string, split_strategy string, train_sessions array<string>, val_sessions array<string>,
dataset_usage struct<final_metrics_use_full_validation:boolean,full_dataset_counts:struct<val_sequences:long>>, metrics map<string,struct<evaluation_split:string,n_val:long>>"""
#: How a result names its split, and what a stated claim and scope must say.
HELD_OUT, SCOPE, CLAIMS = "patient-level held-out split", "patient-level generalization", ("prototype", "not a clinically validated detector")
Rule = tuple[str, Column, str]


def complete_interval(tier: str) -> Column:
    """Whether a tier's event sensitivity comes with both ends of its interval."""
    level = F.col(f"{tier}_mode.event_level")
    return level["event_sensitivity_ci95_low"].isNotNull() & level["event_sensitivity_ci95_high"].isNotNull()


def scientific_rules() -> list[Rule]:
    """Whether uncertainty, operating point and label policy are documented."""
    point = F.col("matched_false_alarm_operating_point")
    return [
        ("uncertainty_estimates", complete_interval("standard") & complete_interval("pro"), "warn"),
        ("operating_point_documented", point["validation_alarm_budget"].isNotNull() | (F.size(point["fixed_validation_alarm_budgets"]) > 0), "warn"),
        ("label_policy_documented", F.trim("label_policy.offset_policy") != "", "warn"),
    ]


def detection_rules() -> list[Rule]:
    """Checks on a document of `DETECTION_SCHEMA`; a number that is missing counts as 0."""
    number = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    gain = lambda name: number(f"pro_mode.{name}") - number(f"standard_mode.{name}")
    claim = F.lower("claim_scope")
    return [
        ("detection_status", F.col("status") == "completed", "fail"),
        ("split_strategy", F.col("split_strategy") == HELD_OUT, "fail"),
        ("evaluation_scope", F.col("evaluation_scope").contains(SCOPE), "warn"),
        ("claim_scope_disclosed", claim.contains(CLAIMS[0]) & claim.contains(CLAIMS[1]), "warn"),
        ("raw_accuracy_not_primary", number("standard_mode.all_normal_baseline_accuracy") >= F.greatest(number("standard_mode.accuracy"), number("pro_mode.accuracy")), "warn"),
        ("pro_signal_gain", (gain("auc") >= 0) & (gain("recall") >= 0), "warn"),
        ("pro_event_sensitivity_gain", gain("event_level.event_sensitivity") >= 0, "warn"),
        ("event_level_disclosed", F.col("standard_mode.event_level").isNotNull() & F.col("pro_mode.event_level").isNotNull(), "warn"),
        ("checkpoint_provenance_disclosed", F.lit(True), "warn"),
        ("allocation_selected_on_validation", F.col("product_allocation_selection.selection_split") == "validation", "fail"),
        ("science_product_split_present", F.col("best_science_model").isNotNull() & F.col("best_product_model").isNotNull(), "warn"),
        *scientific_rules(),
    ]


def edge_rules(tiers: Sequence[str] = ("standard", "pro"), most_kb: float = 512.0) -> list[Rule]:
    """Checks on facts (TIER_size_kb, TIER_inputs and TIER_outputs: arrays of the tensors' types)."""
    kinds = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",").isin("float32", "int8")
    return [rule for t in tiers for rule in (
        (f"{t}_tflite_size", (F.col(f"{t}_size_kb") > 0) & (F.col(f"{t}_size_kb") < most_kb), "warn"),
        (f"{t}_tflite_io_dtype_disclosed", kinds(f"{t}_inputs") & kinds(f"{t}_outputs"), "warn"))]


def preflight_rules(least_patients: int = 5, settings: dict[str, str] | None = None) -> list[Rule]:
    """Checks on an inventory (patients, sessions, complete_sessions, label_files, incomplete_sessions, generated, resume, settings map)."""
    wanted = settings if settings is not None else {"EDGE_BENCHMARK": "1", "EDGE_FAIL_ON_BENCHMARK_FAILURE": "0", "EDGE_REQUIRE_INT8": "0", "TSMIXER_STOP_ON_FAILURE": "1"}
    return [
        ("patient_dirs", F.col("patients") >= least_patients, "fail"),
        ("session_dirs", F.col("sessions") > 0, "fail"),
        ("complete_sensor_sessions", F.col("complete_sessions") > 0, "fail"),
        ("patient_label_files", F.col("label_files") == F.col("patients"), "fail"),
        ("required_sensor_files", F.col("incomplete_sessions") == 0, "fail"),
        ("clean_generated_artifacts", F.col("resume") | (F.col("generated") == 0), "fail"),
        *((name.lower(), F.col("settings")[name] == value, "fail") for name, value in wanted.items()),
    ]


def valid_detection(version: str, sessions: int, config: EngineConfig = DEFAULT, present: Column | None = None) -> Column:
    """Whether a document of `DETECTION_SCHEMA` is a finished, leakage-safe result of this configuration.

    ``present``: paths of checkpoints that exist (an array); where not all variants were trained from
    scratch, every variant's checkpoint must be among them.
    """
    near = lambda name, x: F.abs(F.col(f"label_policy.{name}") - x) < 1e-6
    paths = F.array_compact(F.transform(F.map_values("model_provenance.variants"), lambda v: v["checkpoint_path"]))
    known = F.array().cast("array<string>") if present is None else present
    checkpoints = (F.size(F.map_values("model_provenance.variants")) > 0) & (F.size(F.array_except(paths, known)) == 0)
    holds = (
        (F.col("pipeline_version") == version) & (F.col("status") == "completed") & (F.col("split_strategy") == HELD_OUT) & ~F.col("sensor_policy.synthetic_signals")
        & F.col("product_allocation_selection").isNotNull() & F.col("best_science_model").isNotNull() & F.col("best_product_model").isNotNull() & F.col("matched_false_alarm_operating_point").isNotNull()
        & (F.col("label_policy.seizure_duration_seconds") == config.event_seconds) & (F.col("label_policy.merge_gap_seconds") == config.merge_gap_seconds)
        & near("detection_window_seconds", config.window_samples / config.target_rate_hz) & near("detection_stride_seconds", config.window_stride / config.target_rate_hz)
        & (F.col("run_config.selected_session_count") == sessions)
        & (F.coalesce(F.col("model_provenance.retrained_from_scratch_all_variants"), F.lit(False)) | F.coalesce(checkpoints, F.lit(False)))
    )
    return F.coalesce(holds, F.lit(False))


def valid_prediction(version: str, sessions: int, horizons: Sequence[int] = DEFAULT.horizons_seconds) -> Column:
    """Whether a document of `PREDICTION_SCHEMA` was measured on the full validation data at every horizon."""
    n = F.col("dataset_usage.full_dataset_counts.val_sequences")
    holds = (
        (F.col("pipeline_version") == version) & (F.col("status") == "completed") & (F.col("split_strategy") == HELD_OUT)
        & (F.coalesce(F.size("train_sessions"), F.lit(0)) + F.coalesce(F.size("val_sessions"), F.lit(0)) == sessions)
        & F.col("dataset_usage.final_metrics_use_full_validation") & n.isNotNull()
    )
    for h in horizons:
        m = F.col("metrics")[str(h)]
        holds = holds & (m["evaluation_split"] == "full_validation") & (m["n_val"] == n)
    return F.coalesce(holds, F.lit(False))


def unknown_names(wanted: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """(name): distinct wanted names that are not known, in order; blanks do not count."""
    w = wanted.select(F.trim(name).alias(name)).where(F.col(name) != "").distinct()
    return w.join(known.select(name), name, "left_anti").orderBy(name)


def known_rows(known: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """The known rows whose name is wanted."""
    return known.join(wanted.select(F.trim(name).alias(name)), name, "left_semi")


def missing_files(required: DataFrame, present: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The first n of the required rows that are not present."""
    return required.join(present, list(keys), "left_anti").orderBy(*keys).limit(n)


def run_stamp(name: Column) -> Column:
    """Timestamp of a run folder named ``yyyymmdd_hhmmss...``; null elsewhere."""
    s = F.regexp_extract(name, r"^(\d{8}_\d{6})", 1)
    return F.try_to_timestamp(F.when(s != "", s), F.lit("yyyyMMdd_HHmmss"))


def in_window_or_latest(runs: DataFrame, stamp: str, start: str | None, end: str | None) -> DataFrame:
    """Runs between two times; without times, or with none inside, those of the latest date."""
    date = F.to_date(stamp)
    latest = runs.agg(F.max(date).alias("__latest"))
    last = runs.join(F.broadcast(latest), date == F.col("__latest"), "left_semi")  # one row
    if start is None or end is None:
        return last
    inside = runs.where(F.col(stamp).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return inside if not inside.isEmpty() else last


def current(runs: DataFrame, version: str) -> DataFrame:
    """Finished runs of a pipeline version."""
    return runs.where((F.col("pipeline_version") == version) & (F.col("status") == "completed"))


def run_status(version: str) -> Column:
    """A run's status from its metadata (pipeline_version, status, edge_status, detection_exit_code), for the version expected."""
    edge = F.coalesce(F.col("edge_status") == "completed", F.lit(False))
    return (
        F.when(~F.coalesce(F.col("pipeline_version") == version, F.lit(False)), "pipeline_version_mismatch")
        .when((F.col("status") == "detection_completed") & edge, "completed").when(F.col("status") != "", F.col("status"))
        .when((F.col("detection_exit_code") == 0) & edge, "completed").when(F.col("detection_exit_code") == 0, "detection_completed").otherwise("detection_failed"))


def latest_by_modification(files: DataFrame, keys: Sequence[str] = (), modified: str = "modified") -> DataFrame:
    """The row of each key that was modified last, the greatest file name among equals."""
    columns = [c for c in files.columns if c not in keys]
    return files.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(modified, "file")).alias("__r")).where("__r is not null").select(*keys, "__r.*")


def status_windows(lines: DataFrame, what: str) -> DataFrame:
    """(file, modified, start, end) from log lines ``START WHAT <ISO time>`` and ``END WHAT <ISO time>``: the last of each file."""
    stamp = lambda kind: F.try_to_timestamp(F.nullif(F.regexp_extract("value", rf"^{kind} {what}\S*\s.*?(\d{{4}}-\d\d-\d\dT[\d:.]+)\s*$", 1), F.lit("")))
    modified = F.col("modified") if "modified" in lines.columns else F.lit(None).cast("timestamp")
    rows = lines.select("file", modified.alias("modified"), stamp("START").alias("start"), stamp("END").alias("end"))
    return rows.groupBy("file").agg(F.max("modified").alias("modified"), F.max("start").alias("start"), F.max("end").alias("end"))


def latest_window(windows: DataFrame) -> DataFrame:
    """(start, end) of the log modified last among those that name a start."""
    return latest_by_modification(windows.where("start is not null")).select("start", "end")
