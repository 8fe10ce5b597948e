"""Daily table to every result table, for many symbols in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.config import (
    BOOTSTRAP_SIMULATIONS, FEATURE_SETS, INSTRUMENTS, LEAD_RULES, POLICIES, Instrument,
)
from tidemark.functions.windows import spread_by_symbol
from tidemark.operators import compare as C, metrics as M, observed as O, selection as S, walkforward
from tidemark.operators.features import build_features
from tidemark.operators.filters import from_first_predicted
from tidemark.operators.labels import add_monthly_labels, monthly_oracle
from tidemark.operators.leads import attach_leads
from tidemark.operators.quality import data_quality, duplicate_keys, require
from tidemark.session import scratch, written
from tidemark.sources import landed, runs


@dataclass(frozen=True)
class Prepared:
    features: DataFrame
    labelled: DataFrame
    oracle: DataFrame


def prepare(
    daily: DataFrame, first_complete_month: str | Column, complete_through: str | None = None
) -> Prepared:
    """Features, labels of complete months, and the monthly oracle; one exchange by symbol."""
    features = build_features(daily)
    labelled = add_monthly_labels(features, complete_through, first_month=first_complete_month)
    return Prepared(features, labelled, monthly_oracle(labelled))


BOUGHT = ("symbol", "strategy", "month", "date", "trading_day", "days_in_month", "adjusted_open", "regret", "forced")


def policy_purchases(predictions: DataFrame) -> DataFrame:
    """Purchases of every policy for every feature set, from one pass over the predictions."""
    bought = S.select_by_rules(predictions, S.policy_rules(), ("symbol", "feature_set", "month"))
    return bought.select(*BOUGHT, "feature_set")


def model_purchases(bought: DataFrame) -> DataFrame:
    """Each feature set as a strategy of its own, under the default policy."""
    default = bought.where(F.col("strategy") == POLICIES[0].name)
    return default.withColumn("strategy", F.col("feature_set")).drop("feature_set")


def model_metrics(purchases: DataFrame, predictions: DataFrame, terminal: DataFrame) -> DataFrame:
    """Metrics and probability scores per model."""
    key = ("symbol", "feature_set")
    scores = M.brier_score(predictions, key).join(M.average_precision(predictions, key), list(key))
    return M.metrics_with_wealth(purchases, terminal).join(
        scores.withColumnRenamed("feature_set", "strategy"), ["symbol", "strategy"])


def evaluate(
    daily: DataFrame, labelled: DataFrame, oracle: DataFrame, predictions: DataFrame,
    instrument: Instrument, with_interval: bool = True, simulations: int = BOOTSTRAP_SIMULATIONS,
) -> dict[str, DataFrame]:
    """All metric tables. ``predictions`` carries a ``feature_set`` column.

    Baselines and signal rules are picked in one pass over the labelled rows, policies in
    one pass over the predictions. Both purchase tables (one row per month and strategy)
    are written once; every comparison reads them.
    """
    rows = from_first_predicted(labelled, predictions)
    terminal = M.terminal_close(daily)
    ruled = O.written_checked(
        S.select_by_rules(rows, S.baseline_rules() + S.lead_rules()).select(*BOUGHT), "rule-purchases", one_purchase())
    policies = O.written_checked(policy_purchases(predictions), "policy-purchases", one_purchase("feature_set"))
    baselines = ruled.where(~F.col("strategy").isin(*LEAD_RULES))
    signals = ruled.where(F.col("strategy").isin(*LEAD_RULES))
    day1 = baselines.where("strategy = 'fixed_day_1'")
    day5 = baselines.where("strategy = 'fixed_day_5'")
    models = model_purchases(policies)
    model = models.where(F.col("strategy") == instrument.primary_model)
    primary = policies.where(F.col("feature_set") == instrument.primary_model).drop("feature_set")
    first = predictions.groupBy("symbol").agg(F.min("month").alias("_first"))
    names = [name for key in instrument.feature_sets for name in FEATURE_SETS[key]]

    def against_day1(purchases: DataFrame) -> DataFrame:
        return with_verdict(
            C.compare_to_day1(purchases, day1, terminal, instrument.holdout, with_interval, simulations),
            with_interval)

    return {
        "data_quality": data_quality(daily),
        "oracle_distribution": M.oracle_distribution(oracle),
        "oracle_ranges": M.oracle_ranges(labelled, daily, instrument.has_local_crosscheck),
        "oracle_feature_profile": M.oracle_feature_profile(labelled, tuple(dict.fromkeys(names))),
        "strategy_metrics": model_metrics(models, predictions, terminal).unionByName(
            M.metrics_with_wealth(baselines, terminal), allowMissingColumns=True),
        "primary": C.paired_improvement(model, day1, simulations=simulations, with_interval=with_interval),
        "holdout": C.holdout_result(
            labelled.join(first, "symbol"), model, F.col("_first"), instrument.holdout,
            with_interval, simulations),
        "day1_vs_day5": C.paired_improvement(day1, day5, simulations=simulations, with_interval=with_interval),
        "policy_ablation": against_day1(primary),
        "lead_rules": against_day1(signals).join(M.signal_rates(rows), ["symbol", "strategy"]).withColumn(
            "role", C.rule_role(F.col("forced_rate"), F.col("mean_trading_day"))),
        "lead_coverage": M.lead_coverage(rows),
        "random_strategy": C.random_strategy(rows, simulations),
        "walk_forward_purchases": models,
        "rule_purchases": ruled,
        "meta": meta(rows, instrument),
    }


REPEATED = "more than one purchase in a month"


def one_purchase(*key: str) -> O.Check:
    """A strategy buys once in a month; seen while the purchases are written."""
    return O.unique(REPEATED, ("symbol", "strategy", "month", *key))


def refuse_repeats(purchases: DataFrame, *key: str) -> None:
    """Stop where purchases that are written already hold a month twice."""
    require(duplicate_keys(purchases, ("symbol", "strategy", "month", *key)), REPEATED)


def with_verdict(compared: DataFrame, with_interval: bool) -> DataFrame:
    if not with_interval:
        return compared
    return compared.withColumns({
        "verdict": C.verdict(F.col("ci95_bps")[0], F.col("ci95_bps")[1]),
        "holdout_verdict": C.verdict(F.col("holdout_ci95_bps")[0], F.col("holdout_ci95_bps")[1]),
    })


def meta(rows: DataFrame, instrument: Instrument) -> DataFrame:
    """Run facts per symbol."""
    facts = {
        "display_name": instrument.display_name,
        "primary_model": instrument.primary_model,
        "has_local_crosscheck": instrument.has_local_crosscheck,
        "deadline_first_5_rate": instrument.deadline_first_5_rate,
    }
    return rows.groupBy("symbol").agg(
        F.min("month").alias("oos_start"), F.max("month").alias("oos_end"),
        F.count_distinct("month").alias("oos_months"),
    ).withColumns({name: F.lit(value) for name, value in facts.items()})


def run_research(
    daily: DataFrame, tsm: DataFrame, sox: DataFrame, fx: DataFrame, instrument: Instrument,
    complete_through: str | None = None, stored: DataFrame | None = None,
    simulations: int = BOOTSTRAP_SIMULATIONS,
) -> dict[str, DataFrame]:
    """Daily table to every result table.

    The labelled table with its leads and the predictions are written once: folds,
    baselines, rules and profile all read them. A ``first_complete_month`` column in the
    daily table overrides the preset's month, symbol by symbol. ``stored`` may be the
    ``walk_forward_predictions`` of an earlier run. Symbols that no result table can have
    are listed in ``refused`` with the reason.
    """
    own = "first_complete_month" in daily.columns
    first = F.col("first_complete_month") if own else instrument.first_complete_month
    parts = prepare(spread_by_symbol(daily), first, complete_through)
    labelled = written(attach_leads(parts.labelled, tsm, sox, fx, daily), "labelled")
    daily = daily.drop("first_complete_month")
    oracle = monthly_oracle(labelled)
    sets = {name: FEATURE_SETS[name] for name in instrument.feature_sets}
    predictions = O.written_checked(
        walkforward.predictions(labelled, instrument.model, sets, stored), "predictions",
        O.full_months("unusable predictions", ("symbol", "feature_set", "month")))
    tables = evaluate(daily, labelled, oracle, predictions, instrument, simulations=simulations)
    short = daily.select("symbol").distinct().join(predictions.select("symbol").distinct(), "symbol", "left_anti")
    return {"refused": short.withColumn("reason", F.lit("too few complete months for a first training set")),
            "features": parts.features, "labelled": labelled, "monthly_oracle": oracle,
            "walk_forward_predictions": predictions, **tables}


def research_from_files(
    spark: SparkSession, daily_path: str, leads_folder: str, out_folder: str,
    instruments: Sequence[Instrument] = INSTRUMENTS, default: Instrument | None = None,
) -> dict[str, dict[str, DataFrame]]:
    """The preset instruments over one daily table; all results are published at ``out_folder`` as one run.

    Instruments that differ only in name and first month share one job, so a market of
    any number of symbols is one run. Symbols without a preset follow ``default``; without
    one they are listed in ``refused``. A table ``t`` of a job ``j`` is named ``j/t``. Readers of the
    folder see the run when all of it is written, and the one before until then.
    """
    daily = landed.read_daily(spark, daily_path)
    leads = landed.load_leads(spark, leads_folder)
    with scratch(spark):
        symbols = written(first_months(daily, instruments, default), "first-months")
        tables, lines = {}, {}
        if default is None:
            tables["refused"] = symbols.where("NOT listed").select("symbol", F.lit("no preset").alias("reason"))
        for name, preset, mine in jobs(instruments, default):
            firsts = symbols.where(mine).select("symbol", "first_complete_month")
            found = run_research(
                daily.join(firsts, "symbol"), leads["tsm"], leads["sox"], leads["fx"], replace(preset, display_name=name))
            tables.update({f"{name}/{table}": frame for table, frame in found.items()})
            lines[f"{name}/results_json"] = found["strategy_metrics"]
        run = runs.publish(tables, out_folder, lines)
    results: dict[str, dict[str, DataFrame]] = {}
    for path, table in runs.latest(spark, out_folder, run).items():
        job, _, name = path.rpartition("/")
        if job and path not in lines:
            results.setdefault(job, {})[name] = table
    return results


def jobs(instruments: Sequence[Instrument], default: Instrument | None) -> list[tuple[str, Instrument, Column]]:
    """(name, common preset, which of ``first_months``) of every group of instruments that can share a job."""
    def common(instrument: Instrument) -> Instrument:
        return replace(instrument, code="", display_name="", first_complete_month="")

    groups: dict[Instrument, list[Instrument]] = {}
    for instrument in instruments:
        groups.setdefault(common(instrument), []).append(instrument)
    shared = None if default is None else common(default)
    if shared is not None:
        groups.setdefault(shared, [])
    found = []
    for preset, members in groups.items():
        name = members[0].code if len(members) == 1 else f"{preset.primary_model}-{len(found)}"
        mine = F.col("symbol").isin([member.code for member in members])
        found.append((name, preset, mine | ~F.col("listed") if preset == shared else mine))
    return found


def first_months(daily: DataFrame, instruments: Sequence[Instrument], default: Instrument | None = None) -> DataFrame:
    """``symbol, first_complete_month, listed`` of every symbol: its preset's month, else the default's, else NULL."""
    own = settings_table(daily.sparkSession, instruments).select("symbol", F.col("first_complete_month").alias("_own"))
    month = F.coalesce("_own", F.lit(default.first_complete_month if default else None))
    return daily.select("symbol").distinct().join(own, "symbol", "left").select(
        "symbol", month.alias("first_complete_month"), F.col("_own").isNotNull().alias("listed"))


def settings_table(spark: SparkSession, instruments: Sequence[Instrument] = INSTRUMENTS) -> DataFrame:
    """Instrument presets as a table to join by symbol."""
    rows = [
        (i.code, i.first_complete_month, i.primary_model, list(i.feature_sets), i.holdout[0], i.holdout[1],
         i.deadline_first_5_rate)
        for i in instruments
    ]
    return spark.createDataFrame(
        rows, "symbol string, first_complete_month string, primary_model string, "
              "feature_sets array<string>, holdout_start string, holdout_end string, "
              "deadline_first_5_rate double")


def day1_regret(daily: DataFrame, first_complete_month: str | None = None) -> DataFrame:
    """Flagship query: how much buying on the first trading day misses, per symbol."""
    labelled = add_monthly_labels(daily, first_month=first_complete_month)
    day1 = S.select_fixed_day(labelled, 1)
    return M.strategy_metrics(day1, ("symbol",)).drop("forced_rate")
