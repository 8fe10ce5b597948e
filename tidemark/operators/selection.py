"""One purchase per symbol and month.

Every rule is the same operator: the first day that meets a condition, else a deadline
day. The target days of all rules come from one pass of integer window aggregates over
the month; each row then keeps the rules whose target it is. No rule needs a loop, a
sort of its own or a second scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.config import (
    FIXED_DAYS, LEAD_DEADLINE, LEAD_RULES, POLICIES, RSI_THRESHOLD, Policy, check_deadline,
)
from tidemark.functions.scalars import holds
from tidemark.operators.quality import DataQualityError

DAY = "trading_day"


@dataclass(frozen=True)
class Rule:
    """Buy on the first day meeting ``condition``, else on the deadline day.

    Without a condition the deadline day is bought outright. ``reports_forced`` says
    whether the result tells bought-at-deadline apart. With ``first_row_stands_in`` the
    month's first row is the search window when no row lies within the deadline.
    """

    strategy: str
    condition: Column | None = None
    deadline: int | None = None
    reports_forced: bool = True
    first_row_stands_in: bool = False

    def __post_init__(self) -> None:
        check_deadline(self.deadline)

    def window_end(self, month: WindowSpec) -> Column:
        day = F.col(DAY)
        if self.deadline is None:
            return F.max(day).over(month)
        end = F.max(F.when(day <= self.deadline, day)).over(month)
        return F.coalesce(end, F.min(day).over(month)) if self.first_row_stands_in else end

    def hit(self, month: WindowSpec) -> Column:
        """First day in the search window that meets the condition, NULL without one."""
        day = F.col(DAY)
        if self.condition is None:
            return F.lit(None).cast("int")
        met = holds(self.condition)
        if self.deadline is None:
            return F.min(F.when(met, day)).over(month)
        inside = F.min(F.when(met & (day <= self.deadline), day)).over(month)
        if not self.first_row_stands_in:
            return inside
        first = F.min(day).over(month)
        late = (first > self.deadline) & F.min_by(met, day).over(month)
        return F.coalesce(inside, F.when(late, first))


def select_by_rules(
    frame: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ("symbol", "month")
) -> DataFrame:
    """Rows bought by each rule, with ``strategy`` and ``forced`` columns added."""
    month = Window.partitionBy(*by)
    df = frame.withColumns({
        name: column
        for number, rule in enumerate(rules)
        for name, column in ((f"_hit{number}", rule.hit(month)), (f"_end{number}", rule.window_end(month)))
    })
    choices = [
        F.when(
            F.col(DAY) == F.coalesce(f"_hit{n}", f"_end{n}"),
            F.struct(
                F.lit(rule.strategy).alias("strategy"),
                (F.col(f"_hit{n}").isNull() if rule.reports_forced else F.lit(None).cast("boolean"))
                .alias("forced"),
            ),
        )
        for n, rule in enumerate(rules)
    ]
    chosen = df.withColumn("_bought", F.explode(F.array_compact(F.array(*choices))))
    return chosen.select(*frame.columns, "_bought.strategy", "_bought.forced")


def fixed_day(day: int) -> Rule:
    """The N-th trading day, or the month's last when it has fewer."""
    return Rule(f"fixed_day_{day}", None, day, reports_forced=False)


def last_day() -> Rule:
    return Rule("last_day", None, None, reports_forced=False)


def rsi_rule(threshold: float = RSI_THRESHOLD) -> Rule:
    return Rule(f"rsi{threshold:g}_or_last", F.col("rsi_14") < threshold, None, reports_forced=False)


def signal_rule(strategy: str, column: str, deadline: int = LEAD_DEADLINE) -> Rule:
    return Rule(strategy, F.col(column), deadline, first_row_stands_in=True)


def policy_rule(policy: Policy) -> Rule:
    condition = F.lit(True)
    if policy.min_probability is not None:
        condition = condition & (F.col("near_probability") >= F.lit(float(policy.min_probability)))
    if policy.use_reservation:
        condition = condition & (F.col("adjusted_open") <= F.col("reservation_adjusted"))
    return Rule(policy.name, condition, policy.deadline)


def baseline_rules() -> list[Rule]:
    return [*map(fixed_day, FIXED_DAYS), last_day(), rsi_rule()]


def lead_rules() -> list[Rule]:
    return [signal_rule(name, column) for name, column in LEAD_RULES.items()]


def policy_rules(policies: Sequence[Policy] = POLICIES) -> list[Rule]:
    return [policy_rule(policy) for policy in policies]


def select_fixed_day(frame: DataFrame, day: int) -> DataFrame:
    """Direct filter form: no window is needed when ``days_in_month`` is known."""
    check_deadline(day)
    return frame.where(F.col(DAY) == F.least(F.col("days_in_month"), F.lit(day)))


def select_last_day(frame: DataFrame) -> DataFrame:
    return frame.where(F.col(DAY) == F.col("days_in_month"))


def select_rsi_rule(frame: DataFrame, threshold: float = RSI_THRESHOLD) -> DataFrame:
    _need(frame, "rsi_14")
    return select_by_rules(frame, [rsi_rule(threshold)]).drop("forced", "strategy")


def select_first_true_or_deadline(frame: DataFrame, column: str, deadline: int = LEAD_DEADLINE) -> DataFrame:
    _need(frame, column)
    return select_by_rules(frame, [signal_rule(column, column, deadline)]).drop("strategy")


def select_monthly_purchases(predictions: DataFrame, policy: Policy = POLICIES[0]) -> DataFrame:
    _need(predictions, "near_probability", "reservation_adjusted", "adjusted_open")
    return select_by_rules(predictions, [policy_rule(policy)]).drop("strategy")


def baselines(out_of_sample: DataFrame) -> DataFrame:
    return select_by_rules(out_of_sample, baseline_rules())


def lead_purchases(out_of_sample: DataFrame) -> DataFrame:
    return select_by_rules(out_of_sample, lead_rules())


def policy_purchases(predictions: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    return select_by_rules(predictions, policy_rules(policies))


def _need(frame: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns).difference(frame.columns))
    if missing:
        raise DataQualityError(f"selection lacks columns {missing}")
