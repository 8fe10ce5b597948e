"""The stages of the pipeline over the stand-in market, as lazy tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import adjust as A, assemble, selection as S
from tidemark.operators.features import build_features
from tidemark.operators.filters import out_of_sample
from tidemark.operators.labels import add_monthly_labels, monthly_oracle
from tidemark.operators.leads import attach_leads
from tidemark.operators.metrics import terminal_close
from tidemark.session import written
from tidemark.sources import parsers
from tidemark.sources.standin import FIRST_MONTH, INITIAL_MONTHS, Market


class Stages(Market):
    @cached_property
    def institutions(self) -> DataFrame:
        return written(parsers.parse_institutions(self.institutions_raw), "institutions")

    @cached_property
    def quotes(self) -> DataFrame:
        return written(super().quotes, "quotes")  # the leads are read many times over

    @cached_property
    def adjusted(self) -> DataFrame:
        m = self.landed  # one scan of the facts for all three
        return A.build_adjusted_prices(m.prices, m.dividends, m.splits)

    @cached_property
    def daily(self) -> DataFrame:
        m = self.landed
        return assemble.assemble_daily(
            m.prices, m.dividends, m.splits, m.nav, m.margin, self.institutions, m.official)

    @cached_property
    def us_daily(self) -> DataFrame:
        return assemble.assemble_us_daily(self.us_ohlc)

    @cached_property
    def features(self) -> DataFrame:
        return build_features(self.daily)

    @cached_property
    def labelled(self) -> DataFrame:
        """Labels without features: what most label queries need."""
        return add_monthly_labels(self.adjusted, first_month=FIRST_MONTH)

    @cached_property
    def labelled_features(self) -> DataFrame:
        return add_monthly_labels(self.features, first_month=FIRST_MONTH)

    @cached_property
    def oracle(self) -> DataFrame:
        return monthly_oracle(self.labelled)

    @cached_property
    def led(self) -> DataFrame:
        return attach_leads(self.labelled, self.tsm, self.sox, self.fx, self.landed.days)

    @cached_property
    def led_features(self) -> DataFrame:
        return attach_leads(self.labelled_features, self.tsm, self.sox, self.fx, self.landed.days)

    @cached_property
    def oos(self) -> DataFrame:
        return out_of_sample(self.labelled, INITIAL_MONTHS)

    @cached_property
    def oos_led(self) -> DataFrame:
        return out_of_sample(self.led, INITIAL_MONTHS)

    @cached_property
    def oos_features(self) -> DataFrame:
        return out_of_sample(self.labelled_features, INITIAL_MONTHS)

    @cached_property
    def predictions(self) -> DataFrame:
        """Synthetic scores for out-of-sample rows, for operators that follow the models."""
        day = F.unix_date("date")
        return self.oos.withColumns({
            "near_probability": day * 37 % 100 / F.lit(100.0),
            "reservation_adjusted": F.coalesce("previous_adjusted_close", "adjusted_open") * 0.99,
        })

    @cached_property
    def baseline(self) -> DataFrame:
        return S.baselines(self.oos_features)

    @cached_property
    def day1(self) -> DataFrame:
        return S.select_by_rules(self.oos, [S.fixed_day(1)])

    @cached_property
    def lead_bought(self) -> DataFrame:
        return S.lead_purchases(self.oos_led)

    @cached_property
    def policy_bought(self) -> DataFrame:
        return S.policy_purchases(self.predictions)

    @cached_property
    def terminal(self) -> DataFrame:
        return terminal_close(self.adjusted)
