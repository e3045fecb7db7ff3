"""Fundamental features of statements: 47 levels, ratios and growth rates for a model of returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import panel
from ..functions import scalars as f

#: Items of a statement that the features are made of.
ITEMS = ("revenue", "gross_profit", "operating_income", "pretax_income", "net_income", "recurring_income", "comprehensive_income", "ebitda", "depreciation", "operating_cash_flow", "capex", "interest_expense", "tax", "non_operating_income",
         "operating_expense", "selling_expense", "administrative_expense", "research_expense", "assets", "current_assets", "inventory", "receivables", "liabilities", "current_liabilities", "equity", "shares")

#: The features in the order of the modelling set. A level is an item; a ratio is one item over another, a
#: percentage where it is marked; a growth rate is the percent change of an item from the quarter before.
LEVELS = {"ebitda": "ebitda", "operating_cash_flow": "operating_cash_flow", "net_income": "net_income", "depreciation": "depreciation", "current_assets": "current_assets", "current_liabilities": "current_liabilities", "capex": "capex", "recurring_income": "recurring_income"}
PERCENT = {
    "roa_before_interest": ("pretax_income + interest_expense", "assets"), "roa_comprehensive": ("comprehensive_income", "assets"), "roe": ("net_income", "equity"), "roe_comprehensive": ("comprehensive_income", "equity"),
    "ebitda_margin": ("ebitda", "revenue"), "gross_margin": ("gross_profit", "revenue"), "operating_margin": ("operating_income", "revenue"), "pretax_margin": ("pretax_income", "revenue"), "net_margin": ("net_income", "revenue"),
    "non_operating_share": ("non_operating_income", "revenue"), "berry_ratio": ("gross_profit", "operating_expense"), "operating_expense_share": ("operating_expense", "revenue"), "selling_share": ("selling_expense", "revenue"),
    "administrative_share": ("administrative_expense", "revenue"), "research_share": ("research_expense", "revenue"), "cash_flow_ratio": ("operating_cash_flow", "current_liabilities"), "tax_rate": ("tax", "pretax_income"),
    "debt_to_equity": ("liabilities", "equity"), "debt_ratio": ("liabilities", "assets"), "equity_ratio": ("equity", "assets"), "current_ratio": ("current_assets", "current_liabilities"), "quick_ratio": ("current_assets - inventory", "current_liabilities"),
    "interest_share": ("interest_expense", "revenue"),
}
PER_SHARE = {"revenue_per_share": "revenue", "operating_income_per_share": "operating_income", "cash_flow_per_share": "operating_cash_flow", "pretax_per_share": "pretax_income", "comprehensive_per_share": "comprehensive_income", "eps": "net_income"}
GROWTH = {"revenue_growth": "revenue", "gross_profit_growth": "gross_profit", "operating_income_growth": "operating_income", "pretax_growth": "pretax_income", "net_income_growth": "net_income", "asset_growth": "assets", "equity_growth": "equity"}
TURNOVER = {"asset_turnover": ("revenue", "assets"), "receivable_turnover": ("revenue", "receivables")}
WORKING_CAPITAL = "working_capital"
FEATURES = (*LEVELS, *PERCENT, *PER_SHARE, *GROWTH, WORKING_CAPITAL, *TURNOVER)


def features(statements: DataFrame) -> DataFrame:
    """(symbol, quarter, d, ``FEATURES``) from (symbol, quarter, d, ``ITEMS``); a division by 0 or infinity gives null."""
    over = lambda a, b, k=1: f.finite(k * F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double")))
    return statements.select(
        "symbol", "quarter", "d", *(F.col(x).cast("double").alias(n) for n, x in LEVELS.items()), *(over(a, b, 100).alias(n) for n, (a, b) in PERCENT.items()), *(over(x, "shares").alias(n) for n, x in PER_SHARE.items()),
        *((100 * panel.pct_change(F.col(x))).alias(n) for n, x in GROWTH.items()), (F.col("current_assets") - F.col("current_liabilities")).alias(WORKING_CAPITAL), *(over(a, b).alias(n) for n, (a, b) in TURNOVER.items()),
    )
