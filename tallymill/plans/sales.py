"""From cleaned sales to the overview tables, for all sales or for one product."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymill.operators import basket, kpis, rollups


def sales_report(cleaned: DataFrame, top: int = 10, basket_items: int = 15) -> dict[str, DataFrame]:
    """Every overview table. Persist `cleaned` first if more than one of them is read."""
    return {
        "monthly": rollups.monthly_revenue(cleaned),
        "weekday": rollups.weekday_revenue(cleaned),
        "hourly": rollups.hourly_revenue(cleaned),
        "country": rollups.country_revenue(cleaned),
        "top_products": rollups.top_products(cleaned, top),
        "bottom_products": rollups.bottom_products(cleaned, top),
        "bottom_countries": rollups.bottom_countries(cleaned, top),
        "new_vs_returning": rollups.new_vs_returning(cleaned),
        "average_order_value": rollups.average_order_value(cleaned),
        "basket": basket.market_basket(cleaned, basket_items),
        "kpis": kpis.sales_kpis(cleaned),
    }


def product_report(cleaned: DataFrame, description: str) -> dict[str, DataFrame]:
    """The drill-down of one product."""
    rows = rollups.product(cleaned, description)
    return {
        "figures": rollups.product_kpis(rows),
        "monthly": rollups.monthly_revenue(rows),
        "weekday": rollups.weekday_revenue(rows),
        "country": rollups.country_revenue(rows),
        "kpis": kpis.sales_kpis(rows),
    }
