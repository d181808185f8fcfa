"""Claims, row scopes and column masks, as DataFrame filters put before any caller's logic."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.guard import session_view

# Row dimension of each table (its column has the same name), None for access by dataset alone.
ROW_SCOPES: dict[str, dict[str, str | None]] = {
    "refmaster": {"legal_entities": None, "securities": "asset_class", "products": None, "accounts": None, "corporate_actions": None, "dq_rules": None, "exceptions": "asset_class", "change_requests": None, "data_dictionary": None},
    "marketmaster": {"vendors": None, "instruments": "asset_class", "golden_prices": "asset_class", "vendor_prices": "asset_class", "price_suspects": "asset_class", "dq_stage_metrics": None, "esg_scores": None},
    "cashrecon": {"cash_accounts": "region", "statements": "region", "statement_entries": "region", "ledger_entries": "region", "match_rules": None, "match_groups": "region", "match_items": "region", "breaks": "region", "break_actions": "region"},
    "assetrecon": {"custodians": None, "portfolios": "fund_group", "internal_positions": "fund_group", "custodian_positions": "fund_group", "internal_transactions": "fund_group", "custodian_transactions": "fund_group", "recon_runs": "fund_group", "recon_exceptions": "fund_group", "nav_checks": "fund_group"},
    "feedhub": {"sources": "source_type", "feeds": "source_type", "feed_deliveries": "source_type", "support_tickets": "source_type"},
}
MASKED = {("cashrecon", "cash_accounts"): {"nostro_no": 4}}  # column: characters left visible without pii:read
PII = "pii:read"


@dataclass(frozen=True)
class Claims:
    """Who asks, and for what. A missing row dimension grants no rows; metrics_only defaults to the restricted side."""

    sub: str
    scopes: frozenset[str] = frozenset()
    rows: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    metrics_only: bool = True

    def can(self, source: str, table: str) -> bool:
        return source in self.scopes or f"{source}.{table}" in self.scopes

    def allowed(self, dimension: str) -> tuple[str, ...]:
        return tuple(self.rows.get(dimension, ()))


# The five personas.
EVERY = ("refmaster", "marketmaster", "cashrecon", "assetrecon", "feedhub")
ALL_ROWS = {"asset_class": ("*",), "region": ("*",), "fund_group": ("*",), "source_type": ("*",)}
PERSONAS = {
    "steward": Claims("steward", frozenset({"refmaster", "marketmaster"}), {"asset_class": ("*",)}, False),
    "cash_ops_emea": Claims("cash_ops_emea", frozenset({"cashrecon", "feedhub"}), {"region": ("EMEA",), "source_type": ("bank",)}, False),
    "invest_ops_growth": Claims("invest_ops_growth", frozenset({"assetrecon", "feedhub", "refmaster.securities", "refmaster.legal_entities"}), {"fund_group": ("Growth",), "source_type": ("custodian",), "asset_class": ("*",)}, False),
    "bi_analyst": Claims("bi_analyst", frozenset(EVERY), ALL_ROWS, True),
    "head_data": Claims("head_data", frozenset({*EVERY, PII}), ALL_ROWS, False),
}


def row_filter(claims: Claims, source: str, table: str, dimension: str | None, column: Column | None = None) -> Column:
    """Literals of the caller's claims: Catalyst folds them, and the filter goes down to the scan."""
    if not claims.can(source, table):
        return F.lit(False)
    if dimension is None:
        return F.lit(True)
    allowed = claims.allowed(dimension)
    return F.lit(True) if "*" in allowed else (F.col(dimension) if column is None else column).isin(*allowed) if allowed else F.lit(False)


def masked(column: str, visible: int, shown: bool) -> Column:
    return F.when(F.lit(shown), F.col(column)).otherwise(F.concat(F.lit("****"), F.right(F.col(column), F.lit(visible)))).alias(column)


def secure(df: DataFrame, claims: Claims, source: str, table: str, dimension: str | None = None, mask: Mapping[str, int] | None = None) -> DataFrame:
    """A table as this caller sees it."""
    scoped = df.filter(row_filter(claims, source, table, dimension))
    hidden = mask or {}
    return scoped.select(*(masked(c, hidden[c], PII in claims.scopes) if c in hidden else F.col(c) for c in df.columns)) if hidden else scoped


def secured_views(spark: SparkSession, claims: Claims, source: str, read: Callable[[str], DataFrame | None]) -> SparkSession:
    """A new session that holds this caller's secured views of one source and nothing else."""
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for table, dimension in ROW_SCOPES[source].items():
        if claims.can(source, table) and (df := read(table)) is not None:
            session_view(session, table, secure(df, claims, source, table, dimension, MASKED.get((source, table))))
    return session
