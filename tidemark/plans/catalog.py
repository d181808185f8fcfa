"""The governed metrics over the five operational databases."""

from __future__ import annotations

from pathlib import Path

from tidemark.plans.metrics import Metric, register


def _m(id_: str, source: str, type_: str, frm: str, dims: str, filters: str = "", **more: object) -> Metric:
    """dims: names, each its own column; filters: names with types (str where none is given); `as` maps a name to another column."""
    named = more.pop("named", {})
    expr = lambda n: named.get(n, n)
    kinds = [f.partition(":") for f in (filters or dims).split()]
    split = lambda k: tuple(str(more.pop(k, "")).split())
    return Metric(id_, source, type_, frm, dimensions={d: expr(d) for d in dims.split()}, filters={n: (expr(n), t or "str") for n, _, t in kinds}, required=split("required"), sensitive=split("sensitive"), fine_grain=split("fine"), **more)


# Identifiers, tables, expressions, filters and grains of the 25 metrics.
METRICS = register([
    _m("open_breaks", "cashrecon", "count", "breaks", "region ccy break_type legal_entity_id bank_source_id", "region ccy break_type legal_entity_id status age_days:int bank_source_id", base_filter="status <> 'closed'", time_column="opened_on", fine="bank_source_id"),
    _m("aged_open_breaks", "cashrecon", "count", "breaks", "legal_entity_id ccy region", "legal_entity_id ccy region age_days:int", base_filter="status <> 'closed' AND age_days > 5", time_column="opened_on"),
    _m("avg_break_age", "cashrecon", "avg", "breaks", "region ccy legal_entity_id", expr="age_days", base_filter="status <> 'closed'", time_column="opened_on"),
    _m("break_resolution_rate", "cashrecon", "ratio", "breaks", "region ccy break_type", numerator="status = 'closed'", time_column="opened_on"),
    _m("open_break_amount", "cashrecon", "sum", "breaks", "region ccy legal_entity_id break_type bank_source_id", expr="amount", base_filter="status <> 'closed'", time_column="opened_on", required="ccy", fine="bank_source_id"),
    _m("auto_match_rate", "cashrecon", "ratio", "match_groups", "region matched_by", "region matched_by rule_id", numerator="status = 'auto'", sensitive="matched_by"),
    _m("manual_matches", "cashrecon", "count", "match_groups", "region matched_by rule_id", "region matched_by", base_filter="status = 'manual'", sensitive="matched_by"),
    _m("position_exceptions", "assetrecon", "count", "recon_exceptions", "cause_code fund_group portfolio_id business_date security_id", "cause_code fund_group portfolio_id business_date:date security_id", time_column="business_date", fine="business_date portfolio_id security_id"),
    _m("open_position_exceptions", "assetrecon", "count", "recon_exceptions", "cause_code fund_group portfolio_id business_date security_id", "cause_code fund_group portfolio_id business_date:date security_id", base_filter="status = 'open'", time_column="business_date", fine="business_date portfolio_id security_id"),
    _m("exception_mv_abs", "assetrecon", "sum", "recon_exceptions", "cause_code fund_group portfolio_id", expr="abs(diff_mv)", time_column="business_date"),
    _m("recon_unmatched_items", "assetrecon", "sum", "recon_runs", "recon_type fund_group portfolio_id business_date", "recon_type fund_group portfolio_id business_date:date", expr="unmatched", time_column="business_date", fine="portfolio_id business_date"),
    _m("clean_recon_run_rate", "assetrecon", "ratio", "recon_runs", "recon_type fund_group business_date", "recon_type fund_group", numerator="unmatched = 0", time_column="business_date"),
    _m("nav_breaches_above_5bps", "assetrecon", "count", "nav_checks", "portfolio_id fund_group nav_date", "portfolio_id fund_group", base_filter="abs(diff_bps) > 5", time_column="nav_date", fine="portfolio_id nav_date"),
    _m("nav_break_bps_max", "assetrecon", "max", "nav_checks", "portfolio_id nav_date", "portfolio_id fund_group nav_date:date", expr="abs(diff_bps)", time_column="nav_date", fine="portfolio_id nav_date"),
    _m("funds", "assetrecon", "count", "portfolios", "portfolio_id fund_group fund_entity_id custodian_source_id", fine="portfolio_id fund_entity_id custodian_source_id"),
    _m("late_feeds", "feedhub", "count", "feed_deliveries", "source_id business_date status source_type feed_type", "source_id status source_type business_date:date feed_type", base_filter="status <> 'on_time'", time_column="business_date", fine="source_id business_date"),
    _m("missing_or_failed_deliveries", "feedhub", "count", "feed_deliveries", "source_id source_type status business_date feed_type", "source_id source_type status feed_type", base_filter="status IN ('missing', 'failed')", time_column="business_date", fine="source_id business_date"),
    _m("feed_on_time_rate", "feedhub", "ratio", "feed_deliveries", "source_id source_type business_date", "source_id source_type", numerator="status = 'on_time'", time_column="business_date", fine="source_id business_date"),
    _m("avg_feed_latency_min", "feedhub", "avg", "feed_deliveries", "source_id source_type business_date", "source_id source_type", expr="latency_min", base_filter="status = 'late'", time_column="business_date", fine="source_id business_date"),
    _m("open_support_tickets", "feedhub", "count", "support_tickets", "category source_id source_type", base_filter="status = 'open'"),
    _m("price_conflicts", "marketmaster", "count", "price_suspects", "vendor_id asset_class price_date status", "vendor_id asset_class price_date:date status", base_filter="kind = 'conflict'", time_column="price_date", fine="vendor_id price_date"),
    _m("price_suspects", "marketmaster", "count", "price_suspects", "security_id kind vendor_id price_date status", "security_id kind vendor_id price_date:date status", time_column="price_date", fine="security_id vendor_id price_date"),
    _m("open_dq_exceptions", "refmaster", "count", "exceptions", "domain asset_class status rule_id record_ref", base_filter="status <> 'closed'", fine="record_ref"),
    _m("dq_exceptions_total", "refmaster", "count", "exceptions", "domain asset_class status rule_id record_ref", fine="record_ref"),
    _m("pending_corporate_actions", "refmaster", "count", "corporate_actions", "security_id issuer_entity_id action_type effective_date", "security_id issuer_entity_id action_type effective_date:date", base_filter="status = 'pending'", time_column="ex_date", named={"action_type": "event_type", "effective_date": "ex_date"}, fine="security_id issuer_entity_id effective_date"),
])


def load_metrics(folder: str) -> dict[str, Metric]:
    """Definitions from YAML files, one or a list each; unknown keys and repeated ids are refused."""
    import yaml

    known = {f for f in Metric.__dataclass_fields__} - {"filters"}
    made = []
    for path in sorted(Path(folder).glob("*.y*ml")):
        found = yaml.safe_load(path.read_text())
        for d in found if isinstance(found, list) else [found]:
            if extra := {*d} - known - {"filters", "from"}:
                raise ValueError(f"{path.name}: unknown keys {sorted(extra)}")
            d = dict(d)
            d["frm"] = d.pop("from", d.get("frm", ""))
            filters = {n: (f["expr"], f.get("type", "str")) for n, f in d.pop("filters", {}).items()}
            lists = {k: tuple(d.pop(k)) for k in ("required", "sensitive", "fine_grain") if k in d}
            joins = tuple((j["table"], j["on"]) for j in d.pop("joins", []))
            made.append(Metric(**d, **lists, filters=filters, joins=joins))
    return register(made)
