"""From a grid of strategies to a verdict: replay, ledger, deflation, overfitting, report."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import unbiased_kurtosis, unbiased_skew
from ..operators.backtest import backtest
from ..operators.statistics import deflated_sharpe, max_drawdown, min_backtest_length, pbo, robustness_score, sharpe, subperiod_sharpes
from ..operators.strategies import Strategy
from .trials import TrialLedger


@dataclass
class Verdict:
    scope: str
    passed: bool
    best: str | None
    n_trials: int
    pbo: float | None
    min_btl_years: float
    rows: list[dict] = field(default_factory=list)
    markdown: str = ""


def replay_grid(strategies: Sequence[Strategy], panel: DataFrame, **frictions) -> DataFrame:
    """All strategies in one relation, so that they share every shuffle of the replay."""
    tagged = [s.tagged(panel) for s in strategies]
    weights = tagged[0]
    for t in tagged[1:]:
        weights = weights.unionByName(t)
    return backtest(weights, panel, **frictions)


def summary(results: DataFrame) -> DataFrame:
    """(strategy, n_obs, sr, skew, kurt, ann, turnover, hit, maxdd, worst_sub, positive_subs, robustness); one row per strategy."""
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    g = results.groupBy("strategy").agg(
        F.count("net").alias("n_obs"),
        sharpe("net").alias("sr"),
        unbiased_skew("net").alias("skew"),
        unbiased_kurtosis("net").alias("kurt"),
        F.coalesce(F.try_divide(F.count("net"), years), F.lit(252.0)).alias("ann"),
        F.avg("turnover").alias("turnover"),
        F.avg(F.when(F.col("n_names") > 0, (F.col("net") > 0).cast("double"))).alias("hit"),
        F.min("capacity").alias("capacity"),
    )
    subs = subperiod_sharpes(results, ["strategy"], 3, 1.0, "net").groupBy("strategy").agg(F.min("sharpe").alias("_w"), F.avg((F.col("sharpe") > 0).cast("double")).alias("positive_subs"))
    d = g.join(max_drawdown(results, ["strategy"], "net"), "strategy").join(subs, "strategy")
    d = d.withColumn("worst_sub", F.col("_w") * F.sqrt("ann"))
    return d.withColumn("robustness", robustness_score(F.col("worst_sub"), F.col("positive_subs"), F.col("maxdd"), F.col("turnover"))).drop("_w")


def judge_grid(strategies: Sequence[Strategy], panel: DataFrame, scope: str, hypothesis: str, rationale: str, ledger: TrialLedger, dsr_threshold: float = 0.95, extra_trials: int = 0, **frictions) -> Verdict:
    """Registers every strategy as a trial; passes if the best one's deflated Sharpe ratio reaches the threshold.

    Strategies without spread have no Sharpe ratio; they stay in the report and out of the ledger.
    """
    results = replay_grid(strategies, panel, **frictions).checkpoint() if panel.sparkSession.conf.get("spark.checkpoint.dir", None) else replay_grid(strategies, panel, **frictions)
    rows = [r.asDict() for r in summary(results).orderBy("strategy").collect()]  # one per strategy
    judged = [r for r in rows if r["sr"] is not None]
    if judged:
        ledger.log_trials([{"scope": scope, "strategy_id": r["strategy"], "params": {k: str(v) for k, v in frictions.items() if isinstance(v, (int, float))}, "sharpe": r["sr"], "n_obs": r["n_obs"], "skew": r["skew"], "kurt": r["kurt"], "hypothesis": hypothesis, "rationale": rationale} for r in judged])
    n, var = ledger.trial_count(scope) + extra_trials, ledger.sharpe_variance(scope)
    for r in judged:
        r["dsr"] = deflated_sharpe(r["sr"], var, n, r["n_obs"], r["skew"] or 0.0, r["kurt"] or 3.0)
    best = max(judged, key=lambda r: (r["sr"], r["strategy"]), default=None)
    over = pbo(results.select("strategy", "date", F.col("net").alias("ret"))).first()["pbo"] if len(judged) > 1 else None
    passed = bool(best and best["dsr"] >= dsr_threshold)
    verdict = Verdict(scope, passed, best["strategy"] if best else None, n, over, min_backtest_length(max(n, 2)), rows)
    verdict.markdown = render(verdict, hypothesis, dsr_threshold)
    return verdict


def money(x: float | None) -> str:
    if x is None or math.isnan(x) or math.isinf(x):
        return "n/a"
    for size, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M")):
        if abs(x) >= size:
            return f"{x / size:.1f}{unit}"
    return f"{x:,.0f}"


def _n(x, digits: int = 2) -> str:
    return "n/a" if x is None else f"{x:+.{digits}f}"


def render(v: Verdict, hypothesis: str, threshold: float) -> str:
    head = f"# {v.scope}: {'PASS' if v.passed else 'FAIL'}\n\n{hypothesis}\n\n- trials: {v.n_trials}\n- best: {v.best}\n- threshold of the deflated Sharpe ratio: {threshold}\n- probability of overfitting: {_n(v.pbo)}\n- shortest honest backtest: {v.min_btl_years:.1f} years\n\n"
    table = "| strategy | n | Sharpe a year | DSR | max drawdown | turnover | hit | robustness | capacity |\n|---|--:|--:|--:|--:|--:|--:|--:|--:|\n"
    for r in v.rows:
        ann = r["sr"] * math.sqrt(r["ann"]) if r["sr"] is not None else None
        table += f"| {r['strategy']} | {r['n_obs']} | {_n(ann)} | {_n(r.get('dsr'))} | {_n(r['maxdd'])} | {_n(r['turnover'])} | {_n(r['hit'])} | {_n(r['robustness'])} | {money(r['capacity'])} |\n"
    return head + table


def sparkline(values: Sequence[float], columns: int = 80) -> str:
    """An SVG area in a box of its own units: the means of ``columns`` stretches of the values, from the least mean up."""
    n = min(columns, len(values))
    stretches = [values[i * len(values) // n : (i + 1) * len(values) // n] for i in range(n)]
    means = [math.fsum(x) / len(x) for x in stretches]
    floor = min(means, default=0.0)
    scale = max(means, default=0.0) - floor
    steps = "".join(f"V{1 - (m - floor) / scale if scale else 1:.3f}h1" for m in means)
    return f'<svg style="width:16em;height:3em" preserveAspectRatio="none" viewBox="0 0 {max(n, 1)} 1"><path d="M0 1{steps}V1Z"/></svg>'


def to_html(v: Verdict, curves: dict[str, Sequence[float]] | None = None) -> str:
    rows = "".join(f"<tr><td>{html.escape(r['strategy'])}</td><td>{_n(r['sr'], 3)}</td><td>{_n(r.get('dsr'))}</td><td>{_n(r['maxdd'])}</td><td>{sparkline((curves or {}).get(r['strategy'], []))}</td></tr>" for r in v.rows)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(v.scope)}</title><h1>{html.escape(v.scope)}: {'PASS' if v.passed else 'FAIL'}</h1><table><tr><th>strategy</th><th>Sharpe</th><th>DSR</th><th>drawdown</th><th>equity</th></tr>{rows}</table>"


def write_html(v: Verdict, path: str, curves: dict[str, Sequence[float]] | None = None) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_html(v, curves))


def month_rows(results: DataFrame) -> DataFrame:
    """(strategy, month, ret): compounded by month."""
    return results.groupBy("strategy", F.trunc("date", "MM").alias("month")).agg((F.product(1 + F.col("net")) - 1).alias("ret"))




def index_page(scopes: Sequence[tuple[str, int, float]], reports: Sequence[str]) -> str:
    """HTML list of scopes (name, trials, variance of Sharpe ratios), linked where there is a report of that name."""
    line = lambda name: f"<a href='{html.escape(name)}.html'>{html.escape(name)}</a>" if name in reports else html.escape(name)
    body = "".join(f"<tr><td>{line(n)}</td><td>{k}</td><td>{v:.4f}</td></tr>" for n, k, v in scopes)
    return f"<!doctype html><meta charset='utf-8'><title>Trials</title><h1>{len(scopes)} scopes, {sum(k for _, k, _ in scopes)} trials</h1><table><tr><th>scope</th><th>trials</th><th>variance</th></tr>{body}</table>"


def dashboard(status: dict, months: DataFrame, daily: DataFrame, orders: DataFrame) -> dict:
    """What a status page shows, safe for JSON: all months and days, and the newest month's orders (month, ...)."""
    rows = lambda df, *by: [json.loads(r) for (r,) in df.orderBy(*by).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    listed = rows(months, "month")
    latest = listed[-1]["month"] if listed else None
    return {"status": status, "months": listed, "daily": rows(daily, "date"), "orders": rows(orders.where(F.col("month") == latest), "code") if listed else [], "latest": latest}
