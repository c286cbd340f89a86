"""Trial ledger: every trial is registered before its result, and a result is written once.

The ledger is an append-only table of events; its state is the last event per
trial. One driver writes; readers see whole appends only.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.statistics import deflated_sharpe
from ..sources.store import exists

SCHEMA = "uuid string, seq long, at string, scope string, strategy_id string, hypothesis string, rationale string, params_json string, fingerprint string, status string, sharpe double, n_obs long, skew double, kurt double, returns_hash string, extra_json string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
LEAST_TEXT = 8


def fingerprint(scope: str, strategy_id: str, params: dict | None) -> str:
    return hashlib.sha1("|".join([scope, strategy_id, json.dumps(params or {}, sort_keys=True, default=str)]).encode()).hexdigest()


class TrialLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], SCHEMA)

    def state(self) -> DataFrame:
        w = Window.partitionBy("uuid").orderBy(F.desc("seq"), F.desc("at"))
        return self.events().withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    def _append(self, rows: list[dict]) -> None:
        at = dt.datetime.now(dt.timezone.utc).isoformat()
        self.spark.createDataFrame([tuple({**r, "at": at}.get(n) for n in NAMES) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def _one(self, trial: str) -> dict:
        row = self.state().where(F.col("uuid") == trial).first()
        if row is None:
            raise KeyError(f"no such trial: {trial}")
        return row.asDict()

    def preregister(self, scope: str, hypothesis: str, rationale: str, strategy_id: str | None = None, params: dict | None = None) -> str:
        if min(len(hypothesis.strip()), len(rationale.strip())) < LEAST_TEXT:
            raise ValueError(f"hypothesis and rationale need {LEAST_TEXT} characters")
        trial = str(uuid.uuid4())
        self._append([{"uuid": trial, "seq": 0, "scope": scope, "strategy_id": strategy_id, "hypothesis": hypothesis, "rationale": rationale, "params_json": json.dumps(params or {}, sort_keys=True, default=str), "status": "preregistered"}])
        return trial

    def record_result(self, trial: str, sharpe: float, n_obs: int, skew: float, kurt: float, returns_hash: str | None = None, extra: dict | None = None) -> None:
        row = self._one(trial)
        if row["status"] != "preregistered":
            raise ValueError("the trial has its result already")
        self._append([{**row, "seq": row["seq"] + 1, "status": "completed", "sharpe": sharpe, "n_obs": n_obs, "skew": skew, "kurt": kurt, "returns_hash": returns_hash, "extra_json": json.dumps(extra or {}, sort_keys=True)}])

    def log_trial(self, scope: str, strategy_id: str, params: dict | None, sharpe: float, n_obs: int, skew: float, kurt: float, hypothesis: str, rationale: str) -> str:
        """Same scope, strategy and parameters: same trial, with the latest result."""
        return self.log_trials([{"scope": scope, "strategy_id": strategy_id, "params": params, "sharpe": sharpe, "n_obs": n_obs, "skew": skew, "kurt": kurt, "hypothesis": hypothesis, "rationale": rationale}])[0]

    def log_trials(self, trials: list[dict]) -> list[str]:
        prints = [fingerprint(t["scope"], t["strategy_id"], t["params"]) for t in trials]
        had = {r["fingerprint"]: r for r in self.state().where(F.col("fingerprint").isin(prints)).collect()}  # as many as are logged
        rows = []
        for t, f in zip(trials, prints):
            old = had.get(f)
            rows.append({**{k: v for k, v in t.items() if k != "params"}, "uuid": old["uuid"] if old else str(uuid.uuid4()), "seq": old["seq"] + 1 if old else 0, "params_json": json.dumps(t["params"] or {}, sort_keys=True, default=str), "fingerprint": f, "status": "completed"})
        self._append(rows)
        return [r["uuid"] for r in rows]

    def log_scan_trials(self, scope: str, count: int, hypothesis: str, rationale: str) -> int:
        """Stands in for ``count`` trials of a scan whose results were not kept; repeated calls add only what is missing."""
        prints = [fingerprint(scope, f"scan-{i}", None) for i in range(count)]
        had = {r["fingerprint"] for r in self.state().where((F.col("scope") == scope) & F.col("fingerprint").isNotNull()).select("fingerprint").collect()}
        new = [{"uuid": str(uuid.uuid4()), "seq": 0, "scope": scope, "strategy_id": f"scan-{i}", "hypothesis": hypothesis, "rationale": rationale, "params_json": "{}", "fingerprint": f, "status": "completed"} for i, f in enumerate(prints) if f not in had]
        if new:
            self._append(new)
        return len(new)

    def trial_count(self, scope: str) -> int:
        return self.state().where((F.col("scope") == scope) & (F.col("status") == "completed")).count()

    def sharpe_variance(self, scope: str) -> float:
        return self.state().where(F.col("scope") == scope).agg(F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("v")).first()["v"]

    def scopes(self) -> DataFrame:
        return self.state().groupBy("scope").agg(F.count_if(F.col("status") == "completed").alias("n")).orderBy("scope")

    def deflated_sharpe(self, trial: str) -> float:
        r = self._one(trial)
        if r["status"] != "completed" or r["sharpe"] is None:
            raise ValueError("the trial has no result")
        return deflated_sharpe(r["sharpe"], self.sharpe_variance(r["scope"]), self.trial_count(r["scope"]), r["n_obs"], r["skew"], r["kurt"])
