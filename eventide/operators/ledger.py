"""The experiment ledger and study manifests as append-only logs.

Every change is an entry of its own; nothing is updated. A state is the latest entry of its key, and what may follow it is checked by the same act that
adds it, so writers may be many. The logs are small: an entry for each step of an experiment.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.verdicts import check_execution, check_transition
from eventide.sources.landing import Folder
from eventide.sources.readers import canonical_digest

LOG = "exp_id long, step long, status string, family string, family_trial long, source_type string, verdict_power string, title string, digest string, payload string"

#: What a plan must hold, who may write one, and the sources that a manifest needs.
REQUIRED = ("event_def", "window", "pool", "benchmark", "cost", "holdout", "cleaning", "snapshot_batch_req")
SOURCES, POWERS, ANALYSES, SCHEMA = ("human", "platform", "literature", "llm"), ("full", "prescreen"), ("event", "strategy", "event_and_strategy"), 2
FACTS = ("stock_basic", "namechange", "trade_cal", "daily", "adj_factor", "forecast")
DERIVED = ("market_return", "pool_b1", "pool_b1_return")


def check_plan(plan: dict) -> None:
    """All parts are there, the schema is the present one, and a strategy has a valid execution."""
    missing = [k for k in REQUIRED if plan.get(k) in (None, "", {})]
    if missing:
        raise ValueError(f"the plan lacks {missing}")
    if plan.get("pap_schema_version") != SCHEMA or plan.get("analysis_type") not in ANALYSES:
        raise ValueError(f"no such schema or analysis: {plan.get('pap_schema_version')!r}, {plan.get('analysis_type')!r}")
    if "strategy" in plan["analysis_type"]:
        check_execution(plan.get("strategy_execution") or {})


class Ledger:
    """register, freeze, start, finish and close experiments of a log at `path`, by any number of writers.

    The log is a sequence of small files, each created only if it isn't there. A change is computed from all entries before it and takes the next number;
    if another writer has taken it, the change is checked and computed again after that one's entry. So ids and trials have no gaps or repeats, and of two
    steps that exclude each other one raises.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder, self.entries = spark, Folder(spark, path), []

    def log(self) -> DataFrame:
        """All changes, a row each."""
        self._catch_up()
        return self.spark.createDataFrame([tuple(e.get(c.split()[0]) for c in LOG.split(", ")) for e in self.entries], LOG)

    def state(self) -> DataFrame:
        """The latest row of each experiment; plan and result are those of its own steps."""
        rows = self.log()
        last = [F.max_by(c, "step").alias(c) for c in ("status", "step")]
        first = [F.min_by(c, "step").alias(c) for c in ("family", "family_trial", "source_type", "verdict_power", "title", "digest")]
        of = lambda status: F.max(F.when(F.col("status") == status, F.col("payload")))
        return rows.groupBy("exp_id").agg(*last, *first, of("registered").alias("plan"), of("done").alias("result"), of("closed").alias("closure_reason"))

    def _catch_up(self) -> None:
        """Read the entries that others have added."""
        while self.folder.exists(name := f"{len(self.entries) + 1:012d}.json"):
            self.entries.append(json.loads(self.folder.text(name)))

    def _append(self, change) -> dict:
        """Add what change() makes of the entries so far."""
        while True:
            self._catch_up()
            entry = change(self.entries)
            if self.folder.create(f"{len(self.entries) + 1:012d}.json", json.dumps(entry, sort_keys=True, ensure_ascii=False)):
                return entry

    def register(self, *, family: str, title: str, source_type: str, verdict_power: str, plan: dict) -> int:
        """Born registered; a model's experiment is a prescreen; the trial counts up in its family. Returns exp_id."""
        if source_type not in SOURCES or verdict_power not in POWERS:
            raise ValueError(f"no such source or power: {source_type}, {verdict_power}")
        check_transition(None, "registered", llm=source_type == "llm", power=verdict_power)
        check_plan(plan)

        def born(entries: list[dict]) -> dict:
            births = [e for e in entries if e["status"] == "registered"]
            return {
                "exp_id": len(births) + 1, "step": 0, "status": "registered", "family": family, "family_trial": sum(e["family"] == family for e in births) + 1, "source_type": source_type,
                "verdict_power": verdict_power, "title": title, "digest": canonical_digest(plan), "payload": json.dumps(plan, sort_keys=True, ensure_ascii=False),
            }

        return self._append(born)["exp_id"]

    def step(self, exp_id: int, status: str, payload: str | None = None) -> None:
        """The next step of an experiment. A result is written once, by 'done'; a reason by 'closed'; a plan can't change."""

        def stepped(entries: list[dict]) -> dict:
            own = [e for e in entries if e["exp_id"] == exp_id]
            if not own:
                raise ValueError(f"no experiment {exp_id}")
            check_transition(own[-1]["status"], status)
            if (payload is not None) != (status in ("done", "closed")):
                raise ValueError(f"{status} {'needs' if payload is None else 'takes no'} text")
            return {"exp_id": exp_id, "step": own[-1]["step"] + 1, "status": status, "payload": payload}

        self._append(stepped)

    def finish(self, exp_id: int, result: dict) -> None:
        self.step(exp_id, "done", json.dumps(result, sort_keys=True, ensure_ascii=False))


def manifest(batches: DataFrame, derived: DataFrame | None = None) -> dict:
    """The latest batch of each source (source, batch_id); with `derived`, a research manifest, else one of sources only. Missing sources raise."""
    halves = {"facts": (batches, FACTS)} | ({"derived": (derived, DERIVED)} if derived is not None else {})
    out = {}
    for half, (rows, needed) in halves.items():
        out[half] = {r["source"]: r["batch_id"] for r in rows.groupBy("source").agg(F.max("batch_id").alias("batch_id")).collect()}  # a row per source
        missing = sorted(set(needed) - set(out[half]))
        if missing:
            raise ValueError(f"no batch of {missing}")
    return out


def publish(spark: SparkSession, path: str, snapshot_id: int, content: dict) -> str:
    """The manifest's mirror, then its attestation, each created once; again with the same content it changes nothing, with other content it raises."""
    digest, folder = canonical_digest(content), Folder(spark, path)
    for half, row in (("mirror", {"digest": digest, "content": content}), ("attestation", {"digest": digest})):
        name = f"{snapshot_id}.{half}.json"
        if not folder.create(name, json.dumps(row, sort_keys=True)) and json.loads(folder.text(name))["digest"] != digest:
            raise ValueError(f"snapshot {snapshot_id} is there with other content")
    return digest


def published(spark: SparkSession, path: str, snapshot_id: int) -> dict:
    """The content of a snapshot whose mirror has an attestation of the same digest; anything else raises."""
    folder = Folder(spark, path)
    rows = [json.loads(folder.text(name)) if folder.exists(name) else {} for name in (f"{snapshot_id}.mirror.json", f"{snapshot_id}.attestation.json")]
    if not rows[1] or rows[0].get("digest") != rows[1]["digest"]:
        raise ValueError(f"snapshot {snapshot_id} isn't published")
    if canonical_digest(rows[0]["content"]) != rows[0]["digest"]:
        raise ValueError(f"snapshot {snapshot_id} doesn't match its digest")
    return rows[0]["content"]


def check_lineage(content: dict, anchors: dict[str, dict[str, int]], parents: dict[str, tuple[str, int]]) -> None:
    """Every derived batch was made from the manifest's own sources, and from the manifest's own parent batch.

    anchors: for each derived source the fact batches that it was made from. parents: (parent source, batch) of those made from another derived one.
    """
    for name, used in anchors.items():
        wrong = {k for k, v in used.items() if content["facts"].get(k) != v}
        if wrong:
            raise ValueError(f"{name} was made from other batches of {sorted(wrong)}")
    for name, (parent, batch) in parents.items():
        if content.get("derived", {}).get(parent) != batch:
            raise ValueError(f"{name} was made from another batch of {parent}")
