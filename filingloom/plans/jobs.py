"""End-to-end jobs in stages that survive a stop: extract, build a dataset, evaluate, compare.

A run is a folder named by its id. Each stage writes its table below an attempt of its own
and then commits: a small record, put in place by a rename, names the attempt that counts.
A run that is started again reads what is committed and goes on with the first stage that
is not, so nothing is computed twice and a half-written attempt is never read. Starting a
finished run again changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.operators import compare, scoring
from filingloom.plans import builds


class StagedRun:
    """The stages of one run of a job.

    ``root`` is a folder that driver and executors share, ``run_id`` names the run in it.
    ``params`` is what the results depend on besides their inputs: an id that was used with
    other parameters is refused.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str, **params):
        if not run_id or "/" in run_id:
            raise ValueError("a run id is the name of a folder")
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{run_id}"
        self.params = json.dumps(params, sort_keys=True, default=str)
        self.computed: list[str] = []

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_record(self, name: str) -> dict | None:
        path = f"{self.folder}/_commits/{name}.json"
        if not self._store().exists(self._path(f"_commits/{name}.json")):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(path).collect()))

    def _commit(self, name: str, record: dict) -> None:
        store = self._store()
        draft, final = self._path(f"_drafts/{name}-{uuid.uuid4().hex}"), self._path(f"_commits/{name}.json")
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(record), "utf-8"))
        out.close()
        store.mkdirs(self._path("_commits"))
        # where another attempt was faster its record stays, and is read below
        if not store.exists(final):
            store.rename(draft, final)

    def committed(self, name: str) -> bool:
        return self._read_record(name) is not None

    def stage(self, name: str, build: Callable[[], DataFrame], inputs: Sequence[str] = ()) -> DataFrame:
        """The committed table of a stage; ``build`` is only called if there is none.

        ``inputs`` names the stages it is made from: if one of them was committed anew, what
        was built on the former is not used.
        """
        before = [self._read_record(i) for i in inputs]
        if None in before:
            raise ValueError(f"stage {name} comes before its inputs")
        told = json.dumps([name, [r["path"] for r in before]])
        digest = hashlib.sha256(told.encode()).hexdigest()
        record = self._read_record(name)
        if record is not None and record["params"] != self.params:
            raise ValueError(f"run {self.folder} was made with other parameters: {record['params']}")
        if record is not None and record["inputs"] != digest:
            raise ValueError(f"stage {name} was made from other inputs")
        if record is None:
            path = f"{self.folder}/{name}/attempt-{uuid.uuid4().hex}"
            built = build()
            built.write.parquet(path)
            self.computed.append(name)
            rows = self.spark.read.schema(built.schema).parquet(path).count()
            self._commit(
                name,
                {"stage": name, "path": path, "rows": rows, "params": self.params, "inputs": digest, "schema": built.schema.json()},
            )
            record = self._read_record(name)
        schema = T.StructType.fromJson(json.loads(record["schema"]))
        return self.spark.read.schema(schema).parquet(record["path"])

    def manifest(self) -> DataFrame:
        """Stage, path and rows of everything that is committed; empty for a new run."""
        if not self._store().exists(self._path("_commits")):
            return self.spark.createDataFrame([], "stage string, path string, rows long")
        lines = self.spark.read.text(f"{self.folder}/_commits")
        parsed = F.from_json("value", "stage string, path string, rows bigint")
        return lines.select(parsed.alias("r")).select("r.*")


def extract_job(run: StagedRun, manifest: DataFrame, files: DataFrame, min_section_words: int) -> DataFrame:
    """``missing`` (manifest rows without a file) and ``sections``; returns the sections."""
    run.stage("missing", lambda: builds.fl.missing_files(manifest, files))
    return run.stage("sections", lambda: builds.extract_filings(manifest, files, min_section_words))


def dataset_job(run: StagedRun, section_rows: DataFrame, **options) -> dict[str, DataFrame]:
    """``examples`` with their split, and the tables that describe them, by name.

    ``options`` are those of :func:`filingloom.plans.builds.split_dataset`.
    """
    written = run.stage("examples", lambda: builds.split_dataset(section_rows, **options))
    tables = {"examples": written}
    for name, table in builds.describe_dataset(written).items():
        tables[name] = run.stage(name, lambda t=table: t, inputs=["examples"])
    return tables


def evaluation_job(
    run: StagedRun,
    test_rows: DataFrame,
    order: str,
    backend: str,
    predictions: DataFrame | None = None,
    scorer: Callable[[Column, Column], Column] | None = None,
) -> dict[str, DataFrame]:
    """``scored`` rows of one run, their ``metrics``, ``counts`` and ``metadata``."""
    scored = run.stage("scored", lambda: builds.scored_rows(test_rows, order, scorer=scorer, predictions=predictions))
    named = scored.withColumn("backend", F.lit(backend))
    later = {
        "metrics": lambda: compare.aggregate_metrics(scoring.metrics_long(scored, ["task_type"])),
        "counts": lambda: compare.task_counts(scored),
        "metadata": lambda: compare.run_metadata(named),
    }
    return {"scored": scored} | {name: run.stage(name, build, inputs=["scored"]) for name, build in later.items()}


def comparison_job(
    run: StagedRun, baseline: dict[str, DataFrame], finetuned: dict[str, DataFrame], order: str
) -> dict[str, DataFrame]:
    """``overall``, ``by_task``, ``summary`` and ``pairs`` of two evaluations."""

    def scope(side: dict[str, DataFrame], name: str) -> DataFrame:
        return side["metrics"].where(F.col("scope") == name)

    overall = run.stage("overall", lambda: compare.compare_metrics(scope(baseline, "overall"), scope(finetuned, "overall")))
    by_task = run.stage(
        "by_task", lambda: compare.compare_metrics(scope(baseline, "task"), scope(finetuned, "task"), ("task_type", "metric"))
    )
    summary = run.stage(
        "summary",
        lambda: compare.comparison_summary(overall, baseline["metadata"], finetuned["metadata"]),
        inputs=["overall"],
    )
    pairs = run.stage("pairs", lambda: compare.prediction_join(baseline["scored"], finetuned["scored"], order))
    return {"overall": overall, "by_task": by_task, "summary": summary, "pairs": pairs}
