"""Plan and apply are separate: every verb returns a plan, and only ``apply`` touches files.

A plan is written down before anything moves, so that a run cut off can be taken up: ``unfinished`` names
such runs and ``resume`` ends them.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sink

#: In this order: (phase, the table of the run that it carries out).
PHASES = (("tags", "tags"), ("stage", "moves"), ("place", "moves"), ("text", "texts"), ("tidy", "folders"))


def summary(plan: DataFrame) -> DataFrame:
    """(kind, n): what a run would do; a dry run is just this."""
    if "status" in plan.columns:
        plan = plan.where(F.coalesce("status", F.lit("planned")) == "planned")
    return plan.groupBy("kind").count().withColumnRenamed("count", "n")


def apply(root: str, plan: DataFrame | None = None, texts: DataFrame | None = None, folders: DataFrame | None = None, tags: DataFrame | None = None, create: bool = False) -> dict[str, int]:
    """Carry out tags (path, tags, cover: a picture file or null), moves (src, dst), texts (path, text), then remove those folders (parent) that are empty; all tables are written down first.

    Existing files are never overwritten by a move; texts replace files that are there, or, with create, make new ones too.
    Returns how many moved, were written and were removed.  Failures of single files are rows of the journal, not errors.
    """
    given = next(t for t in (plan, texts, folders, tags) if t is not None)
    spark = given.sparkSession
    run = os.path.join(os.path.abspath(root), sink.HOME, uuid.uuid4().hex)
    os.makedirs(run)
    if plan is not None:
        if "status" in plan.columns:
            plan = plan.where(F.coalesce("status", F.lit("planned")) == "planned")
        plan = plan.where("src <> dst").select("src", "dst", F.sha2("src", 256).alias("id"))
    tables = {"moves": plan, "texts": texts and texts.select("path", "text"), "folders": folders and folders.select("parent"), "tags": tags and tags.select("path", "tags", "cover")}
    for name, rows in tables.items():
        if rows is not None:
            rows.write.parquet(f"file://{run}/{name}")
    with open(os.path.join(run, "_plan.json"), "w", encoding="utf-8") as f:
        json.dump({"tables": [n for n, t in tables.items() if t is not None], "create": create}, f)
    return resume(spark, run)


def resume(spark: SparkSession, run: str) -> dict[str, int]:
    """End a run whose plan is written down; phases that have ended are not begun again."""
    sink.register(spark)
    with open(os.path.join(run, "_plan.json"), encoding="utf-8") as f:
        plan = json.load(f)
    done = {}
    for phase, name in PHASES:
        if name not in plan["tables"]:
            continue
        if not os.path.exists(sink.summary_path(run, phase)):
            rows = spark.read.parquet(f"file://{run}/{name}")
            rows.write.format("library_actions").option("run", run).option("phase", phase).option("create", str(plan["create"]).lower()).mode("append").save()
        with open(sink.summary_path(run, phase), encoding="utf-8") as f:
            done[phase] = json.load(f)["counts"].get("done", 0)
    held = [f for _, _, names in os.walk(os.path.join(run, "staged")) for f in names if not f.endswith(".done")]
    if not held:
        shutil.rmtree(os.path.join(run, "staged"), ignore_errors=True)
    with open(os.path.join(run, "_ended"), "w", encoding="utf-8"):
        pass
    return {k: v for k, v in done.items() if k != "stage"}


def unfinished(root: str) -> list[str]:
    """Runs below the library whose plan is written down and that have not ended."""
    home = os.path.join(os.path.abspath(root), sink.HOME)
    runs = [os.path.join(home, r) for r in sorted(os.listdir(home))] if os.path.isdir(home) else []
    return [r for r in runs if os.path.exists(os.path.join(r, "_plan.json")) and not os.path.exists(os.path.join(r, "_ended"))]
