"""The curation run: from a file of trajectories to training and validation rows, an audit and a manifest.

    python -m millrace.plans.curation INPUT OUTPUT [--lines] [--limit N] [--train-size N] [--val-size N] [--max-per-group N] [--threshold X] [--neighbors N] [--seed N]
"""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dedup, judging, selection, trajectory
from millrace.session import build, ship_package
from millrace.sources import readers, sinks
from millrace.sources.shared import discard, owning, shared_dir, write_text, written


@dataclass
class Curated:
    """A split (all columns of the records, and ``split``; a table in the shared folder, which the caller may ``discard``), and how many rows each step has left."""

    split: DataFrame
    source: int
    after_exact: int
    after_near: int

    def counts(self) -> dict[str, int]:
        return {"exact_duplicates_removed": self.source - self.after_exact, "near_duplicates_removed": self.after_exact - self.after_near}


def ranked(df: DataFrame) -> DataFrame:
    """Adds ``rank``: 0 for the best reward, equals by index, which no two rows share. Only these columns are sorted."""
    order = trajectory.global_rank(df.select("final_reward", "index"), F.desc("final_reward"), F.asc("index"))
    return owning(df.join(order.select("index", F.col("__rank").alias("rank")), "index"), order)


def _step(df: DataFrame, label: str, *done: DataFrame) -> DataFrame:
    """``df`` written, and what it was made of deleted: the tables that it owns and those ``done`` with."""
    out = written(df, label)
    discard(*getattr(df, "_millrace_tables", ()), *done)
    return out


def curate(items: DataFrame, settings: selection.Selection, *, ask: Callable[[str, str], tuple[float, str]] | None = None, judged: int = 0, cache: DataFrame | None = None, cache_path: str | None = None, retry_failures: bool = True, rate: float | None = None) -> Curated:
    """Score, judge, dedup, pick and split ``items`` (index, id, group, level, messages). Raises ValueError if too few rows are left or no split fits.

    ``ask`` marks the ``judged`` best rows that ``cache`` has no success for, at most ``rate`` a second; its verdicts, failures too, are appended to ``cache_path`` batch by batch, so a run that dies loses none it has finished.
    Without ``retry_failures`` a failure in the cache is a verdict for good.
    """
    scored = _step(trajectory.rewarded(trajectory.records(items)), "curation-scored")
    first = scored
    if judged > 0 and ask is not None:
        known = judging.latest_verdicts(cache, retry_failures=retry_failures) if cache is not None else None
        best = scored.orderBy(F.desc("deterministic_reward"), "index").limit(judged)
        log = cache_path or f"{shared_dir(items.sparkSession)}/millrace/verdicts-{uuid.uuid4().hex}"
        asked = judging.judge_into(scored, judged, ask, log, known=known, rate=rate)
        fresh = readers.judge_cache(items.sparkSession, log) if asked else None
        new = None if fresh is None else judging.latest_verdicts(fresh, retry_failures=False)
        verdicts = new if known is None else known if new is None else new.unionByName(known.join(new, "message_hash", "left_anti"))
        if verdicts is not None:
            scored = judging.blended(scored, verdicts.join(best.select("message_hash").distinct(), "message_hash", "left_semi"))
    rows = _step(ranked(scored), "curation-ranked", first)
    source = rows.count()
    exact = _step(_exact(rows), "curation-exact", rows)
    after_exact = exact.count()
    near = _step(dedup.near_dedup(exact, "rank", "normalized_prompt", "task_prompt", threshold=settings.near_duplicate_threshold, neighbors=settings.dedup_neighbors), "curation-near", exact)
    after_near = near.count()
    size = settings.train_size + settings.val_size
    pool = _step(selection.capped_pool(near, size, settings.max_per_group), "curation-pool", near)
    split = selection.group_split(selection.checked_size(pool, size), settings.val_size, settings.seed, settings.trials)
    return Curated(selection.validated(_step(split, "curation-split", pool), settings), source, after_exact, after_near)


def _exact(rows: DataFrame) -> DataFrame:
    """Rows kept by id, messages and prompt; an empty prompt is no key."""
    keyed = rows.withColumn("__prompt", F.when(F.col("normalized_prompt") != "", F.col("prompt_hash")))
    kept = dedup.exact_dedup(keyed, "rank", ["id", "message_hash", "__prompt"])
    return owning(kept.drop("__prompt"), kept)


def run(spark: SparkSession, path: str, out: str, settings: selection.Selection = selection.Selection(), *, lines: bool = False, limit: int = 0, **judge) -> Curated:
    """``curate`` the file at ``path`` into the folder ``out``: train, validation, their metadata, audit and manifest. Of the tables on the way only that of the returned split stays."""
    ship_package(spark)
    items = _step(readers.trajectories(spark, path, limit, lines), "curation-items")
    found = curate(items, settings, **judge)
    outputs = {name: f"{out}/{name}" for name in ("train.jsonl", "validation.jsonl", "train_metadata.jsonl", "validation_metadata.jsonl", "selection_audit.csv", "selection_manifest.json")}
    raw = found.split.join(items.select("index", "raw"), "index") if "raw" not in found.split.columns else found.split
    for name in ("train", "validation"):
        part = raw.where(F.col("split") == name).orderBy("rank")
        sinks.write_jsonl(sinks.training_rows(part), outputs[f"{name}.jsonl"])
        sinks.write_jsonl(sinks.metadata_rows(part), outputs[f"{name}_metadata.jsonl"])
    sinks.write_csv(sinks.audit_rows(found.split, "rank"), outputs["selection_audit.csv"], "split", "rank")
    source = {"path": path, "sha256": {r["path"]: r["sha256"] for r in readers.fingerprint(spark, path).collect()}, "processed_count": found.source}
    write_text(spark, outputs["selection_manifest.json"], sinks.manifest(found.split, found.counts(), asdict(settings), source, outputs))
    discard(items)
    return found


def main() -> None:
    plain = selection.Selection()
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--lines", action="store_true", help="the input has one JSON object a line")
    parser.add_argument("--limit", type=int, default=0)
    parser.add_argument("--train-size", type=int, default=plain.train_size)
    parser.add_argument("--val-size", type=int, default=plain.val_size)
    parser.add_argument("--max-per-group", type=int, default=plain.max_per_group)
    parser.add_argument("--threshold", type=float, default=plain.near_duplicate_threshold)
    parser.add_argument("--neighbors", type=int, default=plain.dedup_neighbors)
    parser.add_argument("--seed", type=int, default=plain.seed)
    given = parser.parse_args()
    settings = selection.Selection(given.train_size, given.val_size, given.max_per_group, given.threshold, given.neighbors, given.seed)
    found = run(build("curation"), given.input, given.output, settings, lines=given.lines, limit=given.limit)
    print(f"train {settings.train_size}, validation {settings.val_size}, {found.counts()}")


if __name__ == "__main__":
    main()
