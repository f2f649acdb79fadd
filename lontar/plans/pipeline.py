"""The curation pipeline: audit, select, enrich, each stage written with a manifest and resumed if unchanged."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from lontar.operators import curate, enrich, select
from lontar.sources import writers


class Pipeline:
    """Stages in one folder. A stage whose manifest names the same input is skipped; changed input of
    a stage with later stages is refused."""

    ORDER = ("audit", "select", "enrich")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)

    def manifest(self, stage: str) -> dict | None:
        path = self.folder / f"{stage}.json"
        return json.loads(path.read_text(encoding="utf-8")) if path.is_file() else None

    def status(self) -> dict[str, str | None]:
        done = [s for s in self.ORDER if self.manifest(s)]
        left = [s for s in self.ORDER if s not in done]
        return {"done": ",".join(done), "next": left[0] if left else None}

    def _stage(self, stage: str, source: str, tables: Callable[[], dict[str, DataFrame]]) -> dict:
        known = self.manifest(stage)
        if known and known["source"] == source:
            return known
        later = self.ORDER[self.ORDER.index(stage) + 1 :]
        if known and any(self.manifest(s) for s in later):
            raise RuntimeError(f"the input of {stage} changed after later stages were made")
        hashes = {}
        for name, df in tables().items():
            writers.write_parquet(df, str(self.folder / name))
            hashes[name] = writers.content_hash(self.spark.read.parquet(str(self.folder / name)))
        writers.write_json(str(self.folder / f"{stage}.json"), {"stage": stage, "source": source, "outputs": hashes})
        return self.manifest(stage)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.folder / name))

    def audit(self, raw: DataFrame) -> dict:
        def tables() -> dict[str, DataFrame]:
            rows = curate.normalised(raw)
            records = curate.senses(curate.unique_rows(rows))
            return {"senses": curate.curated(records), "quarantined": curate.quarantined(records), "duplicates": curate.lineage(rows)}

        return self._stage("audit", writers.content_hash(raw.select("entry_id", *curate.RAW)), tables)

    def select(self, quotas: dict[str, int], cap: int = 3, seed: str = "lontar", anchors: tuple[str, ...] = (), focus: tuple[str, ...] = ()) -> dict:
        def tables() -> dict[str, DataFrame]:
            terms = curate.terms(self.read("senses"))
            eligible = terms.where("not warned")
            lengths = eligible.select(F.lit(1).alias("all"), "longest_definition")
            long_from = (curate.nearest_rank(lengths, ["all"], "longest_definition", {"p90": 0.9}).first() or {"p90": 0})["p90"]
            plan = select.Plan(quotas, cap, seed, anchors, focus)
            chosen, pairs = select.select_terms(eligible, plan, long_from)
            related = select.related(self.spark.createDataFrame(pairs, "left_id string, right_id string"), terms)
            picked = terms.join(chosen.select("term_id", "bucket", "place"), "term_id").join(related, "term_id", "left").withColumn("related_terms", F.coalesce("related_terms", F.lit("")))
            return {"pilot": picked.withColumn("tags", select.tags(plan, long_from, F.col("related_terms") != ""))}

        return self._stage("select", json.dumps([self.manifest("audit")["outputs"], quotas, cap, seed, anchors, focus]), tables)

    def enrich(self, corpus: DataFrame) -> dict:
        def tables() -> dict[str, DataFrame]:
            pilot = self.read("pilot")
            features = enrich.evidence(pilot, corpus)
            ranked = enrich.best(features)
            return {"candidates": ranked, "enriched": enrich.match_status(pilot, features, ranked)}

        return self._stage("enrich", json.dumps(self.manifest("select")["outputs"]), tables)
