"""Model bundle save / load (S7): MLlib model folders plus a JSON sidecar.

Everything goes through Spark writers, so the bundle can live on any
cluster file system.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from churnkit.operators.clean import Scaler, Vocabulary


def save_bundle(spark: SparkSession, path: str, models: dict[str, PipelineModel], meta: dict) -> None:
    """``models``: name -> PipelineModel; ``meta``: columns, vocabulary, scaler, threshold..."""
    root = path.rstrip("/")
    for name, m in models.items():
        m.write().overwrite().save(f"{root}/models/{name}")
    doc = dict(meta)
    doc["models"] = list(models)
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "json string").coalesce(1) \
        .write.mode("overwrite").text(f"{root}/bundle")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], dict]:
    root = path.rstrip("/")
    doc = json.loads(spark.read.text(f"{root}/bundle").first()[0])
    models = {name: PipelineModel.load(f"{root}/models/{name}") for name in doc["models"]}
    return models, doc


def vocabulary_of(doc: dict) -> Vocabulary:
    return Vocabulary({k: list(v) for k, v in doc.get("vocabulary", {}).items()})


def scaler_of(doc: dict) -> Scaler | None:
    s = doc.get("scaler")
    return Scaler(s["mean"], s["scale"]) if s else None
