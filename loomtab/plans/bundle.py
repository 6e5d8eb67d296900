"""Export of a run: fitted preparation, features, model and calibration in one folder, and the predictor that reads it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import Interaction, TargetTransform, augment
from ..operators.labels import Labels
from ..operators.models import Calibrated, Calibrator, Fitted, load_model
from ..operators.prep import PrepModel

VERSION = 1


@dataclass(frozen=True)
class Predictor:
    """Everything between a raw frame and its predictions."""

    prep: PrepModel
    model: Fitted | Calibrated
    interactions: tuple[Interaction, ...] = ()
    calibrator: Calibrator | None = None
    transform: TargetTransform | None = None
    #: Dense tables of high-cardinality columns, by column.
    embeddings: dict[str, DataFrame] = field(default_factory=dict)
    #: The values behind a classifier's codes.
    labels: Labels | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        """Prepared columns with ``prediction`` and, of a classifier, ``probability``; of two classes, ``score`` is that of class 1.

        With ``labels``, ``prediction`` is a value of the target; probabilities are in the order of its values.
        """
        rows = self.prep.transform(augment(df, list(self.embeddings), self.embeddings) if self.embeddings else df)
        if self.interactions:
            rows = rows.withColumns({i.name: i.expression for i in self.interactions})
        out = self.model(rows)
        if self.transform:
            out = out.withColumn("prediction", self.transform.inverse(F.col("prediction")))
        if "probability" in out.columns:
            score = F.get("probability", F.lit(1))
            out = out.withColumn("score", self.calibrator.apply(score) if self.calibrator else score)
        if self.labels:
            out = out.withColumn("prediction", self.labels.decode(F.col("prediction")))
        return out


def export_bundle(spark: SparkSession, path: str, predictor: Predictor, about: dict | None = None) -> str:
    """Write the predictor to a folder that Spark reaches; the manifest comes last, so a folder without one is unfinished."""
    prep = predictor.prep
    for i, c in enumerate(sorted(prep.tables)):
        prep.tables[c][0].write.mode("overwrite").parquet(f"{path}/codes-{i}")
    for i, c in enumerate(sorted(predictor.embeddings)):
        predictor.embeddings[c].write.mode("overwrite").parquet(f"{path}/embedding-{i}")
    predictor.model.save(spark, f"{path}/model")
    body = {
        "version": VERSION,
        "about": about or {},
        "prep": {"drops": prep.drops, "fills": prep.fills, "tops": prep.tops, "dates": prep.dates, "codes": prep.codes, "tables": {c: prep.tables[c][1] for c in sorted(prep.tables)}},
        "embeddings": sorted(predictor.embeddings),
        "interactions": [asdict(i) for i in predictor.interactions],
        "calibrator": predictor.calibrator and asdict(predictor.calibrator),
        "transform": predictor.transform and asdict(predictor.transform),
        "labels": predictor.labels and asdict(predictor.labels),
    }
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def load_bundle(spark: SparkSession, path: str) -> Predictor:
    body = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if body["version"] != VERSION:
        raise ValueError(f"a bundle of version {body['version']}")
    counts = body["prep"].pop("tables")
    tables = {c: (spark.read.parquet(f"{path}/codes-{i}"), n) for i, (c, n) in enumerate(sorted(counts.items()))}
    found = Predictor(replace(PrepModel(**body["prep"]), tables=tables), load_model(spark, f"{path}/model"), tuple(Interaction(**i) for i in body["interactions"]))
    calibrator, transform = body["calibrator"], body["transform"]
    dense = {c: spark.read.parquet(f"{path}/embedding-{i}") for i, c in enumerate(body["embeddings"])}
    labels = body.get("labels")
    return replace(found, embeddings=dense, labels=labels and Labels(**labels), calibrator=calibrator and Calibrator(**calibrator), transform=transform and TargetTransform(**transform))
