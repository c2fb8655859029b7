"""Preprocessing and model as one ``PipelineModel`` of Spark's own stages.

:func:`pipeline_model` writes a fitted :class:`FeatureModel` down as SQL:

1. ``SQLTransformer`` — the row goes into one struct, so that no input column meets
   one of ours; numbers are imputed and scaled, capped one-hot columns compared;
2. ``StringIndexerModel`` for text columns with codes — or, for a vocabulary over
   ``LABELS`` values, an ``SQLTransformer`` that joins the saved vocabulary on its
   digest, so that no large vocabulary is part of a plan;
3. ``SQLTransformer`` — codes imputed and scaled; ``VectorAssembler``;
4. the model's stages; ``IndexToString`` (or a join) for a text target;
5. ``SQLTransformer`` — the input row and ``prediction`` (``predicted_label``).

Names go through back ticks, text through hexadecimal literals and numbers through
their shortest exact decimals, so any name or value is safe.  The saved folder is
read by ``PipelineModel.load`` alone; only the kernel models have a stage of this
library (``operators.kernels``).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.features import NAN_CLASS, FeatureModel

#: Largest vocabulary, in values and in bytes, that is kept inside a stage.
LABELS, LABEL_BYTES = 100_000, 16_000_000


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_sql(text: str) -> str:
    return f"decode(X'{text.encode().hex()}', 'UTF-8')"


def double_sql(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def number_sql(name: str, kind: str) -> str:
    """A numeric cell as a double: NaN is null, −0 is 0, a day-time interval its seconds."""
    if kind.startswith("interval"):
        return f"unix_micros(timestamp_seconds(0) + {name_sql(name)}) / CAST(1e6 AS DOUBLE)"
    return f"nanvl(CAST({name_sql(name)} AS DOUBLE), CAST(NULL AS DOUBLE)) + CAST(0 AS DOUBLE)"


def scaled_sql(value: str, mean: float, scale: float) -> str:
    return f"(coalesce({value}, {double_sql(mean)}) - {double_sql(mean)}) / {double_sql(scale)}"


def labels_of(vocab: DataFrame, size: int) -> list[str] | None:
    """The values in the order of their codes; None for a vocabulary too large for a stage."""
    if size > LABELS or (vocab.agg(F.sum(F.octet_length("value")).alias("b")).first().b or 0) > LABEL_BYTES:
        return None
    return [r["value"] for r in vocab.orderBy("code").collect()]  # at most LABELS values


def save_vocabulary(vocab: DataFrame, path: str) -> str:
    """The vocabulary by digest, for the joins of stages that have it too large; returns the table's name in SQL."""
    vocab.select(F.unhex(F.sha2("value", 256)).alias("digest"), "value", F.col("code").cast("double").alias("code")).write.mode("overwrite").parquet(path)
    return f"parquet.{name_sql(path)}"


def pipeline_model(features: FeatureModel, model, family: str, tables: str) -> PipelineModel:
    """One transformer from input rows to input rows with ``prediction``; ``tables``: folder for vocabularies too large for a stage."""
    spec = features.spec
    plain, coded, texts = ["struct(*) AS row"], [], []
    names = [f"f{i}" for i in range(len(spec.feature_names()))]
    for i, n in enumerate(spec.numeric):
        if n.ordinal:
            at = len(texts)
            texts.append(n.name)
            plain.append(f"coalesce(CAST({name_sql(n.name)} AS STRING), {text_sql(NAN_CLASS)}) AS s{at}")
            coded.append(f"{scaled_sql(f'i{at}', n.mean, n.scale)} AS f{i}")
        else:
            plain.append(f"{scaled_sql(number_sql(n.name, n.kind), n.mean, n.scale)} AS f{i}")
    i = len(spec.numeric)
    for o in spec.onehot:
        value = f"coalesce(CAST({name_sql(o.name)} AS STRING), {text_sql(o.mode)})"
        for _, values in o.outputs():
            plain.append(f"CAST({value} IN ({', '.join(map(text_sql, values))}) AS DOUBLE) AS f{i}")
            i += 1
    stages: list = [SQLTransformer(statement=f"SELECT {', '.join(plain)} FROM __THIS__")]
    for at, c in enumerate(texts):
        size = features.vocab_sizes[c]
        labels = labels_of(features.vocabs[c], size)
        if labels is None:
            table = save_vocabulary(features.vocabs[c], f"{tables}/codes-{at}")
            stages.append(SQLTransformer(statement=f"SELECT t.*, v.code AS i{at} FROM __THIS__ AS t LEFT JOIN {table} AS v ON unhex(sha2(t.s{at}, 256)) = v.digest"))
        else:  # values without a code get the next one, which is taken back below
            stages.append(StringIndexerModel.from_labels(labels, inputCol=f"s{at}", outputCol=f"k{at}", handleInvalid="keep"))
            stages.append(SQLTransformer(statement=f"SELECT *, IF(k{at} < {size}, k{at}, CAST(NULL AS DOUBLE)) AS i{at} FROM __THIS__"))
    if coded:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(coded)} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error"))
    stages += model.stages if isinstance(model, PipelineModel) else [model]
    out = ["row.*", "prediction"]
    if family == "classification" and spec.target_kind == "text":
        labels = labels_of(features.target_vocab, spec.target_classes or 0)
        if labels is None:
            table = save_vocabulary(features.target_vocab, f"{tables}/classes")
            stages.append(SQLTransformer(statement=f"SELECT t.*, v.value AS predicted_label FROM __THIS__ AS t LEFT JOIN {table} AS v ON t.prediction = v.code"))
        else:
            stages.append(IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels))
        out.append("predicted_label")
    stages.append(SQLTransformer(statement=f"SELECT {', '.join(out)} FROM __THIS__"))
    return PipelineModel(stages=stages)
