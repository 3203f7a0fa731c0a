"""K5: text encoders.

Default encoder: hashed term frequencies (``HashingTF``) normalised to unit
length (``Normalizer``) -- deterministic, JVM-side, no model weights. A
neural encoder plugs in through :func:`encode_with` (``mapInPandas`` with
the model loaded once per Python worker and texts encoded in small
batches). ``model_id`` travels with every vector so that vectors of
different encoders are never compared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.operators.rerank import terms
from textlake.params import ENCODE_BATCH, EMBED_DIM

HASHING_MODEL = "hashing-tf"


def hashing_model_id(dim: int = EMBED_DIM) -> str:
    return f"{HASHING_MODEL}-{dim}"


def encode(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = EMBED_DIM) -> DataFrame:
    """Unit-length hashed term vectors as ``array<float>``; blank text gives []."""
    tmp = df.withColumn("_terms", terms(F.col(text)))
    tf = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dim).transform(tmp)
    nv = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0).transform(tf)
    vec = F.when(F.size("_terms") > 0, vector_to_array(F.col("_nv"), "float32")) \
        .otherwise(F.array().cast("array<float>"))
    return nv.withColumn(out, vec).withColumn("model_id", F.lit(hashing_model_id(dim))) \
        .drop("_terms", "_tf", "_nv")


@lru_cache(maxsize=2)
def _load(factory):
    return factory()


def encode_with(df: DataFrame, factory, model_id: str, text: str = "text",
                out: str = "embedding", batch: int = ENCODE_BATCH) -> DataFrame:
    """Hook: ``factory() -> model`` with ``model.encode(list[str]) -> ndarray``.

    Loaded once per worker; blank texts get an empty vector (as the
    reference's ``get_embedding``).
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType())),
                                              T.StructField("model_id", T.StringType())])

    def run(batches):
        model = _load(factory)
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            vecs: list = [[] for _ in texts]
            idx = [i for i, s in enumerate(texts) if s.strip()]
            for s in range(0, len(idx), batch):
                part = idx[s:s + batch]
                emb = np.asarray(model.encode([texts[i] for i in part]), dtype=np.float32)
                for j, i in enumerate(part):
                    vecs[i] = emb[j].tolist()
            yield pdf.assign(**{out: vecs, "model_id": model_id})

    return df.mapInPandas(run, schema)


def same_model(queries: DataFrame, vectors: DataFrame) -> None:
    """Defect guard: refuse to compare vectors of different encoders."""
    q = {r[0] for r in queries.select("model_id").distinct().limit(2).collect()}
    v = {r[0] for r in vectors.select("model_id").distinct().limit(2).collect()}
    if len(q) != 1 or q != v:
        raise ValueError(f"query and store encoders differ: {sorted(q)} vs {sorted(v)}")
