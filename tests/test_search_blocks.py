"""How often vectors are copied where all requests meet all chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import search as S


def test_blocks_are_as_large_as_bytes_let_them_be(spark, monkeypatch):
    vector = lambda n: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * n + i).cast("float"))
    model = [F.lit(1).alias("organization_id"), F.lit("m").alias("embedding_model")]
    chunks = spark.range(50).select("id", *model, vector(3).alias("embedding"))
    requests = spark.range(40).select(F.col("id").alias("user_id"), *model, vector(7).alias("query"))
    copies, blocks = [], S._blocks

    def counted(*args):
        out = blocks(*args)
        copies.append(out.count())
        return out

    monkeypatch.setattr(S, "_blocks", counted)
    monkeypatch.setattr(S, "REQUEST_BLOCK", 2)
    shown = lambda df: sorted((r["user_id"], r["rank"], r["chunk_id"], round(r["distance"], 9)) for r in df.collect())
    large = shown(S.vector_topk_batch(chunks, requests, 3))
    assert copies == [50 * S.LEAST_BLOCKS, 40]
    # 10 vectors of 4 numbers
    monkeypatch.setattr(S, "BLOCK_BYTES", 320)
    assert shown(S.vector_topk_batch(chunks, requests, 3)) == large and len(large) == 120
    assert copies[2:] == [50 * 4, 40 * 5]
