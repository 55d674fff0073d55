"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.functions.chunks import ChunkSettings, chunks_of


def chunk_documents(df: DataFrame, settings: ChunkSettings = ChunkSettings(), leading: bool = False) -> DataFrame:
    """One row per chunk of ``doc_id, text [, source_type, source_uri, metadata]``.

    Only the chunks leave the row, never the whole text, so long documents are
    not copied once per chunk. ``leading`` adds the number of characters
    trimmed in front of the chunk text.
    """
    kept = [name for name in ("source_type", "source_uri", "metadata") if name in df.columns]
    exploded = df.select("doc_id", *kept, F.explode_outer(chunks_of(F.col("text"), settings)).alias("c"))
    # The outer form keeps the optimizer from repeating the chunking in a filter.
    exploded = exploded.filter(F.col("c").isNotNull())
    index = F.col("c.chunk_index")
    columns = [
        F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.format_string("%04d", index)).alias("chunk_id"),
        "doc_id",
        index.alias("chunk_index"),
        F.col("c.start_char").alias("start_char"),
        F.col("c.end_char").alias("end_char"),
        F.col("c.text").alias("text"),
    ]
    if "metadata" in kept:
        kept.remove("metadata")
        added = F.create_map(F.lit("chunk_index"), index.cast("string"))
        if "source_uri" in kept:
            added = F.when(
                F.col("source_uri").isNotNull(), F.map_concat(added, F.create_map(F.lit("source_uri"), F.col("source_uri")))
            ).otherwise(added)
        own = F.map_filter(F.col("metadata"), lambda key, _: ~key.isin("chunk_index", "source_uri"))
        columns.append(F.map_concat(own, added).alias("metadata"))
    if leading:
        columns.append(F.col("c.leading").alias("leading"))
    return exploded.select(*columns, *kept)
