"""MinHash near-dedup: fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch, unused
from flowloom.llm.neardup import Similarity, linked


def near_duplicates(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (smallest id that links reach) and kept (id = component_id).

    Documents are linked when their sets of 5-word shingles are 0.75 alike or more
    (see Similarity). Null, empty and blank texts have no shingles, are linked with
    nothing and kept. Rows with a null id get the component null and are kept. Rows
    repeated in full give equal rows. Other columns of docs are not used, whatever
    their names; an empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    units = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sized, grouped = linked(units, scratch, how)
    all_rows = sized.join(grouped.select("fp", "n", "component"), ["fp", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return all_rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates, all columns as they are.

    Of a group the smallest id stays; of rows that share that id, as many as there are.
    Rows without an id stay.
    """
    scratch, gone = Scratch(docs.sparkSession), unused(docs, "gone")
    found = near_duplicates(docs, how, id_col, text_col, scratch).where("not kept").select(F.col(id_col).alias(gone)).distinct()
    return docs.join(scratch.save(found), F.col(f"`{id_col}`").cast("long") == F.col(gone), "left_anti")
