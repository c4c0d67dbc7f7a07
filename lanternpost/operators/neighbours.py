"""Exact nearest neighbours by cosine similarity, without a pair table.

``nearest`` scores blocks of vectors inside tasks and lets only the best ``k`` per
query leave a task.  Two plans give the same rows:

* few queries (their bytes are measured against a limit): the query matrix is
  broadcast and every knowledge-base partition is read once;
* many queries: an index of cells is built and searched in rounds, see
  :mod:`vector_index`.  An index that is already there answers either way.

Similarities are rounded before they are ranked and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import delete, shared_folder
from .ordering import per_group
from .scoring import QUERY_STEP, Best, unit_matrix
from .vector_index import MEETINGS, VectorIndex, build

BROADCAST_BYTES = 16 << 20
HITS_BATCH = 1 << 16


def _result_schema(queries: DataFrame, query_id: str, kb: DataFrame, kb_id: str) -> str:
    return (
        f"query_id {queries.schema[query_id].dataType.simpleString()}, "
        f"kb_id {kb.schema[kb_id].dataType.simpleString()}, similarity double"
    )


def _query_rows_within(queries: DataFrame, vector: str, limit: int) -> bool:
    """Whether the query matrix is known to fit ``limit`` bytes; reads one integer back."""
    cells = queries.select(F.sum(F.size(vector) + F.lit(4)).alias("n")).first()["n"] or 0
    return cells * 8 <= limit


def _broadcast_plan(
    queries: DataFrame, kb: DataFrame, ids: tuple[str, str], vectors: tuple[str, str], k: int, floor: float | None
) -> DataFrame:
    local = queries.where(F.col(ids[0]).isNotNull() & F.col(vectors[0]).isNotNull()).select(ids[0], vectors[0]).toPandas()
    shared = kb.sparkSession.sparkContext.broadcast((local[ids[0]].to_numpy(), unit_matrix(local[vectors[0]])))
    kb_id, kb_vector = ids[1], vectors[1]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = shared.value
        best = Best(q, k, floor, QUERY_STEP)
        for batch in batches:
            if len(batch) and len(q_ids):
                best.add(batch[kb_id].to_numpy(), unit_matrix(batch[kb_vector]))
        rows, found, similarity = best.hits()
        for at in range(0, len(rows), HITS_BATCH):
            part = slice(at, at + HITS_BATCH)
            yield pd.DataFrame({"query_id": q_ids[rows[part]], "kb_id": found[part], "similarity": similarity[part]})

    # each task gives up to k hits a query, however small its share
    rows = kb.where(F.col(kb_vector).isNotNull()).select(kb_id, kb_vector).coalesce(MEETINGS * kb.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInPandas(scan, _result_schema(queries, ids[0], kb, kb_id))


def _cell_plan(
    queries: DataFrame, kb: DataFrame, ids: tuple[str, str], vectors: tuple[str, str], k: int, floor: float | None
) -> DataFrame:
    """An index for this search only."""
    path = shared_folder(kb.sparkSession, "cells")
    index = build(kb, path, ids[1], vectors[1])
    hits = index.search(queries, k, query_id=ids[0], query_vector=vectors[0], floor=floor)
    delete(kb.sparkSession, path)
    return hits.drop("rank")


def nearest(
    queries: DataFrame,
    kb: DataFrame | VectorIndex,
    k: int,
    *,
    query_id: str,
    query_vector: str,
    kb_id: str = "id",
    kb_vector: str = "vec",
    floor: float | None = None,
    plan: str = "auto",
    probe: int | None = None,
) -> DataFrame:
    """(query_id, kb_id, similarity, rank): the ``k`` most similar rows of ``kb`` per query.

    ``floor`` drops hits below a similarity.  It is applied inside the tasks, which
    gives the same rows as filtering the ranked result.  ``probe`` limits the cells a query
    visits; with it the search goes through an index and may miss rows.
    """
    ids, vectors = (query_id, kb_id), (query_vector, kb_vector)
    if plan == "auto":
        few = probe is None and _query_rows_within(queries, query_vector, BROADCAST_BYTES)
        plan = "broadcast" if few else "cells"
    if isinstance(kb, VectorIndex):
        if plan == "cells":
            return kb.search(queries, k, query_id=query_id, query_vector=query_vector, floor=floor, probe=probe)
        kb, ids, vectors = kb.vectors(), (query_id, "id"), (query_vector, "vec")
    scan = {"broadcast": _broadcast_plan, "cells": _cell_plan}[plan]
    hits = scan(queries, kb, ids, vectors, k, floor)
    return per_group(hits, "query_id", F.desc("similarity"), "kb_id", k)
