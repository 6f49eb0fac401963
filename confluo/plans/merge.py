"""Partial records in, canonical records out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from confluo.operators.fusion import fuse
from confluo.operators.linkage import cluster
from confluo.storage import materialize, spread


def merge(partials: DataFrame) -> DataFrame:
    """One canonical record for each person, with ``component``, the number of its first record.

    record_idx must be unique; its order is the order of records. Sort by candidate_id and component for output: the id alone is not unique.
    """
    found = materialize(cluster(partials))
    return fuse(spread(materialize(partials.join(found, "record_idx")), "record_idx"))


def ordered(canonical: DataFrame) -> DataFrame:
    return canonical.orderBy("candidate_id.value", "component")
