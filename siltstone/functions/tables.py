"""Table functions for SQL over raw records.

    tables.register(spark)
    spark.sql("SELECT r.record_number, a.* FROM raw_records r, LATERAL siltstone_attributes(r.raw) a")

A table function takes one record at a time.  For whole images use ``attributes`` of the listings, which
decodes records batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

ATTRIBUTE = "ordinal int, type_id bigint, id int, non_resident boolean, data_size bigint, value_length bigint, name string, namespace int, parent_reference bigint"


@udtf(returnType=ATTRIBUTE)
class Attributes:
    """The attributes of a record, in order; none of a null, torn or invalid one."""

    def eval(self, raw: bytes) -> Iterator[tuple]:
        from siltstone.sources import records

        table = np.frombuffer(raw or b"", np.uint8).reshape(1, -1).copy()
        if records.fix_up(table)[0] or not records.valid(table)[0]:
            return
        for a in records.attributes_of(table):
            name = a["name"] or {}
            yield a["ordinal"], a["type_id"], a["id"], a["non_resident"], a["data_size"], a["value_length"], name.get("name"), name.get("namespace"), name.get("parent_reference")


def register(spark: SparkSession) -> None:
    spark.udtf.register("siltstone_attributes", Attributes)
