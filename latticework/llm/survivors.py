"""One surviving record per entity: field-by-field survivorship in a single aggregation.

Each field keeps the maximum of a composite struct (usable, priority, time, value) over the records of its group,
so one group never has to be collected and a group of any size is combined map-side first.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[^0-9a-z]+")


def name_key(name: str | None) -> str | None:
    """Letters and digits of a name without regard to case, accents and width; null if there are none.

    Spacing, punctuation and invisible characters are written form only.
    """
    if name is None:
        return None
    if name.isascii():
        key = _PLAIN.sub("", name.lower())
    else:
        folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", name).casefold())
        key = "".join(c for c in folded if c.isalnum())
    return key or None


def name_key_column(name: str) -> Column:
    """``name_key`` over Arrow batches; Spark has no built-in Unicode decomposition."""

    def keys(names: pd.Series) -> pd.Series:
        return names.map(name_key, na_action="ignore")

    return F.pandas_udf(keys, "string")(name)


#: Contents that stand for a missing description (compared without case and wrapping marks).
PLACEHOLDERS = (
    "", "n/a", "na", "null", "none", "nan", "tbd", "unknown", "missing", "description", "not available",
    "no information", "no description", "no description available", "no details", "empty", "undefined", "todo",
)

#: Sentences that say there is nothing to say about the entity.
SAYS_NOTHING = (
    r"^no (description|information|details|data)\b",
    r"^(the )?(source text|text|chunk|passage|document) (does not|doesn't|did not) (describe|mention|cover)",
    r"^nothing is (said|known|stated|mentioned|given)\b",
    r"^there is no (description|information)\b",
    r"^(a |the )?description (is )?(not|un)\s*(provided|available|given)",
    r"\bdescription (is )?pending\.?$",
    r"\(no (details|description|information)[^)]*\)\.?$",
    r"^not (described|mentioned|available|provided)\b",
)


def finished_text(text: Column) -> Column:
    """Whether ``text`` is a finished text about its entity: neither missing, a placeholder, a statement that
    nothing is known, nor cut short. False for null."""
    bare = F.regexp_replace(text, r"^[\s ​‍﻿\p{Z}]+|[\s ​‍﻿\p{Z}]+$", "")
    inner = F.lower(F.regexp_replace(bare, r"^[\s\"'“”‘’«»(\[<{*_-]+|[\s\"'“”‘’«»)\]>}*_.-]+$", ""))
    low = F.lower(F.regexp_replace(bare, r"^[\"'“”‘’«»(\[*_]+", ""))
    ends = bare.rlike(r"[.!?。！？][\"'”’»)\]*_]*$") & ~bare.rlike(r"(\.\.|…)[\"'”’»)\]*_\s]*$")
    nothing = F.lit(False)
    for pattern in SAYS_NOTHING:
        nothing = nothing | low.rlike(pattern)
    return F.coalesce(ends & ~inner.isin(*PLACEHOLDERS) & ~nothing & bare.rlike(r"\p{L}"), F.lit(False))


def chunk_ids(source: Column) -> Column:
    """Distinct non-blank chunk ids without surrounding spaces; empty for null."""
    trimmed = F.transform(source, lambda x: F.regexp_replace(x, r"^[\s\p{Z}﻿​]+|[\s\p{Z}﻿​]+$", ""))
    return F.coalesce(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def scored(entity: DataFrame) -> DataFrame:
    """Records with their group's key and the composite struct of each field. Records without a name are dropped."""
    recency = F.struct(F.col("updated_at").isNotNull().alias("dated"), F.col("updated_at").alias("at"), (-F.col("record_id")).alias("r"))
    confidence, text = F.col("attributes.confidence"), F.col("attributes.description")
    trusted = F.coalesce(confidence.between(0.0, 1.0) & ~F.isnan(confidence), F.lit(False))
    n_ids = F.size(chunk_ids(F.col("source")))
    return (
        entity.select("record_id", "name", "updated_at", "attributes", "source")
        .withColumn("key", name_key_column("name"))
        .where(F.col("key").isNotNull())
        .select(
            "key",
            "record_id",
            F.when(finished_text(text), recency).alias("d"),
            F.when(trusted, F.struct(confidence.alias("c"), recency.alias("t"))).alias("c"),
            F.when(n_ids > 0, F.struct(n_ids.alias("n"), recency.alias("t"))).alias("s"),
            text.alias("description"),
            "source",
            "name",
        )
    )


def winners(entity: DataFrame) -> DataFrame:
    """(group_id, n_records, description, confidence, source): the record each field is taken from, null if none.

    A group is all records whose names agree by ``name_key``; ``group_id`` is its smallest ``record_id``. Repeated
    rows change nothing. ``description`` comes from the latest finished text (undated ones last),
    ``confidence`` from the highest value within 0..1, ``source`` from the most distinct chunk ids; ties go to
    the latest, then to the smallest ``record_id``. Groups of one record come out too (``alone`` is true).
    """
    rows = scored(entity).select("key", "record_id", "d", "c", "s")
    best = rows.groupBy("key").agg(
        F.min("record_id").alias("group_id"), F.max("record_id").alias("top"), F.max("d").alias("d"), F.max("c").alias("c"), F.max("s").alias("s")
    )
    return best.select(
        "key",
        "group_id",
        (F.col("group_id") == F.col("top")).alias("alone"),
        (-F.col("d.r")).alias("description"),
        (-F.col("c.t.r")).alias("confidence"),
        (-F.col("s.t.r")).alias("source"),
    )


def winners_long(entity: DataFrame) -> DataFrame:
    """(group_id, field, record_id) for every group of two or more records; no row for a field without a winner."""
    fields = ("description", "confidence", "source")
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("record_id")) for f in fields]))
    return winners(entity).where("not alone").select("group_id", one.alias("x")).select("group_id", "x.*").where("record_id is not null")


def survivors(entity: DataFrame) -> DataFrame:
    """The surviving record of every named entity, one row per group, groups of one included.

    ``name`` is that of the smallest record; ``description``, ``confidence`` and ``chunk_ids`` are the winning values
    (null where no record has a usable one), each with its ``*_record``. The values are part of the composite
    structs, so no join back is needed.
    """
    rows = scored(entity)
    best = rows.groupBy("key").agg(
        F.min(F.struct("record_id", "name")).alias("first"),
        F.max(F.when(F.col("d").isNotNull(), F.struct(F.col("d").alias("o"), F.col("description").alias("v")))).alias("d"),
        F.max("c").alias("c"),
        F.max(F.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("o"), chunk_ids(F.col("source")).alias("v")))).alias("s"),
    )
    return best.select(
        F.col("first.record_id").alias("group_id"),
        F.col("first.name").alias("name"),
        F.col("d.v").alias("description"),
        (-F.col("d.o.r")).alias("description_record"),
        F.col("c.c").alias("confidence"),
        (-F.col("c.t.r")).alias("confidence_record"),
        F.array_sort(F.col("s.v")).alias("chunk_ids"),
        (-F.col("s.o.t.r")).alias("source_record"),
    )
