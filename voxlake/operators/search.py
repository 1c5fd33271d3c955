"""Searching, filtering, ordering and paging of instances, studies and patients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

#: Filters of a study search that must equal a column.
EXACT = ("patient_id", "accession_number", "study_date", "study_description", "referring_physician", "institution", "study_uid")


def first_per_study(instances: DataFrame, study: str = "study_uid", order: str | list[str] = "sop_uid") -> DataFrame:
    """The instance of each study that comes first in the order."""
    columns = [order] if isinstance(order, str) else order
    # The least row is kept on each side of the shuffle; nulls come first, as in a sort.
    first = F.min_by(F.struct(*instances.columns), F.struct(*columns))
    return instances.groupBy(F.col(study).alias("__study")).agg(first.alias("__row")).select("__row.*")


def study_filter(columns: list[str], **filters: str | None) -> Column:
    """All filters that are not blank, joined by and: ``patient_name`` is contained in any case, ``modality`` falls back from the
    study's first modality to the instance's, the others are equal."""
    tests = [F.lit(True)]
    for name, wanted in filters.items():
        if wanted is None or not wanted.strip():
            continue
        if name == "patient_name":
            tests.append(F.contains(F.lower(F.coalesce("patient_name", F.lit(""))), F.lower(F.lit(wanted))))
        elif name == "modality":
            value = F.coalesce(F.get("modalities_in_study", 0), "modality") if "modalities_in_study" in columns else F.col("modality")
            tests.append(F.coalesce(value, F.lit("")) == wanted)
        elif name in EXACT:
            tests.append(F.coalesce(F.col(name).cast("string"), F.lit("")) == wanted)
        else:
            raise ValueError(f"no such filter: {name}")
    return reduce(lambda a, b: a & b, tests)


def page(rows: DataFrame, order: list[str], offset: int | str | None = None, limit: int | str | None = None) -> DataFrame:
    """Ordered rows from ``offset`` on, at most ``limit``. Raises ValueError for what is not a whole number from 0 on."""

    def number(value: int | str | None, name: str) -> int | None:
        if value is None:
            return None
        try:
            n = int(str(value))
        except ValueError:
            raise ValueError(f"{name} is not a whole number: {value}") from None
        if n < 0:
            raise ValueError(f"{name} is negative: {value}")
        return n

    start, count = number(offset, "offset"), number(limit, "limit")
    rows = rows.orderBy(*order)
    rows = rows.offset(start) if start else rows
    return rows if count is None else rows.limit(count)


def search_studies(instances: DataFrame, offset: int | str | None = None, limit: int | str | None = None, order: str = "sop_uid", tie: list[str] | None = None, **filters: str | None) -> DataFrame:
    """One row per study, from its first instance, then filtered, ordered and paged: a study whose first instance does not match is not found."""
    first = first_per_study(instances, order=[order, *(tie or [])])
    return page(first.where(study_filter(instances.columns, **filters)), [order, *(tie or [])], offset, limit)


def study_summary(rows: DataFrame) -> DataFrame:
    """Study, patient and first modality of a search's rows; a missing name is Unknown."""
    return rows.select("study_uid", F.coalesce(blank_to_null(F.col("patient_name")), F.lit("Unknown")).alias("patient_name"), "patient_id", "study_date", "modality")


def search_patients(patients: DataFrame, query: str, columns: tuple[str, ...] = ("patient_name", "patient_id", "study_description", "modality")) -> DataFrame:
    """Patients of whom any of the columns contains the query, in any case; a blank query finds all."""
    if not query.strip():
        return patients
    return patients.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lower(F.lit(query))), F.lit(False)) for c in columns]))


def worklist(items: DataFrame, **keys: str | None) -> DataFrame:
    """Worklist items that match all keys that are not blank."""
    wanted = {k: v for k, v in keys.items() if v is not None and v.strip()}
    return items.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in wanted.items()], F.lit(True)))


def instance_at(instances: DataFrame, study_uid: str, series_uid: str, sop_uid: str) -> DataFrame:
    return instances.where((F.col("study_uid") == study_uid) & (F.col("series_uid") == series_uid) & (F.col("sop_uid") == sop_uid))


def by_date_newest(patients: DataFrame, date: str, *ties: str) -> DataFrame:
    """Newest first, without a date last."""
    return patients.orderBy(F.desc_nulls_last(date), *ties)


def numbered(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Rows of a sorted frame with their places from 1: the place within a partition, after all rows of earlier partitions.

    The sorted rows are persisted, so both passes see the same partitions; no task gets more than its part of the sort.
    """
    marked = ordered.withColumn("__at", F.monotonically_increasing_id()).persist()
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    return marked.join(F.broadcast(starts), part == F.col("__part")).select(*ordered.columns, (F.col("__before") + within + 1).alias(name))


def latest(instances: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key."""
    last = F.max_by(F.struct(*instances.columns), F.struct(F.col(version).isNotNull(), version))
    return instances.groupBy(F.col(key).alias("__key")).agg(last.alias("__row")).select("__row.*")
