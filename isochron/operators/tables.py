"""Lookups, projections, filters and set operations on keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Beat symbols and the class each belongs to.
SYMBOLS = {
    "N": "N", "L": "N", "R": "N", "e": "N", "j": "N",
    "A": "S", "a": "S", "J": "S", "S": "S",
    "V": "V", "E": "V",
    "F": "F",
    "/": "Q", "f": "Q", "Q": "Q",
}
# Record lists of the inter-patient split of the arrhythmia database.
TRAIN_RECORDS = [101, 106, 108, 109, 112, 114, 115, 116, 118, 119, 122, 124, 201, 203, 205, 207, 208, 209, 215, 220, 223, 230]
TEST_RECORDS = [100, 103, 105, 111, 113, 117, 121, 123, 200, 202, 210, 212, 213, 214, 219, 221, 222, 228, 231, 232, 233, 234]


def map_symbols(events: DataFrame, symbols: dict[str, str], column: str = "symbol") -> DataFrame:
    """Add label; events whose symbol is not in the map are dropped.

    The map is a literal of the plan: no join, and the filter reaches the scan.
    """
    table = F.create_map(*(F.lit(x) for kv in symbols.items() for x in kv))
    return events.where(F.col(column).isin(list(symbols))).withColumn("label", table[F.col(column)])


def select_leads(channels: DataFrame, record: str, name: str, idx: str, wanted: list[str]) -> DataFrame:
    """As many channels as wanted: those named, in the wanted order and whatever their case, then the first others."""
    place = F.array_position(F.array(*(F.lit(x.upper()) for x in wanted)), F.upper(name))
    key = F.when(place > 0, place).otherwise(F.lit(len(wanted)) + 1 + F.col(idx))
    order = Window.partitionBy(record).orderBy(key, idx)
    return channels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= len(wanted))


def inside(events: DataFrame, at: str, length: str, before: int, after: int) -> DataFrame:
    """Events whose window [at - before, at + after) lies in the signal.  Intervals must be taken first."""
    return events.where((F.col(at) - before >= 0) & (F.col(at) + after <= F.col(length)))


def cut(samples: str, at: str, before: int, after: int) -> Column:
    return F.slice(F.col(samples), F.col(at) - before + 1, before + after)


def z_scores(df: DataFrame, by: list[str], value: str, eps: float = 1e-8) -> DataFrame:
    """value minus its group's mean over its population sd; groups' statistics are a small partial aggregate."""
    own = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(own, by).withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def allocation(rows: DataFrame, patient: str, part: str) -> DataFrame:
    """Per part: patients, rows, and how many patients also stand in another part."""
    pairs = rows.groupBy(patient, part).agg(F.count(F.lit(1)).alias("rows"))
    parts = pairs.groupBy(patient).agg(F.count(F.lit(1)).alias("parts"))
    return pairs.join(parts, patient).groupBy(part).agg(
        F.count(F.lit(1)).alias("patients"), F.sum("rows").alias("rows"), F.count_if(F.col("parts") > 1).alias("shared"))


def audit(rows: DataFrame, patient: str, part: str, label: str) -> DataFrame:
    """Per part and class: patients, rows, the part's patients and rows, and whether no patient stands in another part.

    The ids themselves are ``patient_lists``: rows, since a list of all of them would grow with the table.
    """
    own = rows.groupBy(patient, part, label).agg(F.count(F.lit(1)).alias("n"))
    parts = own.groupBy(patient).agg(F.count_distinct(part).alias("parts"))
    whole = own.join(parts, patient).groupBy(part).agg(
        F.count_distinct(patient).alias("part_patients"), F.sum("n").alias("part_rows"), (F.max("parts") == 1).alias("disjoint"))
    return own.groupBy(part, label).agg(F.count_distinct(patient).alias("patients"), F.sum("n").alias("rows")).join(whole, part)


def patient_lists(rows: DataFrame, patient: str, part: str) -> DataFrame:
    """(patient, parts): every patient with the sorted parts it stands in; more than one is an overlap."""
    return rows.groupBy(patient).agg(F.array_sort(F.collect_set(part)).alias("parts"))


def with_patients(rows: DataFrame, parsed: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """rows with the patient of their record: the override's if it has one, else the parsed one; none is an error."""
    known = parsed.select("record", F.col("patient").alias("_parsed"))
    if override is not None:
        known = known.join(override.select("record", F.col("patient").alias("_given")), "record", "full")
    else:
        known = known.withColumn("_given", F.lit(None).cast(dict(parsed.dtypes)["patient"]))
    found = F.coalesce("_given", "_parsed")
    missing = F.raise_error(F.concat(F.lit("no patient for record "), F.col("record").cast("string")))
    return rows.join(known, "record", "left").withColumn("patient", F.when(found.isNull(), missing.cast(dict(parsed.dtypes)["patient"])).otherwise(found)).drop("_parsed", "_given")


def of_records(rows: DataFrame, record: str, wanted: list) -> DataFrame:
    """Rows of the records of a split; the list is a literal of the plan, so the filter reaches the scan."""
    return rows.where(F.col(record).isin(wanted))


def of_pair(rows: DataFrame, label: str, a, b) -> DataFrame:
    """Rows of two classes."""
    return rows.where(F.col(label).isin(a, b))


def one_versus_rest(label: str, positive) -> Column:
    return (F.col(label) == F.lit(positive)).cast("int")


def basename(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def record_name(number: str, form: str = "I%02d") -> Column:
    return F.format_string(form, F.col(number).cast("long"))


def families(columns: list[str], prefixes: dict[str, str], keep: set[str]) -> list[str]:
    """Columns whose family, told by their prefix, is kept."""
    return [c for c in columns for p, f in prefixes.items() if c.startswith(p) and f in keep]


def cost_benefit(deltas: DataFrame, cost: DataFrame) -> DataFrame:
    """Benefit (a drop's loss) per ms of each feature family.

    deltas has (key, delta) with keys drop_<family>, cost (family, ms).
    """
    rows = deltas.withColumn("family", F.regexp_replace("key", "^drop_", "")).join(cost, "family", "left")
    total = F.sum("ms").over(Window.partitionBy(F.lit(0)))
    return rows.select("family", (-F.col("delta")).alias("benefit"), "ms", (100 * F.try_divide("ms", total)).alias("pct_of_cost"),
                       F.try_divide(-F.col("delta"), "ms").alias("benefit_per_ms"))


def cost_ratio(linear: str | Column, other: str | Column) -> Column:
    """How many times as many parameters another model has, to one decimal."""
    linear, other = (F.col(c) if isinstance(c, str) else c for c in (linear, other))
    return F.round(other / F.greatest(linear, F.lit(1)), 1)
