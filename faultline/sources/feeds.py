"""Feed records turned into incidents: accident records and power-fault records.

Each function reads landed records, batch or stream, and gives (key, incident_id, source,
narrative, risk_floor); a record that cannot become an incident is left out, `*_rejects` has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions.risk import customer_floor
from faultline.functions.text import strip

ACCIDENT_SOURCE = "NTSB API"
FAULT_SOURCE = "UKPN Live Faults"
DEFAULT_FAULT_TEXT = "Unplanned power cut"


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def accident_narrative(field: dict[str, Column]) -> Column:
    """Sentence on one accident; parts that are missing are left out, null without a cause."""
    cause = _filled(strip(field["probable_cause"]))
    craft = _filled(F.concat_ws(" ", _filled(field["acft_make"]), _filled(field["acft_model"])))
    place = _filled(
        F.concat_ws(", ", _filled(field["ev_city"]), _filled(field["ev_state"]), _filled(field["ev_country"]))
    )
    prefix = F.concat_ws(
        " ",
        F.concat(F.lit("On "), _filled(field["ev_date"])),
        F.concat(F.lit("a "), craft),
        F.concat(F.lit("at "), place),
        F.concat(F.lit("("), _filled(field["ev_highest_injury"]), F.lit(" injury outcome)")),
    )
    return F.when(prefix == "", cause).otherwise(F.concat(prefix, F.lit(": "), cause))


def _with_missing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({name: F.lit(None).cast("string") for name in names if name not in df.columns})


def accident_incidents(records: DataFrame) -> DataFrame:
    names = schema.ACCIDENT_RECORD.fieldNames()
    complete = _with_missing(records, names)
    built = complete.select("ev_id", accident_narrative({n: F.col(n) for n in names}).alias("narrative"))
    key = F.concat(F.lit("ntsb-"), "ev_id")
    return built.filter("narrative is not null and ev_id <> ''").select(
        key.alias("key"),
        key.alias("incident_id"),
        F.lit(ACCIDENT_SOURCE).alias("source"),
        "narrative",
        F.lit(None).cast("string").alias("risk_floor"),
    )


def fault_narrative(field: dict[str, Column]) -> Column:
    """Message or category or default, zone, postcodes and customers, as one line."""

    def part(value: Column) -> Column:
        return F.rtrim(strip(value), F.lit("."))

    opening = F.coalesce(
        _filled(strip(field["mainmessage"])),
        _filled(strip(field["incidentcategorycustomerfriendlydescription"])),
        F.lit(DEFAULT_FAULT_TEXT),
    )
    zone = _filled(strip(field["operatingzone"]))
    postcodes = _filled(strip(field["postcodesaffected"]))
    customers = field["nocustomeraffected"]
    return F.concat(
        F.concat_ws(
            ". ",
            part(opening),
            F.concat(F.lit("Affecting the "), zone, F.lit(" operating zone")),
            F.concat(F.lit("postcodes "), part(postcodes)),
            F.when(customers > 0, F.concat(customers.cast("string"), F.lit(" customers affected"))),
        ),
        F.lit("."),
    )


def flatten_faults(records: DataFrame) -> DataFrame:
    """The fault fields of records that are flat, under `fields`, or under `record.fields`."""
    present = {name: records.schema[name].dataType for name in records.columns}

    def struct_fields(dtype) -> list[str]:
        return dtype.fieldNames() if hasattr(dtype, "fieldNames") else []

    # The innermost container that is there is the record; its nulls are not filled from outside.
    containers = []
    record = present.get("record")
    if record is not None:
        if "fields" in struct_fields(record):
            containers.append(("record.fields", struct_fields(record["fields"].dataType)))
        containers.append(("record", struct_fields(record)))
    if struct_fields(present.get("fields")):
        containers.append(("fields", struct_fields(present["fields"])))

    def value(name: str) -> Column:
        out = F.col(name).cast("string") if name in present else F.lit(None).cast("string")
        for path, names in reversed(containers):
            inner = F.col(f"{path}.{name}").cast("string") if name in names else F.lit(None).cast("string")
            out = F.when(F.col(path).isNotNull(), inner).otherwise(out)
        return out

    fields = {name: value(name).alias(name) for name in schema.FAULT_FIELDS.fieldNames()}
    flat = records.select(*fields.values())
    count = F.coalesce(F.expr("try_cast(try_cast(nocustomeraffected as double) as bigint)"), F.lit(0))
    return flat.withColumn("nocustomeraffected", count)


def fault_incidents(records: DataFrame) -> DataFrame:
    """Unplanned cuts with a reference; many affected customers set a risk floor."""
    flat = flatten_faults(records).filter("lower(powercuttype) = 'unplanned' and incidentreference <> ''")
    key = F.concat(F.lit("ukpn-"), "incidentreference")
    return flat.select(
        key.alias("key"),
        key.alias("incident_id"),
        F.lit(FAULT_SOURCE).alias("source"),
        fault_narrative({n: F.col(n) for n in flat.columns}).alias("narrative"),
        customer_floor(F.col("nocustomeraffected")).alias("risk_floor"),
    )


def fault_rejects(records: DataFrame) -> DataFrame:
    """Records that give no incident, with the reason."""
    reason = F.when(F.coalesce(F.lower("powercuttype"), F.lit("")) != "unplanned", "not an unplanned cut").when(
        F.coalesce("incidentreference", F.lit("")) == "", "no reference"
    )
    return flatten_faults(records).withColumn("reason", reason).filter("reason is not null")


def accident_rejects(records: DataFrame) -> DataFrame:
    names = schema.ACCIDENT_RECORD.fieldNames()
    complete = _with_missing(records, names)
    reason = F.when(F.coalesce(strip(F.col("probable_cause")), F.lit("")) == "", "no cause").when(
        F.coalesce("ev_id", F.lit("")) == "", "no event id"
    )
    return complete.withColumn("reason", reason).filter("reason is not null")


def read_feed(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """Landed JSON records of a feed, one object per line; a line that is no JSON gives nulls."""
    layout = {"accident": schema.ACCIDENT_RECORD, "fault": schema.FAULT_RECORD}[kind]
    reader = spark.readStream if stream else spark.read
    return reader.schema(layout).option("mode", "PERMISSIVE").json(path)
