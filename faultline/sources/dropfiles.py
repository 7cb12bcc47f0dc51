"""Drop-folder files: forgiving CSV (unquoted commas stay in the narrative) and one-report TXT.

A CSV is read line by line, so a huge file is split over many tasks. The number of a record inside its
file comes from the position in the task and one small count per file block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import strip
from faultline.session import materialise, scratch, shared_folder
from faultline.sources import linework

CSV_GLOB = "*.[cC][sS][vV]"
TXT_GLOB = "*.[tT][xX][tT]"
# Options of Spark's writer for files that `read_csv` gives back as they were.
CSV_WRITER = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
NARRATIVE_HEADERS = ("narrative", "text", "report")
# Every field is preceded by a comma (one is put in front of the line): a quoted field and what
# follows it up to the next comma, or anything without a comma.
FIELD = r',("[^"]*(?:""[^"]*)*"[^,]*|[^,]*)'
# A quoted part that is closed on its line; doubled quotes are never taken for the closing one.
CLOSED = r'"[^"]*+(?:""[^"]*+)*+"'
PARTS = "file_path string, file_name string, run bigint, pos bigint, record bigint, whole boolean, line string"
QUOTED_FIELD = r'^"([^"]*(?:""[^"]*)*)"(.*)$'


def _wanted(df: DataFrame) -> DataFrame:
    """Documentation and hidden files are no incidents."""
    return df.filter(~F.lower("file_name").startswith("readme") & ~F.col("file_name").startswith("."))


def _reader(spark: SparkSession, stream: bool, max_files: int | None):
    if not stream:
        return spark.read
    return spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)


def read_lines(
    spark: SparkSession, folder: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """Lines of the CSV files of a folder with the file and block they come from."""
    reader = _reader(spark, stream, max_files)
    lines = reader.format("text").option("pathGlobFilter", CSV_GLOB).load(folder)
    return _wanted(
        lines.select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )


def read_texts(
    spark: SparkSession, folder: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """Whole TXT files, one report each."""
    reader = _reader(spark, stream, max_files)
    texts = reader.format("text").option("wholetext", True).option("pathGlobFilter", TXT_GLOB).load(folder)
    return _wanted(texts.select("value", F.col("_metadata.file_name").alias("file_name")))


def _ends_inside(line: Column) -> Column:
    """Whether a line that starts outside a quoted field ends inside one."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f",({CLOSED}[^,]*|[^,]*)"), 1)
    return F.exists(fields, lambda f: f.startswith('"') & ~f.rlike(f"^{CLOSED}"))


def _line_states(lines: DataFrame) -> DataFrame:
    """Lines with their place in a run of a file block and their state for either state the run may start in; written."""
    linework.travel_with_tasks()
    states = linework.with_states
    quote = F.contains("line", F.lit('"'))
    opened, closed = _ends_inside(F.col("line")), _ends_inside(F.concat(F.lit('"'), "line"))
    # The two bits of a change: linework.OUTSIDE, SAME, FLIP, INSIDE. A line without a quote leaves the state as it is.
    change = F.when(~quote, linework.SAME).otherwise(opened.cast("int") * 2 + closed.cast("int"))
    placed = lines.select(
        "file_path", "file_name", "block", "line", F.monotonically_increasing_id().alias("_at"), change.alias("_change")
    )
    layout = f"file_path string, file_name string, block bigint, line string, {linework.STATES}"
    return materialise(placed.mapInArrow(lambda batches: states(batches), layout), "drop-lines")


def _record_parts(lines: DataFrame) -> DataFrame:
    """Records, or what of them lies in one run of lines, in the columns PARTS."""
    states = _line_states(lines)
    # Numbers alone, the last line's states in the lowest bits of its place: a hash aggregate, without a sort.
    ends = states.groupBy("file_path", "block", "run").agg(
        F.max(F.col("pos") * 4 + F.col("out0") * 2 + F.col("out1")).alias("_last"),
        F.max("starts0").alias("starts0"),
        F.max("starts1").alias("starts1"),
    )
    end = F.col("_last") % 4
    ends = ends.withColumns({"_set": F.when(end == 0, 0).when(end == 3, 1), "_flip": (end == 2).cast("int")})
    in_file = Window.partitionBy("file_path").orderBy("block", "run")
    runs = _before(ends, in_file, F.lit(0), "_entry")
    starts = F.when(F.col("_entry") == 1, F.col("starts1")).otherwise(F.col("starts0"))
    runs = materialise(runs.select("run", "_entry", (F.sum(starts).over(in_file) - starts).alias("_earlier")), "drop-runs")

    def known(name: str) -> Column:
        return F.when(F.col("_entry") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    placed = states.join(runs, "run").select(
        "file_path",
        "file_name",
        "run",
        "pos",
        (F.col("_earlier") + known("starts") - 1).alias("record"),
        known("in").alias("inside"),
        known("out").alias("goes_on"),
        "line",
    )
    together = linework.joined
    return placed.mapInArrow(lambda batches: together(batches), PARTS)


def whole_records(lines: DataFrame) -> DataFrame:
    """(file_path, file_name, pos, line) of the records of files: a line break inside quotes does not end one; written.

    A line either leaves the state as it is, flips it, or ends in one state whatever came before. So a run of
    lines has one end for each state it may start in, which a task finds as it reads the run. The few runs of a
    file are then put in order, which gives the state each one starts in and the records before it. Lines of one
    record are put together where they lie; only records that go on in another run are brought together.
    """
    spark, path = lines.sparkSession, shared_folder(lines.sparkSession, "drop-records")
    with scratch(spark):
        # The lines and their states go when the records are written.
        _record_parts(lines).write.parquet(path)
    parts = spark.read.schema(PARTS).parquet(path)
    entry = F.array_sort(F.collect_list(F.struct("run", "pos", "line")))
    split = (
        parts.filter("not whole")
        .groupBy("file_path", "file_name", "record")
        .agg(F.array_join(F.transform(entry, lambda e: e["line"]), "\n").alias("line"))
    )
    columns = ["file_path", "file_name", F.col("record").alias("pos"), "line"]
    return parts.filter("whole").select(*columns).unionByName(split.select(*columns))


def _before(rows: DataFrame, order, initial: Column, out: str) -> DataFrame:
    """State before each row (0 outside, 1 inside a quoted field) from `_set` and `_flip` of the rows before.

    A row has only one of them.
    """
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = rows.withColumn("_sum", F.sum("_flip").over(up_to))
    marks = flips.withColumn("_mark", F.when(F.col("_set").isNotNull(), F.struct("_set", F.col("_sum").alias("_at"))))
    last = F.last("_mark", ignorenulls=True).over(past)
    found = marks.withColumns({"_last_mark": last, "_past": F.coalesce(F.sum("_flip").over(past), F.lit(0))})
    state = F.coalesce(F.col("_last_mark._set"), initial) + F.col("_past") - F.coalesce("_last_mark._at", F.lit(0))
    return found.withColumn(out, F.pmod(state, F.lit(2)).cast("int")).drop("_sum", "_mark", "_last_mark", "_past")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files under the header of the first one, all columns strings.

    Quoted line breaks are kept, yet a big file is read by many tasks. As in Spark's reader blank lines
    are left out and an empty field, quoted or not, is null.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    records = whole_records(placed).withColumn("line", F.regexp_replace("line", "\r$", ""))
    plain = F.regexp_replace("line", "^\ufeff", "")
    header = records.filter("pos = 0").orderBy("file_path").select(csv_fields(plain).alias("names")).first()
    given = header["names"] if header else []
    names = [name if name and name not in given[:i] else f"_c{i}" for i, name in enumerate(given)]
    if not names:
        return spark.createDataFrame([], T.StructType())
    layout = ", ".join("`" + name.replace("`", "``") + "` string" for name in names)
    rows = records.filter(F.col("pos") > 0).filter(F.trim("line") != "")
    fields = F.from_csv("line", layout, {"quote": '"', "escape": '"'})
    return rows.select(fields.alias("_fields")).select("_fields.*")


def csv_fields(line: Column) -> Column:
    """Fields of a CSV line, trimmed; a field may be quoted, doubled quotes inside it."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), 1)

    def value(field: Column) -> Column:
        inner = F.replace(F.regexp_extract(field, QUOTED_FIELD, 1), F.lit('""'), F.lit('"'))
        unquoted = F.concat(inner, F.regexp_extract(field, QUOTED_FIELD, 2))
        return strip(F.when(field.rlike(QUOTED_FIELD), unquoted).otherwise(field))

    return F.transform(raw, value)


def parse_lines(numbered: DataFrame) -> DataFrame:
    """Incidents of numbered CSV lines; line 0 of each file is its header, an empty one ends it.

    The narrative runs from its column to the end of the row. An id is the `id` field or, when
    that is absent or blank, the file's stem and the row number, which counts blank rows too.
    """
    names = F.transform(csv_fields(F.col("line")), lambda name: F.lower(name))
    headers = (
        numbered.filter("pos = 0 and line <> ''")
        .select("file_path", names.alias("_names"))
        .select(
            "file_path",
            F.greatest(
                F.array_position(F.transform("_names", lambda n: n.isin(*NARRATIVE_HEADERS)), True), F.lit(1)
            ).alias("_text_at"),
            F.array_position("_names", "id").alias("_id_at"),
        )
    )
    rows = numbered.filter("pos > 0").withColumn("_fields", csv_fields(F.col("line")))
    rows = rows.join(materialise(headers, "drop-headers"), "file_path")
    tail = F.slice("_fields", F.col("_text_at").cast("int"), F.size("_fields") + 1)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    given = F.when(F.col("_id_at") > 0, F.get("_fields", F.col("_id_at").cast("int") - 1))
    incidents = rows.select(
        "file_name",
        "pos",
        F.coalesce(F.nullif(given, F.lit("")), F.concat(stem, F.lit("-row"), F.col("pos").cast("string"))).alias(
            "incident_id"
        ),
        F.array_join(F.filter(tail, lambda part: part != ""), " ").alias("narrative"),
    )
    return incidents.filter("narrative <> '' and lower(narrative) not in ('nan', 'none')")


def _as_incident(df: DataFrame, arrival: Column) -> DataFrame:
    return df.select(
        F.col("incident_id").alias("key"),
        "incident_id",
        F.concat(F.lit("watch/"), "file_name").alias("source"),
        "narrative",
        F.lit(None).cast("string").alias("risk_floor"),
        arrival.alias("arrival"),
    )


def csv_incidents(lines: DataFrame) -> DataFrame:
    arrival = F.concat_ws("|", "file_name", F.lpad(F.col("pos").cast("string"), 19, "0"))
    return _as_incident(parse_lines(whole_records(lines)), arrival)


def txt_incidents(texts: DataFrame) -> DataFrame:
    rows = texts.select("file_name", F.col("file_name").alias("incident_id"), strip(F.col("value")).alias("narrative"))
    return _as_incident(rows.filter("narrative <> ''"), F.col("file_name"))


def mixed_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """CSV lines and TXT files of a watched folder as one stream."""
    lines = read_lines(spark, folder, True, max_files).withColumn("value", F.lit(None).cast("string"))
    texts = read_texts(spark, folder, True, max_files).withColumns(
        {
            "line": F.lit(None).cast("string"),
            "file_path": F.lit(None).cast("string"),
            "block": F.lit(None).cast("bigint"),
        }
    )
    return lines.unionByName(texts)


def mixed_incidents(batch: DataFrame) -> DataFrame:
    """Incidents of one batch of `mixed_stream`."""
    lines = batch.filter("line is not null").drop("value")
    texts = batch.filter("line is null").select("file_name", "value")
    return csv_incidents(lines).unionByName(txt_incidents(texts))
