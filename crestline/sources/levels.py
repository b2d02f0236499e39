"""Where levels come from: an analyser's text lines, files of them, or an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.sources.selectors import select_formats

#: The format of an analyser's line, a time and a momentary level; the choice of formats; the keys of a saved configuration.
LEVEL_LINE = r"t:\s*([\d.]+).*?M:\s*(-?[\d.]+|-?inf|nan)"
SELECTOR = "bv*[height<={height}]+ba/b[height<={height}]/b"
LINES = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("line", T.StringType())])
CONFIG = T.StructType([T.StructField(n, T.StringType()) for n in ("nombre", "logo", "salida")])


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Text files as (series_id, line), one series per file, known by its path; a file is split over tasks as it needs."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return _by_path(reader.text(path))


def stream_lines(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream of the files that come into a folder or match a pattern."""
    reader = spark.readStream
    for name, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", files_per_trigger)):
        reader = reader.option(name, value) if value is not None else reader
    return _by_path(reader.text(path))


def _by_path(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("series_id"), F.col("value").alias("line"))


def clean_level(level: Column, floor: float = -70.0) -> Column:
    """The level, or ``floor`` for null, NaN and the infinities."""
    return F.when(level.isNull() | F.isnan(level) | (F.abs(level) == float("inf")), F.lit(floor)).otherwise(level)


def parsed(lines: DataFrame, *more: Column, floor: float = -70.0) -> DataFrame:
    """series_id, t, level and ``more`` of every line; t and level are null where it isn't in the analyser's format."""
    # of a line in another format the groups are empty, and so no number
    t, m = (F.regexp_extract("line", LEVEL_LINE, i).try_cast("double") for i in (1, 2))
    found = lines.select("series_id", t.alias("t"), m.alias("m"), *more)
    level = F.when(F.col("t").isNotNull(), clean_level(F.col("m"), floor))
    return found.select("series_id", "t", level.alias("level"), *found.columns[3:])


def parse_lines(lines: DataFrame, floor: float = -70.0) -> DataFrame:
    """(series_id, t, level) of the lines in the analyser's format; others are left out.

    A level that isn't a finite number is ``floor``. A time that isn't a number,
    such as 1.2.3, makes a line void.
    """
    return parsed(lines, floor=floor).where("t IS NOT NULL")


def from_events(events: DataFrame, origin: str = "2024-01-01 00:00:00", series: str = "event_type", at: str = "ts", level: str = "value", floor: float = -70.0) -> DataFrame:
    """(series_id, t, level) of an event table; t is seconds since ``origin``, and earlier events are left out.

    The origin is explicit, since series start at 0 and gaps from there on are filled.
    """
    start = F.expr(f"TIMESTAMP_NTZ '{origin}'")
    t = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{origin}', `{at}`)") / 1e6
    # the time is compared as it is stored, so that Parquet leaves out what is earlier
    return events.where(F.col(at) >= start).select(F.col(series).alias("series_id"), t.alias("t"), clean_level(F.col(level).cast("double"), floor).alias("level"))


def at_origin(samples: DataFrame, origin: str = "2024-01-01 00:00:00") -> DataFrame:
    """(series_id, ts, level) of samples whose t is seconds since ``origin``; times that no timestamp can hold are left out."""
    start = F.unix_micros(F.expr(f"TIMESTAMP '{origin}'"))
    within = samples.where((F.col("t") >= 0) & (F.col("t") < 2.0e11))
    return within.select("series_id", F.timestamp_micros(start + (F.col("t") * 1e6).cast("bigint")).alias("ts"), "level")


def parse_config(rows: DataFrame, json_col: str, default_output: str = "") -> DataFrame:
    """The columns nombre, logo and salida of a JSON column, and all others.

    Missing keys are empty, but salida is ``default_output`` then, where it is empty,
    and for text that isn't a JSON object, of which nothing is known.
    """
    got = F.from_json(F.col(json_col), CONFIG, {"mode": "PERMISSIVE"})
    value = {n: F.coalesce(got[n], F.lit("")) for n in CONFIG.names}
    value["salida"] = F.when(value["salida"] == "", F.lit(default_output)).otherwise(value["salida"])
    return rows.select("*", *(value[n].alias(n) for n in CONFIG.names))


def config_text(nombre: Column, logo: Column, salida: Column) -> Column:
    """A configuration as JSON text: two spaces before each key, characters as they are, null as an empty string."""

    def quoted(value: Column) -> Column:
        wrapped = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
        return wrapped.substr(F.lit(6), F.length(wrapped) - 6)

    lines = [F.concat(F.lit(f'  "{key}": '), quoted(value)) for key, value in zip(CONFIG.names, (nombre, logo, salida), strict=True)]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def choose_formats(formats: DataFrame, hd: bool = False) -> DataFrame:
    """(entry, choice, video_id, audio_id): the best formats of each entry that fit a height of 1080 if ``hd``, else 720.

    ``formats``: entry, format_id, height, bitrate, has_video, has_audio. First choice
    is the best video within the height with the best audio; then the best format
    with both within the height; then the best with both. Better is higher, then of
    the larger bitrate, then the smaller id. Entries without any have null ids.
    """
    found = select_formats(formats, SELECTOR.format(height=1080 if hd else 720))
    paired = F.col("alternative") == 1
    return found.select(
        "entry",
        F.when(paired, "video+audio").when(F.col("alternative") == 2, "fitting").when(F.col("alternative") == 3, "combined").otherwise("none").alias("choice"),
        F.col("format_ids")[0].alias("video_id"),
        F.when(paired, F.col("format_ids")[1]).alias("audio_id"),
    )
