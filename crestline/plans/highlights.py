"""The whole detection as one plan, and what follows from its peaks: clips, reports, filters, commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.text import clock, escape_text, file_clock, tenths
from crestline.operators import series as S
from crestline.operators.rounds import chosen_peaks
from crestline.params import DetectParams

#: Filter graph sources, sizes (font, x, y, logo height), file names and messages of the output format,
#: and the encoder's arguments in render_command.
VERTICAL = (
    "[0:v]scale=1080:1920:force_original_aspect_ratio=increase,crop=1080:1920,gblur=sigma=25[bg];"
    "[0:v]scale=1080:-2[fg];[bg][fg]overlay=(W-w)/2:(H-h)/2[v]"
)
HORIZONTAL = "[0:v]null[v]"
SIZES_VERTICAL = (48, 40, 60, 110)
SIZES_HORIZONTAL = (36, 30, 40, 80)
NO_DETAIL = "sin detalle de FFmpeg"
TITLE = "Momentos detectados (mejor primero):"


def scores(samples: DataFrame, p: DetectParams = DetectParams()) -> tuple[DataFrame, DataFrame]:
    """(the series' states, the scores of those that are long enough, by runs) of raw samples."""
    buckets = S.bucket_max(samples, p)
    states = S.observed(buckets, p)
    long_enough = buckets.join(states.where("status = 'ok'").select("series_id", "n"), "series_id")
    return states, S.scored(S.smooth_runs(long_enough, p))


def detect(samples: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """(series_id, rank, second, score): every series' peaks, best first. Series that are too short have none."""
    return chosen_peaks(S.candidates(scores(samples, p)[1], p), p)


def statuses(samples: DataFrame, p: DetectParams = DetectParams(), strict: bool = False) -> DataFrame:
    """(series_id, status): ok, too_short or no_peaks; one bad series doesn't fail the others.

    ``strict`` raises ValueError instead if any isn't ok.
    """
    states, scored = scores(samples, p)
    high = S.candidates(scored, p).select("series_id").distinct().withColumn("found", F.lit(True))
    out = states.join(high, "series_id", "left").select("series_id", F.when(F.col("status") != "ok", F.col("status")).when(F.col("found"), "ok").otherwise("no_peaks").alias("status"))
    if strict and (bad := out.where("status <> 'ok'").limit(5).collect()):
        raise ValueError(f"series without peaks, the first of them: {[(r.series_id, r.status) for r in bad]}")
    return out


def completion(samples: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """(series_id, status, clips): how many clips each series gets, and why if there are none."""
    states, scored = scores(samples, p)
    counts = chosen_peaks(S.candidates(scored, p), p).groupBy("series_id").agg(F.count(F.lit(1)).alias("clips"))
    found = states.join(counts, "series_id", "left").withColumn("clips", F.coalesce("clips", F.lit(0).cast("long")))
    return found.select("series_id", F.when(F.col("status") != "ok", F.col("status")).when(F.col("clips") > 0, "ok").otherwise("no_peaks").alias("status"), "clips")


def clip_plan(peaks: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """The peaks with clip_start, duration and file_name; the end isn't cut to the recording's."""
    start = F.greatest(F.lit(0).cast("bigint"), F.col("second") - int(p.duration * p.lead))
    rank = F.lpad(F.col("rank").cast("string"), F.greatest(F.lit(2), F.length(F.col("rank").cast("string"))), "0")
    out = peaks.select("series_id", "rank", "second", "score", start.alias("clip_start"), F.lit(p.duration).alias("duration"))
    return out.withColumn("file_name", F.concat(F.lit("clip_"), rank, F.lit("_min_"), file_clock(F.col("clip_start")), F.lit(".mp4")))


def summary(peaks: DataFrame) -> DataFrame:
    """(series_id, rank, line): a sentence on each peak."""
    rank = F.lpad(F.col("rank").cast("string"), F.greatest(F.lit(2), F.length(F.col("rank").cast("string"))), "0")
    line = F.concat(F.lit("clip_"), rank, F.lit(": momento "), clock(F.col("second")), F.lit(" del VOD ("), tenths(F.col("score")), F.lit(" dB sobre lo normal)"))
    return peaks.select("series_id", "rank", line.alias("line"))


def report(summaries: DataFrame, title: str = TITLE) -> DataFrame:
    """(series_id, text): each series' report: a title, an empty line, a line per clip, and a line break at the end."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    return summaries.groupBy("series_id").agg(F.concat(F.lit(title + "\n\n"), lines, F.lit("\n")).alias("text"))


def render_filter(vertical: Column, name: Column, with_logo: Column, font: Column, default_font: str | None = None) -> Column:
    """The filter graph of a request; a null font means the default one, an empty one none."""
    font = F.coalesce(font, F.lit(default_font or ""))

    def graph(base: str, sizes: tuple[int, int, int, int]) -> Column:
        size, x, y, logo = sizes
        overlay = F.when(with_logo, f";[1:v]scale=-1:{logo}[lg];[v][lg]overlay=W-w-{x}:{y}[v2]").otherwise("")
        at = F.when(with_logo, "[v2]").otherwise("[v]")
        font_part = F.when(font == "", "").otherwise(F.concat(F.lit("fontfile='"), F.replace(font, F.lit(":"), F.lit("\\:")), F.lit("':")))
        text = F.concat(F.lit("drawtext="), font_part, F.lit("text='"), escape_text(name), F.lit(f"':fontsize={size}:fontcolor=white:borderw=3:bordercolor=black:x={x}:y={y}[out]"))
        return F.concat(F.lit(base), overlay, F.lit(";"), at, F.when(F.coalesce(name, F.lit("")) == "", "null[out]").otherwise(text))

    return F.when(vertical, graph(VERTICAL, SIZES_VERTICAL)).otherwise(graph(HORIZONTAL, SIZES_HORIZONTAL))


def render_command(video: Column, start: Column, duration: Column, filters: Column, output: Column, logo: Column | None = None) -> Column:
    """The encoder's arguments as an array of strings, for a renderer elsewhere; nothing is run here."""
    words = lambda *xs: F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    logo_part = F.array().cast("array<string>") if logo is None else F.when(F.coalesce(logo, F.lit("")) != "", words("-i", logo)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        words("ffmpeg", "-hide_banner", "-loglevel", "error", "-y", "-ss", start.cast("string"), "-i", video),
        logo_part,
        words("-t", duration.cast("string"), "-filter_complex", filters, "-map", "[out]", "-map", "0:a?"),
        words("-c:v", "libx264", "-preset", "veryfast", "-crf", "23", "-c:a", "aac", "-b:a", "160k", "-movflags", "+faststart", output),
    )


def write_clip_plan(plan: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One row per clip as Parquet."""
    plan.write.mode(mode).parquet(path)


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text per series, in a folder of the series' name."""
    value = F.regexp_replace("text", "\n$", "")  # the writer ends a row with a line break
    reports.select("series_id", value.alias("value")).write.mode(mode).partitionBy("series_id").text(path)
