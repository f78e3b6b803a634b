"""From decoded recordings to the interim table: one row per sample of every trial."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions import labels
from strideframe.functions.names import (
    ACTIVITY,
    DIMENSIONS,
    INCLINE,
    LOCATIONS,
    MEASURES,
    SPEED,
    TIME,
    TRIAL,
    col,
    fill_location,
    is_selected,
    tidy_label,
)
from strideframe.operators.positions import sorted_index
from strideframe.storage import lookup_join, materialise, serialised_bytes

FILE_KEY = ["participant", "filename"]
PAIR = ["participant", "label"]


def read_recordings(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Decoded samples ``(frame, label, value, rate)`` below ``path/P<n>/<recording>.<fmt>``.

    Participant and file name come from each row's own path.
    """
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true").option("header", "true")
    rows = reader.schema(schema or "frame long, label string, value double, rate double").load(path)
    parts = F.split(F.col("_metadata.file_path"), "/")

    def plain(part: Column) -> Column:
        return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))

    name = plain(F.element_at(parts, -1))
    return rows.select(
        plain(F.element_at(parts, -2)).alias("participant"),
        F.regexp_replace(name, rf"\.{fmt}$", "").alias("filename"),
        *[col(c) for c in rows.columns],
    )


def list_recordings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(participant, filename, length) of every file below ``path/P<n>``, also of those that hold no sample.

    Only the listing is read, no file's content.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{fmt}")
    parts = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    return found.load(path).select(
        F.element_at(parts, -2).alias("participant"),
        F.regexp_replace(F.element_at(parts, -1), rf"\.{fmt}$", "").alias("filename"),
        "length",
    )


def recording_states(listing: DataFrame, samples: DataFrame, skip: Sequence[int] = ()) -> DataFrame:
    """(participant, filename, samples, TRIAL) of every recording of an activity that is listed or has samples.

    An empty recording has 0 samples and no TRIAL, so it takes no number from the others. ``listing`` may name a
    file in several rows. Samples are counted before they are shuffled; what is joined is one row per file.
    """
    counts = samples.groupBy(*FILE_KEY).agg(F.count("*").alias("samples"))
    files = materialise(listing.select(*FILE_KEY).distinct().join(counts, FILE_KEY, "full"))
    known = trial_files(files, skip)
    full = known.where("samples is not null")
    order = [F.col("participant_no"), F.col("participant"), F.col("filename")]
    numbered = sorted_index(full.select(*FILE_KEY, "participant_no"), order, "_index")
    numbers = numbered.select(*FILE_KEY, F.col("_index").cast("int").alias(TRIAL))
    return known.join(numbers, FILE_KEY, "left").select(
        *FILE_KEY, F.coalesce("samples", F.lit(0)).cast("long").alias("samples"), TRIAL
    )


def participants(files: DataFrame, skip: Sequence[int] = ()) -> DataFrame:
    """Participants ``P<n>`` in numeric order, without the skipped ones.

    Raises ``ValueError`` where no folder has such a name.
    """
    # Materialised, so that names are tested once per participant and not once per sample.
    return _participants(materialise(files.select("participant").distinct()), skip)


def _participants(found: DataFrame, skip: Sequence[int]) -> DataFrame:
    numbered = found.withColumn("participant_no", labels.participant_number(F.col("participant")))
    named = numbered.filter("participant_no is not null")
    if named.isEmpty():
        other = [r["participant"] for r in found.orderBy("participant").take(3)]
        raise ValueError(f"none of the folders is called P and a number, only for example {other}")
    return named.filter(_not_skipped(skip)).orderBy("participant_no", "participant")


def _not_skipped(skip: Sequence[int]) -> Column:
    return ~F.col("participant_no").isin(list(skip)) if skip else F.lit(True)


def trial_files(files: DataFrame, skip: Sequence[int] = ()) -> DataFrame:
    """Rows of valid, unskipped participants whose file is a recording of an activity."""
    return (
        files.withColumn("participant_no", labels.participant_number(F.col("participant")))
        .filter("participant_no is not null")
        .filter(_not_skipped(skip))
        .filter(labels.is_trial_file(F.col("filename")))
    )


def with_labels(files: DataFrame) -> DataFrame:
    """Activity, incline and speed of each file, from its name."""
    name = F.col("filename")
    return files.select(
        "*", labels.activity(name).alias(ACTIVITY), labels.incline(name).alias(INCLINE), labels.speed(name).alias(SPEED)
    )


def number_trials(files: DataFrame, skip: Sequence[int] = ()) -> DataFrame:
    """One row per recording with its TRIAL number, by participant number and then file name.

    ``files`` holds a row for every file that has samples (any number of rows per file), so an
    empty recording takes no number.
    """
    return _number_trials(materialise(files.select(*FILE_KEY).distinct()), skip)


def _number_trials(files: DataFrame, skip: Sequence[int]) -> DataFrame:
    recordings = trial_files(files, skip)
    order = [F.col("participant_no"), F.col("participant"), F.col("filename")]
    numbered = sorted_index(recordings, order, "_index")
    return numbered.select(*FILE_KEY, "participant_no", F.col("_index").cast("int").alias(TRIAL))


def normalised(
    label: Column, participant: Column, missing_locations: Mapping[int, str] | None, measures: Sequence[str]
) -> Column:
    """Lower-cased label, with the location this participant's labels lack."""
    lowered = F.lower(label)
    if not missing_locations:
        return lowered
    # One entry per participant folder, of which the name pattern allows a hundred.
    entries = [F.lit(x) for pair in missing_locations.items() for x in pair]
    return fill_location(lowered, F.create_map(*entries)[labels.participant_number(participant)], measures)


def label_names(
    pairs: DataFrame,
    missing_locations: Mapping[int, str] | None = None,
    measures: Sequence[str] = MEASURES,
    locations: Sequence[str] | None = None,
    dimensions: Sequence[str] = DIMENSIONS,
) -> DataFrame:
    """(participant, label, name) of distinct (participant, label) pairs.

    With ``locations`` only wanted channels are kept and their names are tidied, else every label
    keeps its normalised name. Names are worked out once per pair, not once per sample.
    """
    name = normalised(F.col("label"), F.col("participant"), missing_locations, measures)
    named = pairs.select("participant", "label", name.alias("name"))
    if locations is None:
        return named
    kept = named.filter(is_selected(F.col("name"), measures, locations, dimensions))
    return kept.withColumn("name", tidy_label(F.col("name")))


def _pairs(samples: DataFrame) -> DataFrame:
    """Distinct pairs, materialised so that name tests are not pushed down to the samples."""
    return materialise(samples.select(*PAIR).distinct())


def _rename(samples: DataFrame, names: DataFrame) -> DataFrame:
    spread = [F.col("filename"), F.col("frame")]
    renamed = lookup_join(samples, materialise(names), PAIR, spread, "inner")
    return renamed.select(*[F.col("name").alias(c) if c == "label" else col(c) for c in samples.columns])


def normalise_labels(
    samples: DataFrame, missing_locations: Mapping[int, str] | None = None, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Lower-case channel labels and name the location a participant's labels lack."""
    return _rename(samples, label_names(_pairs(samples), missing_locations, measures))


def select_samples(
    samples: DataFrame,
    missing_locations: Mapping[int, str] | None = None,
    measures: Sequence[str] = MEASURES,
    locations: Sequence[str] = LOCATIONS,
    dimensions: Sequence[str] = DIMENSIONS,
) -> DataFrame:
    """Samples of the wanted channels, under their normalised and tidied names."""
    return _rename(samples, label_names(_pairs(samples), missing_locations, measures, locations, dimensions))


def first_trial_channels(channels: DataFrame) -> list[str]:
    """Channel names of the first trial: they become the columns of the table."""
    first = channels.agg(F.min(TRIAL)).first()[0]
    if first is None:
        return []
    return sorted(r["name"] for r in channels.filter(F.col(TRIAL) == first).select("name").collect())


def channel_differences(trials: DataFrame, channels: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(TRIAL, channel, difference): channels of ``wanted`` that a trial lacks are ``missing``, others it has are ``extra``.

    ``channels`` are (TRIAL, name). A trial's names form one set (as many as a recording has labels), and the two
    set differences are taken in its row; a trial without any channel lacks all.
    """
    held = channels.groupBy(TRIAL).agg(F.collect_set("name").alias("_held"))
    none = F.array().cast("array<string>")
    expected = F.array(*[F.lit(c) for c in wanted]) if wanted else none
    sets = trials.select(TRIAL).join(held, TRIAL, "left").withColumn("_held", F.coalesce("_held", none))
    lacking = F.transform(F.array_except(expected, "_held"), lambda c: F.struct(c.alias("c"), F.lit("missing").alias("d")))
    besides = F.transform(F.array_except("_held", expected), lambda c: F.struct(c.alias("c"), F.lit("extra").alias("d")))
    found = sets.select(TRIAL, F.explode(F.concat(lacking, besides)).alias("_x"))
    return found.select(TRIAL, F.col("_x.c").alias("channel"), F.col("_x.d").alias("difference"))


def check_channels(differences: DataFrame) -> None:
    """Raise ``ValueError`` where a trial lacks a wanted channel; extra channels are dropped later."""
    short = differences.filter("difference = 'missing'").orderBy(TRIAL, "channel").take(5)
    if short:
        trials = sorted({r[TRIAL] for r in short})
        raise ValueError(f"trials {trials} lack some of the channels, for example {[r['channel'] for r in short]}")


def widen(samples: DataFrame, channels: Sequence[str], compat_time: bool = False) -> DataFrame:
    """One row per (TRIAL, frame) with a column per channel; NaN samples become NULL.

    ``samples`` name their channel by its number ``_i``. The samples of a frame become one map; the
    maps are built before the shuffle too, and wide rows come into being only behind it. (A
    conditional aggregate per channel generates code too large to compile, and a pivot shuffles its
    wide buffers.) A channel that a frame holds twice is an error.
    """
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    frames = samples.groupBy(TRIAL, "frame", "rate").agg(
        F.map_from_entries(F.collect_list(F.struct("_i", value.alias("v")))).alias("_samples")
    )
    wide = frames.select(TRIAL, "frame", "rate", *[F.col("_samples")[i].alias(c) for i, c in enumerate(channels)])
    time = labels.time_ms(F.col("frame"), F.col("rate"), compat_time)
    return wide.select(TRIAL, time.alias(TIME), *[col(c) for c in channels])


@dataclass
class Ingest:
    """What an ingest gives: a row per trial (participant, filename, TRIAL, labels), the columns of the table, how trials'
    channels differ from them, and the interim table."""

    trials: DataFrame
    columns: list[str]
    differences: DataFrame
    table: DataFrame


def ingest_parts(
    samples: DataFrame,
    skip_participants: Sequence[int] = (),
    missing_locations: Mapping[int, str] | None = None,
    measures: Sequence[str] = MEASURES,
    locations: Sequence[str] = LOCATIONS,
    dimensions: Sequence[str] = DIMENSIONS,
    channels: Sequence[str] | None = None,
    compat_time: bool = False,
    first_trial: int = 0,
    strict: bool = True,
) -> Ingest:
    """Ingest of decoded samples with its side tables; see ``ingest_trials``. TRIAL counts from ``first_trial``.

    Where ``strict`` is off a trial that lacks channels is no error: it keeps NULLs there and ``differences`` names them.
    """
    contents = materialise(samples.select(*FILE_KEY, "label").distinct())
    _participants(contents.select("participant").distinct(), skip_participants)
    numbered = _number_trials(contents.select(*FILE_KEY).distinct(), skip_participants)
    trials = materialise(with_labels(numbered.withColumn(TRIAL, F.col(TRIAL) + F.lit(first_trial))))
    pairs = contents.select(*PAIR).distinct()
    names = materialise(label_names(pairs, missing_locations, measures, locations, dimensions))
    size = serialised_bytes(trials)
    known = lookup_join(contents, names, PAIR, [F.col("filename")], "inner")
    known = lookup_join(known, trials.select(*FILE_KEY, TRIAL), FILE_KEY, [F.col("label")], "inner", size=size)
    held = materialise(known.select(TRIAL, "name").distinct())
    columns = list(channels) if channels is not None else first_trial_channels(held)
    differences = channel_differences(trials, held, columns)
    if strict:
        check_channels(differences)

    # As many rows as the table has columns.
    places = samples.sparkSession.createDataFrame([(c, i) for i, c in enumerate(columns)], "name string, _i int")
    numbers = materialise(names.join(F.broadcast(places), "name").select(*PAIR, "_i"))
    spread = [F.col("frame"), F.col("value")]
    wanted = lookup_join(samples, numbers, PAIR, spread, "inner")
    wanted = lookup_join(wanted, trials.select(*FILE_KEY, TRIAL), FILE_KEY, spread, "inner", size=size)
    wide = widen(wanted, columns, compat_time)
    trial_labels = trials.select(TRIAL, ACTIVITY, INCLINE, SPEED)
    table = lookup_join(wide, trial_labels, [TRIAL], [F.col(TIME)], "inner", size=size)
    return Ingest(trials, columns, differences, table)


def ingest_trials(
    samples: DataFrame,
    skip_participants: Sequence[int] = (),
    missing_locations: Mapping[int, str] | None = None,
    measures: Sequence[str] = MEASURES,
    locations: Sequence[str] = LOCATIONS,
    dimensions: Sequence[str] = DIMENSIONS,
    channels: Sequence[str] | None = None,
    compat_time: bool = False,
) -> DataFrame:
    """Interim table of decoded samples ``(participant, filename, frame, label, value, rate)``.

    Columns: TRIAL, TIME, one per channel (those of the first trial unless given), ACTIVITY,
    INCLINE, SPEED. Later trials are laid on those columns: extra ones are dropped
    (``ingest_parts`` names them), a missing one is an error.

    Two passes: the first reads only the distinct (participant, filename, label) and settles trial
    numbers, channel names and columns on that small table; the second reads the samples, looks up
    two numbers per sample and shuffles once by (TRIAL, frame).
    """
    return ingest_parts(
        samples, skip_participants, missing_locations, measures, locations, dimensions, channels, compat_time
    ).table


def process_recordings(samples: DataFrame, output_path: str, **options) -> None:
    """Raw recordings to interim Parquet."""
    ingest_trials(samples, **options).write.mode("overwrite").parquet(output_path)
