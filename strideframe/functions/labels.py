"""Trial labels from file names, and sample times from frame numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Activity words in search order, file rules, number patterns.
ACTIVITY_WORDS = ("walk", "jog", "run", "jump")
RECORDING_SUFFIX = ".c3d"
EXCLUDED_WORD = "transition"
PARTICIPANT_PATTERN = r"^P\d{1,2}$"
INCLINE_PATTERN = r"(\d+)(\s*|_*)incline"
DECLINE_PATTERN = r"(\d+)(\s*|_*)decline"
SPEED_PATTERN = r"(\d+)_(\d+)ms"


def _number(text: Column, pattern: str, group: int) -> Column:
    """Matched digits or NULL; an empty match must not reach an ANSI cast."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def activity_word(filename: Column, words: Sequence[str] = ACTIVITY_WORDS) -> Column:
    """First word, in list order, found in the lower-cased name."""
    lowered = F.lower(filename)
    return F.coalesce(*[F.when(lowered.contains(word), F.lit(word)) for word in words])


def activity(filename: Column, words: Sequence[str] = ACTIVITY_WORDS) -> Column:
    """Activity of a trial; jogging counts as running."""
    word = activity_word(filename, words)
    return F.when(word == "jog", F.lit("run")).otherwise(word)


def incline(filename: Column) -> Column:
    """Signed incline: NULL for jumps, negative for a decline, 0 where none is named.

    ``incline`` is tested before ``decline``; a name that holds the word without a number is 0.
    """
    name = F.lower(filename)
    up = F.coalesce(_number(name, INCLINE_PATTERN, 1).cast("int"), F.lit(0))
    down = F.coalesce(-_number(name, DECLINE_PATTERN, 1).cast("int"), F.lit(0))
    return (
        F.when(name.contains("jump"), F.lit(None).cast("int"))
        .when(name.contains("incline"), up)
        .when(name.contains("decline"), down)
        .otherwise(F.lit(0))
        .cast("smallint")
    )


def speed(filename: Column) -> Column:
    """``2_5ms`` -> 2.5; the unit is matched in lower case only."""
    whole = _number(filename, SPEED_PATTERN, 1)
    fraction = _number(filename, SPEED_PATTERN, 2)
    return F.concat(whole, F.lit("."), fraction).cast("float")


def is_trial_file(filename: Column, words: Sequence[str] = ACTIVITY_WORDS) -> Column:
    """Recordings of an activity; calibration and transition files are left out."""
    return (
        filename.endswith(RECORDING_SUFFIX)
        & activity_word(filename, words).isNotNull()
        & ~F.lower(filename).contains(EXCLUDED_WORD)
    )


def participant_number(participant: Column) -> Column:
    """Number of a ``P<n>`` folder, NULL for any other name."""
    return F.when(
        participant.rlike(PARTICIPANT_PATTERN), F.regexp_extract(participant, r"^P(\d+)$", 1)
    ).cast("int")


def time_ms(frame: Column, rate: Column, compat: bool = False) -> Column:
    """Frame number to whole milliseconds.

    The exact form multiplies first, so one division is rounded once and ``floor`` is right for
    every whole rate. ``compat`` divides first and truncates, which loses a millisecond on some
    frames (1001 at 1,000 Hz gives 1000), as data written by the older tool has it.
    """
    if compat:
        return (frame.cast("double") / rate.cast("double") * F.lit(1000)).cast("long")
    return F.floor((frame.cast("long") * F.lit(1000)).cast("double") / rate.cast("double")).cast("long")
