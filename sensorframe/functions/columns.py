"""Scalar column expressions: casts, keys, labels and path parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorframe.schema import BLOCKS

# File-name patterns of the recordings.
TIMESTAMP_PATTERN = r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}\.\d{3})"
FRAME_PATTERN = r"(?i)(?:frame_|_)(\d+)(?:_Color)?\.(?:jpg|jpeg|png|json)$"
ACTION_PATTERN = r"^(\d+)_(.+)$"
DECIMAL_PATTERN = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
# A whole date, then at most a time and an offset.
MOMENT_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
IGNORED_NAMES = ("settings.local.json", "Thumbs.db")


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def safe_float(text: Column) -> Column:
    """Number in decimal text (digit groups may be joined by underscores), NULL when it is not a finite number."""
    given = F.trim(text.cast("string"))
    return F.when(given.rlike(DECIMAL_PATTERN), finite(F.replace(given, F.lit("_"), F.lit("")).try_cast("double")))


def epoch_seconds(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / F.lit(1e6)


def known_time(text: Column) -> Column:
    """The moment that ISO text with a whole date names; NULL for years, bare times and other text."""
    given = F.trim(text)
    # hours or minutes alone and a comma before the fraction are ISO, but the cast reads them in full only
    full = F.regexp_replace(given, ",", ".")
    full = F.regexp_replace(full, r"^(.{10}[T ]\d{2})(Z|[+-]|$)", "$1:00$2")
    full = F.regexp_replace(full, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")
    return F.when(given.rlike(MOMENT_PATTERN), F.try_to_timestamp(full))


def parse_time(text: Column, sequence: Column) -> Column:
    """Epoch seconds of an ISO timestamp with a whole date, else the row's sequence number."""
    return F.coalesce(epoch_seconds(known_time(text)), sequence.cast("double"))


def natural_key(text: Column) -> Column:
    """Sortable parts of text: digit runs compare as numbers, the rest in lower case.

    Parts alternate text, digits, text, ... so equal positions always compare alike. Digit runs
    lose leading zeros and carry their length in front, which orders numbers of any size.
    """
    given = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.regexp_extract_all(given, F.lit(r"(\d+|[^\d]+)"), F.lit(1))
    parts = F.when(given.rlike(r"^\d"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)

    def comparable(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.when(
            part.rlike(r"^\d+$"), F.concat(F.lpad(F.length(digits).cast("string"), 8, "0"), digits)
        ).otherwise(F.lower(part))

    return F.transform(parts, comparable)


def pretty_label(name: Column) -> Column:
    """Action name for display: no numeric prefix, blanks for underscores."""
    text = name.cast("string")
    bare = F.when(text.rlike(r"^\d+_"), F.regexp_replace(text, r"^\d+_", "")).otherwise(text)
    return F.coalesce(F.translate(bare, "_", " "), F.lit("Unknown"))


def prediction_label(action_id: Column, name: Column) -> Column:
    return F.concat(
        F.lpad(action_id.cast("string"), F.greatest(F.lit(2), F.length(action_id.cast("string"))), F.lit("0")),
        F.lit(" · "),
        pretty_label(name),
    )


def path_tail(path: Column) -> Column:
    """Last part of a slash or backslash path; NULL when nothing is left."""
    text = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"/+$", "")
    tail = F.element_at(F.split(text, "/"), -1)
    return F.when(F.length(tail) > 0, tail)


def label_from_action(action: Column) -> Column:
    """Integer in front of the first underscore."""
    return F.split(action, "_", 2)[0].try_cast("int")


def correct_flag(predicted: Column, actual: Column, split: Column | None = None) -> Column:
    """Whether the prediction is right; NULL when either is unknown or the row is a test row."""
    same = predicted == actual
    return same if split is None else F.when(split == "test", F.lit(None).cast("boolean")).otherwise(same)


def text_flag(text: Column) -> Column:
    """True/false text as a nullable boolean."""
    return F.lower(F.trim(text)) == "true"


def block_list_text(names: Column) -> Column:
    """Block names in canonical order, unknown names last in name order."""
    known = F.filter(F.array(*[F.lit(b) for b in BLOCKS]), lambda b: F.array_contains(names, b))
    other = F.array_sort(F.array_distinct(F.array_except(names, F.array(*[F.lit(b) for b in BLOCKS]))))
    return F.array_join(F.concat(known, other), ", ")


def normalize_blocks(names: Sequence[str] | None) -> tuple[str, ...]:
    """Requested blocks in canonical order; None means all but the plain infrared block."""
    if names is None:
        return tuple(b for b in BLOCKS if b != "ir")
    wanted = [str(n).strip() for n in names if str(n).strip()]
    unknown = sorted(set(wanted) - set(BLOCKS))
    if unknown:
        raise ValueError(f"unknown feature blocks: {unknown}")
    if not wanted:
        raise ValueError("select at least one feature block")
    return tuple(b for b in BLOCKS if b in wanted)


def shown(value: Column, digits: int = 4) -> Column:
    """Rounded for display; the nudge keeps exact decimal ties on one side of the boundary."""
    return F.round(value.cast("double") + F.lit(1.3e-7), digits) + F.lit(0.0)
