"""Column functions on names, paths, dates, labels and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and the plain text that replaces them.
PLAIN_TEXT = {
    "\u00a0": " ",
    "\u2010": "-",
    "\u2011": "-",
    "\u2012": "-",
    "\u2013": "-",
    "\u2014": "--",
    "\u2015": "--",
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2022": "*",
    "\u2026": "...",
    "\u2192": "->",
    "\u21d2": "=>",
    "\u2212": "-",
    "\u2264": "<=",
    "\u2265": ">=",
}


def fs_safe(name: Column) -> Column:
    """File-system safe name: colons and slashes become underscores."""
    return F.translate(name, ":/", "__")


def base_name(path: Column) -> Column:
    """Last path component."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Last path component without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Last extension with its dot, or an empty string."""
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def parent_name(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)


def pretrain_ckpt(path: Column) -> Column:
    """Canonical name of a ``<name>_pretrain_<data>-<hash>`` checkpoint file."""
    parts = F.split(F.get(F.split(stem(path), "-"), F.lit(0)), "_")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def taxon_label(*ranks: Column) -> Column:
    """Ranks joined by ``|``; a missing rank counts as an empty one."""
    return F.concat_ws("|", *[F.coalesce(rank, F.lit("")) for rank in ranks])


def epoch_ms(date: Column) -> Column:
    """Milliseconds since 1970-01-01 UTC of a date."""
    return F.datediff(F.to_date(date), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000


def month_year(ms: Column) -> Column:
    """``Month YYYY`` label of epoch milliseconds in UTC, ``unknown`` when missing."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    # Month labels of the leaderboard.
    months = ["Jan", "Feb", "March", "April", "May", "June",
              "July", "Aug", "Sept", "Oct", "Nov", "Dec"]
    label = F.element_at(F.array(*[F.lit(m) for m in months]), F.month(day))
    shown = F.concat_ws(" ", label, F.year(day).cast("string"))
    return F.when(ms.isNull(), "unknown").otherwise(shown)


def percent_label(score: Column) -> Column:
    """Score times 100 with one decimal, ``-`` when missing."""
    return F.when(score.isNull(), "-").otherwise(F.format_string("%.1f", F.round(score * 100, 1)))


# Units of the parameter counts and the open upper end of a range.
BIG_UNITS = [(1_000, 1, ""), (1_000_000, 1_000, "K"), (1_000_000_000, 1_000_000, "M"),
             (1_000_000_000_000, 1_000_000_000, "B")]
UPPER_LIMIT = 10**16


def big_int_label(value: Column) -> Column:
    """Whole number with a K, M or B suffix."""
    out = None
    for below, unit, mark in BIG_UNITS:
        text = F.concat(F.floor(value / unit).cast("bigint").cast("string"), F.lit(mark))
        out = F.when(value < below, text) if out is None else out.when(value < below, text)
    return out.otherwise(F.floor(value).cast("decimal(38,0)").cast("string"))


def range_label(low: Column, high: Column) -> Column:
    """``<50M``, ``100M-400M`` or ``2B+`` for a parameter range."""
    return (
        F.when(low == 0, F.concat(F.lit("<"), big_int_label(high)))
        .when(high == UPPER_LIMIT, F.concat(big_int_label(low), F.lit("+")))
        .otherwise(F.concat_ws("-", big_int_label(low), big_int_label(high)))
    )


def resolution(text: Column) -> Column:
    """``WxH`` as a struct of two integers."""
    parts = F.split(text, "x")
    return F.struct(
        F.get(parts, F.lit(0)).cast("int").alias("width"),
        F.get(parts, F.lit(1)).cast("int").alias("height"),
    )


def segment(bounds: Column) -> Column:
    """Two-element text or number array as a struct of start and end seconds."""
    return F.struct(
        F.get(bounds, F.lit(0)).cast("double").alias("start_s"),
        F.get(bounds, F.lit(1)).cast("double").alias("end_s"),
    )


def json_labels(text: Column) -> Column:
    """JSON list of numbers or booleans as integers."""
    as_ints = F.from_json(text, "array<int>")
    as_flags = F.from_json(text, "array<boolean>")
    flags = F.transform(as_flags, lambda x: x.cast("int"))
    return F.when(text.rlike("true|false"), flags).otherwise(as_ints)


def plain_text(text: Column) -> Column:
    """Typographic characters replaced by plain ones."""
    for char, plain in PLAIN_TEXT.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    return text


def first_non_ascii(text: Column) -> Column:
    """1-based position of the first non-ASCII character, 0 when there is none."""
    return F.regexp_instr(text, F.lit(r"[^\x00-\x7F]"))


def log10_params(params: Column) -> Column:
    return F.log10(params.cast("double"))


def renamed(value: Column, names: dict[str, str]) -> Column:
    """Display name from a small fixed map; other values stay as they are."""
    if not names:
        return value
    pairs = [F.lit(item) for pair in names.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def frame_count_vote(candidates: Column, tolerance: float = 0.01) -> Column:
    """Frame count agreed on by several estimates, in order of preference.

    Each estimate gets one vote per exact copy, plus one for every copy of it when
    another value lies within the relative tolerance. The first value with the most
    votes wins. The result is null when several estimates exist and none has two votes.
    """
    known = F.filter(candidates, lambda v: v.isNotNull())

    def votes(v: Column) -> Column:
        same = F.size(F.filter(known, lambda o: o == v))
        near = F.exists(
            known,
            lambda o: (o != v) & (F.abs(o - v) <= tolerance * F.greatest(F.abs(o), F.abs(v))),
        )
        return same + F.when(near, same).otherwise(0)

    scored = F.transform(known, lambda v, i: F.struct(votes(v).alias("n"), (-i).alias("p"), v.alias("v")))
    best = F.array_max(scored)
    return F.when((best["n"] >= 2) | (F.size(known) == 1), best["v"])
