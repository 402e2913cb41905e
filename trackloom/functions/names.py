"""Class tables, names in paths and other small scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Object classes by the numbering of tracks (0-based); ground truth counts from 1.
CLASSES = ("Person", "Forklift", "NovaCarter", "Transporter", "FourierGR1T2", "AgilityDigit")


def class_name(class_id: Column, base: int = 0) -> Column:
    """Name of a class number; "Unknown" for others."""
    table = F.create_map(*[F.lit(x) for k, n in enumerate(CLASSES) for x in (k + base, n)])
    return F.coalesce(table[class_id.cast("int")], F.lit("Unknown"))


def class_id(name: Column, base: int = 0) -> Column:
    """Number of a class name; -1 for others."""
    table = F.create_map(*[F.lit(x) for k, n in enumerate(CLASSES) for x in (n, k + base)])
    return F.coalesce(table[name], F.lit(-1))


def serial(n: Column, digits: int = 8) -> Column:
    """A number with leading zeros."""
    return F.lpad(n.cast("string"), digits, "0")


def camera_tag(path: Column) -> Column:
    """The part of a path that names a camera, such as Camera_01 (empty if none)."""
    return F.regexp_extract(path, r"((?i:camera)(?:_\d+)?)", 1)


def trailing_number(name: Column) -> Column:
    """P25: the number after the last underscore, null where there is none."""
    return F.expr("try_cast(null as int)") if name is None else F.element_at(F.split(name, "_"), -1).try_cast("int")


def feature_name(path: Column) -> Column:
    """Fields in a feature file's name, feature_{frame}_{n}_{x1}_{x2}_{y1}_{y2}_{score}[_cls{c}].npy.

    The score has lost its point: its first digit stands before it.  A name
    without a class has null there; a name of another form gives null fields.
    """
    pattern = r"feature_(\d+)_(\d+)_(\d+)_(\d+)_(\d+)_(\d+)_(\d+)(?:_cls(\d+))?\.npy$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))

    score = F.concat(F.substring(part(7), 1, 1), F.lit("."), F.coalesce(F.substring(part(7), 2, 30), F.lit("0")))
    kinds = [(1, "frame", "int"), (2, "n", "int"), (3, "x1", "int"), (4, "x2", "int"), (5, "y1", "int"), (6, "y2", "int")]
    return F.struct(*(part(i).cast(t).alias(n) for i, n, t in kinds), score.try_cast("double").alias("score"), part(8).cast("int").alias("class_id"))


def label_colour(label: Column) -> Column:
    """Blue, green and red of an id, from the first bytes of the MD5 of its text."""
    digest = F.md5(label.cast("string").cast("binary"))
    return F.struct(*(F.conv(F.substring(digest, at, 2), 16, 10).cast("int").alias(name) for name, at in (("b", 5), ("g", 3), ("r", 1))))
