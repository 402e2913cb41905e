"""Open-world categories (F15): known, distractor and unknown classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category numbers of the tracking-any-object data; all others up to the last are unknown.
KNOWN = (4, 13, 34, 35, 36, 41, 45, 58, 60, 78, 79, 81, 91, 95, 99, 118, 126, 133, 139, 154, 174, 185, 211, 221, 229, 235, 237, 276, 299, 347, 371, 382, 392, 428, 429, 452, 475, 480, 502, 544, 579, 621, 625, 642, 699, 714, 717, 729, 747, 779, 805, 829, 852, 896, 926, 937, 961, 979, 980, 982, 993, 1001, 1018, 1038, 1057, 1091, 1097, 1099, 1115, 1117, 1122, 1132, 1135, 1144, 1155, 1162, 1215, 1229)
DISTRACTOR = (20, 63, 108, 180, 188, 204, 212, 247, 303, 403, 407, 415, 490, 504, 507, 513, 529, 567, 569, 588, 672, 691, 702, 708, 711, 720, 736, 737, 798, 813, 815, 827, 831, 851, 877, 883, 912, 971, 976, 1130, 1133, 1134, 1169, 1184, 1220)
LAST = 1999


def world(category: Column) -> Column:
    """"known", "distractor" or "unknown"; null beyond the table."""
    return F.when(category.isin(*KNOWN), "known").when(category.isin(*DISTRACTOR), "distractor").when(category.between(1, LAST), "unknown")


def subset(df: DataFrame, category: str, which: str) -> DataFrame:
    """rows whose category is in one of the three subsets, or with "all" in known or unknown."""
    kept = ("known", "unknown") if which == "all" else (which,)
    return df.where(world(F.col(category)).isin(*kept))
