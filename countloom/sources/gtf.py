"""GTF annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a GTF line, and the feature filters.
FIELDS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame")
INTEGER_FIELDS = ("start", "end")
FEATURE_TYPES = ("all", "exon", "transcript", "gene_id")


def _attributes(text: Column, strip_quotes: bool) -> Column:
    """``key value; key value; ...`` to a map; the last value of a repeated key wins."""
    items = F.filter(F.transform(F.split(text, ";"), lambda z: F.trim(z)), lambda z: z != "")
    key = lambda z: F.substring_index(z, " ", 1)

    def value(z: Column) -> Column:
        rest = F.trim(F.substr(z, F.length(key(z)) + 1))
        return F.regexp_replace(rest, '^"|"$', "") if strip_quotes else rest

    pairs = F.transform(items, lambda z: F.struct(key(z).alias("key"), value(z).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def parse_gtf(lines: DataFrame, feature_type: str = "all", strip_quotes: bool = False) -> DataFrame:
    """GTF lines (column ``value``) to typed rows with an attribute map.

    Comment and blank lines are skipped; a line with fewer than nine fields is an error. ``feature_type`` exon or transcript selects by
    feature, gene_id keeps rows that have this attribute, and any other value
    gives no rows.
    """
    fields = F.split(F.trim(F.col("value")), "\t")
    rows = lines.filter(~F.col("value").startswith("#")).filter(F.trim("value") != "")
    short = F.raise_error(F.concat(F.lit("GTF line with fewer than 9 fields: "), F.substring("value", 1, 200)))
    rows = rows.select(F.when(F.size(fields) >= 9, fields).otherwise(short).alias("_f"))
    if feature_type in ("exon", "transcript"):
        rows = rows.filter(F.col("_f")[2] == feature_type)
    elif feature_type not in FEATURE_TYPES:
        rows = rows.filter(F.lit(False))
    columns = [
        (F.col("_f")[i].cast("int") if name in INTEGER_FIELDS else F.col("_f")[i]).alias(name)
        for i, name in enumerate(FIELDS)
    ]
    parsed = rows.select(*columns, _attributes(F.col("_f")[8], strip_quotes).alias("attributes"))
    return parsed.filter(F.map_contains_key("attributes", "gene_id")) if feature_type == "gene_id" else parsed


def read_gtf(spark: SparkSession, path: str, feature_type: str = "all", strip_quotes: bool = False) -> DataFrame:
    """Read plain or gzip-compressed GTF files."""
    return parse_gtf(spark.read.text(path), feature_type, strip_quotes)
