"""The image catalog: lookups over relational tables, given as DataFrames (Parquet, JDBC, whatever Spark reads)."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.functions.scalar import envelope, parse_time
from rasterloom.plans.schemas import COVERAGE

OPERATORS = {"=": "eqNullSafe", "<>": "__ne__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def select(table: DataFrame, columns: list[str], where: list[tuple[str, str, object]] = (), joins: list[tuple[DataFrame, object]] = (), aliases: dict[str, str] | None = None) -> DataFrame:
    """Columns (by alias, if given) of a table joined with others, where all comparisons (column, operator, value) hold.

    An empty value is an error, as a predicate that was meant and not given; an unknown operator too.
    """
    for other, on in joins:
        table = table.join(other, on)
    tests = []
    for key, op, value in where:
        if value is None or value == "":
            raise ValueError(f"no value for {key}")
        if op not in OPERATORS:
            raise ValueError(f"no operator {op!r}")
        tests.append(getattr(F.col(key), OPERATORS[op])(F.lit(value)))
    if tests:
        table = table.where(reduce(lambda a, b: a & b, tests))
    return table.select([F.col(c).alias((aliases or {}).get(c, c)) for c in columns])


def coverages(image: DataFrame, product: DataFrame, product_measurement: DataFrame, measurement: DataFrame, coverage_id: str, product_name: str) -> DataFrame:
    """One row for each band of an image: id, path of the band's file, geometry, extent, band, rank, time, type.

    Bands with band_train 0 (quality) are left out. measurement only has to have the band.
    """
    rows = (
        image.where(F.col("image_identification") == coverage_id)
        .join(product.where(F.col("name") == product_name), image["product_key"] == product["id"])
        .join(product_measurement, "product_key")
        .join(measurement, "measurement_key", "left_semi")
        .where("band_train <> 0")
    )
    return as_coverages(rows)


def as_coverages(rows: DataFrame) -> DataFrame:
    """The catalog's columns as those of a coverage."""
    name = F.concat(F.col("path"), F.lit("/"), F.col("image_identification"), F.lit("_"), F.col("band_num"), F.lit(".tif"))
    return rows.select(
        F.col("image_identification").alias("coverage_id"), name.alias("path"), F.col("geom").alias("geom_wkt"), envelope(F.col("geom")).alias("extent"),
        F.col("band_num").alias("measurement"), F.col("band_rank").alias("measurement_rank"), parse_time(F.col("phenomenon_time")).alias("time"),
        "crs", F.col("dtype").alias("data_type"), F.col("resolution_m").alias("resolution"),
    )


def only_bands(rows: DataFrame, bands: list[str], column: str = "measurement", strict: bool = False) -> DataFrame:
    """Rows of these bands; a catalog of one row is kept as it is, unless strict."""
    chosen = rows.where(F.col(column).isin(list(bands)))
    # whether there is a second row is asked at once, so that the filter itself stays a plain one that reaches the scan
    return chosen if strict or rows.limit(2).count() != 1 else rows


class Catalog:
    """Coverage rows by image and product, each asked of the tables once while it is kept; an image without rows is an error."""

    def __init__(self, image: DataFrame, product: DataFrame, product_measurement: DataFrame, measurement: DataFrame):
        self.tables, self.known = (image, product, product_measurement, measurement), {}

    def bands(self, coverage_id: str, product_name: str, bands: list[str] | None = None) -> DataFrame:
        key = coverage_id, product_name
        if key not in self.known:
            rows = coverages(*self.tables, *key).collect()
            if not rows:
                raise ValueError(f"no image {coverage_id} of product {product_name}")
            self.known[key] = self.tables[0].sparkSession.createDataFrame(rows, COVERAGE)
        return self.known[key] if bands is None else only_bands(self.known[key], bands)


NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def select_sql(table: str, columns: list[str], where: list[tuple[str, str, object]] = (), joins: list[tuple[str, str, str]] = (), aliases: dict[str, str] | None = None) -> str:
    """What `select` does, as one statement for a server: names are checked, values written as literals, joins (table, left
    column, right column) are equalities. Empty values and unknown operators are errors, as there."""
    for name in (table, *columns, *(x for j in joins for x in j), *(k for k, _, _ in where), *(aliases or {}).values()):
        if not NAME.fullmatch(name):
            raise ValueError(f"no name of a table or column: {name!r}")

    def literal(v: object) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(v)
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        raise ValueError(f"no literal of {type(v).__name__}")

    parts = [f"{c} AS {aliases[c]}" if aliases and c in aliases else c for c in columns]
    sql = f"SELECT {', '.join(parts)} FROM {table}" + "".join(f" JOIN {t} ON {a} = {b}" for t, a, b in joins)
    tests = []
    for key, op, value in where:
        if value is None or value == "":
            raise ValueError(f"no value for {key}")
        if op not in OPERATORS:
            raise ValueError(f"no operator {op!r}")
        tests.append(f"{key} {'<>' if op == '!=' else op} {literal(value)}")
    return sql + (f" WHERE {' AND '.join(tests)}" if tests else "")


def connected(load: Callable[[], DataFrame], url: str, retries: int, delay: float) -> DataFrame:
    """What load gives, asked for up to `retries` times, `delay` seconds apart."""
    for i in range(retries):
        try:
            return load()
        except Exception as e:
            if i + 1 == retries:
                raise RuntimeError(f"no connection to {url} after {retries} tries") from e
            time.sleep(delay)


def jdbc(spark: SparkSession, url: str, table: str, retries: int = 3, delay: float = 1.0, split: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table over JDBC, or a statement in brackets with a name; filters and columns are pushed to the server.

    The schema is asked for at once, up to `retries` times, `delay` seconds apart; connections lost later are made again
    with the task (spark.task.maxFailures). split: a column of numbers, its least and greatest value and the number of
    partitions that read ranges of it.
    """
    if split:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, split)))
    return connected(lambda: spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), url, retries, delay)


#: Tables of a server's catalog by their role.
TABLES = {"image": "image", "product": "product", "product_measurement": "product_measurement", "measurement": "measurement"}


def server_coverages(spark: SparkSession, url: str, coverage_id: str, product_name: str, bands: list[str] | None = None, tables: dict[str, str] | None = None, **how) -> DataFrame:
    """`coverages` of an image by one statement: joins, comparisons and the choice of bands run on the server, which sends a row
    for each band. A single row is kept whatever its band, as `only_bands` does. tables: names where they differ. how: as `jdbc`."""
    t = TABLES | (tables or {})
    i, p, pm, m = (t[k] for k in TABLES)
    columns = [f"{i}.image_identification", f"{i}.path", f"{i}.geom", f"{i}.phenomenon_time", f"{i}.crs", f"{p}.dtype", f"{pm}.band_num", f"{pm}.band_rank", f"{pm}.resolution_m"]
    joins = [(p, f"{i}.product_key", f"{p}.id"), (pm, f"{i}.product_key", f"{pm}.product_key"), (m, f"{pm}.measurement_key", f"{m}.measurement_key")]
    where = [(f"{i}.image_identification", "=", coverage_id), (f"{p}.name", "=", product_name), (f"{pm}.band_train", "<>", 0)]
    aliases = {c: c.split(".")[1] for c in columns}
    rows = jdbc(spark, url, f"({select_sql(i, columns, where, joins, aliases)}) catalog", **how)
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    out = as_coverages(rows)
    return out if bands is None else only_bands(out, bands)
