"""Queries and jobs from the command line.

python -m rasterloom QUERY SF_DIR [ROWS]
    runs a query by name and prints its first rows, count and seconds.
python -m rasterloom SETTINGS.yml METHOD IMAGE SIZE BANDS [PARTITIONS [LAYER.KIND]]
    a set of map tiles: METHOD 11, 12 (forward match), 21, 22 (inverted match) or an operator's name (focalMean has radius
    3, focalMeanV2 50), IMAGE as id/product, SIZE and BANDS by index. The settings name the catalog's tables (image, product, product_measurement,
    measurement: Parquet paths, or tables of catalog_url), the folder or store of the files (files) and bucket. With
    LAYER.KIND, KIND being png or jpg, the tiles are written as images of their first three bands to the settings' store.
"""

import sys
import time

from pyspark.sql import DataFrame, SparkSession

from rasterloom.operators.raster import band_stack
from rasterloom.plans import jobs
from rasterloom.plans.queries import QUERIES
from rasterloom.sources.catalog import TABLES, Catalog, server_coverages
from rasterloom.sources.cog import cog_index
from rasterloom.sources.store import Settings, write_images

def job(settings: Settings, method: str, image: str, size: int, bands: int, partitions: int | None = None) -> DataFrame:
    """The tiles that a command asks for."""
    spark, options = settings.session(), settings.options
    spark.conf.set("spark.sql.shuffle.partitions", partitions or settings.partitions)
    if settings.catalog_url:
        coverage = server_coverages(spark, settings.catalog_url, *image.split("/"), jobs.BAND_SETS[bands], {t: options.get(t, t) for t in TABLES})
    else:
        coverage = Catalog(*(spark.read.parquet(options[t]) for t in TABLES)).bands(*image.split("/"), jobs.BAND_SETS[bands])
    codes, zoom = jobs.code_set(spark, size)
    first = coverage.first()
    store = store_options(settings)
    index = cog_index(spark, options["files"], **store)
    out = jobs.match_job(method, coverage, index, codes, zoom, first.crs, first.data_type, float(options.get("bucket", 1.0)), int(options.get("tile", 256)), options=store)
    return jobs.required(out)


def store_options(settings: Settings) -> dict:
    return {k: settings.options[k] for k in ("endpoint", "access_key", "secret_key", "region", "timeout") if k in settings.options}


def images(settings: Settings, tiles: DataFrame, size: int, name: str) -> int:
    """Writes the tiles of a set as images of a layer; how many."""
    layer, _, kind = name.rpartition(".")
    return write_images(band_stack(tiles), layer, jobs.CODE_SETS[size][0], settings.store, kind, options=store_options(settings))


def main(args: list[str]) -> int:
    began = time.time()
    if len(args) >= 5 and args[0].endswith((".yml", ".yaml")):
        settings = Settings.load(args[0])
        out, rows = job(settings, args[1], args[2], int(args[3]), int(args[4]), *map(int, args[5:6])), 0
        if len(args) > 6:
            print(f"{images(settings, out, int(args[3]), args[6])} images, {time.time() - began:.1f} s")
            return 0
    elif len(args) >= 2 and args[0] in QUERIES:
        out, rows = QUERIES[args[0]](SparkSession.builder.appName("rasterloom").getOrCreate(), args[1]), int(args[2]) if len(args) > 2 else 20
    else:
        print(f"{__doc__}\nQueries: {', '.join(sorted(QUERIES))}\nOperators: {', '.join(jobs.OPERATORS)}")
        return 2
    if rows:
        out.show(rows, truncate=False)
    print(f"{out.count()} rows, {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
