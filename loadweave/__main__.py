"""python -m loadweave READINGS OUT: preprocess raw readings (CSV or Parquet) into profiles and statistics."""

import argparse

from loadweave.operators import etl
from loadweave.session import build_session
from loadweave.sources.profiles import read_readings_csv


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loadweave", description=__doc__)
    parser.add_argument("readings")
    parser.add_argument("out")
    parser.add_argument("--households", type=int, default=2000, help="per group")
    parser.add_argument("--required", type=int, default=48, help="readings of a whole day")
    a = parser.parse_args(args)
    spark = build_session("preprocess")
    if a.readings.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(a.readings)
    else:
        # an order of arrival is needed for keep-last; CSV has none but the order inside a file
        raw = read_readings_csv(spark, a.readings).selectExpr("*", "monotonically_increasing_id() AS reading_id", "CAST(NULL AS TIMESTAMP) AS ingested_at")
    etl.preprocess(raw, a.out, a.households, a.required)


if __name__ == "__main__":
    main()
