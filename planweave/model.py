"""Schemas, constants and the table of states.

Fixed values: thresholds, weights and the seats of the 118th Congress.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PP_MIN, POP_DEV_MAX = 0.05, 0.005
PENINSULA_RATIO = 0.05
MIN_BORDER_M = 50.0
ROAD_BUFFER_M, WATER_BUFFER_M = 50.0, 100.0
W_COUNTY, W_PLACE, W_COUSUB, ROAD_DIVISOR, WATER_DIVISOR = 10.0, 5.0, 3.0, 2.0, 5.0
BETA_FEW, BETA_MANY = 0.5, 2.0
SAMPLE, SEED = 5000, 42
MARGIN_BANDS = (2, 5, 8)
POP_TOL, BURN_IN, CHUNK = 0.005, 500, 1000

# fips, abbreviation, name, seats, EPSG code of the projection
STATES = """
01 AL Alabama 7 5070
02 AK Alaska 1 3338
04 AZ Arizona 9 5070
05 AR Arkansas 4 5070
06 CA California 52 5070
08 CO Colorado 8 5070
09 CT Connecticut 5 5070
10 DE Delaware 1 5070
12 FL Florida 28 5070
13 GA Georgia 14 5070
15 HI Hawaii 2 26904
16 ID Idaho 2 5070
17 IL Illinois 17 5070
18 IN Indiana 9 5070
19 IA Iowa 4 5070
20 KS Kansas 4 5070
21 KY Kentucky 6 5070
22 LA Louisiana 6 5070
23 ME Maine 2 5070
24 MD Maryland 8 5070
25 MA Massachusetts 9 5070
26 MI Michigan 13 5070
27 MN Minnesota 8 5070
28 MS Mississippi 4 5070
29 MO Missouri 8 5070
30 MT Montana 2 5070
31 NE Nebraska 3 5070
32 NV Nevada 4 5070
33 NH New_Hampshire 2 5070
34 NJ New_Jersey 12 5070
35 NM New_Mexico 3 5070
36 NY New_York 26 5070
37 NC North_Carolina 14 5070
38 ND North_Dakota 1 5070
39 OH Ohio 15 5070
40 OK Oklahoma 5 5070
41 OR Oregon 6 5070
42 PA Pennsylvania 17 5070
44 RI Rhode_Island 2 5070
45 SC South_Carolina 7 5070
46 SD South_Dakota 1 5070
47 TN Tennessee 9 5070
48 TX Texas 38 5070
49 UT Utah 4 5070
50 VT Vermont 1 5070
51 VA Virginia 11 5070
53 WA Washington 10 5070
54 WV West_Virginia 2 5070
55 WI Wisconsin 8 5070
56 WY Wyoming 1 5070
"""

# Two-party share of the Democratic candidate in the presidential election of 2024, by state; then those of the states with one seat
SHARES_2024 = """
AL 0.326 AR 0.323 AZ 0.471 CA 0.606 CO 0.564 CT 0.574 FL 0.434 GA 0.489 HI 0.710 IA 0.419 ID 0.284 IL 0.544 IN 0.367 KS 0.352 KY 0.312
LA 0.341 MA 0.637 MD 0.666 ME 0.540 MI 0.493 MN 0.533 MO 0.397 MS 0.367 MT 0.392 NC 0.483 NE 0.366 NH 0.518 NJ 0.544 NM 0.554 NV 0.482
NY 0.565 OH 0.439 OK 0.322 OR 0.594 PA 0.491 RI 0.597 SC 0.411 TN 0.331 TX 0.432 UT 0.392 VA 0.548 WA 0.601 WI 0.494 WV 0.248
"""
AT_LARGE_2024 = "AK 0.436 DE 0.583 ND 0.321 SD 0.361 VT 0.676 WY 0.233"

# The Census Bureau's regions
REGIONS = {
    "Northeast": "CT ME MA NH NJ NY PA RI VT",
    "Midwest": "IL IN IA KS MI MN MO NE OH ND SD WI",
    "South": "AL AR DE FL GA KY LA MD MS NC OK SC TN TX VA WV",
    "West": "AK AZ CA CO HI ID MT NV NM OR UT WA WY",
}


def state_rows() -> list[tuple[str, str, str, int, str]]:
    rows = [line.split() for line in STATES.strip().splitlines()]
    found = [(fips, abbr, name.replace("_", " "), int(k), f"EPSG:{code}") for fips, abbr, name, k, code in rows]
    if sum(r[3] for r in found) != 435:
        raise ValueError("the states' seats don't add up to 435")
    return found


def seats_checked(states: DataFrame, seats: int = 435) -> DataFrame:
    """`states` (k), or an error where the seats don't add up."""
    found = states.agg(F.sum("k")).first()[0]
    if found != seats:
        raise ValueError(f"the states have {found} seats, not {seats}")
    return states


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(state_rows(), "fips string, abbr string, name string, k int, crs string")


def shares(spark: SparkSession, at_large: bool = False) -> DataFrame:
    """abbr, target: the states' shares of 2024, those with several seats or those with one."""
    words = (AT_LARGE_2024 if at_large else SHARES_2024).split()
    return spark.createDataFrame([(a, float(x)) for a, x in zip(words[::2], words[1::2], strict=True)], "abbr string, target double")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, r) for r, held in REGIONS.items() for a in held.split()], "abbr string, region string")
