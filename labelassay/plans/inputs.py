"""Label-checking inputs derived from the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import WARNING
from ..session import dealt, ship_package

CLASS = """CASE p_size % 7 WHEN 0 THEN 'Kentucky Straight Bourbon Whiskey' WHEN 1 THEN 'Red Wine' WHEN 2 THEN 'Pale Ale'
 WHEN 3 THEN 'London Dry Gin' WHEN 4 THEN 'Wine' WHEN 5 THEN 'Chardonnay' ELSE 'Distilled Spirits' END"""
ABV = """CASE p_size % 5 WHEN 0 THEN '45% ALC/VOL' WHEN 1 THEN '40% ALC/VOL (80 PROOF)' WHEN 2 THEN '12.5% ALC/VOL'
 WHEN 3 THEN '90 PROOF' ELSE NULL END"""
NET = """CASE p_size % 4 WHEN 0 THEN '750 mL' WHEN 1 THEN '0.75 L' WHEN 2 THEN '25.4 FL OZ' ELSE '1.75 L' END"""
PRODUCER = """CASE p_partkey % 6 WHEN 0 THEN 'Old River Distilling Co, Frankfort, KY 40601' WHEN 1 THEN 'Hill Cellars, 12 Main Street, Napa, California'
 WHEN 2 THEN 'Granite Brewing LLC, Portland, Maine 04101' WHEN 3 THEN 'North Import Inc, Edinburgh, Scotland'
 WHEN 4 THEN 'Maison Claire, Reims, France' ELSE NULL END"""
COUNTRY = "CASE p_partkey % 4 WHEN 0 THEN 'France' WHEN 1 THEN 'Scotland' ELSE NULL END"

VIEWS = {
    "library": f"""
SELECT p_partkey AS id, p_name AS name, p_brand AS brand_name, {CLASS} AS class_type, {ABV} AS alcohol_content,
       {NET} AS net_contents, {PRODUCER} AS producer_info, {COUNTRY} AS country_of_origin
FROM part""",
    "readings": """
SELECT s_suppkey AS photo_id, s_nationkey AS run_id,
       CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'BRAND # ' || CAST(11 + s_suppkey % 45 AS STRING) ELSE 'Brand#' || CAST(11 + s_suppkey % 45 AS STRING) END AS brand_name,
       CASE s_suppkey % 5 WHEN 0 THEN 'Straight Bourbon Whiskey' WHEN 1 THEN 'RED WINE' WHEN 2 THEN 'Pale Ail' WHEN 3 THEN ' ' ELSE 'London Dry Gin' END AS class_type,
       CASE s_suppkey % 7 WHEN 0 THEN '45.2% ALC/VOL' WHEN 1 THEN '80 PROOF' WHEN 2 THEN '12.8% ALC/VOL' WHEN 3 THEN 'strong' WHEN 4 THEN '' ELSE '40% ALC/VOL' END AS alcohol_content,
       CASE s_suppkey % 4 WHEN 0 THEN '750ML' WHEN 1 THEN '0.75 L' WHEN 2 THEN '700 mL' ELSE NULL END AS net_contents,
       CASE s_nationkey % 5 WHEN 0 THEN 'Old River Distilling Company Frankfort Kentucky' WHEN 1 THEN 'Hill Cellars Napa, CA 94558' WHEN 2 THEN 'Granite Brewing, Portland, ME' WHEN 3 THEN 'Maison Claire Reims France' ELSE NULL END AS producer_info,
       CASE s_nationkey % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'Scotlnd' ELSE NULL END AS country_of_origin
FROM supplier""",
    "label_text": f"""
SELECT p_partkey AS label_id,
       p_name || chr(10) || {CLASS} || chr(10)
       || CASE p_partkey % 5 WHEN 0 THEN 'ALC. 12% BY VOL' WHEN 1 THEN '45 % Alc./Vol. (90 Proof)' WHEN 2 THEN '13.5% ALC BY VOL' WHEN 3 THEN '80 PROOF' ELSE 'strong' END || chr(10)
       || {NET} || chr(10) || 'Produced and Bottled By: ' || coalesce({PRODUCER}, 'Nobody') || chr(10)
       || coalesce('PRODUCT OF ' || {COUNTRY}, 'Domestic') || chr(10)
       || CASE p_partkey % 4 WHEN 0 THEN '{WARNING}' WHEN 1 THEN 'Government  Warning: according to the Surgeon' WHEN 2 THEN '' ELSE 'GOVERNMENT' || chr(10) || 'WARNING: drink less' END
       || chr(10) || CASE p_size % 3 WHEN 0 THEN '[ ] WINE  [X] DISTILLED  SPIRITS [ ] MALT BEVERAGE' WHEN 1 THEN 'x: wine' ELSE '[] WINE' END AS raw_text
FROM part""",
    "ocr_words": """
SELECT l_orderkey AS photo_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS word_seq,
       CASE l_suppkey % 9 WHEN 0 THEN 'PROOF' WHEN 1 THEN '  ' WHEN 2 THEN 'Bottled by Oak' WHEN 3 THEN 'Salem OR 97301' ELSE 'Word' || CAST(l_partkey % 97 AS STRING) END AS text,
       CASE l_partkey % 11 WHEN 0 THEN 'low' WHEN 1 THEN '12.5' ELSE '91' END AS conf,
       CAST(l_partkey % 500 AS INT) AS "left", CAST(l_linenumber * 45 + l_suppkey % 3 AS INT) AS top, CAST(50 AS INT) AS width,
       CAST(20 + 10 * (l_suppkey % 3) AS INT) AS height, CAST(1 + l_linenumber % 2 AS INT) AS block_num, CAST(1 AS INT) AS par_num, CAST(l_linenumber AS INT) AS line_num
FROM lineitem""",
    "photos": """
SELECT s_suppkey AS photo_id, s_nationkey AS run_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS index,
       CASE s_suppkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'product' WHEN 2 THEN 'cola' ELSE 'adhoc' END AS mode, s_suppkey * 3 AS chosen_id,
       CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS caps_ok, CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS bold_ok,
       ' Brand#' || CAST(11 + s_suppkey % 45 AS STRING) || ' ' AS typed_brand_name, 'RED WINE' AS typed_class_type, '  ' AS typed_alcohol_content, '750 mL' AS typed_net_contents,
       '' AS typed_producer_info, CAST(NULL AS STRING) AS typed_country_of_origin
FROM supplier""",
    "applications": """
SELECT n_nationkey AS run_id, 'Brand#' || CAST(11 + n_nationkey AS STRING) AS brand_name, 'Wine' AS class_type, '40% ALC/VOL' AS alcohol_content, '750 mL' AS net_contents,
       CASE n_nationkey % 2 WHEN 0 THEN 'Hill Cellars, Napa, CA' ELSE NULL END AS producer_info, CASE n_nationkey % 3 WHEN 0 THEN 'France' ELSE NULL END AS country_of_origin
FROM nation""",
    "photo_results": """
SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS INT) AS index,
       CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '750 mL' WHEN 3 THEN '0.75 L' WHEN 4 THEN '700 ML' ELSE '1 L' END AS extracted,
       '750 mL' AS expected, CASE WHEN l_suppkey % 6 < 2 THEN 'not_found' WHEN l_suppkey % 6 < 4 AND l_returnflag = 'R' THEN 'match' ELSE 'mismatch' END AS status
FROM lineitem""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input over whole tables."""
    ship_package(spark)
    sql = VIEWS[name].replace('"left"', "`left`")
    for table in ("part", "supplier", "lineitem", "nation"):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        # What is looked for in a label's text costs far more than its row.
        (dealt(rows) if name == "label_text" and table == "part" else rows).createOrReplaceTempView(table)
    return spark.sql(sql)


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``part``, dealt over tasks."""
    ship_package(spark)
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet"))


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL after the derived inputs it reads."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql
