"""The source tables of the star schema, derived from the driver's tables.

Each statement runs unchanged on Spark and on DuckDB; a name in braces is
another table of this module or a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from opquality.sources.readers import Catalog

SAMPLE_SQL = {
    "view_employee": """
SELECT CASE WHEN s_suppkey % 5 = 0 THEN cast(cast(s_suppkey AS double) AS string) ELSE cast(s_suppkey AS string) END AS OP_ID,
       'CH' || cast(s_suppkey AS string) AS CHORUS_ID, s_name AS OPERATOR_NAME,
       'CH' || cast(s_suppkey % 10 AS string) AS SUPERVISOR_CHORUS_ID, cast(s_nationkey AS string) AS COST_CENTER,
       CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDER' ELSE 'FINISHER' END AS POSITION,
       CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS IS_ACTIVE
FROM {supplier}""",
    "BU_data": """
SELECT cast(s_suppkey AS string) AS OP_ID, r_name AS BU, cast(s_suppkey % 4 + 1 AS int) AS CREW
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE s_suppkey % 10 <> 7""",
    "first_step_prod": """
SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE cast(l_suppkey AS string) END AS OP_ID, l_shipdate AS PROD_DATE,
       'TBM' || cast(l_linenumber AS string) AS TBM,
       CASE WHEN l_suppkey % 25 = 3 THEN 0.0 ELSE l_quantity END AS TIRES_BUILT
FROM {lineitem} WHERE l_linestatus = 'O'""",
    "second_step_prod": """
SELECT cast(l_suppkey AS double) AS FIN_OP_ID, l_shipdate AS PROD_DATE, 'TBM' || cast(l_linenumber AS string) AS TBM,
       l_quantity AS TOTAL_TIRES
FROM {lineitem} WHERE l_linestatus = 'F'""",
    "conf_bc_grq2": """
SELECT cast(l_suppkey AS string) || CASE WHEN l_linenumber = 1 THEN '.0' ELSE '' END AS OP_ID, l_shipdate AS PROD_DATE,
       CASE WHEN l_returnflag = 'N' THEN NULL WHEN p_size = 50 THEN ' X50 '
            WHEN l_linenumber % 2 = 0 THEN cast(p_size AS string) || '.50' ELSE cast(p_size AS string) || '.0' END AS CQ_CODE
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "conf_ac_grq2": """
SELECT cast(l_suppkey AS string) AS OP_ID, cast(l_shipdate AS string) AS PROD_DATE,
       CASE WHEN l_returnflag = 'A' THEN NULL ELSE cast(l_partkey % 40 AS double) END AS CQ_CODE
FROM {lineitem}""",
    "TBM6": """
SELECT DISTINCT cast(p_size AS string) AS CQ, 'defect ' || cast(p_size AS string) AS CQ_CODE_DESCRIPTION,
       CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'Confection' ELSE ' finishing ' END AS RELATES_TO,
       CASE WHEN p_size < 20 THEN 'Tier 1' ELSE 'Tier 2' END AS TYPES
FROM {part} WHERE p_size % 9 <> 0""",
    "nc_scrap": """
SELECT cast(l_suppkey AS string) AS OP_ID, l_shipdate AS PROD_DATE, 'TBM' || cast(l_linenumber AS string) AS TBM,
       l_discount * l_quantity AS OP_SCRAP_LBS_BY_TIRES, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_quantity END AS OP_TIRES
FROM {lineitem}""",
    "uniformity_breakdown": """
SELECT CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS BARCODE,
       l_suppkey AS CONFECTION_OPERATOR_ID, l_suppkey + 1 AS FINISHING_OPERATOR_ID,
       CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END AS RUN_TYPE,
       CASE WHEN l_returnflag = 'R' THEN 'G' || cast(l_linenumber AS string) END AS OGU2_GRADE,
       CASE WHEN l_returnflag = 'A' THEN 'REP' END AS UNI_REPAIR, cast(l_tax * 100 AS double) AS CQ_CODE,
       l_shipdate AS TEST_DATETIME, CASE WHEN l_linenumber = 7 THEN NULL ELSE o_orderdate END AS CONFECTION_TIMESTAMP,
       o_orderdate + interval 1 day AS FINISHING_TIMESTAMP, 'TBM' || cast(l_linenumber AS string) AS CONFECTION_MACHINE
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "fact_counter_verifier": """
SELECT event_id AS MATRICULE, user_id AS OP_ID, s_name AS OPERATOR_NAME, BU, CREW, cast(event_id % 8 AS int) AS COUNTER_VERIFIER_ID,
       CASE WHEN hour(ts) < 8 THEN 'A' WHEN hour(ts) < 16 THEN 'B' ELSE 'C' END AS SHIFT,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS IS_LEAK, year(ts) AS YEAR, weekofyear(ts) AS WEEK
FROM {events} LEFT JOIN {supplier} ON user_id = s_suppkey LEFT JOIN {BU_data} AS unit ON cast(user_id AS string) = unit.OP_ID""",
    "BC_Cage_Log": """
SELECT o_orderkey AS LINE_NO, CASE WHEN o_orderkey % 97 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN NULL ELSE ' R' || cast(o_custkey AS string) END AS RACK_ID,
       CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE cast(o_custkey % 60 AS string) END AS QUANTITY,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderpriority END AS DISPOSITION,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN cast(cast(o_orderdate AS date) AS string) WHEN o_orderstatus = 'P' THEN '  ' END AS DATE_REMOVED
FROM {orders}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def inputs_of(name: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(SAMPLE_SQL[name])))


class SampleCatalog(Catalog):
    """Source tables over a folder of driver tables."""

    def _find(self, name: str) -> DataFrame:
        if name not in SAMPLE_SQL:
            return super()._find(name)
        # ``meta_cq_descriptions`` is not among them, so the fallback is used.
        return self.spark.sql(SAMPLE_SQL[name], **{n: self.read(n) for n in inputs_of(name)})


def sample_catalog(spark: SparkSession, sf_dir: str) -> SampleCatalog:
    return SampleCatalog(spark, sf_dir)
