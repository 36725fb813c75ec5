"""A deterministic work-order view over the line items, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFECTS = (
    "HYD PUMP LEAK FOUND AT ENGINE 1", "ECAM WARNING BLEED FAULT DURING CRUISE", "CABIN LIGHT INOP ROW 12", "ROUTINE DAILY CHECK OF THE CABIN", "SCHEDULED INSPECTION OF BRAKE WEAR",
    "CRACK DETECTED ON PANEL", "FIND NO DEFECT, WITHIN LIMITS", "PAINT PEEL ON LEFT WING", "TYRE WEAR AT POSITION 3", "OVERHEAT MESSAGE AFTER LANDING", "", "NOISE FROM AVIONICS FAN",
    "DISPLAY UNIT FAIL, SEE AMM 31-60-00", "PASSENGER SEAT 14C LOOSE", "GREASE THE FLAP TRACK",
)
ACTIONS = (
    "REPLACED PUMP REF AMM 29-11-00-400-001", "RESET DONE IAW TSM 36 11 00", "CHECK SATIS", "REMOVED AND INSTALLED LAMP REF IPC 33-20-01", "ADJUSTED AS PER CMM 32-41-00",
    "TASK 21-26-40-001 DONE", "REF 29260012 AND 292600", "DONE ON 2025-06-09 AT 09:24", "NO FINDING, ECAM FAULT CLEARED", "BY VAE03251", "", "REPAIR | ACTION: PANEL SEALED",
    "FIM21-51 PERFORMED, ATA 21-51",
)
TYPES = ("SCHEDULED", "UNSCHEDULED", "ROUTINE CHECK", "DEFECT")


def _pick(expr: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} % {len(values)} {cases} END"


def _sql() -> str:
    defect = _pick("(l_partkey + l_linenumber)", DEFECTS)
    action = _pick("(l_suppkey + l_partkey * 3)", ACTIONS)
    second = _pick("(l_orderkey + l_suppkey)", ACTIONS)
    return f"""SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10)) AS wo_id,
  l_orderkey * 10 + l_linenumber AS seq,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE {defect} END AS defect,
  CASE WHEN l_suppkey % 19 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN ({action}) || chr(10) || ({second}) ELSE {action} END AS action,
  {_pick("l_orderkey", TYPES)} AS wo_type,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE lpad(CAST(21 + l_suppkey % 60 AS VARCHAR(5)), 2, '0') || '-' || lpad(CAST(10 + l_partkey % 80 AS VARCHAR(5)), 2, '0') END AS entered,
  l_shipdate AS opened, l_quantity AS quantity
FROM lineitem"""


SQL = _sql()


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
