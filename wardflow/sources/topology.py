"""Registry tables: hospitals, departments, edges.

The literal rows are local relations with exact statistics, so Spark itself decides to broadcast
them. No hint is set anywhere: a registry that grows past the broadcast threshold falls back to a
shuffled join by itself.
"""

from pyspark.sql import functions as F

# The department kinds of every hospital.
DEPT_TYPES = """
 (0,'TRIAGE','Triage','triage',12,1,0.001,0.0), (1,'RESUS','Resuscitation','resus',4,1,0.0,0.001),
 (2,'FASTTRACK','Fast Track','fast_track',20,1,-0.001,0.0), (3,'OBS','Observation','obs',16,2,0.0,-0.001),
 (4,'RADIOLOGY','Radiology','radiology',8,2,0.002,0.001), (5,'BOARDING','Inpatient Boarding','boarding',12,1,-0.001,0.001),
 (6,'DISCHARGE','Discharge Lounge','discharge',10,1,0.001,-0.001)"""
DEPT_TYPES_COLUMNS = "node_idx, suffix, dept_name, dept_type, capacity, floor_number, dlat, dlon"

# The hospitals.
HOSPITALS = """
 ('H1','City General Hospital',23.0225,72.5714), ('H2','North Regional Medical',23.0800,72.5200),
 ('H3','Sunrise Health Centre',22.9900,72.6000), ('H4','Metro Emergency Hospital',23.0500,72.5500),
 ('H5','Westside Medical',23.0100,72.5100), ('H6','Eastview Hospital',23.0600,72.6200)"""
HOSPITALS_COLUMNS = "hospital_id, hospital_name, lat, lon"

# The edges between department kinds.
EDGE_TYPES = """
 (0,'TRIAGE','RESUS','TRANSFER',0.8), (1,'TRIAGE','FASTTRACK','TRANSFER',0.6), (2,'TRIAGE','OBS','TRANSFER',0.4),
 (3,'RESUS','OBS','TRANSFER',0.7), (4,'RESUS','BOARDING','TRANSFER',0.5), (5,'OBS','BOARDING','TRANSFER',0.6),
 (6,'OBS','DISCHARGE','TRANSFER',0.4), (7,'FASTTRACK','DISCHARGE','TRANSFER',0.7), (8,'BOARDING','DISCHARGE','TRANSFER',0.3),
 (9,'TRIAGE','RESUS','SHARED_RESOURCE',1.0), (10,'OBS','RADIOLOGY','SHARED_RESOURCE',0.9), (11,'FASTTRACK','RADIOLOGY','SHARED_RESOURCE',0.7),
 (12,'TRIAGE','FASTTRACK','PROXIMITY',0.5), (13,'RESUS','OBS','PROXIMITY',0.6), (14,'OBS','DISCHARGE','PROXIMITY',0.4)"""
EDGE_TYPES_COLUMNS = "ordinal, source, target, edge_type, base_weight"


def as_sql(rows, columns):
    return f"SELECT * FROM (VALUES {rows}) AS t({columns})"


def _doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def hospitals(spark):
    return _doubles(spark.sql(as_sql(HOSPITALS, HOSPITALS_COLUMNS)), "lat", "lon")


def dept_types(spark):
    return _doubles(spark.sql(as_sql(DEPT_TYPES, DEPT_TYPES_COLUMNS)), "dlat", "dlon")


def _per_hospital(spark, rows, columns):
    """Every kind of row in every hospital: the kinds are one constant array, unpacked per row."""
    kinds = F.expr(f"inline(array({rows}))").alias(*columns.split(", "))
    return hospitals(spark).select("*", kinds)


def departments(spark):
    d = _doubles(_per_hospital(spark, DEPT_TYPES, DEPT_TYPES_COLUMNS), "dlat", "dlon")
    return d.select(
        "hospital_id", F.concat_ws("_", "hospital_id", "suffix").alias("dept_id"), "dept_name",
        "dept_type", "capacity", "floor_number", (F.col("lat") + F.col("dlat")).alias("lat"),
        (F.col("lon") + F.col("dlon")).alias("lon"), F.col("node_idx").alias("ordinal"))


def edges(spark):
    e = _doubles(_per_hospital(spark, EDGE_TYPES, EDGE_TYPES_COLUMNS), "base_weight")
    return e.select(
        "hospital_id", F.concat_ws("_", "hospital_id", "source").alias("source_dept"),
        F.concat_ws("_", "hospital_id", "target").alias("target_dept"), "edge_type",
        "base_weight", "ordinal")
