"""Explicit schemas of all inputs and outputs; nothing is inferred."""

from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x_min", "y_min", "x_max", "y_max")])
RING = T.ArrayType(VERTEX)
#: the object stream; qid 0 stands for no road
LOCATIONS = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("oid", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("qid", T.IntegerType())])
ROADS = T.StructType([
    T.StructField("t", T.LongType()), T.StructField("qid", T.IntegerType()), T.StructField("cid", T.IntegerType()), T.StructField("range", T.LongType()),
    T.StructField("slide", T.LongType()), T.StructField("start", VERTEX), T.StructField("end", VERTEX), T.StructField("ring", RING),
])
ACTIVE = T.StructType([T.StructField("qid", T.IntegerType())])
START_TIMES = T.StructType([T.StructField("oid", T.LongType()), T.StructField("t", T.DoubleType())])
ROAD_SEGMENTS = T.StructType([T.StructField("segment_id", T.LongType()), T.StructField("class_id", T.IntegerType()), T.StructField("osm_id", T.LongType()), T.StructField("name", T.StringType())])
BUFFERS = T.StructType([T.StructField("qid", T.IntegerType()), T.StructField("osm_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("class_id", T.IntegerType())])
AXES = T.StructType([T.StructField("qid", T.IntegerType()), T.StructField("win_range", T.IntegerType()), T.StructField("win_slide", T.IntegerType()), T.StructField("category", T.IntegerType()), T.StructField("length", T.DoubleType())])
#: fixed values: an adaptive run's columns and their names in the text output, in order
TELEMETRY = {
    "t": "t", "load": "L_actual", "predicted": "L_pred", "capacity": "C", "low": "C-theta", "high": "C+theta", "active": "#active", "newbies": "#newbies",
    "profitable": "#profitable", "total": "#total", "used": "n", "delta": "s", "next": "n'", "processed": "#tup_processed", "tuples": "#tup_total",
    "so_far": "#tup_sofar", "maintained": "maintained", "evicted": "#tup_deleted", "cycles_under": "cycles_under", "cycles_over": "cycles_over",
    "cycles_shed": "#cycles_ls", "cycles": "#cyclesTotal", "shed": "LS:_si_o_no?", "answered": "#queries_ans", "up_time": "up_time", "ev_time": "ev_time",
    "ls_time": "ls_time", "mil_up_time": "MIL_up_time", "mil_ev_time": "MIL_ev_time", "mil_ls_time": "MIL_ls_time", "loads": "#Loads4pred",
}
RESULTS = T.StructType([T.StructField("t", T.LongType()), T.StructField("qid", T.IntegerType()), T.StructField("speed", T.DoubleType()), T.StructField("num_objects", T.LongType())])
