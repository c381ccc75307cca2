"""Fixed schemas for every source (no inference)."""

from pyspark.sql import types as T

# Raw daily tap file, header ``time,lineID,stationID,deviceID,status,userID,payType``.
RAW_TAP_CSV = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("lineID", T.StringType()),
    T.StructField("stationID", T.StringType()),
    T.StructField("deviceID", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("userID", T.StringType()),
    T.StructField("payType", T.StringType()),
])

# Submission template, header ``stationID,startTime,endTime,inNums,outNums``.
TEMPLATE_CSV = T.StructType([
    T.StructField("stationID", T.IntegerType()),
    T.StructField("startTime", T.StringType()),
    T.StructField("endTime", T.StringType()),
    T.StructField("inNums", T.DoubleType()),
    T.StructField("outNums", T.DoubleType()),
])

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
