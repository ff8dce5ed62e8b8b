"""Declared schemas. Nothing in this package infers a schema from data."""

from pyspark.sql import types as T

_STR, _DBL, _INT, _LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


OBSERVATIONS = _struct(
    ("model", _STR), ("base_model", _STR), ("family", _STR), ("params_b", _DBL),
    ("is_instruct", _INT), ("scheme", _STR), ("weight_bits", _INT), ("act_bits", _INT),
    ("num_type", _STR), ("method", _STR), ("benchmark", _STR), ("n_items", _INT),
    ("acc_before", _DBL), ("acc_after", _DBL), ("delta", _DBL), ("orient_src", _STR),
    ("verified", _INT),
)
REJECTS = _struct(("model", _STR), ("benchmark", _STR), ("reason", _STR))
DOCUMENTS = _struct(("doc_id", _STR), ("text", _STR), ("n_bytes", _LONG))
TABLE_ROWS = _struct(("doc_id", _STR), ("table_no", _INT), ("row_no", _INT),
                     ("cells", T.ArrayType(_STR)))
PAIRED_RUNS = _struct(
    ("model", _STR), ("base_model", _STR), ("scheme", _STR), ("recipe", _STR),
    ("params_b", _DBL), ("benchmark", _STR), ("acc_before", _DBL), ("acc_after", _DBL),
    ("n_items", _INT), ("flip_rate", _DBL), ("is_control", _INT), ("method", _STR),
    ("weight_bits", _INT), ("act_bits", _INT), ("num_type", _STR), ("is_instruct", _INT),
    ("family", _STR), ("notes", _STR),
)
CLAIMS = _struct(("key", _STR), ("value", _DBL), ("tol", _DBL), ("how", _STR))
MANIFEST = _struct(("path", _STR), ("sha256", _STR))
REQUEST_LOG = _struct(("timestamp_utc", _STR), ("schemes", _STR), ("size_band", _STR),
                      ("moe", T.BooleanType()), ("refused_cells", _STR))
