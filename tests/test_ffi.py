import pytest
from pyspark.sql import functions as F

from brindle.operators.ffi import c_type, ffi_type


def test_c_type(spark):
    want = {
        "int": ("int", False, 0, False), "const char": ("char", True, 0, False), "char *": ("char", False, 1, False), "const char *": ("char", True, 1, False),
        "char const *": ("char", True, 1, False), "char * const": ("char", False, 1, False), "char **": ("char", False, 2, False), " unsigned   long ": ("unsigned long", False, 0, False),
        "int []": ("int", False, 1, True), "int [8]": ("int", False, 1, True), "const struct node*": ("struct node", True, 1, False), "": ("", False, 0, False),
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", c_type(F.col("t")).alias("c")).collect()
    assert {r.t: tuple(r.c) for r in rows} == want


@pytest.mark.parametrize("typedefs, opaque, want", [
    (None, (), {"int": "c_int", "void": "()", "void *": "*mut c_void", "const void *": "*const c_void", "const char **": "*mut *const c_char", "const Bytef *": "*const c_uchar", "mystery_t *": "*mut c_void", "mystery_t": "mystery_t", None: None}),
    ({"handle": "c_int", "int": "no"}, ("z_stream",), {"handle": "c_int", "int": "c_int", "const handle *": "*const c_int", "struct z_stream *": "*mut z_stream", "uint32_t [4]": "*mut u32"}),
])
def test_ffi_type(spark, typedefs, opaque, want):
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", ffi_type(F.col("t"), typedefs, opaque).alias("r")).collect()
    assert {r.t: r.r for r in rows} == want
