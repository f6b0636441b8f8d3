from pyspark.sql import functions as F

from brindle.operators import architecture as A
from brindle.operators import repair as P
from brindle.operators.lints import constant_time, lint_functions
from brindle.operators.variants import resolve


def test_lints(spark):
    kind = "name string, family string, variant string, source string, inputs array<struct<name:string,type:string>>"
    buf = [("buf", "&[u8]")]
    rows = [
        ("ok", "crc32", "ieee_reflected", "pub fn f(buf: &[u8]) { 0xEDB8_8320; c >> 1; buf }", buf),
        ("poly", "crc32", "ieee_reflected", "pub fn f(buf: &[u8]) { 0x04C11DB7; c << 1; buf }", buf),
        ("base", "adler32", None, "let BASE = 255; s1 = 0;", []),
        ("sha", "sha256", None, "bit_len.to_le_bytes()", []),
        ("md5", "md5", None, "bit_len.to_be_bytes()", []),
        ("aes", "aes", "aes128_ecb", "const ROUNDS: u32 = 12;", []),
        ("unused", "other", None, "pub fn f(data: &[u8]) -> u32 { 0 }", [("data", "&[u8]")]),
    ]
    got = {}
    for r in lint_functions(spark.createDataFrame(rows, kind)).collect():
        got.setdefault(r.name, set()).add(r.rule)
    assert got == {
        "poly": {"crc32_wrong_polynomial", "crc32_traversal_direction_mismatch"}, "base": {"adler32_wrong_base", "adler32_s1_zero_init"}, "sha": {"sha256_le_length_padding", "sha256_missing_h0"},
        "md5": {"md5_be_length_padding"}, "aes": {"aes_wrong_round_count"}, "unused": {"unused_input"},
    }
    code = "if key[i] == 0 { }\n// if key == 1\nmatch secret { }\nfor b in key { return }\nif x == 1 { }"
    found = constant_time(spark.createDataFrame([("a", code)], "path string, text string")).collect()
    assert {(r.line, r.rule) for r in found} == {(1, "branch_on_secret"), (3, "match_on_secret"), (4, "early_return_in_secret_loop")}


def test_architecture(spark):
    crates = spark.createDataFrame(
        [("w-a", ["m1", "m2"], ["w-b"], ["f"]), ("w-b", ["m1"], ["w-a", "ext"], []), ("x-c", [], [], []), ("w-x-c", ["m9"], [], [])],
        "name string, modules array<string>, dependencies array<string>, public_api array<string>",
    )
    errors = spark.createDataFrame([("E", "gone")], "name string, crate string")
    specs = spark.createDataFrame([("m1", "a1"), ("m3", "a3"), ("m4", "m2")], "module string, algorithm string")
    got = {(r.rule, r.location) for r in A.validate(crates, errors, specs, "w").collect()}
    assert got == {
        ("dependency_dag", "w-a, w-b"), ("missing_producer", "E"), ("empty_crate", "x-c"), ("workspace_naming", "x-c"), ("module_name_collision", "w-x-c"),
        ("per_crate_error_missing", "w-a"), ("module_multi_assigned", "m1"), ("unknown_module", "m9"), ("spec_unassigned", "m3"),
    }
    types = spark.createDataFrame([("Big", [str(i) for i in range(11)]), ("Held", [str(i) for i in range(11)]), ("Small", ["a"])], "name string, fields array<string>")
    assert [r.location for r in A.large_states(types, spark.createDataFrame([("Held",)], "inner_state string")).collect()] == ["Big"]
    fns = spark.createDataFrame([("deflateInit2_", [("a", "i32"), ("b", "i32"), ("s", "&mut Stream")]), ("init", [("a", "i32")])], "name string, inputs array<struct<name:string,type:string>>")
    assert [r.location for r in A.parameterized_inits(fns, spark.createDataFrame([], "built_type string")).collect()] == ["deflateInit2_"]


def test_repair(spark):
    texts = {
        '{"a": 1}': '{"a": 1}', '<think>{</think> ok ```json\n{"a": [1]}\n``` bye': '{"a": [1]}', 'so {"a": {"b": [1, 2': '{"a": {"b": [1, 2]}}',
        '{"a": "x", "b": "cut': '{"a": "x"}', "nothing": None, 'x {"a": 1} y': '{"a": 1}', '{"a": {"b": "c"}, "d': '{"a": {"b": "c"}}',
        'set {x} is {"k": {"z": [1]}} or {}': '{"k": {"z": [1]}}', "[1, 2]": "[1, 2]", 'a {b} {"c": 1, "d": [2': '{"c": 1, "d": [2]}', "": None, "{": "{}",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.j for r in df.select("t", P.extract_json(F.col("t")).alias("j")).collect()} == texts
    code = {"fn a() { (x": "fn a() { (x)}", "a) }": "a ", 'f("}") {': 'f("}") {}', "// {\n{": "// {\n{}"}
    df = spark.createDataFrame([(t,) for t in code], "t string")
    assert {r.t: r.j for r in df.select("t", P.balanced(F.col("t")).alias("j")).collect()} == code
    assert spark.range(1).select(P.toml_commas(F.lit('m = [\n"a"\n"b",\n"c"\n]')).alias("x")).first().x == 'm = [\n"a",\n    "b",\n"c"\n]'


def test_variants(spark):
    kind = "family string, family_pattern string, variant string, position int, fingerprints array<string>, catalog string"
    variants = spark.createDataFrame([("crc", "crc", "ieee", 0, ["edb88320", "reflected"], "crc32"), ("crc", "crc", "cast", 1, ["82f63b78", "reflected"], "crc32c"), ("md", "md5", "md5", 2, ["none"], "md5")], kind)
    algs = spark.createDataFrame([("crc_a", "poly EDB88320"), ("crc_b", "reflected"), ("crc_c", "reflected"), ("crc_d", "?"), ("md5", "?"), ("zip", "?")], "name string, text string")
    vectors = spark.createDataFrame([("crc_c", "0x616263", "00364b3fb7")], "name string, input string, expected string")
    catalog = spark.createDataFrame([("crc32", "616263", "352441c2"), ("crc32c", "616263", "364b3fb7")], "catalog string, input string, expected string")
    got = {r.name: (r.chosen, r.rationale) for r in resolve(algs, variants, vectors, catalog).collect()}
    assert got == {"crc_a": ("ieee", "one candidate"), "crc_b": (None, "ambiguous"), "crc_c": ("cast", "one candidate"), "crc_d": (None, "no fingerprint"), "md5": ("md5", "one candidate"), "zip": (None, "no family")}


def test_close_json_after_long_tails():
    assert P.close_json('{"a": [1, 2, ' + "x" * 5000) == '{"a": [1, 2]}'
    assert P.close_json('{"a": 1, "b": ' + '"c" ' * 2000) == '{"a": 1, "b": "c"}'
    assert P.close_json("]" + "1" * 1000) is None
