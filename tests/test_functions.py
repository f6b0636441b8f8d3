import hashlib
import random
import time
import zlib

from pyspark.sql import functions as F

from brindle.functions import bytes as B
from brindle.functions import checksums as C
from brindle.operators import differential as D
from brindle.operators import textscan as T
from brindle.operators.stubs import COMMENTS, find_stubs, may_have_stubs, sequences, stub_functions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_checksums(spark):
    rows = D.byte_inputs(spark, 60, seed=3, longest=300).withColumn("x", F.col("input"))
    x, half = F.col("x"), F.floor(F.octet_length("x") / 2).cast("int")
    a, b = F.substr(x, F.lit(1), half), F.substr(x, half + 1)
    got = rows.select(
        "x", C.crc32(x).alias("crc"), C.crc_reflected(x).alias("crc_table"), C.adler32(x).alias("adler"), C.fletcher16(x).alias("fletcher"), C.crc32_msb(x).alias("msb"),
        C.crc32_combine(C.crc32(a), C.crc32(b), F.octet_length(b).cast("bigint")).alias("crc_both"), C.adler32_combine(C.adler32(a), C.adler32(b), F.octet_length(b)).alias("adler_both"),
        *[C.digest(x, n).alias(n) for n in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")],
    ).collect()
    assert len(got) == 60
    for r in got:
        data = bytes(r.x)
        assert r.crc == r.crc_table == r.crc_both == zlib.crc32(data)
        assert r.adler == r.adler_both == zlib.adler32(data)
        s1 = s2 = 0
        for v in data:
            s1 = (s1 + v) % 255
            s2 = (s2 + s1) % 255
        assert r.fletcher == s2 * 256 + s1
        for n in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
            assert r[n] == hashlib.new(n, data).hexdigest()
    assert one(spark, C.crc32_msb(F.lit("123456789"))) == 0xFC891918


def test_inputs_depend_on_seed_and_place_only(spark):
    a = {r.idx: bytes(r.input) for r in D.byte_inputs(spark, 40, 5).collect()}
    b = {r.idx: bytes(r.input) for r in D.byte_inputs(spark, 30, 5).repartition(7).collect()}
    assert all(a[i] == b[i] for i in b)
    assert a != {r.idx: bytes(r.input) for r in D.byte_inputs(spark, 40, 6).collect()}


def test_bytes(spark):
    rnd = random.Random(1)
    rows = [(rnd.getrandbits(62), rnd.getrandbits(20), rnd.randrange(0, 40)) for _ in range(50)]
    df = spark.createDataFrame(rows, "w long, c long, n int")
    table = C.crc_table()
    for r in df.select("*", B.byte_swap(F.col("w")).alias("s"), B.bit_reverse(F.col("c"), F.col("n")).alias("r"), B.crc_word(F.col("w")).alias("k")).collect():
        assert r.s == r.w.to_bytes(8, "little").hex().upper()
        n = r.n % 32
        assert r.r == sum((r.c >> i & 1) << (n - 1 - i) for i in range(n))
        w = r.w
        for _ in range(8):
            w = (w >> 8) ^ table[w & 255]
        assert r.k == w & 0xFFFFFFFF
    assert one(spark, B.compress_bound_simple(F.lit(2**63 - 1))) is None
    assert one(spark, B.compare_bytes(F.lit("abc"), F.lit("abd"), F.lit(2))) == 0
    assert one(spark, B.compare_bytes(F.lit("abc"), F.lit("abd"), F.lit(3))) == -1
    assert bytes(one(spark, B.zero_bytes(F.lit(3)))) == b"\0\0\0"
    assert [one(spark, B.data_type(F.lit(x))) for x in ("a\n", "\x01", "")] == [1, 0, 2]


def test_bit_buffer(spark):
    """Bits sent one after another come out as the same bit string."""
    rnd = random.Random(4)
    sent = [(rnd.getrandbits(n), n) for n in (rnd.randint(1, 16) for _ in range(9))]
    # a step at a time, as columns: nested in one expression the plan would double with every step
    df = spark.range(1).select(B.bit_buffer(F.lit(0), F.lit(0), F.array().cast("array<int>")).alias("s"))
    for v, n in sent:
        df = spark.createDataFrame(df.select(B.send_bits(F.col("s"), F.lit(v), F.lit(n)).alias("s")).collect(), "s " + B.BUFFER)
    out = df.select(B.bi_windup(F.col("s")).alias("s")).first().s
    want = 0
    at = 0
    for v, n in sent:
        want |= v << at
        at += n
    assert bytes(out.pending) == want.to_bytes(-(-at // 8), "little")
    full = spark.range(1).select(B.bi_flush(B.bit_buffer(F.lit(0xABCD), F.lit(16), F.array().cast("array<int>"))).alias("s")).first().s
    assert (full.bi_buf, full.bi_valid, full.pending) == (0, 0, [0xCD, 0xAB])


def test_floats_and_codecs(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 2**-52), (1.0, 1.1), (float("nan"), float("nan")), (0.0, -0.0)], "a double, b double")
    assert [r.x for r in df.select(D.same_float(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, True]
    packed = spark.range(1).select(D.inflate(D.deflate(F.lit("abc" * 50))).alias("x")).first().x
    assert bytes(packed) == b"abc" * 50
    block = one(spark, D.aes_block(F.unhex(F.lit("00112233445566778899aabbccddeeff")), F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))))
    assert bytes(block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"


def test_c_text(spark):
    values = {"0x10": 16, "0b101": 5, "017": 15, "42u": 42, "-7": -7, "1UL": 1, "foo": None, "08": None, "0xFFFFFFFFul": 0xFFFFFFFF}
    df = spark.createDataFrame([(k,) for k in values], "v string")
    got = {r.v: r for r in df.select("v", T.c_literal(F.col("v")).alias("n"), T.literal_type(F.col("v")).alias("t")).collect()}
    assert {k: got[k].n for k in values} == values
    assert (got["42u"].t, got["-7"].t, got["0x10"].t, got["1UL"].t, got["foo"].t) == ("u32", "i32", "u32", "u64", "u32")
    assert one(spark, T.c_type_to_rust(F.lit("const unsigned char *"))) == "*mut u8"
    code = "/* int no(void) { } */\nstatic int add(int a, int (*f)(int, int)) {\n  char *s = \"}\"; // }\n  return g(a) + add(a, f);\n}\nvoid main(void) { add(1, 2); if (x) { } }\n#define N 0x10\n#define F(x) x\n"
    files = spark.createDataFrame([("a.c", code), ("b.c", None)], "path string, text string")
    fns = {r.name: r for r in T.c_functions(files).collect()}
    assert set(fns) == {"add", "main"}
    assert fns["add"].calls == ["add", "g"] and fns["add"].is_static and fns["add"].line_count == 4 and len(fns["add"].params) == 2
    assert fns["main"].params == [] and fns["main"].calls == ["add"]
    assert [tuple(r) for r in T.defines(files, "path", "text").collect()] == [("a.c", "N", "0x10", 16, "u32")]
    assert T.split_top_level("a, f(b, c), [d, e], \"x,y\"") == ["a", "f(b, c)", "[d, e]", '"x,y"']
    assert T.matching_brace("{ '}' \"}\" /* } */ }", 0) == 18


def test_scanners(spark):
    rust = "// TODO: later\npub fn a() { todo!() }\nfn b() { unsafe { x() } } // unsafe { }\nlet s = \"unsafe {\";\npub const fn c() {}\n"
    df = spark.createDataFrame([(1, rust)], "id int, text string")
    assert {(r.line, r.pattern, r.fn_name) for r in find_stubs(df, "id", "text").collect()} == {(2, "todo_macro", "a")}
    assert [r.line for r in T.find_unsafe(df, "id", "text").collect()] == [3]
    assert df.select(T.public_functions(F.col("text")).alias("x")).first().x == ["a", "c"]
    more = 'pub(crate) fn d() { let u = "http://x"; } pub(super) unsafe fn e() {} pub extern "C" fn f() {}\n/* pub fn no() */ pub(in a::b) const fn g() {} let s = "/*"; pub fn h() {} // pub fn not()'
    assert one(spark, T.public_functions(F.lit(more))) == ["d", "e", "f", "g", "h"]
    paths = {"src/ffi.rs": True, "a/src/ffi.rs": False, "x/y/build.rs": True, "src/lib.rs": False, "gen/a/b.rs": True}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.allowed(F.col("p"), ["src/ffi.rs", "build.rs", "gen/**/*.rs"]).alias("ok")).collect()
    assert {r.p: r.ok for r in got} == paths
    assert one(spark, T.strip_line_markers(F.lit('# 1 "a.c"\nint x;\n# if'))) == "int x;\n# if"
    log = [(1, i, t) for i, t in enumerate(["note", "error: a", " at b", "warning: c", " at d", "error: e"])]
    blocks = T.error_blocks(spark.createDataFrame(log, "f int, n int, t string"), "f", "n", "t")
    assert sorted(r.message for r in blocks.collect()) == ["error: a\n at b", "error: e"]
    small = T.error_blocks(spark.createDataFrame(log, "f int, n int, t string"), "f", "n", "t", chunk=2)
    assert sorted((r.block, r.message) for r in small.collect()) == sorted((r.block, r.message) for r in blocks.collect())


def test_sums_of_many_bytes(spark):
    """2,000,000 bytes in 1,000 rows and one row of as many: a fold of expressions took half a microsecond for each byte and sum."""
    rng = random.Random(3)
    data = [rng.randbytes(2000) for _ in range(1000)] + [rng.randbytes(2_000_000), b"", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i long, x binary").repartition(1).cache()
    df.count()
    both = lambda: df.select("i", C.adler32(F.col("x")).alias("a"), C.adler32(F.col("x"), 77).alias("s"), C.crc32c(F.col("x")).alias("c")).collect()
    begun = time.time()
    rows = both()
    assert time.time() - begun < 5
    for r in rows:
        x = data[r.i]
        assert (r.a, r.s) == ((None, None) if x is None else (zlib.adler32(x), zlib.adler32(x, 77)))
    few = df.where("i < 20 or i > 1000").select("i", C.crc_reflected(F.col("x"), 0, C.CRC32C_POLY).alias("c")).collect()
    assert few and {r.i: r.c for r in few}.items() <= {r.i: r.c for r in rows}.items()


def test_stubs_of_long_and_idle_texts(spark):
    """Texts without what a finding needs are never cut; one of 120,000 tokens takes seconds, as no token looks at all behind it."""
    assert not spark.createDataFrame([("<a href='x'>// nothing here</a>",), ("fn a() { b() }",), (None,), ("placeholder",)], "text string").where(may_have_stubs(F.col("text"))).count()
    for phrases in COMMENTS.values():
        said = [s.strip().replace("#", "12") for p in phrases for s in sequences(p)]
        texts = spark.createDataFrame([(f"x /* {s.upper()} */",) for s in said] + [(s if s.startswith("//") else f"// we don't. {s}",) for s in said], "text string")
        assert texts.where(~may_have_stubs(F.col("text"))).count() == 0
    code = "fn a(buf: &[u8]) -> Result<(), E> {\n" + "x = y;\n" * 30_000 + "Ok(())\n}\nfn b() { todo!() }\n"
    begun = time.time()
    rows = find_stubs(spark.createDataFrame([(1, code)], "id long, text string"), "id", "text").collect()
    assert {(r.line, r.pattern, r.fn_name) for r in rows} == {(1, "fn_ignores_inputs", "a"), (30_004, "todo_macro", "b")}
    assert time.time() - begun < 60


def test_stubs(spark):
    code = """fn a(buf: &[u8]) -> Result<(), E> {
    // Conceptually this is a
    //   simple heuristic
    Ok(())
}
fn b(data: &[u8]) -> Result<(), E> { let n = data.len(); Ok(()) }
fn c() { let s = "todo!()"; panic!("not yet there") } /* we don't have the
actual algorithm */
#[cfg(test)]
mod tests { fn t() { todo!() } }
fn d() { let _ = x; unimplemented!("d") }
static T: [u8; 3] = [1, // ... 253 more entries
];
"""
    files = spark.createDataFrame([(1, code), (2, None)], "id long, text string")
    rows = find_stubs(files, "id", "text").collect()
    assert {(r.line, r.pattern, r.fn_name) for r in rows} == {
        (1, "fn_ignores_inputs", "a"), (2, "comment_conceptually", "a"), (3, "comment_simple_heuristic", "a"), (7, "panic_not_impl", "c"),
        (7, "comment_dont_have_algorithm", None), (7, "comment_dont_have_access", None), (11, "unimplemented_macro", "d"), (12, "comment_n_more_entries", None),
    }
    assert len(rows) == 8 and {r.id for r in rows} == {1}
    tests_too = {(r.line, r.pattern) for r in find_stubs(files, "id", "text", skip_tests=False).collect()}
    assert tests_too - {(r.line, r.pattern) for r in rows} == {(10, "todo_macro")}
    names = spark.createDataFrame([(1, "d"), (1, "b"), (1, "t"), (2, "d")], "id long, name string")
    assert sorted(tuple(r) for r in stub_functions(files, names, "id", "text").collect()) == [(1, "d"), (1, "t")]


def test_aliases_in_folds(spark):
    """An alias that is named like an expression's input doesn't get into its folds."""
    df = spark.createDataFrame([(bytearray(b"123456789"), 5, 6, [9, 3, 0])], "x binary, a bigint, b bigint, h array<int>")
    plain = df.select(C.crc32c(F.col("x")).alias("c"), C.multmodp(F.col("a"), F.col("b")).alias("m"), C.x2nmodp(F.col("a"), F.col("b").cast("int")).alias("p"), B.bit_reverse(F.col("a"), F.col("b").cast("int")).alias("r"), B.slide(F.col("h"), F.col("a")).alias("s")).first()
    odd = df.select(F.hex("x").alias("x"), (F.col("a") * 7).alias("a"), (F.col("b") * 3).alias("b"), F.array(F.lit(1)).alias("h"), C.crc32c(F.col("x")).alias("c"), C.multmodp(F.col("a"), F.col("b")).alias("m"), C.x2nmodp(F.col("a"), F.col("b").cast("int")).alias("p"), B.bit_reverse(F.col("a"), F.col("b").cast("int")).alias("r"), B.slide(F.col("h"), F.col("a")).alias("s")).first()
    assert plain.c == 0xE3069283 and plain.s == [4, 0, 0] and plain.r == 0b101000
    assert tuple(plain) == tuple(odd)[4:]
