from brindle.operators import headers as H


def test_headers(spark):
    text = """/* int no(void); */
extern unsigned long adler32(unsigned long adler, const unsigned char *buf, size_t len);
char *name(void);
int cb(int (*f)(int, int), char tab[8]);
#define X 1
enum mode { A, B = 0x10, C, /* D, */ E };
enum { P = Q + 1, R };
static const int tab[2][2] = { {1, 2}, {3, 0x4} };
int body(void) { return f(1); }
"""
    files = spark.createDataFrame([("a.h", text), ("b.h", None)], "path string, text string")
    got = {r.name: r for r in H.prototypes(files).collect()}
    assert set(got) == {"adler32", "name", "cb"}
    assert [tuple(p) for p in got["adler32"].params] == [("unsigned long", "adler"), ("const unsigned char *", "buf"), ("size_t", "len")]
    assert (got["name"].return_type, got["name"].params, got["name"].line) == ("char*", [], 3) and len(got["cb"].params) == 2
    assert {(r.enum, r.name): r.number for r in H.enumerators(files).collect()} == {("mode", "A"): 0, ("mode", "B"): 16, ("mode", "C"): 17, ("mode", "E"): 18, ("", "P"): None, ("", "R"): None}
    assert [(r.name, r.type, r.length, r["values"]) for r in H.constant_tables(files).collect()] == [("tab", "int", 4, ["1", "2", "3", "0x4"])]
    kind = "name string, return_type string, inputs array<struct<name:string,type:string>>"
    specs = spark.createDataFrame([("adler32", "u32", [("a", "u64"), ("b", "&[u8]"), ("n", "usize")]), ("name", "*mut i8", [("x", "i32")]), ("gone", "u8", [])], kind)
    found = H.audit_signatures(specs, H.prototypes(files))
    assert {(r.name, r.rule) for r in found.collect()} == {("adler32", "return_type"), ("name", "parameter_count"), ("gone", "missing_c_function")}
    fixed = H.apply_return_fixes(specs, found, H.prototypes(files))
    assert {r.name: r.return_type for r in fixed.collect()} == {"adler32": "u64", "name": "*mut i8", "gone": "u8"}
