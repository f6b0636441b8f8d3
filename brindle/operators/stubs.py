"""Unfinished code in Rust sources: stub macros, comments that give up, functions that ignore what they are given.

Texts are cut into rows of tokens once (operators.code); every rule is a filter, a window or a join of such rows, so
that spelling, spaces and comments in between make no difference.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.code import brackets, code_tokens, looking_ahead, rust_functions, test_spans
from brindle.operators.intervals import enclosing
from brindle.staging import staged

#: Names of findings. A macro is a stub whatever it says, or if its message has one of the given word sequences.
MACROS = {"unimplemented_macro": ("unimplemented", ()), "todo_macro": ("todo", ()), "panic_not_impl": ("panic", ("not implemented", "stub", "unimplemented", "not yet", "missing"))}
#: Names of findings, and word sequences of comments that give up: a/b are alternatives, ? marks a word
#: that may be missing, * that a longer word may follow; "..." and "//" are words.
COMMENTS = {
    "comment_dont_have_algorithm": ("we dont have the? actual? algorithm*",),
    "comment_dont_have_access": ("we dont have access*", "we dont have the actual*", "we dont have the real*"),
    "comment_for_this_spec": ("for this spec/specification we simulate*/use*/assume*/will*",),
    "comment_we_simulate": ("we simulate/assume", "simulate the process/actual/call/logic/behavior"),
    "comment_conceptually": ("conceptually",),
    "comment_simple_heuristic": ("simple heuristic*",),
    "comment_not_accurate": ("this/it is not accurate*",),
    "comment_todo_implement": ("todo : implement",),
    "comment_fixme_stub": ("fixme :? stub*", "fixme :? not implemented*"),
    "comment_placeholder": ("placeholder",),
    "comment_in_reality": ("in reality this*/we*/the*",),
    "comment_not_implemented": ("not yet? implemented*",),
    "comment_auto_stub": ("autogenerated/auto stub*", "auto generated stub*"),
    "comment_rest_elided": ("// ... ( rest*", "// ... rest of*", "// ... remaining*", "// ... etc*", "// ... and so on*"),
    "comment_n_more_entries": ("// ... #? more/remaining entries*/elements*/values*/items*",),
}
#: Types of inputs that a function must look at, as tokens.
INPUT_TYPES = ("[ u8 ]", "Vec < u8 >", "& str")
STUB_NAMES = ("unimplemented", "todo", "panic")


def sequences(phrase: str) -> list[str]:
    """Every plain word sequence that a phrase stands for, in blanks; an open end has no blank behind it."""
    slots = []
    for word in phrase.split():
        given = [w for w in word.removesuffix("?").split("/")]
        slots.append([*given, ""] if word.endswith("?") else given)
    whole = (" ".join(w for w in words if w) for words in product(*slots))
    return [f" {w[:-1]}" if w.endswith("*") else f" {w} " for w in whole]


def comment_words(comment: Column) -> Column:
    """A comment's words in lower case between single blanks: apostrophes and line breaks don't part them, numbers are #, of
    the signs only colons, opened parentheses, three points and slashes at its start stay."""
    plain = F.regexp_replace(F.lower(comment), "'", "")
    words = F.regexp_extract_all(plain, F.lit(r"^//|\.\.\.|[a-z_][a-z_0-9]*|[0-9]+|[:(]"), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[0-9]"), "#").otherwise(w)), " "), F.lit(" "))


def says(words: Column, phrase: str) -> Column:
    out = F.lit(False)
    for s in sequences(phrase):
        out = out | F.contains(words, F.lit(s))
    return out


class Sources:
    """The token rows of some files, staged once, with their brackets, functions and test blocks. Columns say which texts may have
    test blocks, and functions that end with Ok(()): the others' tokens aren't sorted for them."""

    def __init__(self, files: DataFrame, id_col: str, text: str):
        has = lambda *words: reduce(lambda a, b: a & b, [F.contains(F.col(text).cast("string"), F.lit(w)) for w in words])
        marked = files.select(F.col(id_col), F.col(text), has("cfg", "test").alias("_tested"), has("fn", "Ok").alias("_idle"))
        # a file of a table may hold many texts, and few bytes: they are dealt out before they grow to rows of tokens
        marked = marked.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
        self.tokens = staged(code_tokens(marked, id_col, text, ("_tested", "_idle")), "tokens")
        self.matched, self.seen = staged(brackets(self.tokens), "brackets"), staged(looking_ahead(self.tokens, STUB_NAMES), "ahead")
        self.functions = staged(rust_functions(self.seen, self.matched), "functions")
        self.tests = staged(test_spans(self.tokens.where("_tested"), self.matched), "tests")

    def calls(self) -> DataFrame:
        """(id, i, line, name, open) of calls name!(."""
        return self.seen.where(F.col("token").isin(*STUB_NAMES)).select("id", "i", "line", F.col("token").alias("name"), "open")

    def macros(self) -> DataFrame:
        """(id, i, line, name, open, close) of calls name!(...); close is null for what isn't closed."""
        return self.calls().hint("merge").join(self.matched.where("sign = '('").select("id", "open", "close"), ["id", "open"], "left").select("id", "i", "line", "name", "open", "close")


def may_have_stubs(text: Column) -> Column:
    """Whether a text has what every finding needs: a macro's name, a comment and the longest word of a phrase, or `fn` and Ok."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    plain = F.regexp_replace(F.lower(text), "'", "")
    longest = {max(re.findall("[a-z_]+", s), key=len) for phrases in COMMENTS.values() for p in phrases for s in sequences(p)}
    needed = sorted(w for w in longest if not any(w != v and v in w for v in longest))  # a word holds what it begins with
    says_ = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(w)) for w in needed])
    return has(*STUB_NAMES) | has("//", "/*") & says_ | has("fn") & has("Ok")


def _ignored_inputs(s: Sources) -> DataFrame:
    """(id, i, line, pattern, text) of functions that end with Ok(()) and name none of their byte or text inputs."""
    # every token goes to the innermost function whose parameters or body it stands in
    heads = s.functions.select("id", F.col("open").alias("from"), F.col("end").alias("to"), "head", "close", F.col("start").alias("body"))
    inside = staged(enclosing(s.tokens.where("_idle and kind <> 'comment'").select("id", "i", "token", "kind"), heads, ["id"], "i", "from", "to").where("head is not null and i > `from`"), "inside")
    per = Window.partitionBy("id", "head").orderBy("i")
    turn = F.when(F.col("token").isin("(", "[", "<", "{"), 1).when(F.col("token").isin(")", "]", ">", "}"), -1).otherwise(0)
    params = inside.where("i < close").withColumn("nest", F.sum(turn).over(per)).withColumn("n", F.sum(F.when((F.col("token") == ",") & (F.col("nest") == 0), 1).otherwise(0)).over(per))
    each = params.groupBy("id", "head", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), " ").alias("p"))
    each = each.select("id", "head", F.regexp_replace("p", "^, ", "").alias("p")).where("contains(p, ':')")
    name, kind = F.regexp_extract("p", r"^(?:(?:&|mut) )*([A-Za-z_]\w*) :", 1), F.regexp_extract("p", r"^[^:]*: (.*)$", 1)
    wanted = F.lit(False)
    for t in INPUT_TYPES:
        wanted = wanted | F.contains(F.concat(F.lit(" "), kind, F.lit(" ")), F.lit(f" {t} "))
    inputs = each.where(wanted | kind.rlike(r"& \w+Buf\b")).select("id", "head", name.alias("token")).where("token <> '' and not startswith(token, '_')")
    body = inside.where("i > body")
    used = inputs.join(body.where("kind = 'name'").select("id", "head", "token").distinct(), ["id", "head", "token"]).select("id", "head").distinct()
    last = _tails(body)
    idle = inputs.select("id", "head").distinct().join(last.where("tail = 'Ok(())'").select("id", "head"), ["id", "head"]).join(used, ["id", "head"], "left_anti")
    return idle.join(s.functions.select("id", "head", "name", "line"), ["id", "head"]).select("id", F.col("head").alias("i"), "line", F.lit("fn_ignores_inputs").alias("pattern"), F.concat(F.lit("fn "), "name", F.lit(" returns Ok(()) without touching its inputs")).alias("snippet"), F.col("name").alias("fn_name"))


def _tails(body: DataFrame) -> DataFrame:
    """(id, head, tail): the last five tokens of each body."""
    back = body.withColumn("k", F.row_number().over(Window.partitionBy("id", "head").orderBy(F.desc("i")))).where("k <= 5")
    return back.groupBy("id", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), "").alias("tail"))


def find_stubs(files: DataFrame, id_col: str, text: str, skip_tests: bool = True) -> DataFrame:
    """(id, line, pattern, snippet, fn_name): a row for each stub of each text, fn_name being the innermost function around it.

    Macros count in code only, not in strings or comments, and not under #[cfg(test)] if skip_tests; comments count
    everywhere. Texts that can have none, see may_have_stubs, aren't cut. The snippet is the line a macro stands on, the first line of a comment, or what a function does. Ids tell files
    apart; null texts have no rows.
    """
    files = files.where(may_have_stubs(F.col(text)))
    s = Sources(files, id_col, text)
    quoted = s.tokens.where("kind = 'string'").select("id", F.col("i").alias("at"), F.col("token").alias("message"))
    macros = s.calls().withColumn("at", F.col("open") + 1).hint("merge").join(quoted, ["id", "at"], "left")
    words = comment_words(F.coalesce("message", F.lit("")))
    pattern = F.lit(None).cast("string")
    for found, (name, messages) in MACROS.items():
        hit = F.col("name") == name
        if messages:
            said = F.lit(False)
            for m in messages:
                said = said | says(words, m)
            hit = hit & said
        pattern = F.when(hit, found).otherwise(pattern)
    macros = macros.select("id", "i", "line", pattern.alias("pattern")).where("pattern is not null")
    if skip_tests:
        tests = s.tests.select("id", "start", "end", F.lit(True).alias("tested"))
        macros = enclosing(macros, tests, ["id"], "i").where("tested is null").select("id", "i", "line", "pattern")
    macros = staged(macros, "macros")
    # only texts with a macro's name are shuffled
    source = files.where(reduce(lambda a, b: a | b, [F.contains(F.col(text).cast("string"), F.lit(n)) for n in STUB_NAMES])).select(F.col(id_col).alias("id"), F.split(F.col(text).cast("string"), "\n", -1).alias("lines"))
    macros = macros.hint("merge").join(source, "id").select("id", "i", "line", "pattern", F.trim(F.get("lines", F.col("line") - 1)).alias("snippet"))
    spoken = s.tokens.where("kind = 'comment'").select("id", "i", "line", "token", comment_words(F.col("token")).alias("words"))
    names = F.array_compact(F.array(*[F.when(_any(F.col("words"), phrases), F.lit(n)) for n, phrases in COMMENTS.items()]))
    comments = spoken.select("id", "i", "line", F.explode(names).alias("pattern"), F.trim(F.split("token", "\n")[0]).alias("snippet"))
    around = s.functions.select("id", "start", "end", F.col("name").alias("fn_name"))
    placed = enclosing(staged(macros.unionByName(comments), "found"), around, ["id"], "i").select("id", "line", "pattern", "snippet", "fn_name")
    idle = _ignored_inputs(s)
    if skip_tests:
        idle = enclosing(idle, s.tests.select("id", "start", "end", F.lit(True).alias("tested")), ["id"], "i").where("tested is null")
    return placed.unionByName(idle.select("id", "line", "pattern", "snippet", "fn_name")).distinct().withColumnRenamed("id", id_col)


def _any(words: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | says(words, p)
    return out


def stub_functions(files: DataFrame, functions: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows (id, name) of functions (id, name) that are stubs in their file: a stub macro's arguments name the function,
    or the whole body is such a macro, behind `let _ = x;` and before a semicolon."""
    s = Sources(files, id_col, text)
    macros = staged(s.macros(), "macros")
    asked = functions.select(F.col(id_col).alias("id"), F.col("name")).distinct()
    args = macros.where("close is not null").select("id", "open", "close")
    said = enclosing(s.tokens.select("id", "i", "token"), args, ["id"], "i", "open", "close").where("open is not null and i > open")
    named = said.select("id", F.explode(F.regexp_extract_all(F.lower("token"), F.lit(r"([a-z_]\w*)"), F.lit(1))).alias("_n")).distinct()
    mentioned = asked.withColumn("_n", F.lower("name")).join(named, ["id", "_n"]).select("id", "name")
    own = s.functions.select("id", "start", "end", "name", "head")
    inside = enclosing(s.tokens.where("kind <> 'comment'").select("id", "i", "token"), own, ["id"], "i").where("name is not null and i > start")
    bodies = inside.groupBy("id", "name", "head").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), " ").alias("body"))
    # what is left of the body without its bindings has to begin with the macro that ends it
    left = F.regexp_replace("body", r"^(?:let _ = \w+ ; )*+", "")
    whole = bodies.select("id", "name", "last", left.alias("left"), F.endswith("body", F.lit(";")).alias("shut")).join(macros.select("id", F.col("name").alias("macro"), "i", "close"), "id")
    ends = (F.col("close") == F.col("last") - F.when(F.col("shut"), 1).otherwise(0)) & F.startswith("left", F.concat(F.col("macro"), F.lit(" ! (")))
    bare = whole.where(ends).select("id", "name").join(asked, ["id", "name"], "left_semi")
    return mentioned.unionByName(bare).distinct().withColumnRenamed("id", id_col)
