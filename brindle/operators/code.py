"""Source code as rows: a token each, with its place, line and depth, brackets matched and functions found by windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.arrays import running

#: Comments, raw strings, strings, characters, names, numbers, single signs. Repeated groups are possessive: they take no
#: stack that grows with the text. What isn't closed runs to the end.
PIECE = (
    r"//[^\n]*"
    r"|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?"
    r'|\bb?r(?<hash>#*)"[\s\S]*?(?:"\k<hash>|\z)'
    r'|b?"(?:[^"\\]|\\[\s\S])*+"?'
    r"|b?'(?:[^'\\\n]|\\[^\n][^'\n]*)'"
    r"|[A-Za-z_]\w*|[0-9]\w*|[^\s\w]"
)
KINDS = "comment", "string", "name", "number", "sign"


def _kind(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^(?://|/\*)"), "comment")
        .when(token.rlike(r"""^(?:b?"|b?r#*"|b?'.+'$)"""), "string")
        .when(token.rlike(r"^[A-Za-z_]"), "name")
        .when(token.rlike(r"^[0-9]"), "number")
        .otherwise("sign")
    )


def code_tokens(files: DataFrame, id_col: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, i, pos, line, token, kind, brace, paren) of each text's tokens: i counts them, pos is the place of the first code
    point from 0, line counts from 1; brace and paren say how many braces and parentheses are open behind the token.

    Null texts have no tokens. One row of a text makes them all; nothing is shuffled. Columns to keep stand in every row.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = F.struct(F.regexp_extract_all(t, F.lit(PIECE), F.lit(0)).alias("t"), F.split(t, PIECE, -1).alias("g"))
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    add = lambda a, b: a + b

    def measured(x: Column) -> Column:
        gap = lambda i: F.get(x["g"], i)
        turn = lambda t, a, b: F.when(t == a, 1).when(t == b, -1).otherwise(0)
        return F.struct(
            x["t"].alias("t"), x["g"].alias("g"), running(F.transform(x["t"], lambda t, i: F.length(gap(i)) + F.length(t)), add).alias("end"), running(F.transform(x["t"], lambda t, i: lines(gap(i)) + lines(t)), add).alias("nl"),
            running(F.transform(x["t"], lambda t: turn(t, "{", "}")), add).alias("b"), running(F.transform(x["t"], lambda t: turn(t, "(", ")")), add).alias("p"),
        )

    def rows(x: Column) -> Column:
        row = lambda t, i: F.struct(
            i.alias("i"), (F.get(x["end"], i) - F.length(t)).alias("pos"), (F.get(x["nl"], i) - lines(t) + 1).alias("line"), t.alias("token"), _kind(t).alias("kind"), F.get(x["b"], i).alias("brace"), F.get(x["p"], i).alias("paren")
        )
        return F.transform(x["t"], row)

    # arrays of one element bind what is used more than once to a name
    found = F.transform(F.transform(F.array(cut), measured), rows)[0]
    return files.select(F.col(id_col).alias("id"), *keep, F.explode(found).alias("r")).select("id", *keep, "r.*")


def brackets(tokens: DataFrame) -> DataFrame:
    """(id, sign, open, close, line): places in tokens of the braces and parentheses that are closed. Those of one depth
    take turns, so each one's partner is the next of its depth."""
    inner = F.when(F.col("token").isin("{", "}"), F.col("brace")).otherwise(F.col("paren")) + F.when(F.col("token").isin("}", ")"), 1).otherwise(0)
    signs = tokens.where("kind = 'sign' and token in ('{', '}', '(', ')')").select("id", "i", "line", "token", inner.alias("depth"), F.when(F.col("token").isin("{", "}"), "{").otherwise("(").alias("sign"))
    beside = Window.partitionBy("id", "sign", "depth").orderBy("i")
    paired = signs.withColumn("close", F.lead("i").over(beside)).withColumn("shut", F.lead("token").over(beside))
    return paired.where("token = sign and shut <> sign").select("id", "sign", F.col("i").alias("open"), "close", "line")


def looking_ahead(tokens: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """(id, i, line, token, next, open, paren_at, start) of tokens that more depends on: `fn` before a name, with the place of
    the next parenthesis; closed parentheses before a body, with its place; calls name!( of names, with that of their parenthesis.

    Texts are read from their end, so that what stands ahead is a running minimum: one sort, and no token is looked at
    for each of those before it.
    """
    back = Window.partitionBy("id").orderBy(F.desc("i"))
    ahead = back.rowsBetween(Window.unboundedPreceding, 0)
    sign = F.col("kind") == "sign"
    seen = tokens.where("kind <> 'comment'").select(
        "id", "i", "line", "token", "kind", F.lag("token").over(back).alias("next"), F.lag("kind").over(back).alias("next_kind"), F.lag("token", 2).over(back).alias("after"), F.lag("i", 2).over(back).alias("open"),
        F.min(F.when(sign & (F.col("token") == "("), F.col("i"))).over(ahead).alias("paren_at"),
        F.min(F.when(sign & F.col("token").isin("{", ";"), F.col("i") * 2 + (F.col("token") == ";").cast("int"))).over(ahead).alias("body_at"),
    )
    head = (F.col("kind") == "name") & (F.col("token") == "fn") & (F.col("next_kind") == "name")
    # a place doubled, and one for a semicolon
    behind = sign & (F.col("token") == ")") & (F.col("body_at") % 2 == 0)
    call = (F.col("kind") == "name") & F.col("token").isin(*names) & (F.col("next") == "!") & (F.col("after") == "(")
    return seen.where(head | behind | call).select("id", "i", "line", "token", "next", "open", "paren_at", F.shiftright("body_at", 1).alias("start"))


def rust_functions(seen: DataFrame, matched: DataFrame) -> DataFrame:
    """(id, name, head, line, open, close, start, end) of functions with a body, from rows of looking_ahead: places in tokens
    of `fn`, of the parameters' parentheses and of the body's braces."""
    heads = seen.where("token = 'fn'").select("id", F.col("i").alias("head"), "line", F.col("next").alias("name"), F.col("paren_at").alias("open"))
    parens = matched.where("sign = '('").select("id", "open", "close")
    bodies = matched.where("sign = '{'").select("id", F.col("open").alias("start"), F.col("close").alias("end"))
    behind = seen.where("token = ')'").select("id", F.col("i").alias("close"), "start")
    return heads.hint("merge").join(parens, ["id", "open"]).hint("merge").join(behind, ["id", "close"]).hint("merge").join(bodies, ["id", "start"]).select("id", "name", "head", "line", "open", "close", "start", "end")


def test_spans(tokens: DataFrame, matched: DataFrame) -> DataFrame:
    """(id, start, end) of what stands behind #[cfg(test)]: places in tokens of the next brace and its partner."""
    back = Window.partitionBy("id").orderBy(F.desc("i"))
    mark = F.concat_ws("", "token", *[F.lag("token", k).over(back) for k in range(1, 7)])
    brace = F.min(F.when((F.col("kind") == "sign") & (F.col("token") == "{"), F.col("i"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    found = tokens.where("kind <> 'comment'").select("id", mark.alias("mark"), "token", brace.alias("start")).where("token = '#' and mark = '#[cfg(test)]'")
    return found.join(matched.where("sign = '{'").select("id", F.col("open").alias("start"), F.col("close").alias("end")), ["id", "start"]).select("id", "start", "end").distinct()


test_spans.__test__ = False
