"""op10 against all pairs of lines."""

import random

from brindle.llm.line_dedup import dedup_lines
from brindle.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) - len(b) == 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs, least=5):
    seen, out = [], {}
    for i, t in sorted(docs):
        keep = []
        for line in t.split("\n"):
            w = tuple(line.encode().lower().split())
            if len(w) >= least:
                again = any(one_edit(w, x) for x in seen)
                seen.append(w)
                if again:
                    continue
            keep.append(line)
        out[i] = "\n".join(keep)
    return out


def test_random_lines(spark):
    rnd = random.Random(5)
    docs = [(i, "\n".join(" ".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 3, 5, 6, 7, 8, 9]))) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    got = dedup_lines(spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_lines int"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert {r.doc_id: r.text for r in got.collect()} == brute(docs)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op10_line_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: r.text for r in got} == brute(docs)


def test_edges(spark):
    kind = "doc_id long, text string"
    assert dedup_lines(spark.createDataFrame([], kind)).count() == 0
    line = "this is a line of words"
    rows = [(1, line), (1, line), (2, line.upper() + "\n\n  "), (None, line), (3, None), (4, ""), (5, "w " * 30_000), (6, "w " * 29_999)]
    got = sorted(((r.doc_id or -1, r.text, r.n_dropped) for r in dedup_lines(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == sorted([(1, line, 0), (1, line, 0), (2, "\n  ", 1), (-1, line, 0), (3, None, 0), (4, "", 0), (5, "w " * 30_000, 0), (6, "", 1)], key=str)
