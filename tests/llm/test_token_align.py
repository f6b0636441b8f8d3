import hashlib
from collections import Counter

import pytest

from brindle.llm.token_align import Tokenizers, align, align_documents, links_of, pair_of, unpack

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

ODD = [
    (1, "A <|endoftext|> b <s> </s> <unk> <0x41> don't stop"), (2, None), (3, ""), (4, " "), (5, "▁ low line"), (6, "ｆｕｌｌ ﬁ width"), (7, "Ünïcödé 日本語 한국어 👍🏽 é"), (8, "a\u0000b\r\n\tc d　e"),
    (9, "x" * 5000), (10, " " * 3000 + "a" + "\n" * 2500), (11, "same words same words same words"), (11, "same words"), (None, "same words"), (12, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"), (13, "Ωμέγα и русский"), (14, "q"),
]


def brute(rows, how=Tokenizers()):
    """As the contract words it, by the two libraries' own calls and pairs of byte ranges."""
    first = tokenizers.Tokenizer.from_file(how.a)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=how.b)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def spans(parts):
        out, at = [], 0
        for i, raw in parts:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    docs, count = [], Counter()
    for doc_id, text in rows:
        docs.append((doc_id, [], [], []))
        if not text:
            continue
        a = [(i, bytes(letter[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:-1], 16)]) if len(p := second.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i in second.encode(text)]
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            continue
        a, b = spans(a), spans(b)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        docs[-1] = (doc_id, a, b, ends)
        start = 0
        for x, s, e in a:
            while b[start][2] <= s:
                start += 1
            j = start
            while j < len(b) and b[j][1] < e:
                count[x, b[j][0]] += 1
                j += 1
    most = Counter()
    for (x, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, a, b, ends in docs:
        links, start = [], 0
        for x, s, e in a:
            while b[start][2] <= s:
                start += 1
            j = start
            while j < len(b) and b[j][1] < e:
                links.append((x, b[j][0]))
                j += 1
        text, i, j = [], 0, 0
        for e in ends:
            left, right = [], []
            while i < len(a) and a[i][2] <= e:
                left.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= e:
                right.append(str(b[j][0]))
                j += 1
            text.append(",".join(left) + "|" + ",".join(right))
        digest = hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(ends), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), digest))
    return sorted(out, key=str)


def found(df):
    return sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize("hot", [0, 300, 200_000])
def test_documents_against_brute_force(spark, sf_dir, hot):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(align_documents(docs, Tokenizers(hot=hot))) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts_null_and_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, 5, b"x", "k") for i, t in ODD], "doc_id long, text string, row int, a binary, key string")
    got = found(align_documents(docs))
    assert got == brute(ODD)
    by_id = {r[0]: r for r in got}
    assert by_id[2][1:] == by_id[3][1:] == (0, 0, 0, 0, 0, 0, "") and by_id[5][1] == 0 and by_id[1][1] > 0


def test_empty_table(spark):
    assert align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark):
    rows = [(1, "lorem ipsum " * 60_000), (2, "^" * 400_000), (3, " \n" * 300_000), (4, "z" * 300_000), (5, "lorem ipsum")]
    got = found(align_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [r[0] for r in got] == [1, 2, 3, 4, 5] and got == brute(rows)


def test_tables_of_an_alignment(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    made = align(docs)
    pair = pair_of(Tokenizers())
    for r in made["groups"].collect():
        a, b = unpack(r.key)
        assert b"".join(pair.bytes_a[i] for i in a) == b"".join(pair.bytes_b[i] for i in b) != b""
    links = links_of(made["groups"]).selectExpr("sum(n * m) as x").first().x
    assert links == made["pairs"].selectExpr("sum(n) as x").first().x == sum(r[4] for r in brute(ODD))
    keys = [(r.a, r.b) for r in made["pairs"].collect()]
    assert len(keys) == len(set(keys))


def test_encoders_agree_on_every_character():
    pair = pair_of(Tokenizers())
    texts = ["".join(f"a{chr(c)} {chr(c)}1 " for c in range(at, at + 512) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 512)]
    slow = pair.slow.encode_batch_fast([t for t in texts if t], add_special_tokens=False)
    assert [x.ids for x in slow] == [pair.fast.encode_ordinary(t) for t in texts if t]
