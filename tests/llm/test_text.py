"""Encoding against the vocabulary's own library; languages of documents and segments."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelforge.llm import language as L
from panelforge.llm import prefix_bpe as B

HAVE = Path(B.TOKENIZER_DIR, "byte_bpe_50k.json").exists()
needs_vocabulary = pytest.mark.skipif(not HAVE, reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{B.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@needs_vocabulary
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r'stre\x0b\x1c\x85\xa0　")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(library, text):
    assert B.encoder(B.vocabulary_file()).encode(text) == library.encode(text, add_special_tokens=False).ids


@needs_vocabulary
@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "=-" * 2000, "<|endoftext|>", "def f(x):\n\treturn x\r\n" * 300, "日本語テキスト" * 400, "﻿​\x00"])
def test_long_and_odd_texts(library, text):
    assert B.encoder(B.vocabulary_file()).encode(text) == library.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_appends_and_edits_are_exact():
    vocab, rng = B.encoder(B.vocabulary_file()).vocab, random.Random(0)
    word = lambda n: "".join(rng.choice("abcdeinorst_ABC") for _ in range(n)).encode()
    for _ in range(40):
        t = B.PrefixTable(vocab, word(20))
        t.append(word(15))
        assert t.tokens() == B.PrefixTable(vocab, t.data).tokens()
        a = rng.randrange(len(t.data))
        b = rng.randrange(a, len(t.data) + 1)
        t.replace(a, b, word(rng.randrange(6)))
        fresh = B.PrefixTable(vocab, t.data)
        assert (t.tokens(), t.last, t.width) == (fresh.tokens(), fresh.last, fresh.width)
    big = B.PrefixTable(vocab, word(5000))
    assert big.replace(100, 103, b"xyz") < 1500  # only near the edit
    assert big.last == B.PrefixTable(vocab, big.data).last


@needs_vocabulary
def test_every_token_follows_itself_only_if_unmerged():
    e = B.encoder(B.vocabulary_file())
    for w in ("aaaa", "aaaaa", "abababab", "----------", "eeeeeeeee"):
        ids = e.word(w)
        assert all(e.vocab.may_follow(a, b) for a, b in zip(ids, ids[1:]))


@needs_vocabulary
def test_corpus_edges(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in B.encode_corpus(df, "doc_id", "text").collect()), key=str)
    assert len(got) == 5 and (2, []) in got and (3, []) in got and sum(1 for k, v in got if k == 1 and v == [31373, 995]) == 2
    counts = {r["doc_id"]: r["n_tokens"] for r in B.encode_corpus(df, "doc_id", "text", counts_only=True).collect()}
    assert counts[1] == 2 and counts[2] == counts[3] == 0
    assert B.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


CODES = [("python", "Python", ["py"]), ("sql", "SQL", []), ("en", "English", ["eng"]), ("ja", "Japanese", None)]
PY = ["def f{0}(x):", "    return x + {0}", "import os{0}", "for i in range({0}):", "    print(i, {0})", "class A{0}:", "    pass"]
SQ = ["SELECT a{0} FROM t{0}", "WHERE b > {0}", "GROUP BY a{0};", "CREATE TABLE t{0} (a INT);", "DROP TABLE t{0};"]
EN = ["The loader reads the files for month {0}.", "Every test checks the columns when the disk is slow.", "This module keeps {0} copies of the header."]
JA = ["ローダーは{0}の行を捨てます。", "採点処理は記録を並べ替えます。", "このモジュールは一覧を返します。"]


def block(kind, n, rng):
    return "\n".join(rng.choice({"python": PY, "sql": SQ, "en": EN, "ja": JA}[kind]).format(rng.randrange(99)) for _ in range(n))


def model(rng):
    return L.LineModel.fit([(k, block(k, 30, rng)) for k in ("python", "sql", "en", "ja") for _ in range(8)], ["en", "ja", "python", "sql"], L.label_names(CODES))


DOC = "doc_id long, text string, lang string, path string, repo string, source string, segment string"


def found(spark, rows, m):
    df = spark.createDataFrame(rows, DOC)
    seg = L.identify(df, m, "doc_id", "text", "lang", "path", "repo", "source")
    out = {}
    for r in seg.collect():
        out.setdefault(r["doc_id"], []).append((r["segment"], r["lang"], r["n_lines"]))
    return seg, {k: [x[1] for x in sorted(v)] for k, v in out.items()}


def test_segments_and_labels(spark):
    rng = random.Random(0)
    m = model(rng)
    py, sq, en, ja = (lambda n, k=k: block(k, n, rng) for k in ("python", "sql", "en", "ja"))
    rows = [
        (1, py(20), "PY ", "a.py", "r", "s", "x"),
        (2, py(12) + "\n\n" + sq(8) + "\n" + py(10), "python", "b.py", "r", "s", "x"),
        (3, py(12) + "\n" + sq(3) + "\n" + py(10), "sql", "c.py", "r", "s", "x"),
        (4, en(10) + "\n```sql\n" + sq(6) + "\n```\n" + en(6), None, "d.md", None, None, "x"),
        (5, ja(9), "und", None, "q", "s", "x"),
        (6, None, "en", "e.md", "q", "s", "x"),
        (7, "", None, None, None, None, "x"),
        (8, " \n\t\n", None, None, None, None, "x"),
        (9, "# note\n" * 6 + py(8), "python", "f.py", "r", "s", "x"),
        (10, "﻿" + sq(7).replace("\n", "\r\n"), "SQL", "g.sql", "r", "s", "x"),
        (11, py(3000), None, "h.py", "r", "s", "x"),
    ]
    seg, got = found(spark, rows, m)
    assert got == {1: ["python"], 2: ["python", "sql", "python"], 3: ["python"], 4: ["en", "sql", "en"], 5: ["ja"], 9: ["python"], 10: ["sql"], 11: ["python"]}
    langs = {(r["doc_id"], r["lang"]): r for r in L.document_languages(seg, "doc_id").collect()}
    assert langs[2, "sql"]["n_langs"] == 2 and langs[1, "python"]["declared"] == "python" and langs[5, "ja"]["declared"] is None
    assert all(0 < r["confidence"] <= 1 for r in langs.values())
    assert found(spark, [], m)[1] == {}


def test_priors_decide_where_the_text_does_not(spark):
    rng = random.Random(1)
    m = model(rng)
    rows = [(i, block("sql", 8, rng), "sql", "a.sql", "warehouse", "s", "") for i in range(30)] + [(100 + i, block("python", 8, rng), "python", "b.py", "scripts", "s", "") for i in range(30)]
    rows += [(1000, "zzqq", None, "x.sql", "warehouse", "s", ""), (1001, "zzqq", None, "x.py", "scripts", "s", "")]
    _, got = found(spark, rows, m)
    assert got[1000] == ["sql"] and got[1001] == ["python"]


def test_model_learns_from_agreeing_documents(spark):
    rng = random.Random(2)
    samples = spark.createDataFrame([(k, block(k, 20, rng)) for k in ("python", "sql", "en", "ja") for _ in range(6)], "lang string, text string")
    codes = spark.createDataFrame(CODES, "code string, name string, aliases array<string>")
    new = lambda: "\n".join(f"with open('f{rng.randrange(99)}') as fh: yield {rng.randrange(9)}" for _ in range(8))
    docs = [(i, new(), "python", f"a{i}.py") for i in range(40)] + [(100 + i, block("sql", 8, rng), "sql", "b.sql") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, path string")
    m = L.fit_model(samples, codes, df)
    s = L._score_texts([new()], m)[0].sum(0)
    assert m.langs[int(s.argmax())] == "python"


def test_paths_match_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    scores = [-rng.random((n, 3)).astype(np.float32) * 25 for n in (1, 4, 6, 5)] + [np.zeros((0, 3), np.float32)]
    for s, p in zip(scores, L.best_paths(scores)):
        if len(s):
            value = lambda q: sum(s[i, k] for i, k in enumerate(q)) - L.SWITCH * sum(a != b for a, b in zip(q, q[1:]))  # noqa: B023, E731
            assert value(p.tolist()) == pytest.approx(max(value(q) for q in itertools.product(range(3), repeat=len(s))), abs=1e-3)
        else:
            assert len(p) == 0


def test_minified_text_is_told_by_its_statements_not_its_length():
    from panelforge.llm.language import is_minified

    assert is_minified("a=1;" * 25) and is_minified("!function(e,t){" + "if(m>5){n+=1;}" * 12 + "}")
    assert not is_minified("The loader drops rows without a key; " * 40) and not is_minified("x" * 5000) and not is_minified("for (int i = 0; i < n; i++) { a[i] = 0; }")


def test_suffixes_of_any_length(spark):
    from panelforge.llm.language import suffix_of

    df = spark.createDataFrame([("a/b.PY",), ("x.averyveryverylongsuffix",), ("dir.d/none",), (None,), ("a.b.tar",)], "p string")
    assert [r["s"] for r in df.select(suffix_of(F.col("p")).alias("s")).collect()] == ["py", "averyveryverylongsuffix", "", "", "tar"]
