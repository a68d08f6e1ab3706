import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evisparq.llm.codec import Codec
from evisparq.llm.token_counts import count_tokens

TEXTS = ["", " ", "a", "a  b", "a \n b", "\n\na b\n", "x\t\ty \t", "Don't STOP  it's 12345 !!! ###", "é̂ à ̀x", "ΑΣ ΣΑΣ ς", "a<|endoftext|>b  <|endoftext|> c", "<|startoftext|>", "a b  c　d", "日本語 テキスト 😀 👩‍👩‍👧", "w" * 5000, " ".join(["word"] * 3000), "a\x1cb \x1f c", "trail \n", "\r\n x\r\n\r\n y", "İI ß ŉ", "'s 'S don'T", "0́ 1 ́x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_codec_equals_library(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    import duckdb
    import numpy as np

    texts = TEXTS + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    codec = Codec(path)
    assert codec.kind != "whole"
    for text, got in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_letter_beside_every_mark(name):
    draw = random.Random(11)
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] if c not in (0xD7, 0xF7)]
    marks = [*",.;:!?'\"-()[]<>=|&#/ \n\t", "\u0307", "\u0301", "\u0300", "\u0327", "\u0338", "\u2019", "\u2026", "\xb7", "\u0130", "\u0131"]
    samples = ["ANKARA'YA G\u0130TT\u0130.", "EVLER\u0130, BAH\xc7ELER\u0130; YEN\u0130!", "hello \u0130.", "I\u015eIK, \u0131\u011fd\u0131r;", "i\u0307\u0303 \u0173\u0304 J\u0307 \u012f\u0307\u0301.", "\u017dMON\u0116S: \u012e\u012e"]
    texts = samples + [f"a{c}{m} {m}{c}b{m}{c}" for c in letters for m in marks]
    texts += ["".join(draw.choice(draw.choice((letters, marks, samples, [" "]))) for _ in range(draw.randint(1, 12))) for _ in range(20_000)]
    codec = Codec(public_tokenizers.path(name))
    assert codec.encode(texts) == codec._direct(texts)


def test_counts_and_cache(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "one two", 7), (2, None, 7), (None, "one two", 7), (4, "", 7), (4, "", 7), (5, "three " * 2100, 7), (None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    plain = Tokenizer.from_file(path)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = count_tokens(docs, path, cache).collect()
        want = [(i, len((t or "").encode()), n := len(plain.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in rows]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert spark.read.parquet(cache).select("digest").distinct().count() == 3
    once = spark.read.parquet(cache).count()
    count_tokens(docs.union(spark.createDataFrame([(9, "new one", 1), (10, "new one", 1)], docs.schema)), path, cache)
    assert spark.read.parquet(cache).count() == once + 1
    assert count_tokens(docs.limit(0), path).count() == 0
