import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evisparq.llm import pfor, registry
from evisparq.llm.token_files import read_token_files, read_token_ids, write_token_files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_round_trip(values):
    ids = np.array(values, np.uint32)
    lengths, got = pfor.decode_segment(pfor.encode_segment(np.array([len(ids)]), ids))
    assert lengths.tolist() == [len(ids)] and got.tolist() == values


def test_one_block_alone_and_damage():
    ids = np.random.default_rng(1).integers(0, 49_000, 5000).astype(np.uint32)
    ids[::37] = 2**31
    index, payload = pfor.encode_ids(ids)
    assert (pfor.decode_blocks(index[7:8], np.frombuffer(payload, np.uint8)) == ids[7 * 128 : 8 * 128]).all()
    assert len(payload) < 4 * len(ids) * 0.7
    data = bytearray(pfor.encode_segment(np.array([5000]), ids))
    data[99] ^= 1
    with pytest.raises(ValueError):
        pfor.decode_segment(bytes(data))


def brute(rows):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark, tmp_path):
    rows = [(3, "three of them"), (1, None), (None, "no id"), (2, ""), (9, "long " * 4000), (-4, "neg"), (7, "x"), (7, "x")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(4)
    write_token_files(docs, f"file://{tmp_path}/f", public_tokenizers.path("word_bpe_49k.json"), segment_ids=3)
    got = read_token_files(spark, f"file://{tmp_path}/f").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)
    ids = {r.doc_id: r.ids for r in read_token_ids(spark, f"file://{tmp_path}/f").collect()}
    assert ids[1] == [2] and len(ids[9]) == 4001
    write_token_files(docs.limit(0), f"file://{tmp_path}/e", public_tokenizers.path("word_bpe_49k.json"))
    assert read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_rows_of_one_id_keep_their_order(spark, tmp_path):
    rows = [(5, "b c"), (5, "a"), (5, None), (None, "z z"), (None, "y"), (5, "a"), (1, "q")]
    seen = set()
    for i, mixed in enumerate((rows, rows[::-1], rows[3:] + rows[:3])):
        write_token_files(spark.createDataFrame(mixed, "doc_id long, text string").repartition(3), f"file://{tmp_path}/{i}", public_tokenizers.path("word_bpe_49k.json"))
        seen.add(tuple(sorted(map(tuple, read_token_files(spark, f"file://{tmp_path}/{i}").collect()), key=lambda r: r[1])))
    assert len(seen) == 1


def test_query(spark):
    at = "/root/testdata/sf0.01"
    got = registry.queries()["op4_token_files"](spark, at).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_cuts_are_searched(spark):
    from bisect import bisect_right

    from evisparq.llm.ranks import cuts_below

    cuts = sorted({k * k * 37 % 10_007 - 3000 for k in range(900)})
    values = [None, -(2**63), 2**63 - 1, *range(-3100, 7100, 7), *cuts[:50]]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for most in (4096, 10):
        got = [(r.v, r.n) for r in rows.select("v", cuts_below("v", cuts, most).alias("n")).collect()]
        assert got == [(v, 0 if v is None else bisect_right(cuts, v)) for v in values]
