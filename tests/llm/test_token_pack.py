import io
import zlib

import numpy as np
import pytest

from pagewatch.llm import token_pack as tp
from pagewatch.llm.queries import QUERIES
from tests.llm.frames import TEXTS, documents


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 20, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = tp.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (tp.unpack(data, n, bits) == ids).all()
        plain = sum(int(x) << (bits * i) for i, x in enumerate(ids))
        assert int.from_bytes(data, "little") == plain


def test_shard_random_access():
    sink, rng = io.BytesIO(), np.random.default_rng(1)
    writer = tp.ShardWriter(sink, 16, block=64)
    docs = [(i if i else None, rng.integers(0, 50257, n, dtype=np.uint32)) for i, n in enumerate([0, 5, 3000, 1, 64, 63])]
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.finish()
    shard = tp.Shard(sink)
    every = np.concatenate([ids for _, ids in docs])
    assert [(d, i.tolist()) for d, _, i in shard] == [(d, i.tolist()) for d, i in docs]
    for start, count in [(0, 1), (63, 2), (100, 777), (len(every) - 1, 1), (5, 0)]:
        assert (shard.ids(start, count) == every[start : start + count]).all()


def plain_rows(rows):
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(tp.tokenizer_path()), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def order(rows):
    return sorted(rows, key=lambda r: r[1])


def test_awkward_texts(spark):
    got = [tuple(r) for r in tp.packed(spark, documents(spark)).collect()]
    assert order(got) == plain_rows([(d, t) for d, t, _ in TEXTS])
    assert tp.packed(spark, documents(spark, [])).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op2_token_pack"](spark, folder).collect()]
    assert order(got) == plain_rows(rows)


def test_word_cache_equals_whole_text():
    path = tp.tokenizer_path()
    small = tp.WordEncoder(path, limit=3)
    texts = ["a b  c   d", "x \n\t y\n z ", " lead", "  lead", "don't  we 'll   go", "tab\tb  c", "a" * 100 + " b", "\x1c \x85 q"]
    for text in texts:
        assert small.encode(text).tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
