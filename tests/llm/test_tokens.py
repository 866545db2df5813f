import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mosaica.llm import common, token_output as t

from .helpers import awkward

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aé '\n\t\x85\xa0\x1f12½³,.<|>sdtl", max_size=60), st.just("a <|endoftext|> b")))
def test_ids_are_the_library_s(text):
    assert t.encode_text(text, PATH).tolist() == Tokenizer_.encode(text, add_special_tokens=False).ids


Tokenizer_ = Tokenizer.from_file(PATH)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=8), st.text("aé '\n\t\x85\xa0\x00\x1f12½³,.sdtmrevl", max_size=60), st.sampled_from(["'s", "don't", "we'll've", " 'tis", "''s", "!'re", "a  b", "x \n", "<|endoftext|>"])), max_size=6))
def test_texts_encoded_at_once(texts):
    got = t.encode_all(texts, PATH, 7)
    assert [x.tolist() for x in got] == [[*(Tokenizer_.encode(x, add_special_tokens=False).ids if x else []), 7] for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers(spark, sf, name):
    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + ["It's  1234 ÄÖ\n", "x <|endoftext|> y", ""]
    assert all(t.encode_text(x, path).tolist() == own.encode(x, add_special_tokens=False).ids for x in texts)


def test_the_stored_order_is_kept(spark, library):
    df = spark.createDataFrame([(i * 7 % 50, f"text {i}") for i in range(50)], "doc_id long, text string").repartitionByRange(4, "text").sortWithinPartitions("text")
    df = common.stored(df, "t")
    got = t.read_tokens(t.write_tokens(df, common.new_path(spark, "t"), as_stored=True)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i * 7 % 50 for i in sorted(range(50), key=lambda i: f"text {i}")]
    plain = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")
    assert [r.doc_id for r in t.read_tokens(t.write_tokens(plain, common.new_path(spark, "t"), as_stored=True)).orderBy("start").collect()] == [1, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 500), max_size=1500), st.integers(1, 100))
def test_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    image = t.encode_shard(ids, np.array([len(ids)]), 128, percentile)
    assert (t.read_ids(image) == ids).all()
    a, b = len(ids) // 3, 2 * len(ids) // 3
    assert (t.read_ids(image, a, b) == ids[a:b]).all()


def test_outliers_are_patched_and_blocks_are_small():
    ids = np.concatenate([np.arange(1000) % 16, [4_000_000_000]]).astype(np.uint32)
    image = t.encode_shard(ids, np.array([1001]))
    assert len(image) < 1001 * 4 / 4 and t.read_ids(image)[-1] == 4_000_000_000


def test_cut_images_are_refused():
    image = t.encode_shard(np.arange(2000, dtype=np.uint32), np.array([2000]))
    with pytest.raises(ValueError):
        t.read_ids(image[:-3])
    with pytest.raises(ValueError):
        t.read_ids(b"JUNK" + image[4:])


def brute(rows, library, ordered=False):
    out, at = [], 0
    for doc_id, text in rows if ordered else sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*(library.encode(text, add_special_tokens=False).ids if text else []), 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in t.op10_token_output(spark, sf).collect())
    assert got == brute(rows, library)


def test_awkward_rows(spark, library):
    df = awkward(spark)
    got = [tuple(r) for r in t.read_tokens(t.write_tokens(df, common.new_path(spark, "t"), shard_ids=50)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == brute([(r.doc_id, r.text) for r in df.collect()], library)
    assert t.read_tokens(t.write_tokens(df.limit(0), common.new_path(spark, "t"))).count() == 0
