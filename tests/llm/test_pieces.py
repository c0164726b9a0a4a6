import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tidemark.llm import pieces, queries

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
CODEC = pieces.Codec(PATH)


def _ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdething er  é▁字𝒳\n\t0</s>"), max_size=80))
def test_any_text_is_encoded_as_by_the_library(text):
    ids = CODEC.encode(text)
    assert _ids(ids) == LIBRARY.encode(text)
    assert CODEC.decode(ids) == text.replace("▁", " ")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="▁aenrtthi", max_size=70), max_size=6))
def test_stream_in_parts_gives_the_same_ids(parts):
    stream = pieces.StreamingEncoder(CODEC.vocabulary)
    got = [i for p in parts for i in stream.feed(p)] + stream.finish()
    assert got == CODEC.vocabulary.ids_of(CODEC.vocabulary.merge("".join(parts)))


def test_state_stays_within_a_window():
    stream = pieces.StreamingEncoder(CODEC.vocabulary)
    most = 0
    for _ in range(300):
        stream.feed("theingandoration" * 4)
        most = max(most, len(stream.text))
    assert most <= 8 * CODEC.vocabulary.longest


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_pieces(spark, SF).collect()
    import struct
    import zlib

    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert r.n_ids == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        assert r.round_trip and r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode())


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a  b", 1), (3, "a  b", 1)], "id long, text string, ids int")
    found = pieces.decode(pieces.encode(rows, PATH), PATH).collect()
    assert [(r.id, r.ids is None, r.decoded) for r in sorted(found, key=lambda r: r.id)] == [(1, True, None), (2, False, ""), (3, False, "a  b"), (3, False, "a  b")]
    assert pieces.encode(rows.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["x" * 200_000, "ab " * 100_000, " " * 5000])
def test_long_texts(text):
    assert _ids(CODEC.encode(text)) == LIBRARY.encode(text)


def test_bad_bytes_become_replacement_characters():
    v = CODEC.vocabulary
    assert CODEC.decode(np.array([v.bytes[0xE2], v.bytes[0x82]], "<u4").tobytes()) == "�"
    assert CODEC.decode(b"") == ""


def test_words_kept_are_bounded_by_their_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 2000)
    codec = pieces.Codec(PATH)
    for i in range(300):
        text = f"word{i} and other{i % 7} words"
        assert _ids(codec.encode(text)) == LIBRARY.encode(text)
        assert len(codec.words) + len(codec.words.old) <= 2 * 2000 // 240 + 2


def test_ids_are_decoded_in_the_same_pass(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a  b▁c"), (3, "a  b▁c")], "id long, text string")
    found = pieces.encode(rows, PATH, decoded="back")
    assert found.columns == ["id", "text", "ids", "back"]
    both = pieces.decode(pieces.encode(rows, PATH), PATH, text="back")
    assert sorted(map(str, found.collect())) == sorted(map(str, both.collect()))
    plan = queries.op3_pieces(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_the_pieces_that_end_at_a_position_are_found_at_once():
    v = pieces.Vocabulary(PATH)
    text = "theingandorations" * 3
    for end in range(1, len(text) + 1):
        node = v.survivors(text[:end], last := [""], [v.row("")], v.root)
        assert [p for _, p, _ in node[2]] == [text[b:end] for b in range(end - 1) if text[b:end] in v.ids]
        assert pieces.trace(last, end) == v.merge(text[:end])
