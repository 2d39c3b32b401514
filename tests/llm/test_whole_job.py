"""What was left out once: each test here failed before the operator did its whole job."""

import numpy as np
import pytest

from millrace.llm import mpeg_audio, ngram_join, token_codes

public_tokenizers = pytest.importorskip("public_tokenizers")

A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))
C = " ".join(f"gamma{i}" for i in range(60))
D = " ".join(f"delta{i}" for i in range(60))
NEAR = " more"


def test_one_of_each_tells_rows_apart_not_ids(spark, tmp_path):
    rows = [(3, A), (None, A + NEAR), (None, B), (7, A + " less"), (7, B + " unlike " + B[::-1]), (None, C), (None, C + NEAR), (None, C), (9, D), (9, D), (9, D + NEAR), (11, ""), (11, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    got = sorted(map(tuple, ngram_join.one_of_each(spark.read.parquet(str(tmp_path / "docs"))).collect()), key=str)
    alone = sorted([(3, A), (None, B), (7, B + " unlike " + B[::-1]), (11, ""), (11, None)], key=str)
    assert [r for r in got if r[1] is None or not r[1].startswith((C, D))] == alone
    assert [r[0] for r in got if r[1] and r[1].startswith((C, D))] == [9, None]
    linked = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    assert {(3, 3, 2), (None, 3, 2), (7, 3, 2), (7, 7, 0), (None, None, 0), (None, None, 2), (9, 9, 2)} <= linked


def test_added_tokens_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    fresh, encoder = Tokenizer.from_file(path), token_codes.WordEncoder(path, "<u4")
    texts = ["hello <|endoftext|> world", "x<|startoftext|>y", "<|ENDOFTEXT|> a.", "É <|endoftext|>. Word, word.", "<|endoftext|><|endoftext|>", "日本 <|startoftext|>x", "<|endoftext |>", "Hello, World. It's"]
    for t, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids, t


def test_audio_features_hold_offsets_and_seek_tables(spark):
    wrapped = mpeg_audio.wrap(bytes(192 * 5))
    first = wrapped.index(b"\xff\xfa")
    frame = lambda four: four + bytes(mpeg_audio.header(four).size - 4)
    a, b = b"\xff\xfb\x64\xc4", b"\xff\xfb\x74\xc4"  # Layer III at 80 and 96 kbit/s, no checksum
    varied = frame(a) + frame(b) + b"junk" + frame(b) + frame(a)
    vbri = bytearray(frame(b"\xff\xfb\x94\xc4"))
    vbri[36:66] = b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"".join(n.to_bytes(2, "big") for n in (2, 3, 2, 7, 100, 200))
    second = frame(b"\xff\xfc\x64\xc4")  # Layer II with a checksum
    media = [(1, 0, wrapped), (2, 0, varied), (3, 0, bytes(vbri) + frame(a)), (4, 0, second * 3), (5, 0, None)]
    got = {r.doc_id: r for r in mpeg_audio.features(spark.createDataFrame(media, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert got[1].frame_offsets == [first + 240 * k for k in range(1, 6)] and got[1].seek_frames == 0
    at = wrapped.index(b"Xing") + 16
    assert got[1].seek_table == list(wrapped[at : at + 100]) and got[1].unverified_checksums == 0
    assert got[2].frame_offsets == mpeg_audio.read(varied).offsets and {0, 532, 820} <= set(got[2].frame_offsets) and got[2].seek_table == []
    assert (got[3].seek_table, got[3].seek_frames) == ([300, 600], 7)
    assert (got[4].unverified_checksums, got[4].bad_checksums, len(got[4].frame_offsets)) == (3, 0, 3)
    assert (got[5].frame_offsets, got[5].unverified_checksums) == ([], 0)
