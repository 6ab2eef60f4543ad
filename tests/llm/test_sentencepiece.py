"""The lattice against the sentencepiece library: its BPE as it is, and its Viterbi on the same pieces."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from sentencepiece import sentencepiece_model_pb2

from wayfold.llm.sentencepiece_codec import UNIGRAM, Folder, decode, decode_ids, encode, load_model, model_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  the world 123 thblerely éàü 漢字 ##(test)  two\n\ttab ² ²³.", "", None, " ", "   lead and trail  ", "thingthing" * 40, "▁odd ▁▁ marks", "\x00\x01 é́ 🙂🙂", "aaaa aaaaa aaaaaaaaaaaaaaaaaa", "don't (a) [b] {c} --> ... ||"]


@pytest.fixture(scope="module", params=["bpe", "unigram"])
def both(request):
    if request.param == "bpe":
        return load_model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = UNIGRAM
    for k, p in enumerate(proto.pieces):
        if p.type == 1:  # scores as a unigram model has them, without ties
            p.score = -5 - 3 * (k % 997) / 997 - 1e-5 * k
    return model_of(proto), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_ids_are_the_librarys(spark, odd, both):
    model, library = both
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for frame in (docs, odd.where("doc_id is null or doc_id <> 7"), docs.limit(0)):
        for segment, head in ((1, 0), (5, 7), (100_000, 1000)):
            rows = encode(frame, model, segment=segment, head=head).collect()
            texts = {xxhash.xxh64_intdigest((r["text"] or "").encode(), 42): r["text"] or "" for r in frame.collect()}
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in frame.collect())
            for r in rows:
                own = texts[r["text_hash"] % (1 << 64)]
                assert list(r["ids"]) == library.encode(own), own


def test_long_units_fold_alike(both):
    model, library = both
    folder = Folder(model)
    for x in ("y" * 9000, "thing" * 300, "thehenreonthe" * 50):
        assert folder.ids("▁" + x) == library.encode(x)
    for x in TEXTS[:1]:
        assert decode_ids(model.surface, model.prefix, library.encode(x)) == x


def test_one_pass_and_repeated_search_give_the_librarys_units(spark, both):
    """Units of random neighbouring pieces, among them many whose late pieces the single pass leaves open."""
    import random

    model, library = both
    rnd = random.Random(3)
    pieces = [p for p, _, _ in model.pieces if p.isascii() and p.isalpha() and len(p) < 7]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 6)))[:60] for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bad = [texts[r["doc_id"]] for r in encode(docs, model).collect() if list(r["ids"]) != library.encode(texts[r["doc_id"]])]
    assert bad == []


def test_decoding_gives_the_text_back(spark, documents, both):
    model, library = both
    rows = decode(encode(documents.limit(40), model), model).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == 40 and all(r["decoded"] == texts[r["doc_id"]] for r in rows)
    for r in encode(documents.limit(5), model, check=True).collect():
        assert r["round_trip"] and r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    bad = spark.createDataFrame([([model.bytes_at + 0xE6, model.bytes_at + 0x41] if model.bytes_at >= 0 else [5],), (None,)], "ids array<int>")
    assert {r["decoded"] for r in decode(bad, model).collect()} == {library.decode([model.bytes_at + 0xE6, model.bytes_at + 0x41]), None}


def test_models_with_pieces_that_are_not_handled_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    from wayfold.llm.sentencepiece_codec import model_of

    for piece, kind in (("<mark>", 4), ("x" * 32, 1)):
        proto = sentencepiece_model_pb2.ModelProto()
        for text, own in (("<unk>", 2), ("a", 1), (piece, kind)):
            proto.pieces.add(piece=text, type=own, score=0.0)
        with pytest.raises(ValueError):
            model_of(proto)
