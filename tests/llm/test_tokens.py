"""Token counts and token files against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm.binary_tokens import read_token_files, write_token_files
from wayfold.llm.encoder import ChunkEncoder
from wayfold.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("most", [4, 600_000])
def test_chunks_encode_as_the_library_does(library, most):
    encoder = ChunkEncoder(PATH, most)
    texts = ["The THE the.", "don't DON'T 'tis a's!'s", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>.", "á e ́x", "ΟΔΟΣ ΣΑΣ.", "tab\tline\r\nnbsp  em x\u001cy", "1234 ½ ²3", "a" * 500 + " " + "?!" * 80, "|<| a<|b ...", "İstanbul ǅ ﬁ", "(word) word) word.'s", ""]
    for x in [*texts, *texts]:
        assert encoder.ids(x.encode()) == np.array(library(x), "<u2").tobytes(), x


def test_letters_of_other_scripts_are_words_of_the_model(library):
    """Every letter before U+0250, alone and beside others and marks, without a run of the whole tokenizer."""
    encoder, plain = ChunkEncoder(PATH), ChunkEncoder(PATH)
    encoder._whole = lambda text: pytest.fail(text) if text.lower() == text and text.isalpha() else plain._whole(text)
    letters = [chr(c) for c in range(0x80, 0x250) if chr(c).isalpha() and len(chr(c).lower()) == 1]
    for x in [y for c in letters for y in (c, f"a{c}b.", f"{c}{c}**", f"{c}1", f"{c}'s", f"{c}'S.", f"1{c}")]:
        assert encoder.ids(x.encode()) == np.array(library(x), "<u2").tobytes(), x
    for x in ("İx", "x\u0301é", "ŉ", "ĳ", "éa\u0301."):
        assert encoder.ids(x.encode()) == np.array(library(x), "<u2").tobytes(), x


def test_an_encoder_is_loaded_once_a_process(tmp_path):
    import shutil

    from wayfold.llm.encoder import kept

    own = str(shutil.copy(PATH, tmp_path / "own.json"))
    first = kept(own)
    assert kept(own) is first
    with open(own, "a") as f:  # another file of the same name is another encoder
        f.write("\n")
    assert kept(own) is not first


def test_counts(odd, documents, library):
    for docs in (odd, documents, odd.limit(0)):
        rows = docs.select("doc_id", "text").collect()
        found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, PATH).collect())
        assert found == sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library(r["text"]))) for r in rows)


def test_counts_by_sentencepiece(documents):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts(documents.limit(20), path).collect()}
    assert all(found[r["doc_id"]] == len(model.encode(r["text"])) for r in documents.limit(20).collect())


@pytest.mark.parametrize("parts", [1, 3])
def test_files_round_trip(spark, odd, documents, library, tmp_path, parts):
    for k, docs in enumerate((odd, documents, odd.limit(0))):
        uri = f"file://{tmp_path}/{parts}-{k}"
        table = write_token_files(docs, uri, PATH, end_id=1, parts=parts)
        found = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_token_files(spark, uri, table).collect()), key=lambda r: r[0])
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()), key=lambda r: r[:3])
        start, expected = 0, []
        for known, i, _, text in rows:
            ids = [*library(text), 1]
            expected.append((start, i if known else None, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert found == expected


def test_writing_again_replaces_files(spark, documents, tmp_path):
    uri = f"file://{tmp_path}/again"
    for _ in range(2):
        table = write_token_files(documents.limit(30), uri, PATH, parts=2)
        assert read_token_files(spark, uri, table).count() == 30


def test_files_tell_their_width_and_leave_no_earlier_parts(spark, documents, library, tmp_path):
    uri = f"file://{tmp_path}/ids"
    docs = documents.select("doc_id", "text").where("doc_id < 40")
    write_token_files(docs, uri, PATH, end_id=1, parts=5)
    table = write_token_files(docs, uri, PATH, end_id=1, parts=2)
    assert {x.name.split(".")[0] for x in (tmp_path / "ids").glob("*.ids")} == {"000000", "000001"}
    narrow = sorted(tuple(r) for r in read_token_files(spark, uri, table).collect())
    for x in (tmp_path / "ids").glob("*.ids"):
        np.fromfile(x, "<u2").astype("<u4").tofile(x)
    assert sorted(tuple(r) for r in read_token_files(spark, uri, table).collect()) == narrow
