"""Composed alignments against encodings of whole texts by the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from wayfold.llm.token_alignment import WHITE, Vocabularies, align_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    v = Vocabularies(A, B)

    def tokens(text):
        """Token ids and bytes of both, of whole texts; none if the bytes differ."""
        if not text:
            return [], []
        left = [(i, v.a_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, v.b_bytes[i]) for i in b.encode(text)]
        same = all(b"".join(x for _, x in own) == (" " + text).encode() for own in (left, right))
        return (left, right) if same else ([], [])

    return tokens


def ends(tokens):
    at, out = 0, []
    for _, x in tokens:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def plain(library, rows):
    """Rows of the operator by comparing all pairs of tokens."""
    each, held = [], Counter()
    for i, text in rows:
        a, b = library(text)
        ea, eb = ends(a), ends(b)
        links = [(x[0], y[0]) for x, p in zip(a, ea, strict=True) for y, q in zip(b, eb, strict=True) if p[0] < q[1] and q[0] < p[1]]
        both = sorted({p[1] for p in ea} & {q[1] for q in eb})
        groups, start = [], 0
        for stop in both:
            side = lambda t, e: ",".join(str(x[0]) for x, p in zip(t, e, strict=True) if start <= p[0] < stop)  # noqa: E731, B023
            groups.append(f"{side(a, ea)}|{side(b, eb)}")
            start = stop
        held.update(set(links))
        each.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return [(i, na, nb, ng, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), said) for i, na, nb, ng, links, said in each]


ODD = [None, "", " ", "  ", "a", "don't  stop\n\n  now", "x▁y z", "<s> </s> <|endoftext|> <unk> <0x41>", "tab\there\r\nthere ;\r end", "nbsp a b　c  d\x85e", "é漢字 \U0001f600 ½ ²", "a\x00b \x1c c!\x1c\x1cd", "word " * 300, "y" * 3000, "trailing   \n", "\n\nleading", "᠎ ​ x", "'s 't  've \t 'll"]


def test_segments_encode_as_whole_texts_do(library):
    v = Vocabularies(A, B)
    assert " " in v.cuts and "\n" in v.cuts and "\r" not in v.cuts
    rng = random.Random(3)
    parts = [*WHITE, *"ab1,.;'(){}é漢▁", "the", "ing", " the", "\x1c", "᠎", "\r\n", "<s>", "'s", "   "]
    texts = [x for x in ODD if x] + ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(4000)]
    for x in texts:
        own = v.segments(x)
        assert "".join(own) == " " + x
        links, counts = v.aligned(own)
        a, b = library(x)
        if all(counts):
            begins = set(np.cumsum([0, *counts]).tolist())
            after = [0, *links["ends"].tolist()]
            assert [t["a"] for k, t in enumerate(links) if k in begins or after[k] != 2] == [i for i, _ in a], x
            assert [t["b"] for k, t in enumerate(links) if k in begins or after[k] != 1] == [i for i, _ in b], x
        else:
            assert (a, b) == ([], [])


@pytest.mark.parametrize("segments", [400_000, 50])
def test_against_all_pairs(spark, documents, library, segments):
    texts = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").limit(60).collect() if r["text"] is None or len(r["text"]) < 4000]
    rows = [*enumerate(ODD, 10**6), *texts, *texts[:5], (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, groups string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    found = sorted(map(tuple, align_tokens(docs, A, B, segments=segments).collect()), key=key)
    assert found == sorted(plain(library, rows), key=key)


def test_empty_table(spark, documents):
    assert align_tokens(documents.limit(0), A, B).count() == 0


def test_query_hashes_groups(spark, library):
    from wayfold.llm.queries import op13_token_alignment

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op13_token_alignment(spark, "/root/testdata/sf0.001").collect():
        a, b = library(rows[r["doc_id"]])
        assert (r["n_a"], r["n_b"]) == (len(a), len(b))
        if not a:
            assert r["groups_sha256"] == ""
        else:
            both = sorted({p[1] for p in ends(a)} & {p[1] for p in ends(b)})
            said, i, j, ea, eb = [], 0, 0, ends(a), ends(b)
            for stop in both:
                x = y = ""
                while i < len(a) and ea[i][1] <= stop:
                    x, i = f"{x},{a[i][0]}" if x else str(a[i][0]), i + 1
                while j < len(b) and eb[j][1] <= stop:
                    y, j = f"{y},{b[j][0]}" if y else str(b[j][0]), j + 1
                said.append(f"{x}|{y}")
            assert r["groups_sha256"] == hashlib.sha256(";".join(said).encode()).hexdigest()
