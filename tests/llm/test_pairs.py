"""Line dedup, embeddings and decontamination on planted cases and against brute force."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from wayfold.llm.decontaminate import contaminated, lcs, passages, randomised_svd, words
from wayfold.llm.embedding_dedup import near_vectors
from wayfold.llm.line_dedup import aligned, dedup_lines, heaviest_rise


def test_heaviest_rise_against_all_subsets():
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randrange(1, 9)
        pairs = [(a, b, rnd.randrange(1, 6)) for b, a in enumerate(rnd.sample(range(20), n))]
        chain = heaviest_rise(pairs)
        assert all(pairs[x][0] < pairs[y][0] for x, y in zip(chain, chain[1:], strict=False))
        best = max(sum(pairs[k][2] for k in range(n) if m >> k & 1) for m in range(1 << n) if all(pairs[x][0] < pairs[y][0] for x in range(n) for y in range(x + 1, n) if m >> x & 1 and m >> y & 1))
        assert sum(pairs[k][2] for k in chain) == best


def line(k, n=8):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_lines(spark):
    a, b, c, d = (line(k) for k in "abcd")
    long = line("passage", 60)
    docs = [
        (1, "\n".join([a, "Hi.", b, long])),
        (2, "\n".join([a, "Hi.", b, long])),  # a copy: all goes, the short line between too
        (3, "\n".join([c, "", b, "Hi.", "fresh words here in this line"])),  # b goes; "Hi." is short and has a fresh neighbour
        (4, "\n".join([long, line("own"), a])),  # crossing: what moved is aligned in a second round
        (5, "\n".join([d, d])),
        (6, "\n".join(["  " + d, d, d])),
        (7, "Hi."),
    ]
    made = spark.createDataFrame([(*x, 9) for x in docs], "doc_id long, text string, gone int")
    got = {r["doc_id"]: r for r in dedup_lines(made).collect()}
    assert made.columns + ["removed_lines"] == dedup_lines(made).columns
    assert got[1]["text"] == docs[0][1] and got[2]["text"] == "" and got[2]["removed_lines"] == 4
    assert got[3]["text"] == "\n".join([c, "", "Hi.", "fresh words here in this line"])
    assert got[4]["text"] == line("own")
    assert got[5]["text"] == docs[4][1] and got[6]["text"] == "" and got[7]["text"] == "Hi."


def brute_lines(docs, least=5):
    """Lines that stand in a run of `least` words or more which some earlier document has line by line."""
    split = {k: [x.strip() for x in t.split("\n")] for k, t in docs}
    out = {}
    for k, _ in docs:
        own = [(i, x) for i, x in enumerate(split[k]) if x]
        gone = set()
        for other, _ in docs:
            if other >= k:
                continue
            there = [x for x in split[other] if x]
            for a in range(len(own)):
                for c in range(len(there)):
                    n = 0
                    while a + n < len(own) and c + n < len(there) and own[a + n][1] == there[c + n]:
                        n += 1
                    if sum(len(x.split()) for _, x in own[a : a + n]) >= least:
                        gone |= {i for i, _ in own[a : a + n]}
        out[k] = "\n".join(x for i, x in enumerate(split[k]) if i not in gone)
    return out


@pytest.mark.parametrize("block", [1, 4096])
def test_lines_against_all_pairs(spark, block):
    rnd = random.Random(8)
    pool = ["a", "b b", "c c c", "", "d d d d", "e e e e e", "f f f f f f f"] + [f"g{k} {k}" for k in range(5)]
    docs = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))) for k in range(60)]
    # an aligned block whose lines other, earlier documents own
    docs += [(100, "aa bb"), (101, "cc dd"), (102, "aa bb\ncc dd\nee ff"), (103, "x y z\naa bb\ncc dd\nee ff\nu v w")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()}
    assert got == brute_lines(docs) and got[103] == "x y z\nu v w"
    fewer = [d for d in docs if d[0] % 3]
    less = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(fewer, "doc_id long, text string"), block=block).collect()}
    assert all(len(got[k]) <= len(less[k]) for k in less)  # more earlier documents never delete less


def test_alignment_rises_on_both_sides():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.choice("abcdefgh") for _ in range(rnd.randrange(12))] for _ in range(2))
        found = aligned(a, b, [1] * len(b))
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert aligned(list("abcxyz"), list("abqxyz"), [1] * 6) == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]


def test_lines_of_odd_rows(odd, documents):
    rows = dedup_lines(odd).collect()
    assert len(rows) == odd.count() and [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert [r["text"] for r in rows if r["doc_id"] == 4] == ["one", "one"]
    assert dedup_lines(odd.limit(0)).count() == 0
    # the first place of every line of five words or more stays somewhere
    before = {x.strip() for r in documents.collect() for x in r["text"].split("\n") if len(x.split()) >= 5}
    after = {x.strip() for r in dedup_lines(documents).collect() for x in r["text"].split("\n") if len(x.split()) >= 5}
    assert before == after


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((centre + rng.standard_normal(16) * 0.04, c % 3))
    rows += [(rows[0][0], rows[0][1])] * 5 + [(rows[0][0] * 7, rows[0][1])]
    out = [(k, x.astype(np.float32).tolist(), label) for k, (x, label) in enumerate(rows)]
    n = len(out)
    return out + [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [math.nan] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, out[0][1], None), (n + 5, [], 0), (n + 6, [math.inf] + [1.0] * 15, 0), (n + 7, [1.0, 2.0], 0)]


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors(spark, odd, block):
    rows = vectors(3)
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(k, np.array(x, np.float64), label) for k, x, label in rows if x and None not in x and np.isfinite(x).all() and any(x) and label is not None]
    links = {k: set() for k, _, _ in rows}
    for i, x, a in good:
        for j, y, b in good:
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i].add(j)
    component = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component[k] = min(seen)
    for r in near_vectors(made, block=block).collect():
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[r["vec_id"]]), component[r["vec_id"]], component[r["vec_id"]] == r["vec_id"])
    assert near_vectors(made.limit(0)).count() == 0
    null = near_vectors(spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in null] == [(0, None, None)] * 2


def test_vectors_of_doubles_text_labels_and_repeated_ids(spark):
    rows = [(1, [1e300, 1.0], "a"), (2, [1e300, 1.0], "a"), (3, [1e-60, 0.0], "b"), (4, [2e-60, 0.0], "b"), (4, [0.0, 5.0], "b"), (7, [0.0, 1.0], "b")]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (4, 1, 4), (7, 1, 4)]


def test_vectors_against_sql(spark):
    import duckdb

    from wayfold.llm.queries import ORACLE_SQL

    rows = [(k, x, label) for k, x, label in vectors(6)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    con = duckdb.connect()
    con.register("embeddings", made.toArrow())
    expected = sorted(con.execute(ORACLE_SQL["op5_embedding_dedup"]).fetchall())
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(made).collect())
    assert found == expected and sum(r[1] for r in found) > 50


def test_longest_common_subsequence():
    rnd = random.Random(7)
    for _ in range(200):
        a, b = ([rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert lcs(a, b) == table[-1][-1]


def test_singular_vectors(spark):
    rng = np.random.default_rng(1)
    dense = rng.standard_normal((30, 4)) @ rng.standard_normal((4, 20))
    rows = spark.createDataFrame([(list(range(20)), x.tolist()) for x in dense], "terms array<int>, weights array<double>").repartition(3)
    basis, values = randomised_svd(rows, 20, 4)
    assert np.allclose(values, np.linalg.svd(dense)[1][:4], rtol=1e-3)
    assert basis.shape == (20, 4) and np.allclose(basis.T @ basis, np.eye(4)) and np.allclose(dense @ basis @ basis.T, dense, atol=1e-3)


def test_leaks(spark, odd):
    rnd = random.Random(9)
    vocabulary = [f"t{k}" for k in range(800)] + ["the", "of", "and"] * 40
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(rnd.choice([15, 25, 55, 120])) + ".") for k in range(40)] + [(90, None), (None, text(30)), (91, "too short")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs, expected = [], {}
    for k in range(200):
        body = [text(rnd.randrange(5, 150)) for _ in range(2)]
        if k % 5 == 0:
            item, own = items[k // 5 % 40]
            own = own.split()
            if k % 2:  # a paraphrase: one word in eight is another
                own = [f"t{rnd.randrange(800)}" if j % 8 == 3 else w for j, w in enumerate(own)]
            body.insert(1, (" ".join(own)).upper() if k % 3 == 0 else " ".join(own))
            expected[k] = item
        docs.append((k, " ".join(body)))
    made = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, bench_share string")
    got = {r["doc_id"]: r["bench_items"] for r in contaminated(made, benchmark).collect()}
    assert all(item in got[k] for k, item in expected.items())
    assert all(not got[k] for k in got if k not in expected)
    assert contaminated(odd, benchmark).count() == odd.count() and contaminated(odd, benchmark).columns[: len(odd.columns)] == odd.columns
    assert contaminated(odd, benchmark.limit(0)).where("size(bench_items) > 0").count() == 0
    assert contaminated(odd.limit(0), benchmark).count() == 0
    assert all(len(p.words) <= 32 for k, x in items if x for p in passages(k or 0, x))


def test_short_items_are_found_as_exact_runs(spark):
    items = spark.createDataFrame([(1, "The quick red fox."), (2, "..."), (3, "fox ran home")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "he said the quick red fox ran"), (2, "the quick fox ran home red"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["bench_items"], r["bench_share"]) for r in contaminated(docs, items).collect()}
    assert got == {1: ([1], 1.0), 2: ([3], 1.0), 3: ([], 0.0)}


def test_short_items_are_found_with_other_words_between(spark):
    """Short items against every window of a quarter more words, by the longest common subsequence."""
    rnd = random.Random(21)
    vocabulary = [f"t{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(1 + k % 8))) for k in range(48)] + [(99, "the quick red fox jumped over lazy dogs")]
    docs = [(0, "he said the quick red fox jumped right over lazy dogs again"), (1, "the quick red fox jumped over lazy cats"), (2, "the quick red fox sat over there")]
    docs += [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 40, 1500])))) for k in range(3, 40)]
    got = {r["doc_id"]: r["bench_items"] for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, x in docs:
        own, expected = x.encode().split(), []
        for i, item in items:
            p = item.encode().split()
            window = len(p) + -(-len(p) // 4)
            if any(5 * lcs(p, own[a : a + window]) >= 4 * len(p) for a in range(len(own))):
                expected.append(i)
        assert got[k] == expected, k
    assert 99 in got[0] and 99 in got[1] and 99 not in got[2]


def test_paraphrases_against_every_passage_of_every_item(spark):
    """Recall of the latent search against the longest common subsequence with every passage of the benchmark, on whole texts."""
    rnd = random.Random(12)
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r["text"] for r in source.where("length(text) between 300 and 3000").orderBy("doc_id").limit(150).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    found = [p for k, x in items for p in passages(k, x)]
    vocabulary = sorted({w for x in texts for w in words(x.encode())})
    docs, expected = [], set()
    for k in range(150):
        own = words(items[k % len(items)][1].encode())
        rate = (0.0, 0.1, 0.2, 0.3, 0.38)[k % 5]
        own = [rnd.choice(vocabulary) if rnd.random() < rate and j < len(own) - 9 else w for j, w in enumerate(own)]
        text = b" ".join(words(texts[k].encode())[:80] + own + words(texts[k - 1].encode())[:80])
        docs.append((k, text.decode()))
        for p in found:
            share = lcs(p.words, own) / len(p.words)
            if share >= 0.8 or share >= 0.6 and lcs(p.answer, own) >= 0.8 * len(p.answer):
                expected.add((k, p.item))
    made = spark.createDataFrame(docs, "doc_id long, text string").unionByName(source.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = contaminated(made, spark.createDataFrame(items, "item_id long, text string")).where("doc_id < 10000").collect()
    got = {(r["doc_id"], i) for r in rows for i in r["bench_items"]}
    assert len(expected) >= 140 and len(expected & got) >= 0.95 * len(expected)


def test_verbatim_leaks_of_a_benchmark_much_larger_than_the_rank(spark):
    rnd = random.Random(10)
    vocabulary = [f"t{k}" for k in range(3000)] + ["the", "of", "and"] * 100
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(rnd.randrange(15, 60)) + ".") for k in range(2100)]
    docs = [(k, f"{text(25)} {items[7 * k][1]} {text(25)}") for k in range(300)] + [(1000 + k, text(100)) for k in range(30)]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in contaminated(made, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [k for k in range(300) if 7 * k not in got[k]["bench_items"] or got[k]["bench_share"] < 1] == []
    assert not any(r["bench_items"] for k, r in got.items() if k >= 1000)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 20, 30, 60, 100])
@pytest.mark.parametrize("size", [9, 25])
def test_verbatim_passages_in_small_tables(spark, n, size):
    """Documents of one passage each that hold an item whole between five other words: all are found, whatever the table's size."""
    rnd = random.Random(n * 100 + size)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9)))
    items = [" ".join(word() for _ in range(size)) for _ in range(n)]
    docs = [(i, " ".join([*(word() for _ in range(2)), x, *(word() for _ in range(3))])) for i, x in enumerate(items)]
    docs += [(1000 + i, " ".join(word() for _ in range(size + 5))) for i in range(5)]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r["doc_id"]: r["bench_items"] for r in found.collect()} == {i: [i] if i < 1000 else [] for i, _ in docs}


def test_space_is_fitted_on_the_whole_benchmark(spark, monkeypatch):
    from wayfold.llm import decontaminate

    fit, seen = decontaminate.randomised_svd, []
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda rows, *rest: seen.append(rows.count()) or fit(rows, *rest))
    rnd = random.Random(12)
    items = [(k, " ".join(f"w{rnd.randrange(900)}" for _ in range(20))) for k in range(40)]
    docs = [(k, " ".join(f"v{rnd.randrange(900)}" for _ in range(60)) + " " + items[k % 40][1] * (k < 40)) for k in range(80)]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["bench_items"] for r in found.collect()} == {k: [k] * (k < 40) for k in range(80)}
    assert seen == [40]  # every passage of the benchmark, and no sample of the corpus


def test_terms_are_hashes_and_no_words_are_remembered():
    import pickle

    import xxhash

    from wayfold.llm import decontaminate

    own = [b"one", "été".encode(), b"", b"one"]
    assert decontaminate.terms_of(own, 4).tolist() == [xxhash.xxh32_intdigest(w) % decontaminate.TERMS for w in own]
    retriever = decontaminate.Retriever(passages(1, "some words that stand in an item of a benchmark"), np.ones((decontaminate.TERMS, 2), np.float32), 0.48, 0.8, 0.6)
    before = len(pickle.dumps(retriever))
    assert retriever.matches(b" ".join(b"w%d" % i for i in range(5000))) == {}
    assert len(pickle.dumps(retriever)) == before
