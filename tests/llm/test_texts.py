"""Language, licence and quality operators: brute force, held-out accuracy, odd rows."""

import re
from collections import Counter

import numpy as np

from wayfold.llm.language_id import grams, identify_languages
from wayfold.llm.license_scan import PHRASES, TEMPLATES, Automaton, Scanner, license_digest, license_scan, words
from wayfold.llm.quality import NAMES, estimated_prior, feature_table, fit, keep_good, quality_scores


def test_grams_by_hand():
    code = lambda s: sum(ord(c) << 21 * k if c != "_" else 0 for k, c in enumerate(reversed(s)))
    assert Counter(grams("Ab, c".encode()).tolist()) == Counter(map(code, ["a", "b", "c", "_a", "ab", "b_", "_c", "c_", "_ab", "ab_", "_c_"]))


def test_languages_on_held_out_rows(documents, odd):
    rows = identify_languages(documents).collect()
    known = {r["doc_id"]: r["lang"] for r in documents.collect()}
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == len(known) and sum(r["lang_pred"] == known[r["doc_id"]] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_distances_against_profiles_by_hand(documents):
    """Profiles and out-of-place distances with dictionaries and sorts only."""
    from wayfold.llm.common import is_held_out

    most = 400
    rows = documents.limit(60).collect()
    counts = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and not is_held_out(r["doc_id"]):
            counts.setdefault(r["lang"], Counter()).update(grams(r["text"].encode()).tolist())
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]]
    places = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in counts.items()}
    found = {r["doc_id"]: r for r in identify_languages(documents.limit(60)).collect()}
    for r in rows:
        own = top(Counter(grams((r["text"] or "").encode()).tolist()))
        if not own:
            assert found[r["doc_id"]]["lang_pred"] == "und"
            continue
        far = sorted((sum(abs(known[g] - k) if g in known else most for k, g in enumerate(own)), lang) for lang, known in places.items())
        assert found[r["doc_id"]]["lang_pred"] == far[0][1] and abs(found[r["doc_id"]]["score"] - (1 - far[0][0] / far[1][0])) < 1e-12


def test_languages_of_odd_rows(spark, odd):
    found = identify_languages(odd.selectExpr("doc_id", "text", "if(doc_id = 6, 'en', null) as lang")).collect()
    assert len(found) == odd.count() and {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3)} == {"und"}
    none = identify_languages(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert identify_languages(odd.selectExpr("doc_id", "text", "'x' as lang").limit(0)).count() == 0


def test_automaton_matching_statistics():
    seqs = [words(x.encode()) for x in ("a b a b c", "b a b d", "c a")]
    auto, text = Automaton(seqs), words(b"a b a b d b a c a b c")
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for k, (_, length) in enumerate(auto.stream([auto.ids.get(w, -1) for w in text])):
        assert length == max((n for n in range(k + 2) if tuple(text[k + 1 - n : k + 1]) in runs), default=0)


def test_licences(spark, documents, odd):
    docs = [(1, "x Under the MIT-License under the mit license CC BY-NC cc by nc"), (2, "Apache License, Version 2.0"), (3, "noise " + TEMPLATES["mit"][0].replace("sublicense", "rent") + " tail"), (4, " ".join(TEMPLATES["bsd"][0].split()[:8])), (5, "This work is licensed under the GNU General Public License, version 3.")]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_digest(license_scan(made)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (4, 1, 12, "cc-by-nc,mit")
    assert got[2]["labels"] == "apache-2" and got[3]["labels"] == "mit" and got[3]["n_base"] == 0 and got[3]["score"] > 0.9
    assert got[4]["labels"] == "" and got[5]["labels"] == "gpl"
    for frame in (documents, odd, odd.limit(0)):
        rows = frame.select("doc_id", "text").collect()
        expected = []
        for r in rows:
            own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
            hits = [(k, label) for p, label in PHRASES.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
            expected.append((str(r["doc_id"]), len(own), len(hits), str(min((k for k, _ in hits), default=None)), ",".join(sorted({x for _, x in hits}))))
        found = [(str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), r["base_labels"]) for r in license_digest(license_scan(frame)).collect()]
        assert sorted(found) == sorted(expected)
    long = Scanner().scan(("x " * 500 + TEMPLATES["isc"][0] + " ").encode() * 50)
    assert sum(s[2] == "isc" for s in long.spans) == 50


def test_each_template_has_its_own_longest_match():
    a, b = " ".join(f"a{k}" for k in range(1, 13)), " ".join([*(f"a{k}" for k in range(3, 11)), "b1", "b2"])
    both = Scanner({}, {"A": (a,), "B": (b,)})
    text = " ".join(f"a{k}" for k in range(2, 12)).encode()
    assert {s[2] for s in both.scan(text).spans} <= {"A", "B"}
    matches = []
    ids = [both.auto.ids[w] for w in words(text)]
    both._run(ids, 0, both.scan(b""), matches)
    assert sorted(matches) == [(0, 0, 1, 10), (1, 1, 0, 8)]
    for label, own in (("A", a), ("B", b)):
        alone = Scanner({}, {label: (own,)}).scan(text).spans
        assert [s[2] for s in alone] == [label]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == docs.count() and sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    for frame, known in ((odd, labels), (odd, labels.limit(0)), (odd.limit(0), labels)):
        rows = quality_scores(frame, known, steps=3).collect()
        assert len(rows) == frame.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_prior_is_estimated_from_positives_and_unlabelled_text(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    d = len(NAMES)
    rows = []
    for prior in (0.3, 0.8):
        good = rng.random(4000) < prior
        x = rng.standard_normal((4000, d)) + np.where(good, 1.5, -1.5)[:, None] * (np.arange(d) < 3)
        rows += [(prior, r.astype("<f4").tobytes(), bool(g and k % 3 == 0)) for k, (r, g) in enumerate(zip(x, good, strict=True))]
    table = spark.createDataFrame(rows, "prior double, x binary, p boolean")
    for prior in (0.3, 0.8):
        assert abs(estimated_prior(table.where(F.col("prior") == prior).select("x", "p"), 60) - prior) < 0.1


def test_fit_minimises_the_risk_of_brute_force(spark):
    """The distributed fit against the same risk written out over all rows at once."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, len(NAMES))).astype("<f4")
    p = x[:, 0] + rng.standard_normal(600) > 0.8
    table = spark.createDataFrame([(r.tobytes(), bool(q)) for r, q in zip(x, p, strict=True)], "x binary, p boolean").repartition(3)
    model = fit(table, 0.4, steps=120)
    z = np.column_stack([np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8), np.ones(600)])

    def risk(w):
        s = 1 / (1 + np.exp(-z @ w))
        return 0.4 * -np.log(s[p]).mean() + max(0.0, -np.log(1 - s).mean() - 0.4 * -np.log(1 - s[p]).mean()) + 0.005 * (w[:-1] ** 2).sum()

    least = risk(model.w)
    assert all(least <= risk(model.w + step * rng.standard_normal(len(model.w))) + 2e-3 for step in (0.02, 0.1, 0.5) for _ in range(200))


def test_negative_risk_is_kept_from_falling_below_zero(spark, documents):
    from pyspark.sql import functions as F

    table = feature_table(documents, {"p": F.col("doc_id") % 2 == 0})
    model = fit(table, 0.99, steps=30)
    assert np.isfinite(model.w).all() and np.abs(model.w).max() < 50
