"""Classifiers by held-out accuracy, mixing by SQL, nearest neighbours by brute force, the pipeline by hand."""

import duckdb
import numpy as np
import pytest

TEST = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    from driftline.llm.queries import QUERIES

    got = QUERIES[name](spark, TEST).join(spark.read.parquet(f"{TEST}/labels.parquet"), "doc_id").where("held_out")
    return got.selectExpr("doc_id", f"{label} as y", "score", "predicted").toPandas()


def test_toxicity(spark):
    got = held_out(spark, "op1_toxicity", "toxic")
    hit = ((got.y == 1) & (got.predicted == 1)).sum()
    assert hit / (got.y == 1).sum() > 0.9 and hit / (got.predicted == 1).sum() > 0.9
    assert got.score.between(0, 1).all()


def test_quality(spark):
    got = held_out(spark, "op3_quality_rules", "quality")
    assert (got.y == got.predicted).mean() > 0.98


def test_language(spark):
    from driftline.llm.queries import QUERIES

    got = QUERIES["op2_language_id"](spark, TEST).join(spark.read.parquet(f"{TEST}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.99


def test_language_of_odd_rows(spark, nasty, empty, documents):
    from driftline.llm import langid

    model = langid.fit(documents, sample=100)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(nasty, model).collect()}
    assert got[1] == got[2] == got[7] == ("und", 0.0) and got[6][0] in model.languages
    assert langid.identify(empty, model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(empty)


def test_grammar():
    from driftline.llm import toxicity as T

    model = T.Model({"idiot": 3}, {"worth": 2}, {"foo": 1})
    m = T.Matcher(model)
    weight = lambda t: sum(c[2] for c in m.clauses(t))
    assert weight("an idiot. fine") == 3.0
    assert weight("you idiot") == pytest.approx(3 * model.marks["t"])
    assert weight("not an idiot") == pytest.approx(3 * model.marks["n"])
    assert weight("someone said that idiot left") == pytest.approx(3 * model.marks["r"])
    assert weight("idiot idiot") == 3 + 4 and weight("idiot was here and there an idiot") == 6
    assert weight("i will kill you") == pytest.approx(model.threats["Y"] * model.marks["t"]) and weight("kill the lights") == 0
    for verb in ("kills", "killing", "killed", "stabbing", "strangled"):
        assert weight(f"someone {verb} you") == pytest.approx(model.threats["X"] * model.marks["t"])
    assert weight("worthless") == 2.0 and weight("unworthy") == 0
    assert weight("fooled") == 0 and weight("fooled again. foolish") > 0
    assert m.clauses("") == []
    parts = [T.insult()]
    for make in (T.threat, T.negation, T.reported, T.target):
        parts.append(make(parts[-1].outputs()))
    whole = parts[0]
    for part in parts[1:]:
        whole = T.compose(whole, part)
    rng = np.random.default_rng(3)
    for _ in range(200):
        symbols = [T.SYMBOLS[i] for i in rng.integers(0, len(T.SYMBOLS), 12)]
        by_hand = symbols
        for part in parts:
            by_hand = [s for s, _ in part.run(by_hand)]
        assert [s for s, _ in whole.run(symbols)] == by_hand


def slow_clauses(matcher, text):
    """The clauses of a text, each word of each clause looked at by itself."""
    import re
    from collections import Counter

    from driftline.llm import toxicity as T

    low = text.lower()
    entries = [*matcher.model.words, *matcher.model.stems, *matcher.model.repeated, *T.THREATS]
    begins = Counter(e for m in re.finditer(r"[^\W\d_]+", low) for e in matcher.model.repeated if m[0].startswith(e))
    twice = {e: matcher.model.repeated[e] for e, c in begins.items() if c > 1}
    out = []
    for m in re.finditer(r"[^.!?;:\n]+", low):
        words = re.findall(r"[^\W\d_]+", m[0])
        if any(w.startswith(e) for w in words for e in entries):
            path = list(matcher.machine.run([matcher.symbol(w, twice) for w in words]))
            if any(w > 0 for _, w in path):
                out.append((m.start(), m.end(), pytest.approx(sum(w for _, w in path))))
    return out


def test_toxicity_by_brute_force(spark):
    from driftline.llm import toxicity as T

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(200)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    model = T.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id"))
    matcher, texts = T.Matcher(model), {r.doc_id: r.text or "" for r in docs.collect()}
    some = 0
    for r in T.assess(docs, model).collect():
        want = slow_clauses(matcher, texts[r.doc_id])
        assert [(c.start, c.end, c.weight) for c in r.clauses] == want
        assert r.score == pytest.approx(matcher.probability([(0, 0, sum(c.weight for c in r.clauses))], len(texts[r.doc_id])))
        some += bool(want)
    assert some > 0 and all(v >= 0 for v in (*model.marks.values(), *model.threats.values()))


def test_long_words_and_texts_take_linear_time():
    import time

    from driftline.llm import toxicity as T

    m = T.Matcher(T.Model({"idiot": 3}, {"worth": 2}, {}))
    began = time.time()
    assert len(m.clauses("you idiot " + "x" * 1_000_000)) == 1
    assert len(m.clauses("you idiot " * 100_000 + "!" + " an idiot," * 100_000)) == 2
    assert len(m.clauses("an idiot! " * 200_000)) == 200_000
    assert time.time() - began < 30


def naive_language(model, text):
    """Log probabilities by one pass over the n-grams of the text's letters, in plain Python."""
    from driftline.llm import langid as L

    letters = []
    for c in text:
        low = int(L.letters_of(np.array([ord(c)], dtype=np.uint32))[0])
        if low or (letters and letters[-1]):
            letters.append(low)
    if letters and letters[-1]:
        letters.append(0)
    block = model.blocks[0].value
    total = block.log_prior.copy()
    for n in range(1, L.MAX_GRAM + 1):
        for i in range(len(letters) - n + 1):
            h = 0
            for c in letters[i : i + n]:
                h = (h + c + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
                h ^= h >> 29
            total = total + block.log_prob[h >> 48]
    return block.languages[int(total.argmax())], 1 / np.exp(total - total.max()).sum(), any(letters)


def test_language_by_brute_force(spark, documents):
    from driftline.llm import langid

    model = langid.fit(documents, sample=60)
    rows = documents.select("doc_id", "text").orderBy("doc_id").limit(200)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in langid.identify(rows, model).collect():
        lang, p, seen = naive_language(model, texts[r.doc_id])
        assert r.lang_pred == (lang if seen else "und")
        if seen:
            assert r.score == pytest.approx(p, rel=1e-4)


def test_language_in_blocks_and_parts(spark, documents, monkeypatch):
    from driftline.llm import langid

    rows = documents.select("doc_id", "text")
    whole = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify(rows, langid.fit(documents, sample=60)).collect()}
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 2)
    model = langid.fit(documents, sample=60)
    assert len(model.blocks) > 1
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify(rows, model).collect()} == whole
    text = "Ünï 12 cödé, words.  and more! " * 40
    full = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*langid.grams([text, "x"])))))
    monkeypatch.setattr(langid, "CHUNK_CHARS", 37)
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*langid.grams([text, "x"]))))) == full


def test_language_of_a_very_long_text(spark):
    import time

    from driftline.llm import langid

    model = langid.fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string"))
    began = time.time()
    total, seen = model.blocks[0].value.totals(["the dog and " * 1_000_000])
    assert seen[0] and total[0].argmax() == 1 and time.time() - began < 60


def test_scores_of_odd_rows(spark, nasty, empty):
    from driftline.llm import rule_ensemble, toxicity

    model = toxicity.Model({"idiot": 3}, {}, {})
    got = toxicity.assess(nasty, model).collect()
    assert len(got) == 8 and len({r.score for r in got}) == 1
    assert toxicity.assess(empty, model).count() == 0 and toxicity.learn([], []).words == {}
    flat = rule_ensemble.fit_rules(np.zeros((5, len(rule_ensemble.STATISTICS))), np.ones(5, dtype=int))
    assert rule_ensemble.score(nasty, flat).where("score between 0 and 1").count() == 8


def test_compiled_rules_agree_with_numpy(spark, documents, data):
    from driftline.llm import common, rule_ensemble as R

    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    model = R.fit(common.labelled_sample(documents.select("doc_id", "text"), labels, 1000))
    rows = R.with_statistics(documents).select("doc_id", "__quality.*").orderBy("doc_id").collect()
    x = np.array([[r[k] for k in R.STATISTICS] for r in rows])
    got = [r.score for r in R.score(documents, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(model.predict(x), abs=1e-9)


def test_lasso_drops_what_says_nothing():
    from driftline.llm.rule_ensemble import lasso_logistic

    rng = np.random.default_rng(0)
    x = (rng.random((400, 6)) < 0.5).astype(float)
    w, _ = lasso_logistic(x, (x[:, 0] > 0).astype(float), 0.05)
    assert w[0] > 0.5 and np.abs(w[1:]).max() < 0.05


def test_mixing(spark, documents, nasty, empty):
    from driftline.llm import mixing

    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    want = con.sql(f"select doc_id, copy, n_copies from ({mixing.replicate_sql()}) order by all").fetchall()
    got = sorted((r.doc_id, r.copy, r.n_copies) for r in mixing.replicate(documents).collect())
    assert got == [tuple(r) for r in want]
    assert mixing.replicate(nasty, budget=3.0).columns[-2:] == ["copy", "n_copies"]
    assert mixing.replicate(empty).count() == 0
    only = mixing.replicate(documents, targets={"src0": 1.0}).select("source").distinct().collect()
    assert [r.source for r in only] == ["src0"]
    with pytest.raises(ValueError):
        mixing.rates(documents, targets={"a": -1.0})


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(ids, x, k, modulus):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in np.flatnonzero(ids % modulus == 0):
        s = u @ u[q]
        s[q] = -9
        out[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, -np.round(s, 12)))[:k]]
    return out


def test_nearest_of_few(spark, data):
    """Few rows are hashed too: recall by the model, scores exact; with a recall next to 1 every row is found."""
    from driftline.llm.ann import nearest

    e = spark.read.parquet(f"{data}/embeddings.parquet")
    p = e.toPandas().sort_values("vec_id")
    ids, x = p.vec_id.to_numpy(), np.stack(p.embedding).astype(float)
    want, place = brute(ids, x, 5, 50), {int(v): k for k, v in enumerate(ids)}
    for recall in (0.95, 1 - 1e-9):
        got = {}
        for r in sorted(nearest(e, recall=recall).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.vec_id)
            q, v = x[place[r.query_id]], x[place[r.vec_id]]
            assert r.score == pytest.approx(q @ v / np.linalg.norm(q) / np.linalg.norm(v), abs=1e-12)
        assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)
    assert got == want


def test_recall_and_work_on_clusters(spark):
    """Near neighbours: recall of 0.9 with a part of the rows scored; hashing at every size."""
    from driftline.llm import ann

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((600, 32))
    x = (centres[rng.integers(0, 600, 12000)] + 0.35 * rng.standard_normal((12000, 32))).astype(np.float32)
    want = brute(np.arange(12000), x.astype(float), 5, 50)
    got = {}
    for r in ann.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) / (5 * len(want)) >= 0.9
    unit = ann._unit(x.astype(float))
    near = np.sort(unit[::50] @ unit.T, axis=1)[:, -6]
    model = ann.Tables(len(x), 0.95, float(np.quantile(near, 0.2)), 11)
    keys = [model.bucket(unit, t) for t in range(model.tables)]
    probes = model.probes(unit[::50])
    scored = np.mean([sum(np.isin(k, p).sum() for k in keys) for p in probes])
    assert model.tables >= 2 and scored < 0.15 * len(x)
    small = ann.Tables(500, 0.95, 0.9, 11)
    assert small.m >= 1 and len(np.unique(small.bucket(unit[:500], 0))) > 1


def test_visits_go_by_falling_chance():
    from itertools import product

    from driftline.llm import ann

    rng = np.random.default_rng(1)
    log, _ = ann._chances(rng.standard_normal((2, 3)), rng.uniform(0, 1, (2, 3)), 0.7)
    got = ann.visits(log.tolist(), 0.9)
    chance = [sum(log[t][j][x] for j, x in enumerate(pick)) for t, pick in got]
    assert chance == sorted(chance, reverse=True) and len(set(got)) == len(got)
    every = sorted((sum(log[t][j][x] for j, x in enumerate(pick)) for t in range(2) for pick in product(range(log.shape[2]), repeat=3)), reverse=True)
    assert chance == pytest.approx(every[: len(got)])


def test_many_equal_scores(spark):
    """More unequal vectors with one cosine than any block keeps: ties go to the smallest ids."""
    from driftline.llm.ann import nearest

    rows = [(0, [1.0, 0.0])] + [(k, [float(2 ** (k % 40)), 0.0]) for k in range(99, 50, -1)]
    got = [(r.vec_id, r["rank"]) for r in nearest(vectors(spark, rows), query_modulus=1000).collect()]
    assert sorted(got) == [(51 + k, k + 1) for k in range(5)]


def test_nearest_of_odd_vectors(spark):
    from driftline.llm.ann import nearest

    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0])]
    got = {}
    for r in sorted(nearest(vectors(spark, rows)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got == {0: [(1, 1.0), (2, 1.0), (50, 1.0), (3, 0.0)], 50: [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0)]}
    mixed = [(0, [1.0, 0.0]), (50, [1.0, 0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 0.5, 1.0]), (3, [0.0, 1.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(vectors(spark, mixed)).collect())
    assert got == [(0, 1, 1), (50, 1, 2), (50, 2, 3)]
    clash = vectors(spark, rows).selectExpr("*", "1 as key", "2 as rep", "3 as query", "4 as copies", "5 as vec", "6 as rank", "7 as score")
    assert nearest(clash).count() == 8
    assert nearest(vectors(spark, [])).count() == 0


def test_pipeline(spark, data, documents):
    import corpus_pipeline as P
    from driftline.llm import bpe, mixing, rule_ensemble

    docs = documents
    out = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, data)
        rows = docs.collect()
        out[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
        if name != "tokens":
            assert docs.columns == documents.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r.doc_id for r in out["quality"]}
    assert all((i in kept) == (q == 1) for i, q in labels.items())
    from test_text_operators import brute_classes, spans_by_hand

    classes = brute_classes([(r.doc_id, r.text) for r in out["quality"]], 5, 80)
    assert {r.doc_id for r in out["near_duplicates"]} == {c for _, c in classes.values()}
    assert not any(spans_by_hand(r.text) for r in out["secrets"]) and all(r.n_chars == len(r.text) for r in out["secrets"])
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(out["secrets"], documents.schema).toPandas())
    assert sorted(r.doc_id for r in out["mixture"]) == sorted(r[0] for r in con.sql(f"select doc_id from ({mixing.replicate_sql()})").fetchall())
    assert sorted(r.doc_id for r in out["tokens"]) == sorted(r.doc_id for r in out["mixture"])
    ranks = bpe.load_ranks(P.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = {r.doc_id: r.text for r in out["mixture"]}
    for r in out["tokens"][:20]:
        assert bpe.decode_ids(np.array(r.ids, dtype=np.int64), ranks)[0].tobytes().decode() == texts[r.doc_id]


def test_pipeline_of_odd_rows(spark, data, nasty, empty):
    import corpus_pipeline as P

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (nasty.select(columns), empty):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, data)
        docs.collect()
