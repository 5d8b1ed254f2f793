"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import documents
from weftline.llm import op1_line_dedup as op1
from weftline.llm import op2_decontaminate as op2
from weftline.llm import op3_quality as op3
from weftline.llm import op4_mixing as op4
from weftline.llm import op5_pii as op5
from weftline.llm import op6_language_id as op6
from weftline.llm import op7_jaccard_join as op7
from weftline.llm import op8_license_scan as op8
from weftline.llm import op9_token_counts as op9
from weftline.llm import op10_imatch as op10
from weftline.llm import shingles
from weftline.llm import signature_tree as tree

LONG = "lorem ipsum dolor sit amet, " * 20_000


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "What does 3 apples cost when Tom buys 3 apples for 5 dollars today?"), (2, None), (3, "")], "item_id long, text string")


def test_op1(odd, nothing):
    got = by_id(op1.digest(odd))
    assert len(got) == 11 and got[1]["clean_sha256"] is None and got[6]["n_cut"] == 0
    assert op1.digest(nothing).count() == 0


def test_op1_cuts_after_the_first(spark):
    line = "accept all cookies to continue reading"
    rows = [(k, f"own text number {k} here\n{line}", "en", f"site{k}") for k in range(1, 7)] + [(9, line, "en", None)]
    out = {r["doc_id"]: r["text"] for r in op1.dedup_lines(documents(spark, rows)).collect()}
    assert line in out[1] and all(line not in out[k] for k in range(2, 7)) and out[9] == ""


def test_op2(spark, odd, nothing, bench):
    assert op2.contaminated(odd, bench).count() == 0
    assert op2.contaminated(nothing, bench).count() == 0
    assert op2.contaminated(odd, bench.limit(0)).count() == 0
    docs = documents(spark, [
        (1, "so: What does 7 apples cost when Ann buys 7 apples for 9 dollars today? yes"),
        (2, "so: What does 7 apples cost when Ann buys 8 apples for 9 dollars today? yes"),
        (3, "nothing of the kind"), (4, "so: What does 3 apples cost when Tom buys 3 apples for 5 dollars today? yes"),
    ])
    got = {r["doc_id"]: r["coverage"] for r in op2.contaminated(docs, bench).collect()}
    assert got[1] == 1.0 and got[4] == 1.0 and 3 not in got and got.get(2, 0) < 1.0


def test_op3(spark, odd, nothing):
    grades = spark.createDataFrame([(7, 2), (4, 1), (5, 0), (99, None), (None, 1)], "doc_id long, grade int")
    model = op3.fit_quality(odd, grades, 3)
    got = op3.score_quality(odd, model).collect()
    assert len(got) == 13 and all(0 <= r["p_top"] <= r["p_any"] <= 1 for r in got)
    assert op3.score_quality(nothing, op3.fit_quality(nothing, grades, 3)).count() == 0


def test_op3_orders_grades():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["bad", "so", "good"], 20, p=p)) for p in ((0.8, 0.1, 0.1), (0.1, 0.8, 0.1), (0.1, 0.1, 0.8)) for _ in range(60)]
    grades = np.repeat([0, 1, 2], 60)
    m = op3.Ordinal.fit([op3.features(t) for t in texts], grades, 3)
    assert (np.diff(m.thresholds) > 0).all()
    expected = m.at_least(texts).sum(axis=1)
    assert expected[:60].mean() < expected[60:120].mean() < expected[120:].mean()


def test_op4(spark, odd, nothing):
    got = op4.mix(odd).collect()
    assert len(got) == 13 and sum(r["size"] for r in got if r["doc_id"] == 1) == 0
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert op4.mix(nothing).count() == 0
    assert sorted(map(str, op4.mix(odd).collect())) == sorted(map(str, got))


def test_op4_targets_and_weights(spark):
    rows = [(k, "w " * (k % 40 + 1), "en", f"s{k % 3}") for k in range(3000)]
    docs = documents(spark, rows)
    docs = docs.withColumn("weight", docs["doc_id"] % 7 + 1)
    for weight, broadcast_rows in ((None, 1000), (F.col("weight"), 1000), (F.col("weight"), 0), (op4.digits(), 1000)):
        out = op4.mix(docs, weight=weight, broadcast_rows=broadcast_rows).toPandas()
        for _, own in out.groupby("target"):
            assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 40
        assert (out["taken"] <= 3 * out["size"]).all()
        assert abs(out.groupby("target")["taken"].sum().sum() - out["size"].sum()) < 150
    # the heavier a document of one source, the more copies of it
    both = out.assign(own=out["size"].map(lambda n: n.bit_length()), src=out["doc_id"] % 3)
    assert all(g.groupby("own")["copies"].mean().iloc[-1] > g.groupby("own")["copies"].mean().iloc[0] for _, g in both.groupby("src"))


def test_op4_one_id_with_several_texts(spark):
    rows = [(7, f"text {k} " + "w " * (k % 9), "en", "s") for k in range(40)] + [(k, "w " * 30, "en", "t") for k in range(9)]
    docs = documents(spark, rows)
    runs = [sorted(map(str, op4.mix(docs.repartition(n), weight=op4.digits()).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_op4_targets_of_many_sources(spark):
    """Numbers by code point and levels as a plain computation gives them."""
    rng = np.random.default_rng(2)
    sizes = {f"h{k}": int(rng.integers(0, 1000)) for k in range(300)} | {None: 77, "é": 5000, "Z": 3}
    got = {r["src"]: r["target"] for r in op4.source_targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()}
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None]
    weight, total = {n: k % 3 + 1 for k, n in enumerate(names)}, sum(sizes.values())
    capped = set()
    while True:
        level = (total - 3 * sum(sizes[n] for n in capped)) / sum(weight[n] for n in names if n not in capped)
        more = {n for n in names if 3 * sizes[n] < level * weight[n]}
        if more == capped:
            break
        capped = more
    assert got == pytest.approx({n: 3 * sizes[n] if n in capped else level * weight[n] for n in names})


def test_op5(odd, nothing, spark):
    got = by_id(op5.digest(odd))
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert op5.digest(nothing).count() == 0
    text = "\U0001f600 a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 x 4111 1111 1111 1111 y +1 (650) 555-0101 z " + "9" * 5000 + " a" * 3 + "@"
    row = op5.digest(documents(spark, [(1, text)])).first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (2, 2, 1, 1)


def test_op5_added_kinds(spark):
    """Every labeler's vote on made-up spans, and spans kept by the trained classifier."""
    good = [f"my iban DE{k:02d} 3704 0044 0532 0130 {k:02d} and ssn 123-45-{6000 + k} or call (212) 555-{1000 + k} password = \"a1b2c3d4e5f6a7b8c9d{k}\"" for k in range(40)]
    bad = [f"version 000-00-{7000 + k} page" for k in range(40)]
    rows = {r["doc_id"]: r for r in op5.digest(documents(spark, list(enumerate(good + bad)))).collect()}
    for k in range(40):
        r = rows[k]
        assert (r["n_iban"], r["n_ssn"], r["n_local_phone"], r["n_secret"]) == (1, 1, 1, 1), r
    assert sum(rows[k]["n_spans"] for k in range(40, 80)) == 0
    start = good[0].index("DE00")
    assert f"iban:{start}:{start + 27}" in rows[0]["spans"].split(",")


def test_op6(odd, nothing, spark):
    model = op6.prototypes(op6.training_rows(odd))
    told = op6.identify(odd, model)
    assert told.columns == [*odd.columns, "language_"] and {r["language"] for r in told.collect()} == {"extra language"}
    got = {r["doc_id"]: r["language_"] for r in told.collect()}
    assert [got[k]["lang"] for k in (1, 2, 3, 5)] == ["und"] * 4 and got[6]["lang"] in ("en", "de")
    empty = op6.prototypes(nothing)
    assert empty[0] == [] and op6.identify(nothing, empty).count() == 0
    assert {r["language_"]["lang"] for r in op6.identify(odd, empty).collect()} == {"und"}
    far = op6.identify(documents(spark, [(1, "\U00030000\U00030001 \U00031350")]), model).first()["language"]
    assert far["lang"] in ("en", "de", "fr")


def test_op7(odd, nothing):
    got = by_id(op7.components(odd))
    assert got[1]["n_shingles"] == got[2]["n_shingles"] == got[3]["n_shingles"] == 0
    assert got[1]["component_id"] == 1 and got[8]["component_id"] == 7 and got[4]["n_shingles"] == 1 and got[12]["component_id"] == 12
    assert op7.components(nothing).count() == 0


def test_op7_chains_and_shared_passages(spark):
    """A chain of near copies is one component; documents that share half of their text are not linked."""
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(12):
        w = base.copy()
        for j in range(k + 1):
            w[j * 15] = f"x{j}"
        rows.append((k, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(80))
    rows += [(100 + k, passage + " " + " ".join(f"q{k}_{j}" for j in range(80))) for k in range(30)]
    from tests.llm.test_queries import brute_components

    sizes, comps = brute_components(dict(rows))
    got = by_id(op7.components(documents(spark, rows)))
    assert {i: r["component_id"] for i, r in got.items()} == comps
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes


def test_op7_beyond_what_is_broadcast(spark, monkeypatch):
    """The ways that take over beyond the broadcast bound give the same components."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[: 60 - k % 4] + [f"end{k % 3}"])) for k in range(12)] + [(50 + k, "a copy of the same few words") for k in range(5)] + [(80, None)]
    docs = documents(spark, rows)
    want = sorted(map(str, op7.components(docs).collect()))
    monkeypatch.setattr(op7, "BROADCAST_ROWS", 0)
    assert sorted(map(str, op7.components(docs).collect())) == want


def clusters_of_sets(rng, count, most):
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = []
    for _ in range(count):
        s = np.unique(rng.choice(pool, rng.integers(1, most)))
        sets.append(s)
        for _ in range(3):
            t = s.copy()
            t[: rng.integers(0, max(1, len(t) // 4) + 1)] = rng.integers(0, 1 << 63)
            sets.append(np.unique(t))
    return sets


@pytest.mark.parametrize(("most", "cross"), [(20, False), (60, False), (300, False), (60, True), (300, True)])
def test_op7_tree_finds_what_brute_force_finds(most, cross):
    rng = np.random.default_rng(most)
    sets = clusters_of_sets(rng, 60, most)
    label, side = rng.integers(0, 200, len(sets)), rng.integers(0, 2, len(sets))
    n = np.array([len(s) for s in sets])
    found = [p for a, b in tree.candidate_pairs(np.arange(len(sets)), n, [tree.bitmap(s) for s in sets], label, side, cross) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(set(found)) < len(sets) * (len(sets) - 1) // 6
    for a in range(len(sets)):
        for b in range(a):
            if label[a] != label[b] and (not cross or side[a] != side[b]) and tree.links(n[a], n[b], len(np.intersect1d(sets[a], sets[b]))):
                assert (b, a) in set(found)


def test_op7_blocks_over_a_chunk(spark):
    """Blocks and hubs split into bands and chunks give the links of whole ones."""
    rng = np.random.default_rng(5)
    sets = clusters_of_sets(rng, 40, 120)
    n = [len(s) for s in sets]
    sizes = spark.createDataFrame([(k, len(s)) for k, s in enumerate(sets)], "node long, n long")
    table = spark.createDataFrame([(k, len(s), bytearray(s.tobytes()), bytearray(tree.bitmap(s))) for k, s in enumerate(sets)], "node long, n long, items binary, bits binary")
    everything = spark.createDataFrame([(sig, k, k) for sig in range(40) for k in range(len(sets))], "sig long, node long, label long")
    want = {(b, a) for a in range(len(sets)) for b in range(a) if tree.links(n[a], n[b], len(np.intersect1d(sets[a], sets[b])))}
    for chunk in (7, 50, 1000):
        rows = op7.block_trees(op7._enough(everything, sizes), table, chunk)
        assert rows.groupBy("sig", "i", "j").count().agg({"count": "max"}).first()[0] <= max(6 * chunk, 40)
        got = {(r["a"], r["b"]) for r in op7.verify(op7.tree_join(rows), table).collect()}
        assert got == want
    hubs = spark.createDataFrame([(0, k, 0) for k in range(len(sets))] + [(1, k, 4) for k in range(len(sets))], "sig long, node long, hub long")
    got = {(r["a"], r["b"]) for r in op7.verify(op7.tree_join(op7.hub_trees(hubs, table, 7)), table).collect()}
    assert got == {p for p in want if 0 in p or 4 in p}


def test_op7_shingles_are_those_of_the_definition():
    from tests.llm.test_queries import shingle_set

    texts = ["", " \t", "a", "A b", "a b c d e", "x" * 3_000_000 + " y  Z", "É à\x0b\x0c z \x85 q", "one two three four five six " * 300, None]
    texts += [" ".join(np.random.default_rng(k).choice(["a", "B", "cc", "é"], 90)) for k in range(50)]
    import pyarrow as pa

    for most in (1, 1000, 1 << 24):
        sets = [s for _, part in shingles.shingle_sets(pa.array(texts), most) for s in part]
        brute = [shingle_set(t) for t in texts]
        assert [len(s) for s in sets] == [len(s) for s in brute]
        for k in range(9, len(texts) - 1):
            assert len(np.intersect1d(sets[k], sets[k + 1])) == len(brute[k] & brute[k + 1])


def test_op8(odd, nothing, spark):
    assert op8.license_scan(odd).count() == 0 and op8.license_scan(nothing).count() == 0
    docs = documents(spark, [(1, "a b c. Released under the MIT License."), (2, LONG + op8.TEMPLATES["gpl-3.0"] + LONG), (3, "the license of life")])
    got = {(r["doc_id"], r["license"]) for r in op8.license_scan(docs).collect()}
    assert {(1, "mit"), (2, "gpl-3.0")} <= got and not any(i == 3 for i, _ in got)


def test_op9(odd, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in op9.token_counts(odd, path).collect())
    assert got == sorted((r["doc_id"], len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert op9.token_counts(nothing, path).count() == 0


def test_op9_pieces_agree_with_the_library():
    """Every character taken by the fast path is split as the library splits it; special strings count as one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    c, tok = op9.Counter(path), Tokenizer.from_file(path)
    for p in [*range(0x3000), *range(0x3000, 0x10000, 7), *range(0x1F300, 0x1F650)]:
        if 0xD800 <= p <= 0xDFFF or c.rare(chr(p)):
            continue
        s = f"a{chr(p)}b 1{chr(p)} {chr(p)}{chr(p)}x!{chr(p)}"
        assert [s[i:j] for _, (i, j) in tok.pre_tokenizer.pre_tokenize_str(s)] == c.find(s), hex(p)
    for s in ["<|endoftext|>", "a <|endoftext|>  b<|endoftext|>", "it's  we'll   ", "\n\n a\t b", "漢字ab"]:
        assert c.count(s) == len(tok.encode(s, add_special_tokens=False).ids)


def test_op10(odd, nothing, spark):
    got = by_id(op10.digest(odd))
    assert len(got) == 11 and got[1]["n_chars"] == 0 and got[7]["fingerprint"] == got[8]["fingerprint"]
    assert op10.digest(nothing).count() == 0
    one = op10.digest(documents(spark, [(5, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0


def test_op10_against_a_plain_computation(spark):
    """Fingerprints, edited texts, likenesses: with outlying, repeated and null ids, over several ranges."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in [*range(40), 10**15, -(10**15), 7, 7]] + [(None, "lost words w1"), (41, None)]
    docs = documents(spark, rows)
    lex = op10.lexicon(docs)
    fp = op10.fingerprints(docs, lex)
    part = op10.id_ranges(docs.select("doc_id"), "doc_id", range_rows=5)
    dealt = op10.with_next(fp, part=part)
    assert docs.select(part.alias("p")).groupBy("p").count().agg({"count": "max"}).first()[0] <= 12
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    after = {order[k]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    got = [(r["doc_id"], r["t"], r["next_t"]) for r in dealt.collect()]
    assert len(got) == len(rows) and all(after[i, t] == n for i, t, n in got)
    kept = {t for t in vocabulary + ["lost", "words"] if max(2, 0.01 * len(rows)) <= sum(t in (x or "").split() for _, x in rows) <= max(2, 0.2 * len(rows))}
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in kept], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    assert {r["term"] for r in lex.collect()} == set(hashes.values())
    prints = {r["t"]: r["f"] for r in fp.collect()}
    for _, t in order:  # a subset's hash depends on the text's kept terms only, and texts that share them all agree
        own = {hashes[w] for w in t.split() if w in hashes}
        for _, u in order:
            if own and own == {hashes[w] for w in u.split() if w in hashes}:
                assert prints[t] == prints[u]
    full = {(r["doc_id"], r["n_chars"]): r for r in op10.digest(docs).collect()}
    for i, t in order:
        n = len(t) // 3
        edited = t[: len(t) - n] + after[i, t][:n]
        r = full[i, len(t)]
        if [x for x in order if x[0] == i and len(x[1]) == len(t)] == [(i, t)]:
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            told = [a == b for a, b in zip(prints[t], prints[after[i, t]], strict=True) if not (a == b == op10.NONE)]
            assert r["near_next"] == pytest.approx(sum(told) / len(told) if told else 1.0)
            if edited == t:
                assert r["near_edited"] == 1.0 and r["edited_fingerprint"] == r["fingerprint"]


def test_op8_finds_edited_notices_and_texts(spark):
    """One word in twelve replaced leaves 60 % of five-word runs or more; one in forty leaves 75 % and must be found."""
    rng = np.random.default_rng(6)
    texts = op8.full_texts()
    rows, want = [], set()
    for k, (name, text) in enumerate(sorted(texts.items())):
        words = text.split()
        for j in range(5):
            edited = [w if rng.random() > 1 / 40 else f"changed{rng.integers(1000)}" for w in words]
            rows.append((10 * k + j, "own words before. " + " ".join(edited) + " and after"))
            squash = lambda t: re.findall("[a-z0-9]+", t.lower())
            runs = lambda t: {tuple(x[i : i + 5]) for x in [squash(t)] for i in range(len(x) - 4)}
            if len(runs(text) & runs(" ".join(edited))) >= 0.8 * len(runs(text)):
                want.add((10 * k + j, name))
    got = {(r["doc_id"], r["license"]) for r in op8.license_scan(documents(spark, rows)).collect()}
    assert len(want) >= 30 and len(want & got) >= 0.97 * len(want)


def test_pipeline_keeps_columns(spark, odd, nothing, tmp_path, bench):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            out = stage(spark, before, str(tmp_path))
            if k < 4:
                assert out.columns == before.columns
                assert out.count() <= before.count()
                docs = out
    assert {r["doc_id"] for r in docs.collect()} == set()
