"""Recall on verbatim and re-parameterised benchmark items, and what is left alone."""

import re

import numpy as np
import pytest

from tests.llm.conftest import documents
from weftline.llm import op2_decontaminate as op2

WORDS = "green small heavy basket river market train window garden ticket school morning bottle street yellow engine paper travels carries holds sells buys moves finds keeps leaves reaches".split()
NAMES = "Alice Robert Maria Chen Olga Pierre Fatima Kenji Tom Ann".split()
UNITS = "km kg hours dollars liters miles".split()


def generated(count, seed=1):
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(count):
        w = [" ".join(rng.choice(WORDS, n)) for n in (2, 3, 2, 2, 3)]
        unit = rng.choice(UNITS)
        made.append(lambda a, b, x, y, w=w, unit=unit: f"{a} {w[0]} {x} {unit} {w[1]} while {b} {w[2]} {y} {unit} {w[3]}. How many {unit} does {a} {w[4]}?")
    return rng, made


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def found(docs, bench, **options):
    return {(r["doc_id"], r["item_id"]): r["coverage"] for r in op2.contaminated(docs, bench, **options).collect()}


@pytest.mark.parametrize("broadcast_windows", [1_000_000, 0])
def test_items_of_every_shape_are_found_verbatim(spark, broadcast_windows):
    texts = ["quantum entanglement explained simply", "12 + 30 = 42", "Who Wrote The Old Man And The Sea", "Alice has a green basket of apples", "17 x 23 = ? 5 / 8 = ? 9 - 4 = ? 100", "Paris", "What is it?"]
    around = ["before that, {} and so on", "{}", "so:\n{}\nyes", "\"{}\""]
    docs = documents(spark, [(10 * k + j, a.format(t)) for k, t in enumerate(texts) for j, a in enumerate(around)] + [(900, "nothing of the kind is in here at all"), (901, "17 plus 23 makes 40 and 12 + 31 = 42"), (902, None), (903, "")])
    got = found(docs, items(spark, texts), broadcast_windows=broadcast_windows)
    assert {(10 * k + j, k) for k in range(len(texts)) for j in range(len(around))} <= set(got)
    assert not {i for i, _ in got} & {900, 901, 902, 903}


@pytest.mark.parametrize("broadcast_windows", [1_000_000, 0])
def test_other_names_and_numbers(spark, broadcast_windows):
    rng, made = generated(200)
    bench, docs = [], []
    for k, q in enumerate(made):
        a, b, c, d = rng.choice(NAMES, 4, replace=False)
        bench.append(q(a, b, 3 + k, 1200.5 + k))
        filler = " ".join(rng.choice(WORDS, 60))
        docs.append((k, f"{filler}. {q(c, d, 5000 + k, 7 + k)} {filler}"))
        docs.append((1000 + k, f"{filler}. {' '.join(rng.choice(WORDS, 40))}. {filler}"))
        # one name and one number stand for two: the same pattern, no re-parameterised copy
        docs.append((2000 + k, f"{filler}. {q(c, d, 5000 + k, 7 + k).replace('does ' + c, 'does ' + a)} {filler}"))
    got = found(documents(spark, docs), items(spark, bench), broadcast_windows=broadcast_windows)
    assert len({k for k in range(200) if (k, k) in got}) >= 0.9 * 200
    assert not [i for i, _ in got if 1000 <= i < 2000]
    assert all(i % 1000 == k for i, k in got)
    lower = [(2000 + k, k) not in got or got[2000 + k, k] < got[k, k] for k in range(200)]
    assert sum(lower) >= 0.98 * 200  # a pattern that an item repeats may fit on another alignment


def test_patterns_that_many_share_make_no_pairs(spark):
    """A common sentence pattern in every item and every document links nothing."""
    rng = np.random.default_rng(4)
    pattern = "How many of them are there in the end, then?"
    bench = items(spark, [" ".join(rng.choice(WORDS, 25)) + ". " + pattern for _ in range(60)])
    docs = documents(spark, [(k, " ".join(rng.choice(WORDS, 50)) + ". " + pattern) for k in range(300)])
    assert found(docs, bench) == {}


def test_against_brute_force_coverage(spark):
    """Every pair with half of the item's five-word runs verbatim is found, and none without a quarter of them."""
    rng = np.random.default_rng(9)
    bench = [" ".join(rng.choice(WORDS, 30)) for _ in range(20)]
    docs = []
    for k, t in enumerate(bench):
        w = t.split()
        for j, share in enumerate((1.0, 0.8, 0.62, 0.3, 0.0)):
            n = round(30 * share)
            docs.append((100 * k + j, " ".join([*rng.choice(WORDS, 40), *w[:n], *rng.choice(WORDS, 30)])))
    got = found(documents(spark, docs), items(spark, bench))
    runs = lambda t: {tuple(x[i : i + 5]) for x in [re.findall(r"\w+", t.lower())] for i in range(len(x) - 4)}
    for i, t in docs:
        for k, b in enumerate(bench):
            share = len(runs(b) & runs(t)) / len(runs(b))
            assert (share < 0.5 or (i, k) in got) and ((i, k) not in got or share >= 0.5)


def test_several_texts_of_one_item_or_document(spark):
    a, b = "one green basket holds seven small yellow bottles of paper", "every heavy train leaves the old school garden in the morning"
    bench = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b)], "item_id long, text string")
    got = found(documents(spark, [(5, f"x {a} y"), (5, "other words"), (6, f"x {b} y")]), bench)
    assert got == {(5, 1): 1.0, (6, 1): 1.0, (6, 2): 1.0}
