"""Registered queries against their SQL, and against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.conftest import DATA, against_sql
from weftline.llm import catalog

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, duck, name):
    against_sql(spark, duck, catalog.queries()[name], catalog.oracle_sql()[name])


def rows(spark, name):
    return catalog.queries()[name](spark, SF).toPandas().set_index("doc_id")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i in sorted(sets):
        met = Counter(o for s in sets[i] for o in at[s])
        for o, common in met.items():
            if 100 * common >= 75 * (len(sets[i]) + len(sets[o]) - common):
                a, b = find(i), find(o)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            at[s].append(i)
    return {i: len(s) for i, s in sets.items()}, {i: find(i) for i in sets}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op7(spark, sf):
    got = catalog.queries()["op7_jaccard_join"](spark, f"{DATA}/{sf}").toPandas().set_index("doc_id")
    sizes, comps = brute_components(dict(duckdb.sql(f"select doc_id, text from '{DATA}/{sf}/documents.parquet'").fetchall()))
    assert got["n_shingles"].to_dict() == sizes
    assert got["component_id"].to_dict() == comps


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return out


def test_op5(spark, texts):
    got = rows(spark, "op5_pii")
    for i, t in texts.items():
        spans = base_spans(t)
        assert got.loc[i, "base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        for kind in ("email", "ip", "card", "phone"):
            assert got.loc[i, f"n_{kind}"] == sum(k == kind for k, _, _ in spans)
        listed = got.loc[i, "spans"].split(",") if got.loc[i, "spans"] else []
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(listed)


def test_op5_recall_of_added_kinds(spark):
    """Planted credentials and card-like numbers that fail the check: all found; lines without digits, marks or signs: nothing."""
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/sf0.1/documents.parquet'").fetchall())
    got = catalog.queries()["op5_pii"](spark, f"{DATA}/sf0.1").toPandas().set_index("doc_id")["spans"].to_dict()
    planted, found, clean = Counter(), Counter(), 0
    for i, t in texts.items():
        listed = set(got[i].split(",")) if got[i] else set()
        for m in re.finditer(r'token = "[0-9a-f]{40}"', t):
            planted["secret"] += 1
            found["secret"] += f"secret:{m.start()}:{m.end()}" in listed
        for m in re.finditer(r"(?<![0-9+.-])(?<![0-9] )[0-9]{16}(?![0-9-])(?! [0-9])", t):
            planted["number"] += 1
            found["number"] += bool({f"card:{m.start()}:{m.end()}", f"account:{m.start()}:{m.end()}"} & listed)
        if not re.search(r"[0-9@]", t):
            clean += 1
            assert not listed
    assert planted["secret"] > 50 and planted["number"] > 100 and clean > 1000
    assert all(found[k] >= 0.95 * planted[k] for k in planted), (planted, found)


def test_op6_held_out_accuracy(spark):
    docs = duckdb.sql(f"select doc_id, lang from '{DATA}/sf0.01/documents.parquet'").df().set_index("doc_id")
    got = catalog.queries()["op6_language_id"](spark, f"{DATA}/sf0.01").toPandas().set_index("doc_id")
    held = got[got["held_out"]].join(docs)
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_op3_held_out_accuracy(spark):
    got = catalog.queries()["op3_quality"](spark, f"{DATA}/sf0.1").toPandas().set_index("doc_id")
    both = got.join(duckdb.sql(f"select * from '{DATA}/sf0.1/labels.parquet'").df().set_index("doc_id"), how="inner")
    both = both[both["held_out"]]
    good, toxic, poor = (both.quality == 1) & (both.toxic == 0), both.toxic == 1, (both.quality == 0) & (both.toxic == 0)
    assert min(good.sum(), toxic.sum(), poor.sum()) > 20
    assert both[good]["selected"].mean() > 0.95
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/sf0.1/documents.parquet'").fetchall())
    insults = re.compile(r"\b(?:trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b", re.I)
    abusive = [bool(insults.search(texts[i])) for i in both.index]
    assert sum(abusive) > 20 and not both[abusive]["selected"].any()
    assert both[toxic]["selected"].mean() < 0.2  # some rows have the label and nothing in their text that shows it
    assert both[poor]["selected"].mean() < 0.1
    assert both[good]["expected_grade"].mean() > both[poor]["expected_grade"].mean() > both[toxic]["expected_grade"].mean()


def test_op9(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op9_token_counts")
    for i, t in texts.items():
        assert got.loc[i, "n_tokens"] == len(tok.encode(t, add_special_tokens=False).ids)
        assert got.loc[i, "n_bytes"] == len(t.encode())


def test_op10(spark, texts):
    got = rows(spark, "op10_imatch")
    ids = sorted(texts, reverse=True)
    seen = {}
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(t) // 3
        assert got.loc[i, "edited_sha256"] == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
        assert seen.setdefault(t, got.loc[i, "fingerprint"]) == got.loc[i, "fingerprint"]
    assert (got["near_edited"] > got["near_next"]).mean() > 0.9


def test_op2(spark, texts):
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    low = {i: " ".join(re.findall(r"\w+", t.lower())) for i, t in texts.items()}
    want = {(i, b) for b, x in bench for i, t in low.items() if " ".join(re.findall(r"\w+", x.lower())) in t}
    got = catalog.queries()["op2_decontaminate"](spark, SF).toPandas()
    assert want <= set(zip(got["doc_id"], got["item_id"], strict=True))
    assert len(got) <= len(want) + 2


def test_op8(spark, texts):
    from weftline.llm.op8_license_scan import TEMPLATES

    squash = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    want = {(i, n) for n, x in TEMPLATES.items() for i, t in texts.items() if f" {squash(x)} " in f" {squash(t)} "}
    got = catalog.queries()["op8_license_scan"](spark, SF).toPandas()
    assert want <= set(zip(got["doc_id"], got["license"], strict=True))
    assert (got["containment"] >= 0.75).all()
