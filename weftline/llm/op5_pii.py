"""Personal data spans by weak supervision, with built-in expressions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay.  Further
candidates (account numbers that fail the card check, phone numbers without a country code,
credentials, bank account and social security numbers) are kept or dropped by a span classifier: four labelers (strict shape, gazetteer,
context words, clean edges) vote -1, 0 or +1 on every candidate; expectation-maximisation over the
table of vote patterns estimates each labeler's reliability without labels; a logistic span
classifier is then trained on the posteriors and applied as a column expression.

The vote table has at most kinds x 3**4 rows whatever the corpus, so the fit is a few sums on the
driver.  Texts are read once, in a narrow pass; everything later works on the candidates.

Positions: matches and the pieces between them (split by the same pattern) alternate, so running
lengths give offsets in code points in one pass over a text.  The patterns are the published ones
with possessive repeats and run starts, which match the same spans in linear time.

Defined results: null counts as empty; very long texts are read whole; a document without candidates has
zero counts and empty span lists; an empty table gives an empty result; repeated rows stay separate;
an added span may overlap another added one, never a base one; there are no ties; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "local_phone", "secret", "iban", "ssn")
LABELERS = ("shape", "gazetteer", "context", "edges")
EMAIL_CLASS = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{EMAIL_CLASS})){EMAIL_CLASS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?:token|secret|password|passwd|api_?key|access_?key)\x20?[:=]\x20?\x22[^\x22\s]{8,}\x22",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for the pattern to be worth running.
GATES = {
    "email": "instr(t, '@') > 0",
    "ip": r"t RLIKE '[0-9]\\.[0-9]'",
    "card": r"t RLIKE '[0-9](?:[\\x20-]?[0-9]){12}'",
    "phone": "instr(t, '+') > 0",
    "local_phone": r"t RLIKE '[0-9]{3}[\\x20.-][0-9]{4}'",
    "secret": "instr(t, '\"') > 0",
    "iban": "t RLIKE '[A-Z]{2}[0-9]{2}'",
    "ssn": r"t RLIKE '[0-9]-[0-9]{2}-[0-9]'",
}
#: Gazetteers (fixed public values): top-level domains, calling codes, card issuers' first digits, countries with IBANs.
TOP_DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|io|ai|app|dev|co|me|tv|cc|xyz|online|site|shop|cloud|tech|store|blog|"
    "ac|ad|ae|al|am|ar|at|au|az|ba|bd|be|bg|bo|br|by|ca|ch|cl|cn|cr|cu|cy|cz|de|dk|do|dz|ec|ee|eg|es|eu|fi|fr|ge|gr|gt|hk|hr|hu|id|ie|il|in|iq|ir|is|it|"
    "jo|jp|ke|kr|kw|kz|lb|li|lk|lt|lu|lv|ma|mc|md|mk|mt|mx|my|ng|ni|nl|no|np|nz|pa|pe|ph|pk|pl|pr|pt|py|qa|ro|rs|ru|sa|se|sg|si|sk|sn|sv|th|tn|tr|tw|ua|uk|us|uy|uz|ve|vn|za"
)
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|5[1-8]|60|61|62|63|64|65|66|81|82|84|86|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|3[068]|6011|64[4-9]|65|35[2-8]|62|50|5[6-9]|6[37]"
#: Digits of account and payment numbers in use (14 and 15: Diners and American Express, 16: most cards and accounts, 18: CLABE, 19: Maestro).
ACCOUNT_LENGTHS = (14, 15, 16, 18, 19)
IBAN_COUNTRIES = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FR|GB|GE|GI|GR|HR|HU|IE|IL|IS|IT|JO|KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MT|NL|NO|PK|PL|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA|XK"
NEARBY = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo",
    "ip": "ip|address|server|host|login|adresse|direcci",
    "card": "card|visa|credit|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|llama",
    "account": "account|iban|card|konto|compte|cuenta|pay",
    "local_phone": "phone|call|tel|mobile|fax",
    "secret": "key|token|secret|login|credential|config",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax|insurance",
}
AGAINST = "version|isbn|order|page|sku|chapter|figure|serial"


def _spans(kind: str) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches in column t."""
    pattern = F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(F.col("t"), pattern, F.lit(0))
    parts = F.split(F.col("t"), PATTERNS[kind], -1)
    empty = F.expr("struct(0 AS at, CAST(array() AS array<struct<s:int,e:int,v:string>>) AS found)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v")))).alias("found"))

    pairs = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, v: F.struct(p.alias("p"), v.alias("v")))
    found = F.aggregate(pairs, empty, step, lambda acc: acc["found"])
    return F.when(F.expr(GATES[kind]), found).otherwise(F.expr("CAST(array() AS array<struct<s:int,e:int,v:string>>)"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _octets(v: Column) -> Column:
    return F.transform(F.split(v, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))


def _is_ip(v: Column) -> Column:
    return F.forall(_octets(v), lambda x: (F.length(x) <= 3) & (F.coalesce(F.try_to_number(x, F.lit("999")), F.lit(0)) <= 255))


def _shape(kind: str, v: Column) -> Column:
    digits = _digits(v)
    return {
        "email": v.rlike(r"\.[A-Za-z]{2,}$"),
        "ip": ~v.rlike(r"(^|\.)0[0-9]") & v.rlike("[0-9]{2}"),
        "card": F.length(digits) == F.length(v),
        "account": F.length(digits) == F.length(v),
        "phone": F.length(digits).between(10, 13),
        "local_phone": v.rlike(r"^\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}$"),
        "secret": v.rlike("[0-9]") & v.rlike("[A-Za-z]"),
        "iban": F.length(F.translate(v, " ", "")).between(15, 34),
        "ssn": ~v.rlike("-00-|0000$"),
    }[kind]


def _gazetteer(kind: str, v: Column) -> Column:
    return {
        "email": v.rlike(rf"(?i)\.(?:{TOP_DOMAINS})$"),
        "ip": ~v.rlike(r"^(?:0|10|127|255|192\.168|169\.254)\."),
        "card": v.rlike(f"^(?:{ISSUERS})"),
        "account": F.length(_digits(v)).isin(*ACCOUNT_LENGTHS),
        "phone": v.rlike(rf"^\+(?:{CALLING})"),
        "local_phone": ~v.rlike("^[(]?[2-9]11"),
        "secret": v.rlike("[0-9A-Za-z+/_-]{20}"),
        "iban": v.rlike(f"^(?:{IBAN_COUNTRIES})"),
        "ssn": ~v.rlike("^(?:000|666|9)"),
    }[kind]


def _voted(kind: str, spans: Column, base: bool) -> Column:
    """Candidates of one kind with their votes."""

    def vote(x: Column) -> Column:
        v = x["v"]
        before = F.lower(F.substring(F.col("t"), F.greatest(x["s"] - 39, F.lit(1)), F.least(x["s"], F.lit(40))))
        around = F.concat(F.substring(F.col("t"), x["s"], F.when(x["s"] > 0, 1).otherwise(0)), F.lit("|"), F.substring(F.col("t"), x["e"] + 1, F.lit(1)))
        sign = lambda c: F.when(c, 1).otherwise(-1).cast("tinyint")
        context = F.when(before.rlike(NEARBY[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0).cast("tinyint")
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"),
            sign(_shape(kind, v)).alias("shape"), sign(_gazetteer(kind, v)).alias("gazetteer"),
            context.alias("context"), sign(~around.rlike(r"^[\p{L}\p{N}]|[\p{L}\p{N}]$")).alias("edges"),
        )

    return F.transform(spans, vote)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array of candidates with votes; base ones first, added ones never overlap them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("*", *[_spans(k).alias(k) for k in ("email", "ip", "phone", "local_phone", "secret", "iban", "ssn")], _spans("card").alias("runs"))
    rows = rows.withColumn("runs", F.filter("runs", lambda x: F.length(_digits(x["v"])).between(13, 19)))
    luhn = lambda x: F.call_function("luhn_check", _digits(x["v"]))
    rows = rows.select(
        "doc_id", "t", "email", "local_phone", "secret", "iban", "ssn",
        F.filter("ip", lambda x: _is_ip(x["v"])).alias("ip"),
        F.filter("phone", lambda x: F.length(_digits(x["v"])).between(9, 15)).alias("phone"),
        F.filter("runs", luhn).alias("card"),
        F.filter("runs", lambda x: ~luhn(x)).alias("account"),
    )
    base = F.concat(*[_voted(k, F.col(k), True) for k in BASE])
    added = F.concat(*[_voted(k, F.col(k), False) for k in ADDED])
    rows = rows.select("doc_id", base.alias("b"), added.alias("a"))
    clear = F.filter("a", lambda x: ~F.exists("b", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return rows.select("doc_id", F.concat("b", clear).alias("found"))


def vote_patterns(found: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """(kind, votes, count): at most kinds x 3**labelers rows."""
    rows = found.where(F.size("found") > 0).select(F.explode("found").alias("x")).select("x.*")
    got = rows.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["kind"], tuple(r[v] for v in LABELERS), r["n"]) for r in got)


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> list[float]:
    """Posterior of every pattern by EM: P(vote | span is personal or not) for each labeler, a prior for each kind."""
    post = [min(0.95, max(0.05, 0.5 + 0.15 * sum(votes))) for _, votes, _ in patterns]
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        table = [[{v: 0.5 for v in (-1, 0, 1)} for _ in range(2)] for _ in LABELERS]
        for (kind, votes, n), p in zip(patterns, post, strict=True):
            good, every = prior.setdefault(kind, [1.0, 2.0])
            prior[kind] = [good + n * p, every + n]
            for k, v in enumerate(votes):
                table[k][1][v] += n * p
                table[k][0][v] += n * (1 - p)
        chance = [[{v: c / sum(row.values()) for v, c in row.items()} for row in labeler] for labeler in table]
        post = []
        for kind, votes, _ in patterns:
            share = prior[kind][0] / prior[kind][1]
            odds = math.log(share / (1 - share)) if 0 < share < 1 else 0.0
            odds += sum(math.log(chance[k][1][v] / chance[k][0][v]) for k, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return post


def train(patterns: list[tuple[str, tuple[int, ...], int]], post: list[float], rounds: int = 400) -> dict[str, float]:
    """Weights of a logistic span classifier on kind and votes, fitted to the posteriors."""
    rows = [[f"kind={kind}", *(f"{name}={v}" for name, v in zip(LABELERS, votes, strict=True))] for kind, votes, _ in patterns]
    total = sum(n for _, _, n in patterns) or 1
    weights = {f: 0.0 for row in rows for f in row}
    for _ in range(rounds):
        slope = dict.fromkeys(weights, 0.0)
        for row, (_, _, n), p in zip(rows, patterns, post, strict=True):
            miss = p - 1 / (1 + math.exp(-sum(weights[f] for f in row)))
            for f in row:
                slope[f] += miss * n / total
        for f, g in slope.items():
            weights[f] += 2.0 * (g - 1e-4 * weights[f])
    return weights


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array<struct<kind, s, e, base>>: base spans and the added ones the classifier accepts."""
    found = materialize(candidates(docs, id_col, text_col), "pii-candidates")
    patterns = vote_patterns(found)
    weights = train(patterns, reliabilities(patterns))

    def score(x: Column) -> Column:
        total = F.lit(0.0)
        for name in ("kind", *LABELERS):
            own = [(f.split("=")[1], w) for f, w in weights.items() if f.startswith(name + "=")]
            case = F.lit(0.0)
            for value, w in own:
                case = F.when(x[name].cast("string") == value, F.lit(w)).otherwise(case)
            total = total + case
        return total

    bar = math.log(threshold / (1 - threshold))
    kept = F.filter("found", lambda x: x["base"] | (score(x) >= bar))
    return found.select("doc_id", F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in (*BASE, *ADDED)], F.size("spans").cast("long").alias("n_spans"), F.sha2(text(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), text("spans").alias("spans"))
