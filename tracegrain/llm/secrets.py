"""Secret scans: known shapes, and a randomness test battery with length-aware false-discovery control."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hof import let, match_spans
from .state import save

# fixed values: the contract's patterns and least lengths
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
# runs of HEX with 16 characters at least are just the matches of HEX that stay; the same holds for ACCESS
ACCESS_LONG, HEX_LONG = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_-]{16,}"
#: Letters and digits, or letters of both cases: letters of one case alone may as well be a long word.
MIXED = "[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|[a-z].*[A-Z]|[A-Z].*[a-z]"
KINDS = ["assign", "access", "hex", "random"]
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the characters they use, the narrowest first; a token's is the first that has all its characters.
ALPHABETS = {
    "hex, capitals": DIGITS + "ABCDEF", "hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base36, small": DIGITS + LOWER,
    "base36, capitals": DIGITS + UPPER, "letters": UPPER + LOWER, "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", "base62": DIGITS + UPPER + LOWER, "base64": DIGITS + UPPER + LOWER + "+/", "base64, url": DIGITS + UPPER + LOWER + "-_",
}
WIDEST = "base64"  # of tokens that mix the signs of both kinds of base64
DASHED = "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Parts of an alphabet: vowels, frequent and other consonants, small and capital; digits; signs. Words fill them unevenly.
VOWELS, FREQUENT = "aeiou", "tnsrhldcm"
PARTS = "vcoVCOds"
Q, FLOOR, HALF = 0.05, 0.01, 14
FINE, LEAST_BUCKET = 20, 2000


def _part(c: str) -> str:
    if c in DIGITS:
        return "d"
    if c.lower() not in LOWER:
        return "s"
    kind = "v" if c.lower() in VOWELS else "c" if c.lower() in FREQUENT else "o"
    return kind if c in LOWER else kind.upper()


SIGNS = DIGITS + UPPER + LOWER + "+/-_"
SHARES = {name: [sum(_part(c) == k for c in signs) / len(signs) for k in PARTS] for name, signs in ALPHABETS.items()}


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution, by a logistic curve that is within 0.0002 of it."""
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return 1 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * x + 0.07056 * x * x * x)))


def _encoding(token: Column) -> Column:
    """The place of the token's inferred encoding in ALPHABETS."""
    out = None
    for i, signs in enumerate(ALPHABETS.values()):
        fits = F.regexp_like(token, F.lit("^[" + signs.replace("-", "\\-") + "]+$"))
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out.otherwise(list(ALPHABETS).index(WIDEST))


def _types(p: list[float]) -> list[float]:
    """Shares of small letters, capitals, digits and signs."""
    return [sum(p[:3]), sum(p[3:6]), p[6], p[7]]


def _vowels(p: list[float]) -> float:
    """The share of vowels among letters."""
    return (p[0] + p[3]) / sum(p[:6])


def randomness(token: Column) -> Column:
    """The p-value that ``token`` is random in its inferred encoding; small for words, names and paths.

    Three tests against an even use of the alphabet: chi-squared over its PARTS; runs of one type (small letters,
    capitals, digits, signs), too many or too few; correlation of vowels and consonants with their neighbours. Fisher's
    method makes one p-value of the three. Dashed groups of hex digits are read without their dashes.
    """
    bare = F.when(F.regexp_like(token, F.lit(DASHED)), F.translate(token, "-", "")).otherwise(token)

    def tests(x: Column) -> Column:
        t = x["t"]
        told = lambda value: F.get(F.array(*[F.lit(float(value(p))) for p in SHARES.values()]), x["e"])
        parts, n = F.translate(t, SIGNS, "".join(map(_part, SIGNS))), F.length(t).cast("double")
        count = lambda k: n - F.length(F.translate(parts, k, ""))
        chi, df = F.lit(0.0), told(lambda p: sum(v > 0 for v in p) - 1)
        for i, k in enumerate(PARTS):
            each = n * told(lambda p, i=i: p[i])
            chi = chi + F.when(each > 0, F.pow(count(k) - each, F.lit(2)) / F.greatest(each, F.lit(1e-9))).otherwise(0.0)
        z1 = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        same = n - F.regexp_count(F.translate(parts, PARTS, "lllUUUds"), F.lit("l+|U+|d+|s+"))
        s2, s3 = told(lambda p: sum(v**2 for v in _types(p))), told(lambda p: sum(v**3 for v in _types(p)))
        var = (n - 1) * s2 * (1 - s2) + 2 * (n - 2) * (s3 - s2 * s2)
        z2 = F.when(var > 1e-9, (same - (n - 1) * s2) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(0.0)
        kinds = F.translate(parts, PARTS, "vnnvnnxx")
        pairs = [F.regexp_count(kinds, F.lit(p)).cast("double") for p in ("v(?=v)", "v(?=n)|n(?=v)", "n(?=n)")]
        pv, all_pairs = told(_vowels), pairs[0] + pairs[1] + pairs[2]
        cross = pairs[0] * (1 - pv) * (1 - pv) - pairs[1] * pv * (1 - pv) + pairs[2] * pv * pv
        z3 = F.when(all_pairs > 0, cross / (F.sqrt(F.greatest(all_pairs, F.lit(1))) * pv * (1 - pv))).otherwise(0.0)
        h = -(F.log(_tail(z1)) + F.log(F.least(F.lit(1.0), 2 * _tail(F.abs(z2)))) + F.log(F.least(F.lit(1.0), 2 * _tail(F.abs(z3)))))
        return let(h, lambda v: F.exp(-v) * (1 + v + v * v / 2))

    return let(let(bare, lambda t: F.struct(t.alias("t"), _encoding(t).alias("e"))), tests)


def base_spans(text: Column) -> Column:
    """(s, kind, e) of the known shapes; kind counts from 0 in the order of KINDS."""

    def named(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda v: F.struct(v["s"].alias("s"), F.lit(kind).alias("kind"), v["e"].alias("e")))

    found = [match_spans(text, ASSIGN, 2, ASSIGN_LEAST), match_spans(text, ACCESS_LONG), match_spans(text, HEX_LONG)]
    return F.sort_array(F.concat(*[named(x, k) for k, x in enumerate(found)]))


def _candidates(text: Column, base: Column) -> Column:
    """Long tokens beside the known shapes that mix kinds of signs, with length class and p-value."""

    def tested(v: Column) -> Column:
        return F.struct(v["s"].alias("s"), v["e"].alias("e"), F.floor(F.log2((v["e"] - v["s"]).cast("double")) * 2).cast("int").alias("size"), randomness(v["t"]).alias("p"))

    free = F.filter(match_spans(text, TOKEN, keep=True), lambda v: F.regexp_like(v["t"], F.lit(MIXED)) & ~F.exists(base, lambda b: (b["s"] < v["e"]) & (v["s"] < b["e"])))
    return F.transform(free, tested)


def _bucket(p: Column) -> Column:
    return F.least(F.lit(LEAST_BUCKET), F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * FINE)).cast("int")


def cuts(counts: dict[tuple[int, int], int], q: float = Q) -> dict[int, int]:
    """Of each length class, the last bucket of p-values whose tokens are reported as random.

    p-values of random tokens are even, those of words are not: nearly all are small. So the number of random tokens
    shows in the upper half of the p-values (the first HALF buckets), and how many of them a cut keeps is known. The
    rest of what it keeps are false discoveries; the cut is the widest, down to a p-value of FLOOR, at which their
    estimated share is ``q`` or less. The estimate gets two standard errors, so that few tokens don't decide it.
    """
    out = {}
    for size in sorted({s for s, _ in counts}):
        upper = sum(n for (s, b), n in counts.items() if s == size and b < HALF)
        random = (upper + 2 * math.sqrt(upper) + 1) / (1 - math.exp(-HALF / FINE))
        kept = 0
        for b in range(int(-math.log(FLOOR) * FINE)):
            kept += counts.get((size, b), 0)
            if kept - random * (1 - math.exp(-(b + 1) / FINE)) <= q * kept:
                out[size] = b
    return out


def _cuts(rows: DataFrame, q: float) -> dict[int, int]:
    """``cuts`` of all candidates: short tokens, which the tests tell apart badly, are never judged by the many long ones.
    p-values are counted in buckets of 1/FINE of a natural log: at most LEAST_BUCKET + 1 counts for each of some 50
    classes come to the driver, whatever the input."""
    counts = rows.select(F.explode("_cands").alias("c")).groupBy(F.col("c.size").alias("size"), _bucket(F.col("c.p")).alias("b")).agg(F.count("*").alias("n"))
    return cuts({(r["size"], r.b): r.n for r in counts.collect()}, q)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda v: F.concat_ws(":", F.get(names, v["kind"]), v["s"].cast("string"), v["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (sorted arrays of s, kind, e) for every row of ``docs`` (doc_id, text).

    A token of 16 characters or more beside the known shapes, not of letters of one case or digits alone, is reported if the tests take it for
    random; of what is so reported in each length class, an estimated share of ``q`` at most isn't. Null and empty texts:
    no spans. Repeated rows each get a row, an empty table gives an empty one, other columns are not looked at. Texts are
    read once, whole; what is stored and counted are spans.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", t.alias("_t"), base_spans(t).alias("base")).select("doc_id", "base", _candidates(F.col("_t"), F.col("base")).alias("_cands"))
    rows = save(rows, "secrets")
    last = _cuts(rows, q)
    held = F.create_map(*[F.lit(x) for kv in last.items() for x in kv]) if last else F.create_map().cast("map<int,int>")
    random = F.filter("_cands", lambda c: _bucket(c["p"]) <= F.coalesce(F.try_element_at(held, c["size"]), F.lit(-1)))
    added = F.transform(random, lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("kind"), c["e"].alias("e")))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """The number of each known shape, the digest of their spans, and all spans as text, for every row of ``docs``. Null
    and empty texts have none; repeated rows each get a row; an empty table gives an empty one. Other columns don't matter, whatever they are called."""
    found = find_secrets(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda v: v["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
