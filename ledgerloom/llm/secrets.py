"""Secret scans: fixed patterns, and tokens too random to be text.

Tokens of a length are taken for text until a battery of tests says otherwise. Three tests
compare the token with a text in its inferred encoding: how often it changes between cases,
digits and signs (runs), whether a vowel follows a consonant (serial), and which letters it
has (uniformity). Each is a ratio of likelihoods, random over text, given what the tests
before it have seen; so their product is one too, and its inverse is a p-value that text has
with no greater chance than its size (Markov's inequality), at any length. Discoveries are
made within bands of equal length, by the false-discovery rule over all distinct tokens of
the corpus, so that long tokens do not carry short ones. A discovery must also pass as random
over the alphabet of its encoding: chi-squared, runs and serial correlation.

Places come from SQL alone: what a pattern matches and what lies between the matches have
lengths, and these add up.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, staged, whole_text

# Fixed patterns of the contract. A run that is too short holds no longer match, so where
# only the length of the whole match counts it is part of the pattern.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

# Tokens the battery looks at: whole runs of the characters of common encodings.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
# By encoding: pattern and alphabet. The first that fits is the one.
ENCODINGS = (
    ("^[0-9a-fA-F]+$", "0123456789abcdef"),
    ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[A-Za-z0-9]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"))
# Text, by class of characters: what follows a lower-case letter, an upper-case letter, a
# digit, a sign, and what comes first. Of classes that an encoding lacks, the rest take the share.
CLASSES = "LUDS"
FOLLOWS = {"L": (0.90, 0.03, 0.03, 0.04), "U": (0.45, 0.45, 0.03, 0.07), "D": (0.06, 0.06, 0.78, 0.10),
           "S": (0.55, 0.15, 0.20, 0.10), "": (0.50, 0.20, 0.20, 0.10)}
# Per mille of letters in texts of English, German, Spanish and French; shares of vowels after
# a vowel, after a consonant and after what is no letter.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (
    87, 14, 34, 47, 140, 14, 19, 30, 68, 4, 6, 45, 28, 76, 61, 19, 6, 66, 74, 68, 43, 12, 11, 4, 8, 5)))
VOWELS = "aeiou"
VOWEL_AFTER = (0.15, 0.50, 0.40)
# Share of false discoveries within a band, and the largest deviation of the other tests.
FALSE_SHARE = 0.01
DEVIATIONS = 3.3
# Steps of the p-value's logarithm in which discoveries are counted.
P_STEPS, MOST_STEPS = 10, 600


def _matches(kind: int, pattern: str, ok=None, token: bool = False) -> Column:
    """Of each match: kind, length of what lies before it, its length, and whether it counts."""
    text = F.col("text")
    hit = text.rlike(pattern)
    found = F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.when(hit, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
    return F.zip_with(found, between, lambda m, g: F.struct(
        F.lit(kind).alias("kind"), F.length(g).alias("gap"), F.length(m).alias("size"),
        (F.lit(True) if ok is None else ok(m)).alias("ok"), (m if token else F.lit(None).cast("string")).alias("token")))


def matched(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, and what the patterns match in them, in order."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE
    rows = docs.select("doc_id", whole_text().alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", _matches(0, ASSIGN, value).alias("m0"),
        _matches(1, ACCESS).alias("m1"), _matches(2, HEX).alias("m2"), _matches(3, TOKEN, token=True).alias("m3"))
    return staged(rows, "secret-matches")


def places(rows: DataFrame) -> DataFrame:
    """``row``, ``kind``, ``start``, ``end`` and ``token`` of the matches that count."""
    each = None
    for k in range(len(KINDS)):
        taken = rows.select("row", F.posexplode(f"m{k}").alias("pos", "m")).select("row", "pos", "m.*")
        each = taken if each is None else each.unionByName(taken)
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far)
    return (each.withColumn("end", end).filter("ok AND size IS NOT NULL")
            .select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "token"))


def _kind(c: str) -> str:
    """Class of a character, and whether it is a vowel."""
    if not c.isalpha():
        return "D" if c.isdigit() else "S"
    return ("U" if c.isupper() else "L") + ("v" if c.lower() in VOWELS else "c")


KINDS_OF = ("", "Lv", "Lc", "Uv", "Uc", "D", "S")


def _text_chance(alphabet: str, last: str, c: str) -> float:
    """Chance of a character after one of a kind in a text that has only this alphabet."""
    kind = _kind(c)
    present = {_kind(x)[0] for x in alphabet}
    follows = FOLLOWS[last[:1]]
    among = sum(f for k, f in zip(CLASSES, follows) if k in present)
    chance = follows[CLASSES.index(kind[0])] / among
    same = [x for x in alphabet if _kind(x)[0] == kind[0]]
    if kind[0] not in "LU":
        return chance / len(same)
    alike = sum(LETTERS[x.lower()] for x in same if _kind(x) == kind)
    vowel = VOWEL_AFTER[0 if last[1:] == "v" else 1 if last[1:] == "c" else 2]
    if len(same) < len(LETTERS):  # without most letters, vowels and consonants do not alternate
        vowel = sum(LETTERS[x] for x in same if x in VOWELS) / sum(LETTERS[x] for x in same)
    return chance * (vowel if kind[1] == "v" else 1 - vowel) * LETTERS[c.lower()] / alike


def _ratios(alphabet: str) -> list:
    """Log-likelihood ratios, random over text, of each character after each kind. The first
    of a row is for characters outside the alphabet, which count as signs."""
    rows = []
    for last in KINDS_OF:
        known = [-log(len(alphabet) * _text_chance(alphabet, last, c)) for c in alphabet]
        rows += [known[alphabet.index("-")] if "-" in alphabet else 0.0] + known
    return rows


def _doubles(values) -> str:
    return f"array({', '.join(f'{v:.9f}D' for v in values)})"


RATIOS = f"array({', '.join(_doubles(_ratios(a)) for _, a in ENCODINGS)})"
KIND_AT = "array({})".format(", ".join("array({})".format(
    ", ".join(str(KINDS_OF.index(k)) for k in ["S", *map(_kind, a)])) for _, a in ENCODINGS))


def battery(tokens: DataFrame) -> DataFrame:
    """Statistics of distinct tokens: encoding, length, p-value of all three tests against text,
    and deviations from randomness over the encoding's alphabet by three tests."""
    encoding = F.lit(len(ENCODINGS) - 1)
    alphabet = F.lit(ENCODINGS[-1][1])
    for k in range(len(ENCODINGS) - 2, -1, -1):
        fits = F.col("token").rlike(ENCODINGS[k][0])
        encoding = F.when(fits, F.lit(k)).otherwise(encoding)
        alphabet = F.when(fits, F.lit(ENCODINGS[k][1])).otherwise(alphabet)
    body = F.rtrim("token", F.lit("="))
    body = F.when(F.col("token").rlike(ENCODINGS[0][0]), F.lower(body)).otherwise(body)
    shaped = tokens.select("token", encoding.alias("encoding"), alphabet.alias("alphabet"), body.alias("body")).filter(
        F.length("body") >= 8).select("*", F.greatest(F.length("body"), F.lit(2)).cast("double").alias("n"),
                                      F.length("alphabet").cast("double").alias("size"))
    coded = shaped.select("*", F.expr(
        "transform(filter(split(body, ''), c -> c <> ''), c -> cast(locate(c, alphabet) AS double))").alias("x"))
    # Equal pairs: in sorted order, the k-th of equal characters closes k - 1 of them.
    pairs = ("aggregate(array_sort(x), struct(-1D AS last, 0D AS run, 0D AS pairs), (s, c) -> struct(c AS last, "
             "if(c = s.last, s.run + 1D, 0D) AS run, s.pairs + if(c = s.last, s.run + 1D, 0D) AS pairs), s -> s.pairs)")
    ratio = (f"aggregate(x, struct(0 AS last, 0D AS sum), (s, c) -> struct({KIND_AT}[encoding][cast(c AS int)] AS last, "
             f"s.sum + {RATIOS}[encoding][s.last * (cast(size AS int) + 1) + cast(c AS int)] AS sum), s -> s.sum)")
    mean = "(aggregate(x, 0D, (s, c) -> s + c) / n)"
    first = coded.select("*", F.expr(pairs).alias("equal"), F.expr(mean).alias("mean"), F.expr(ratio).alias("ratio"), F.expr(
        "aggregate(x, 0D, (s, c) -> s + if(c > size / 2, 1D, 0D))").alias("upper"))
    runs = "aggregate(zip_with(x, slice(x, 2, size(x)), (a, b) -> if((a > size / 2) <> (b > size / 2), 1D, 0D)), 1D, (s, c) -> s + coalesce(c, 0D))"
    products = "aggregate(zip_with(x, slice(x, 2, size(x)), (a, b) -> (a - mean) * (b - mean)), 0D, (s, c) -> s + coalesce(c, 0D))"
    squares = "aggregate(x, 0D, (s, c) -> s + (c - mean) * (c - mean))"
    second = first.select("*", F.expr(runs).alias("runs"), F.expr(products).alias("products"), F.expr(squares).alias("squares"))
    n, equal = F.col("n"), F.col("equal")
    k = F.col("size")
    chi = k / n * (2 * equal + n) - n
    lower = n - F.col("upper")
    expected = 2 * F.col("upper") * lower / n + 1
    runs_spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    return second.select(
        "token", "encoding", n.cast("int").alias("n"), F.exp(-F.greatest("ratio", F.lit(0.0))).alias("p"),
        ((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("z_uniform"),
        ((F.col("runs") - expected) / runs_spread).alias("z_runs"),
        F.when(F.col("squares") > 0, F.col("products") / F.col("squares") * F.sqrt(n)).otherwise(n).alias("z_serial"))


def discovered(tested: DataFrame) -> DataFrame:
    """Tokens whose p-value the false-discovery rule accepts within their encoding and length
    band, and that no test of randomness rejects.

    The rule needs only how many tokens a band has in each step of the p-value: a table of a
    fixed size.
    """
    step = F.least(F.lit(MOST_STEPS), F.floor(-F.ln(F.greatest(F.col("p"), F.lit(1e-300))) * P_STEPS)).cast("int")
    banded = tested.withColumn("band", F.floor(F.log2("n") * 2).cast("int")).withColumn("step", step)
    counts = banded.groupBy("encoding", "band", "step").agg(F.count(F.lit(1)).alias("c"))
    band = Window.partitionBy("encoding", "band")
    smaller = F.sum("c").over(band.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))
    # The largest p of a step stands for all of its tokens, so none is accepted too easily.
    accepted = (counts.select("encoding", "band", "step", smaller.alias("rank"), F.sum("c").over(band).alias("all"))
                .filter(F.exp(-F.col("step") / P_STEPS) <= F.col("rank") / F.col("all") * FALSE_SHARE)
                .groupBy("encoding", "band").agg(F.min("step").alias("least")))
    random = [F.abs(c) <= DEVIATIONS for c in ("z_runs", "z_serial")] + [F.col("z_uniform") <= DEVIATIONS]
    passed = banded.join(F.broadcast(accepted), ["encoding", "band"]).filter(F.col("step") >= F.col("least"))
    for test in random:
        passed = passed.filter(test)
    return passed.select("token")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(F.sort_array(spans), lambda s: F.concat(
        F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: numbers of base spans by kind, their digest, and all spans.

    A null text is empty and has none. Repeated rows and null ids stay, each with its own
    spans; columns besides ``doc_id`` and ``text`` are not read; an empty table gives no rows.
    Spans are in code points, the end exclusive, ordered by start and then kind.
    """
    rows = matched(docs)
    found = staged(places(rows), "secret-places")
    tokens = found.filter("kind = 3").select("token").distinct()
    secret = staged(discovered(battery(tokens)), "secret-tokens")
    random = found.filter("kind = 3").join(secret, "token").select("row", "kind", "start", "end")
    spans = found.filter("kind < 3").select("row", "kind", "start", "end").unionByName(random)
    span = F.struct("start", "kind", "end")
    grouped = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.collect_list(F.when(F.col("kind") < 3, span)).alias("base"), F.collect_list(span).alias("every"))
    joined = rows.select("row", "doc_id").join(grouped, "row", "left")
    number = [F.coalesce(f"n_{name}", F.lit(0)).cast("bigint").alias(f"n_{name}") for name in KINDS[:3]]
    text = lambda c: F.coalesce(_listed(F.col(c)), F.lit(""))
    return joined.select("doc_id", *number, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("every").alias("spans"))


def op9_secret_scan(spark, sf_dir):
    return scanned(documents(spark, sf_dir))
