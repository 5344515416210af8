"""Secret scan: three patterns, and a battery of randomness tests for what no pattern names.

Base spans come from the patterns `assign`, `access` and `hex`. The battery
takes long unbroken tokens, infers the encoding of each (hex, base32, one-case
base36, base64), and asks how well a uniformly random string of that encoding
explains it: chi-squared uniformity over the alphabet and over its character
classes, a runs test about the alphabet's middle and the lag-one serial
correlation, combined as the smallest p-value of four (Sidak). Random strings
give uniform p-values, words give values near zero. False discoveries are held
down per encoding and length class: Storey's estimate from the upper half of
the p-values gives the number of truly random tokens, and the lowest threshold
is taken at which the estimated share of others stays under `max_fdr`. The
p-values are counted over the whole corpus in a histogram of fixed size.

Only built-in expressions are used. The spans of a row are found in the row;
nothing but the histogram is shuffled.

Defined results for unusual input: a null or empty text has no spans; a very
long text is scanned whole; spans that begin together are in the order of their
kinds; an empty table gives an empty result; repeated rows give repeated rows and
count in the histogram as often; null ids are kept; only the id and text columns
are read, whatever others are named. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

#: The base patterns, which group must be how long.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets of the encodings, in order of their numbers; each begins with its larger character class.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128)
BINS = 50
MAX_FDR = 0.1
LEAST_P = 0.02
_CHUNK = 256


def _sums(a: Column) -> Column:
    """0 and the running sums of a short array."""
    return F.aggregate(a, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def _starts(a: Column) -> Column:
    """For each element of an array of ints, the sum of those before it; in chunks, so that long arrays stay linear."""

    def chunked(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")), lambda c: F.slice(v, c * _CHUNK + 1, _CHUNK))

        def shifted(cs: Column) -> Column:
            offsets = _sums(F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)))
            return let(offsets, lambda o: F.flatten(F.transform(cs, lambda c, i: F.transform(F.slice(_sums(c), 1, F.size(c)), lambda x: x + F.get(o, i)))))

        return let(chunks, shifted)

    return let(a, chunked)


def _found(text: Column, pattern: str) -> Column:
    """Structs (start, end, token) of the leftmost non-overlapping matches: what split leaves between them gives their places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def placed(m: Column) -> Column:
        widths = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, t: g + F.length(t))
        return F.zip_with(_starts(widths), let(gaps, lambda g: F.zip_with(F.slice(g, 1, F.size(m)), m, lambda x, t: F.struct(x.alias("g"), t.alias("t")))), lambda s, x: F.struct((s + x["g"]).alias("start"), (s + x["g"] + F.length(x["t"])).alias("end"), x["t"].alias("token")))

    return let(matches, placed)


_SPAN = "array<struct<start:int,k:int,end:int>>"
_CANDIDATE = "array<struct<start:int,end:int,class:int,p:double>>"


def _spans(text: Column, pattern: str, k: int) -> Column:
    found = _found(text, pattern)
    if KINDS[k] == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        found = F.filter(F.zip_with(found, values, lambda f, v: F.struct(f["start"].alias("start"), f["end"].alias("end"), v.alias("token"))), lambda f: F.length(f["token"]) >= MIN_ASSIGN)
    plain = F.transform(found, lambda f: F.struct(f["start"].alias("start"), F.lit(k).alias("k"), f["end"].alias("end")))
    return F.when(text.rlike(pattern), plain.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _upper(z: Column) -> Column:
    """P(Z > z) for a standard normal Z (a rational approximation good to 7 digits)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _chi_upper(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared by Wilson and Hilferty's cube root."""
    v = 2 / (9 * df)
    return _upper((F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v))


def _by_encoding(e: Column, values) -> Column:
    out = F.when(e == 0, F.lit(values[0]))
    for k, v in enumerate(values[1:], 1):
        out = out.when(e == k, F.lit(v))
    return out


def _encoded(token: Column) -> Column:
    """Struct (e, s): the number of the inferred encoding, and the token as its alphabet spells it."""
    bare = F.rtrim(F.regexp_replace(token, "=+$", ""))
    e = F.when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 0).when(bare.rlike("^[A-Z2-7]+$"), 1).when(bare.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), 2).otherwise(3)
    return let(e, lambda k: F.struct(k.alias("e"), F.when((k == 0) | (k == 2), F.lower(bare)).when(k == 1, bare).otherwise(F.translate(bare, "-_", "+/")).alias("s")))


def p_random(token: Column) -> Column:
    """Struct (class, p): encoding and length class, and the battery's p-value for the token being uniformly random."""

    def tested(x: Column) -> Column:
        e, s = x["e"], x["s"]
        n = F.length(s).cast("double")
        a = _by_encoding(e, [float(len(v)) for v in ALPHABETS])
        alphabet = _by_encoding(e, list(ALPHABETS))
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda t, c: t + F.when(c == "", F.lit(0.0)).otherwise(F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0))))
        symbols = squares * a / n - n
        # Of the class that comes first in the alphabet: its share, and how many are there.
        share = _by_encoding(e, [10 / 16, 26 / 32, 26 / 36, 26 / 64])
        first = (F.length(s) - F.length(F.regexp_replace(s, _by_encoding(e, ["[0-9]", "[A-Z]", "[a-z]", "[A-Z]"]), F.lit("")))).cast("double")
        digits = (F.length(s) - F.length(F.regexp_replace(s, "[0-9]", ""))).cast("double")
        two = lambda got, q: F.pow(got - n * q, F.lit(2.0)) / (n * q * (1 - q))
        classes = F.when(e == 3, F.greatest(two(first, share), two(digits, F.lit(10 / 64)))).otherwise(two(first, share))
        index = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double"))

        def in_order(v: Column) -> Column:
            middle = (a + 1) / 2
            pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda x, y: F.struct((x > middle).alias("p"), (y > middle).alias("q"), ((x - middle) * (y - middle)).alias("xy")))

            def ordered(z: Column) -> Column:
                runs = F.aggregate(z, F.lit(1.0), lambda t, d: t + F.when(d["p"] != d["q"], 1.0).otherwise(0.0))
                # Each side has half of the alphabet, so neighbours differ in side half the time.
                runs_z = (runs - 1 - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
                variance = (a * a - 1) / 12
                serial_z = F.aggregate(z, F.lit(0.0), lambda t, d: t + d["xy"]) / (variance * F.sqrt(n - 1))
                return F.least(2 * _upper(F.abs(runs_z)), 2 * _upper(F.abs(serial_z)))

            return let(pairs, ordered)

        least = F.least(_chi_upper(symbols, a - 1), 2 * _upper(F.sqrt(classes)), let(index, in_order))
        length_class = sum((n >= v).cast("int") for v in LENGTHS)
        return F.struct((e * 16 + length_class).alias("class"), (1 - F.pow(1 - F.least(F.greatest(least, F.lit(0.0)), F.lit(1.0)), F.lit(4.0))).alias("p"))

    return let(_encoded(token), tested)


def _candidates(text: Column) -> Column:
    found = F.transform(_found(text, TOKEN), lambda f: let(p_random(f["token"]), lambda r: F.struct(f["start"].alias("start"), f["end"].alias("end"), r["class"].alias("class"), r["p"].alias("p"))))
    return F.when(text.rlike(TOKEN), found.cast(_CANDIDATE)).otherwise(F.array().cast(_CANDIDATE))


def thresholds(histogram: list[tuple[int, int, int]], max_fdr: float = MAX_FDR) -> dict[int, float]:
    """(class, bin, count) -> the least p to flag in each class; classes that cannot reach max_fdr are left out."""
    by_class: dict[int, list[int]] = {}
    for c, b, n in histogram:
        by_class.setdefault(c, [0] * BINS)[min(b, BINS - 1)] += n
    out = {}
    for c, bins in sorted(by_class.items()):
        random = 2 * sum(bins[BINS // 2 :])
        for b in range(int(LEAST_P * BINS), BINS // 2 + 1):
            above = sum(bins[b:])
            if above and random and 1 - random * (1 - b / BINS) / above <= max_fdr:
                out[c] = b / BINS
                break
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fdr: float = MAX_FDR) -> DataFrame:
    """id and spans: all spans of each row as structs (start, k, end) by start and kind; k counts KINDS from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), text.alias("_t"))
    t = F.col("_t")
    first = rows.select(id_col, F.concat(_spans(t, ASSIGN, 0), _spans(t, ACCESS, 1), _spans(t, HEX, 2)).alias("base"), _candidates(t).alias("maybe"))
    first = materialize(first, "secret-spans")
    counted = first.select(F.explode("maybe").alias("m")).groupBy(F.col("m.class").alias("c"), F.floor(F.col("m.p") * BINS).cast("int").alias("b")).count()
    least = thresholds([tuple(r) for r in counted.collect()], max_fdr)  # at most 4 x 9 x 51 rows
    keep = lambda m: F.lit(False)
    if least:
        limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
        keep = lambda m: F.coalesce(m["p"] >= F.element_at(limit, m["class"]), F.lit(False))
    added = F.filter("maybe", lambda m: keep(m) & ~F.exists("base", lambda s: (s["start"] <= m["start"]) & (s["end"] >= m["end"])))
    added = F.transform(added, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("k"), m["end"].alias("end"))).cast(_SPAN)
    return first.select(id_col, F.sort_array(F.concat("base", added)).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
