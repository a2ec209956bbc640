"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens. DataFrame functions only.

Positions of all matches of a pattern come from splitting by it: the pieces' and the matches' lengths add up.

A candidate is a run of letters, digits and + / _ - of ``TOKEN_LEAST`` characters or more. Its encoding is the smallest
alphabet that holds it. Three tests ask whether it may be random over that alphabet: chi-squared of the symbol counts,
runs above and below the middle, and lag-1 serial correlation; the least p-value counts, times three. The null
hypothesis of the false-discovery control is prose: symbol counts as uneven as letters are in words, whose chi-squared
grows with length. In small alphabets that tells little, so digits and letters count too: a run of hexadecimal digits with
letters and decimal digits has the probability that word text stays within them; elsewhere the changes between small
letters, capitals and digits have their binomial tail, joined to the chi-squared's p-value by Fisher's method. Benjamini-Hochberg over the p-values of all candidates of the corpus, by length class, says which
are discoveries. A candidate that is one, passes the battery and touches no base span is a span of kind ``random``.

Texts are read once: what the corpus says about its candidates is worked out over a stored table of matches.

Bounds and what they change: p-values below 1e-60 share the last bin of the false-discovery control, which any corpus of
fewer than 1e57 candidates accepts in either case; candidates of 1,024 characters or more share a length class, so they
are held against one another.

Null and empty texts hold nothing. Equal rows are all returned. No documents give no rows. A text of n matches costs n to
the power 1.5 for their places, whatever its length. Other columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import stored

# The base patterns, and which group must have how many characters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN_LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{TOKEN_LEAST},}}"
#: Least battery p-value of a token that counts as random, and the share of false discoveries allowed.
BATTERY_LEAST, FALSE_SHARE = 0.001, 0.001
#: Sum of squares of letter frequencies in prose, as in English (the index of coincidence).
PROSE_COINCIDENCE = 0.066
#: Share of word text's characters within hexadecimal digits; chance of a change of character kind in word text without and with both cases.
PROSE_HEX, PROSE_CHANGE, PROSE_CASE_CHANGE = 0.34, 0.03, 1.0 / 3
CHANGE = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
#: name, pattern, symbols in order
ALPHABETS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
P_BINS, P_STEP = 240, 4.0

Spans = Column


def named(c: Column, use) -> Column:
    """use(c) with c worked out once: a one-element array names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def spans(text: Column, pattern: str, kind: int, wanted=lambda match: F.lit(True)) -> Spans:
    """array<struct<start,kind,stop,match>> of the leftmost non-overlapping matches.

    A running sum over an array copies what it has so far at each step, so it is taken in blocks of about the square root
    of the matches: over the blocks' sums, then within each block.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("match")))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,match:string>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        stop = start + F.char_length(part["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), part["match"].alias("match"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def blocks(all_parts: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_parts).cast("double"))).cast("int"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_parts)), width), lambda at: F.slice(all_parts, at, width))

    def placed(own: Column) -> Column:
        length = lambda b: F.aggregate(b, F.lit(0), lambda acc, p: acc + p["gap"] + F.char_length(p["match"]))
        starts = F.aggregate(
            own,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, b: F.struct((s["at"] + length(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        )["out"]
        fold = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step)["out"]
        return F.flatten(F.zip_with(own, starts, fold))

    all_ = named(parts, lambda p: named(blocks(p), placed))
    return F.when(text.rlike(pattern), F.filter(all_, lambda s: wanted(s["match"]))).otherwise(empty)


def base_spans(text: Column) -> list[Spans]:
    """Of each kind, in order of their starts."""
    return [spans(text, ASSIGN, 0, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8), spans(text, ACCESS, 1), spans(text, HEX, 2)]


def touched(span: Column, others: Spans) -> Column:
    """Whether one of the others, in order and apart from one another, overlaps the span: the last that starts before its end."""
    bounds = F.struct(F.lit(0).alias("lo"), F.size(others).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(others, mid)["start"] < span["stop"])
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(others) + 1.0)).cast("int"))
    before = F.aggregate(steps, bounds, halve)["lo"] - 1
    return (F.size(others) > 0) & F.coalesce(F.get(others, before)["stop"] > span["start"], F.lit(False))


def upper_tail(z: Column) -> Column:
    """Probability that a standard normal exceeds z, to about 12 digits of itself at any z.

    From 2.5 on by the continued fraction of Mills' ratio, below by the series around 0; of negative z by symmetry.
    """
    x = F.least(F.lit(37.0), F.abs(z))
    density = F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
    ratio = F.aggregate(F.sequence(F.lit(48), F.lit(1), F.lit(-1)), x + 0.0, lambda acc, k: x + k.cast("double") / acc)
    start = F.struct(x.alias("term"), x.alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * x * x / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    middle = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(36)), start, add)["sum"]
    tail = F.when(x >= 2.5, density / ratio).otherwise(middle)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def normal_cdf(z: Column) -> Column:
    return upper_tail(-z)


def two_sided(z: Column) -> Column:
    return 2.0 * upper_tail(F.abs(z))


def alphabet_of(token: Column) -> Column:
    """struct<name, symbols> of the first alphabet that holds the token."""
    as_struct = lambda a: F.struct(F.lit(a[0]).alias("name"), F.lit(a[2]).alias("symbols"))
    out = as_struct(ALPHABETS[-1])
    for a in reversed(ALPHABETS[:-1]):
        out = F.when(token.rlike(a[1]), as_struct(a)).otherwise(out)
    return out


def binomial_tail(k: Column, m: Column, p: Column) -> Column:
    """Probability of k or more of m at p each: the first term by its logarithm, the others by their ratios."""
    from_one = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    first = F.aggregate(from_one(k), F.lit(0.0), lambda acc, i: acc + F.log((m - k + i) / i)) + k * F.log(p) + (m - k) * F.log(1.0 - p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:  # the term of k + i
        term = s["term"] * (m - k - i + 1.0) / (k + i) * p / (1.0 - p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.when(k <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(first) * F.aggregate(from_one(m - k), start, add)["sum"]))


def prose_probability(token: Column, encoding: Column, n: Column, chi2_p: Column) -> Column:
    """Of a token of n characters under word text; base64 and runs without digits have the chi-squared alone."""
    mixed = token.rlike("[A-Za-z]") & token.rlike("[0-9]")
    rate = F.when(token.rlike("[a-z]") & token.rlike("[A-Z]"), PROSE_CASE_CHANGE).otherwise(PROSE_CHANGE)
    seen = F.struct(F.regexp_count(token, F.lit(CHANGE)).cast("int").alias("k"), (n - 1).cast("int").alias("m"), rate.alias("p"))
    changes = named(seen, lambda s: binomial_tail(s["k"], s["m"], s["p"]))
    both = lambda c: F.greatest(F.lit(1e-60), F.greatest(chi2_p, F.lit(1e-60)) * c)
    fisher = named(changes, lambda c: F.least(F.lit(1.0), both(c) * (1.0 - F.log(both(c)))))
    return F.when(mixed & F.lower(encoding).eqNullSafe("hex"), F.least(chi2_p, F.pow(F.lit(PROSE_HEX), n))).when(mixed & (encoding != "base64"),
        fisher).otherwise(chi2_p)


def battery(token: Column) -> Column:
    """struct<encoding, n, chi2_p, runs_p, serial_p, random_p, prose_p> of a token."""

    def with_sums(s: Column) -> Column:  # s: struct<token, alphabet, codes, size, n, mean, above, coincident>
        codes, size, n, mean = s["codes"], s["size"], s["n"], s["mean"]
        chi2 = size / n * s["coincident"] - n
        df = size - 1.0
        spread = 2.0 / (9.0 * df)
        uniform_z = (F.pow(F.greatest(chi2, F.lit(1e-9)) / df, F.lit(1.0 / 3)) - (1.0 - spread)) / F.sqrt(spread)
        start = F.struct(F.element_at(codes, 1).alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("serial"))

        def follow(state: Column, c: Column) -> Column:
            changed = F.abs(high(c, size) - high(state["last"], size))
            product = (state["last"] - mean) * (c - mean)
            return F.struct(c.alias("last"), (state["runs"] + changed).alias("runs"), (state["serial"] + product).alias("serial"))

        square = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + (c - mean) * (c - mean))
        lagged = F.aggregate(F.slice(codes, F.lit(2), F.size(codes) - 1), start, follow)
        values = F.struct(chi2.alias("chi2"), uniform_z.alias("uniform"), square.alias("square"), lagged.alias("lagged"))
        return named(values, lambda v: with_tails(s, v))

    def with_tails(s: Column, v: Column) -> Column:
        size, n, chi2, df = s["size"], s["n"], v["chi2"], s["size"] - 1.0
        both = 2.0 * s["above"] * (n - s["above"])
        runs_sd = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1.0)), F.lit(1e-9)))
        runs_z = (v["lagged"]["runs"] - both / n - 1.0) / runs_sd
        serial_z = v["lagged"]["serial"] / F.greatest(v["square"], F.lit(1e-9)) * F.sqrt(n)
        # prose: symbols as uneven as letters in words; the chi-squared is then non-central and grows with n
        uneven = n * F.greatest(size * PROSE_COINCIDENCE - 1.0, F.lit(0.35))
        prose_z = (chi2 - (df + uneven)) / F.sqrt(2.0 * (df + 2.0 * uneven))
        z = F.struct(v["uniform"].alias("uniform"), runs_z.alias("runs"), serial_z.alias("serial"), prose_z.alias("prose"))

        def tails(z: Column) -> Column:
            runs, serial = two_sided(z["runs"]), two_sided(z["serial"])
            return F.struct(upper_tail(z["uniform"]).alias("chi2"), runs.alias("runs"), serial.alias("serial"), normal_cdf(z["prose"]).alias("prose"))

        def told(p: Column) -> Column:
            random_p = F.least(F.lit(1.0), 3.0 * F.least(p["chi2"], p["runs"], p["serial"]))
            prose_p = prose_probability(s["token"], s["alphabet"]["name"], n, p["prose"])
            single = (p["chi2"].alias("chi2_p"), p["runs"].alias("runs_p"), p["serial"].alias("serial_p"))
            return F.struct(s["alphabet"]["name"].alias("encoding"), n.cast("int").alias("n"), *single, random_p.alias("random_p"), prose_p.alias("prose_p"))

        return named(named(z, tails), told)

    def high(c: Column, size: Column) -> Column:
        return (c.cast("double") >= size / 2).cast("int")

    def with_codes(s: Column) -> Column:  # s: struct<token, alphabet>
        symbols = s["alphabet"]["symbols"]
        codes = F.transform(F.filter(F.split(s["token"], ""), lambda c: c != ""), lambda c: F.call_function("instr", symbols, c) - 1)
        size = F.char_length(symbols).cast("double")
        return F.struct(s["token"].alias("token"), s["alphabet"].alias("alphabet"), size.alias("size"), codes.alias("codes"))

    def with_counts(s: Column) -> Column:  # what the lambdas below use again and again is a field, worked out once
        codes, n = s["codes"], F.size(s["codes"]).cast("double")
        mean = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + c) / n
        above = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + high(c, s["size"]))
        coincident = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, c: acc + F.pow((F.size(codes) - F.size(F.array_remove(codes, c))).cast("double"), F.lit(2.0)))
        more = (n.alias("n"), mean.alias("mean"), above.alias("above"), coincident.alias("coincident"))
        return F.struct(*(s[c].alias(c) for c in ("token", "alphabet", "size", "codes")), *more)

    coded = named(F.struct(token.alias("token"), alphabet_of(token).alias("alphabet")), with_codes)
    return named(named(coded, with_counts), with_sums)


def length_class(n: Column) -> Column:
    return F.least(F.lit(10), F.floor(F.log2(n.cast("double")))).cast("int")


def p_bin(p: Column) -> Column:
    return F.least(F.lit(P_BINS), F.floor(-P_STEP * F.log10(F.greatest(p, F.lit(1e-60))))).cast("int")


def tested(text: Column) -> Column:
    """The candidates' spans with their battery."""
    one = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["match"].alias("match"),
        battery(s["match"]).alias("tests"))
    return F.transform(spans(text, TOKEN, 3), one)


def matched(docs: DataFrame) -> DataFrame:
    """doc_id, the base kinds' spans and the candidates of every document, as a stored table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = [c.alias(k) for c, k in zip(base_spans(text), KINDS, strict=False)]
    return stored(docs.select("doc_id", *base, tested(text).alias("candidates")), "matches")


def discovery_bins(found: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """Per length class the least bin of -log10 p that Benjamini-Hochberg over all candidates accepts.

    What comes to the driver is a count per class and bin: at most 11 x 241 numbers whatever the corpus.
    """
    each = found.select(F.explode("candidates.tests").alias("t"))
    counts = each.groupBy(length_class(F.col("t")["n"]).alias("size"), p_bin(F.col("t")["prose_p"]).alias("bin")).count().collect()
    out = {}
    for size in {r.size for r in counts}:
        own = {r.bin: r["count"] for r in counts if r.size == size}
        total, upto = sum(own.values()), 0
        for b in sorted(own, reverse=True):
            upto += own[b]
            if math.pow(10, -b / P_STEP) <= false_share * upto / total:
                out[size] = b
    return out


def scan(docs: DataFrame, false_share: float = FALSE_SHARE, least: float = BATTERY_LEAST) -> DataFrame:
    """doc_id with ``base`` and ``extra``, arrays of spans (start, kind, stop, match)."""
    found = matched(docs)
    bins = discovery_bins(found, false_share)
    accepted = F.lit(P_BINS + 1)
    wanted = lambda t: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in bins.items() for x in kv)), length_class(t["n"])),
        accepted) if bins else accepted
    fresh = F.filter("candidates", lambda c: (c["tests"]["random_p"] >= least) & (p_bin(c["tests"]["prose_p"]) >= wanted(c["tests"])))
    # few are left now: only these are held against the base spans
    free = F.filter(fresh, lambda c: ~(touched(c, F.col("assign")) | touched(c, F.col("access")) | touched(c, F.col("hex"))))
    extra = F.transform(free,
        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), c["match"].alias("match")))
    return found.select("doc_id", F.concat("assign", "access", "hex").alias("base"), extra.alias("extra"))


def told(spans_: Column) -> Column:
    """kind:start:end of every span by start, then kind."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])
    return F.array_join(F.transform(F.array_sort(spans_), one), ",")


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.concat("base", "extra")).alias("spans"),
    )
