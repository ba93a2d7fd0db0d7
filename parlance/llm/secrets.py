r"""Secret scans: three fixed patterns, and a battery of randomness tests for everything else.

Candidates of the battery are runs of 20 and more characters of common text
encodings, whatever stands before and after them.  The narrowest alphabet that a run fits is its encoding.  Three tests
ask whether the run looks like uniform random symbols of that alphabet: a
chi-squared test of the symbols' counts, a Wald-Wolfowitz test of runs in the
lower and upper half, and a test of the correlation of neighbours; Fisher's
method combines their p-values.  A random run has a uniform p-value, ordinary
text a small one.

Runs are pooled over all documents by encoding and length, since short runs of
text often pass for random ones and long ones hardly do.  In each pool the
uniform part is estimated from the histogram of p-values, what is above it at a
threshold counts as false, and the smallest threshold with a false share of at
most ``FALSE_SHARE`` is taken; a pool without one adds nothing.

Only built-in functions are used: places are running sums over the pieces between
the matches, and overlaps are found by bisection, so a text with n matches costs
n log n steps.  The histogram has one row for each encoding, length class and bin,
whatever the input, and is gathered with map-side sums; the thresholds, one for
each pool, become a literal of the last step.

Defined results: a null or empty text has no spans, and base_sha256 is that of
the empty string; texts are scanned whole; a candidate that overlaps a base span
adds nothing; repeated rows give repeated rows, and each counts; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import durable, spread, text_of

#: Kind, pattern, group whose length counts, least length.  Runs that are too short are left out in the
#: pattern where that finds the same places.
BASE = (
    ("assign", r"""(?=[pPsStTaA])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KIND = "random"
#: Runs that the battery looks at, and the alphabets of encodings, narrowest first, with the pattern of what fits.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", r"[0-9a-f]+", DIGITS + "abcdef"),
    ("HEX", r"[0-9A-F]+", DIGITS + "ABCDEF"),
    ("base32", r"[A-Z2-7]+", UPPER + "234567"),
    ("base36", r"[0-9a-z]+", DIGITS + LOWER),
    ("base62", r"[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("base64", r"[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_"),
)
#: Share of false discoveries in a pool, thresholds that are tried, and bins of the histogram of p-values.
FALSE_SHARE, BINS = 0.1, 20
FIRST_BIN = 1  # p below 1 / BINS never counts as random
#: Characters of a run that are an array at a time.
PIECE = 1024


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine) -> Column:
    """The running result of an associative combine(before, x) over a non-empty array, by doubling steps: n log n in all."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, combine(F.get(acc, i - back), x)).otherwise(x))

    return F.aggregate(steps, values, step)


def places(text: Column, pattern: str, group: int) -> Column:
    """array of (first, last, value) of the matches, in code points, last exclusive.

    Lengths of the pieces before the matches are summed up; group 0 is the whole match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    lengths = F.zip_with(before, whole, lambda a, b: F.length(a) + F.length(b))
    parts = F.arrays_zip(running(lengths, lambda a, b: a + b).alias("last"), whole.alias("whole"), value.alias("value"))
    found = F.transform(parts, lambda x: F.struct((x["last"] - F.length(x["whole"])).alias("first"), x["last"].alias("last"), x["value"].alias("value")))
    return F.when(F.size(whole) > 0, found).otherwise(F.expr("CAST(array() AS array<struct<first:int,last:int,value:string>>)"))


def apart(runs: Column, spans: Column) -> Column:
    """The runs that no span overlaps; spans are sorted by first.

    A run meets a span if the last ends of those that begin before its end reaches into it; how many these are is found by bisection.
    """
    ends = running(F.transform(spans, lambda y: y["last"]), lambda a, b: F.greatest(a, b))

    def free(x: Column, spans: Column, ends: Column) -> Column:
        def halve(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
            before = F.get(spans, middle)["first"] < x["last"]
            open_ = acc["low"] < acc["high"]
            return F.struct(F.when(open_ & before, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~before, middle).otherwise(acc["high"]).alias("high"))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans).cast("double"))).cast("int"))
        found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda acc: acc["low"])
        return (found == 0) | (F.get(ends, found - 1) <= x["first"])

    # spans and their running ends are computed once a text, then looked up for each run
    kept = let(F.struct(spans.alias("spans"), ends.alias("ends")), lambda b: F.filter(runs, lambda x: free(x, b["spans"], b["ends"])))
    return F.when((F.size(spans) == 0) | (F.size(runs) == 0), runs).otherwise(kept)


def long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda x: F.length(x["value"]) >= least)


def as_spans(found: Column, order: int, kind: str) -> Column:
    """Places as (first, order, last, kind), which sort as spans are listed."""
    return F.transform(found, lambda x: F.struct(x["first"].alias("first"), F.lit(order).alias("order"), x["last"].alias("last"), F.lit(kind).alias("kind")))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable, by a logistic approximation good to 0.0002."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(value: Column, alphabet: Column) -> Column:
    """The combined p-value of a run as uniform random symbols of an alphabet.

    Symbols are counted by what is left without each, and neighbours are multiplied
    in pieces, so a run of any length costs its own bytes and no array of its symbols.
    """
    m, n = F.length(alphabet).cast("double"), F.octet_length(value).cast("double")
    centre = lambda c: F.instr(alphabet, c).cast("double") - (m + 1) / 2
    counted = F.transform(F.split(alphabet, ""), lambda c: F.struct((n - F.octet_length(F.replace(value, c, F.lit("")))).alias("n"), centre(c).alias("x")))
    sums = F.aggregate(
        counted,
        F.struct(*[F.lit(0.0).alias(k) for k in ("nn", "x", "xx")]),
        lambda s, c: F.struct((s["nn"] + c["n"] * c["n"]).alias("nn"), (s["x"] + c["n"] * c["x"]).alias("x"), (s["xx"] + c["n"] * c["x"] * c["x"]).alias("xx")),
    )

    def products(acc: Column, piece: Column) -> Column:
        """The last symbol so far, and the sum of the products of neighbours."""
        one = lambda s, c: F.struct(centre(c).alias("last"), (s["sum"] + s["last"] * centre(c)).alias("sum"))
        return F.aggregate(F.split(piece, ""), acc, one)

    pieces = F.regexp_extract_all(value, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    multiplied = F.aggregate(pieces, F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum")), products)
    lower = F.ceil(m / 2).cast("int")
    halves = F.call_function("translate", value, alphabet, F.concat(F.repeat(F.lit("0"), lower), F.repeat(F.lit("1"), m.cast("int") - lower)))
    turns = lambda h: F.regexp_count(h, F.lit("01")) + F.regexp_count(h, F.lit("10"))
    upper = lambda h: n - F.octet_length(F.replace(h, F.lit("1"), F.lit("")))
    ones = let(halves, lambda h: F.struct((n - upper(h)).alias("lower"), upper(h).alias("upper"), turns(h).alias("turns")))
    known = F.struct(n.alias("n"), m.alias("m"), sums.alias("s"), multiplied.alias("p"), ones.alias("h"), centre(F.left(value, F.lit(1))).alias("first"))
    return let(let(known, tests), lambda q: F.exp(-q) * (1 + q + q * q / 2))


def tests(v: Column) -> Column:
    """Minus the logarithm of the product of the three p-values, from the sums over a run."""
    n, m = v["n"], v["m"]
    chi, df = v["s"]["nn"] * m / n - n, m - 1
    z1 = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    mean = 2 * v["h"]["upper"] * v["h"]["lower"] / n + 1
    z2 = (1 + v["h"]["turns"] - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    middle = v["s"]["x"] / n
    square = F.greatest(v["s"]["xx"] - n * middle * middle, F.lit(1e-9))
    neighbours = v["p"]["sum"] - middle * (2 * v["s"]["x"] - v["first"] - v["p"]["last"]) + (n - 1) * middle * middle
    z3 = (neighbours / square + 1 / n) * F.sqrt(n)
    return -reduce(lambda a, b: a + b, [F.log(F.least(F.lit(1.0), q)) for q in (upper_tail(z1), 2 * upper_tail(F.abs(z2)), 2 * upper_tail(F.abs(z3)))])


def judged(runs: Column) -> Column:
    """(first, last, pool, p) of each candidate; pool joins its encoding and length class.  A run that fits no encoding goes."""
    which = lambda x: F.coalesce(*[F.when(x["value"].rlike(f"^{fits}$"), F.lit(k)) for k, (_, fits, _) in enumerate(ENCODINGS)])
    known = F.transform(runs, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["value"].alias("value"), which(x).alias("which")))
    names, alphabets = (F.array(*[F.lit(e[k]) for e in ENCODINGS]) for k in (0, 2))
    length = lambda x: F.floor(2 * F.log2(F.length(x["value"]).cast("double"))).cast("string")
    return F.transform(
        F.filter(known, lambda x: x["which"].isNotNull()),
        lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), F.concat_ws(":", F.get(names, x["which"]), length(x)).alias("pool"), battery(x["value"], F.get(alphabets, x["which"])).alias("p")),
    )


def thresholds(pools: DataFrame) -> DataFrame:
    """pool, least_p: from the counts of p-values by pool and bin."""
    by_bin = pools.groupBy("pool").agg(*[F.sum(F.when(F.col("bin") >= b, F.col("n")).otherwise(0)).alias(f"n{b}") for b in range(FIRST_BIN, BINS)])
    uniform = F.least(*[F.col(f"n{b}") / (1 - b / BINS) for b in range(FIRST_BIN, BINS // 2 + 1)])
    out = by_bin.withColumn("uniform", uniform)
    tried = [F.when((F.col(f"n{b}") > 0) & (F.col(f"n{b}") - F.col("uniform") * (1 - b / BINS) <= FALSE_SHARE * F.col(f"n{b}")), F.lit(b / BINS)) for b in range(FIRST_BIN, BINS // 2 + 1)]
    return out.select("pool", F.coalesce(*tried).alias("least_p")).where("least_p IS NOT NULL")


def scans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs."""
    text = F.col("text")
    rows = spread(docs.select("doc_id", text_of("text").alias("text")))
    for kind, pattern, group, least in BASE:
        rows = rows.withColumn(kind, long_enough(places(text, pattern, group), least))
    rows = rows.withColumn("run", places(text, RUN, 0))
    spans = [as_spans(F.col(kind), k, kind) for k, (kind, *_) in enumerate(BASE)]
    rows = rows.select("doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE], F.array_sort(F.concat(*spans)).alias("base"), "run")
    rows = durable(rows.withColumn("run", judged(apart(F.col("run"), F.col("base")))))

    each = rows.select(F.explode("run").alias("x")).select("x.pool", F.least(F.floor(F.col("x.p") * BINS), F.lit(BINS - 1)).alias("bin"))
    least = thresholds(each.groupBy("pool", "bin").agg(F.count("*").alias("n")))
    # one for each encoding and length class: a few hundred at most
    found = sorted((r["pool"], r["least_p"]) for r in least.collect())
    table = F.map_from_arrays(F.array(*[F.lit(pool) for pool, _ in found]).cast("array<string>"), F.array(*[F.lit(p) for _, p in found]).cast("array<double>"))
    good = F.filter("run", lambda x: F.coalesce(x["p"] >= F.try_element_at(table, x["pool"]), F.lit(False)))
    added = as_spans(good, len(BASE), KIND)
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))), ",")
    return rows.select("doc_id", *[f"n_{kind}" for kind, *_ in BASE], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", added))).alias("spans"))
