"""Secret scan: fixed patterns and a battery of randomness tests, with built-in functions only.

Three kinds follow fixed patterns (`assign`, `access`, `hex`). A fourth, `random`, takes runs of
token characters that no other span touches, infers their encoding (hex in one case or in both,
base 32, 36, 62 or 64, by the characters they hold), and asks whether they look drawn at random
from its alphabet: a chi-squared test of uniformity, a runs test of lower and upper half, and a
test of the serial correlation of neighbours. Fisher's method combines the three into one p-value.

A key may stand beside words: `/`, `-` and `_` are digits of base 64 and separators as well. So
the runs between slashes, between dashes and underscores, and between all of these are candidates
besides the whole one, and a run that lies in another one found to be random is not reported.
Hex digits of both cases are read as 22 letters and as 16 in one case, and the better one counts.

The chi-squared statistic has the exact variance of a multinomial draw, whatever the expected
count of a cell, and the tail of a gamma distribution with that mean and variance by Wilson and
Hilferty's cube root; normal tails come from a logistic curve whose error is at most 0.00015. The
tests state what share of random runs has a p-value below 0.05, by alphabet and length.

Ordinary text written with the same characters has tiny p-values. Which are too small is settled
over the whole table: the procedure of Benjamini and Hochberg, for every class of length by
itself since short runs carry less evidence, finds the limit under which the expected share of
truly random runs among those turned away stays below `rate`. It counts each different run once,
in a histogram of fixed bins, so what is gathered has a bound. Runs above the limit are secrets.

The text is read twice, once for the limits and once for the spans; only hashes of candidate runs
are shuffled.

Defined results: null and empty text have no span; positions are code points, the end exclusive;
an empty table gives no rows and no limit; repeated rows and runs are treated alike; columns of
the docs with the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The patterns, the kinds in order, and the alphabets of the encodings.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex22": "0123456789abcdefABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
SHORTEST = 20
RUNS = [rf"[{letters}]{{{SHORTEST},}}" for letters in ("A-Za-z0-9+/_-", "A-Za-z0-9+_-", "A-Za-z0-9+/", "A-Za-z0-9")]
CLASSES = (20, 24, 32, 48, 96)  # least lengths
BINS, STEP = 400, 0.125  # of -ln p


def located(text: Column, pattern: str, least: int = 1, group: int = 0) -> Column:
    """Leftmost matches that do not overlap, as structs start, end, value; those whose group is shorter than `least` go."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1)))
    steps = F.zip_with(found, between, lambda v, gap: F.struct(F.length(gap).alias("gap"), v.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        own = x["value"] if not group else F.regexp_extract(x["value"], pattern, group)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(own) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _guarded(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic curve."""
    return _named(F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)), lambda x: 1 / (1 + F.exp(1.5976 * x + 0.07056 * x * x * x)))


def encoding(run: Column) -> Column:
    """Name of the smallest alphabet that holds the run, if it has the kinds of characters that a random run of its length has."""
    has = lambda p: run.rlike(p)
    mixed = has("[0-9]") & has("[A-Za-z]")
    both = has("[a-z]") & has("[A-Z]")
    return (F.when(mixed & (has("^[0-9a-f]+$") | has("^[0-9A-F]+$")), "hex")
            .when(mixed & has("^[0-9A-Fa-f]+$"), "hex22")
            .when(mixed & has("^[A-Z2-7]+$"), "base32")
            .when(mixed & (has("^[0-9a-z]+$") | has("^[0-9A-Z]+$")), "base36")
            .when(mixed & both & has("^[0-9A-Za-z]+$"), "base62")
            .when(mixed & both & ~(has("[+/]") & has("[_-]")), "base64"))


def _named(value: Column, use) -> Column:
    """use(value) with the value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), 0)


def _tested(x: Column, size: Column) -> Column:
    """The combined p-value of codes 0..size-1 in an array of doubles."""
    half = size / 2
    neighbours = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
                            lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counted = F.struct(
        F.size(x).cast("double").alias("n"), neighbours.alias("pairs"),
        F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, a: acc + F.pow(
            F.size(F.filter(x, lambda c: c == a)).cast("double"), F.lit(2.0))).alias("squares"),
        F.size(F.filter(x, lambda c: c >= half)).cast("double").alias("high"),
        (F.aggregate(x, F.lit(0.0), lambda acc, c: acc + c) / F.size(x)).alias("average"))

    def measured(f: Column) -> Column:
        mean = 2 * f["high"] * (f["n"] - f["high"]) / f["n"] + 1
        return F.struct(
            f["n"].alias("n"), (f["squares"] * size / f["n"] - f["n"]).alias("chi"), mean.alias("mean"),
            (1.0 + F.size(F.filter(f["pairs"], lambda p: (p["a"] >= half) != (p["b"] >= half)))).alias("runs"),
            F.aggregate(x, F.lit(0.0), lambda acc, c: acc + (c - f["average"]) * (c - f["average"])).alias("spread"),
            F.aggregate(f["pairs"], F.lit(0.0), lambda acc, p: acc + (p["a"] - f["average"]) * (p["b"] - f["average"])).alias("moved"))

    def combined(f: Column) -> Column:
        n = f["n"]
        shape = (size - 1) * n / (2.0 * (n - 1))  # of the gamma distribution with the statistic's mean and variance
        uniform = _tail((F.cbrt(f["chi"] / (size - 1)) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape))
        deviation = F.sqrt(F.greatest((f["mean"] - 1) * (f["mean"] - 2) / (n - 1), F.lit(1e-9)))
        ordered = F.when(f["mean"] <= 1, F.lit(1e-9)).otherwise(2 * _tail(F.abs(f["runs"] - f["mean"]) / deviation))
        serial = F.when(f["spread"] == 0, F.lit(1e-9)).otherwise(2 * _tail(F.abs(f["moved"] / f["spread"] + 1 / n) * F.sqrt(n)))
        logs = [F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))) for p in (uniform, ordered, serial)]
        return _named(-(logs[0] + logs[1] + logs[2]), lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return _named(counted, lambda f: _named(measured(f), combined))


def battery(run: Column) -> Column:
    """The combined p-value of the run under a uniform draw from its encoding's alphabet; null without an encoding."""
    def spelled(kind: Column) -> Column:
        alphabet = F.lit(None).cast("string")
        for name, own in ALPHABETS.items():
            alphabet = F.when(kind == name, own).otherwise(alphabet)
        plain = (F.when(kind.isin("hex", "base36"), F.lower(run)).when(kind == "base64", F.translate(run, "-_", "+/")).otherwise(run))
        reading = lambda text, alphabet: F.struct(F.split(text, "").alias("letters"), alphabet.alias("alphabet"))
        first = reading(plain, alphabet)
        return F.when(kind == "hex22", F.array(first, reading(F.lower(run), F.lit(ALPHABETS["hex"])))).when(kind.isNotNull(), F.array(first))

    def tested(f: Column) -> Column:
        codes = F.transform(f["letters"], lambda c: (F.instr(f["alphabet"], c) - 1).cast("double"))
        return _named(codes, lambda x: _tested(x, F.length(f["alphabet"])))

    return F.array_max(F.transform(_named(encoding(run), spelled), tested))


def length_class(length: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, least in enumerate(CLASSES):
        out = F.when(length >= least, k).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Runs with an encoding, as structs start, end, value; some lie in others."""
    found = F.array_distinct(F.concat(*[located(text, run) for run in RUNS]))
    return F.filter(_guarded(text.rlike(RUNS[0]), found), lambda s: encoding(s["value"]).isNotNull())


def outermost(spans: Column) -> Column:
    """The spans that lie in no other one."""
    return F.filter(spans, lambda s: ~F.exists(spans, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (
        (o["start"] < s["start"]) | (s["end"] < o["end"]))))


def limits(docs: DataFrame, rate: float = 0.05) -> dict[int, float]:
    """Per class of length the p-value up to which runs are turned away; classes that turn none away are absent."""
    runs = docs.select(F.explode(candidates(text_or_empty())).alias("run")).select("run.value")
    tested = runs.select(F.xxhash64("value").alias("h"), length_class(F.length("value")).alias("class"), battery(F.col("value")).alias("p"))
    each = tested.groupBy("h", "class").agg(F.first("p").alias("p"))
    place = F.least(F.floor(-F.log(F.greatest("p", F.lit(1e-300))) / STEP), F.lit(BINS)).cast("int")
    counted = each.groupBy("class", place.alias("bin")).count().collect()  # at most 5 * 401 rows
    out: dict[int, float] = {}
    for k in range(len(CLASSES)):
        bins = {r["bin"]: r["count"] for r in counted if r["class"] == k}
        total, below = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            below += bins[b]
            edge = pow(2.718281828459045, -b * STEP)
            if edge <= rate * below / total:
                out[k] = edge
    return out


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """All columns of docs and `spans`, an array of structs kind, start, end in order of start, then kind."""
    found = limits(docs, rate)
    text = text_or_empty()
    rows = docs.select(*[c for c in docs.columns if c != "spans"], *[s.alias(f"_{k}") for k, s in zip(KINDS, (
        _guarded(text.rlike(r"(?i:password|passwd|secret|token|api_?key)"), located(text, ASSIGN, 8, 2)),
        _guarded(text.contains("AKIA"), located(text, r"AKIA[A-Z0-9]+", 16)),
        _guarded(text.rlike(r"[0-9a-f]{32}"), located(text, r"[0-9a-f]{32,}")),
        candidates(text)))])
    base = F.concat("_assign", "_access", "_hex")
    apart = F.filter("_random", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("_random", apart)
    rows = rows.withColumn("_random", F.filter("_random", lambda s: battery(s["value"]) > _limit_of(s["value"], found)))
    rows = rows.withColumn("_random", outermost(F.col("_random")))
    numbered = [_numbered(f"_{kind}", k) for k, kind in enumerate(KINDS)]
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(F.concat(*numbered)), lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    return rows.withColumn("spans", spans).drop(*[f"_{k}" for k in KINDS])


def _numbered(spans: str, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _limit_of(run: Column, found: dict[int, float]) -> Column:
    out = F.lit(-1.0)
    for k, p in found.items():
        out = F.when(length_class(F.length(run)) == k, p).otherwise(out)
    return out


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span replaced by a mark; n_chars, if there, follows the text."""
    rows = scan(docs, **options)
    text = text_or_empty()

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    made = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(
        acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    changed = F.size("spans") > 0
    made = rows.withColumn("text", F.when(changed, made).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        made = made.withColumn("n_chars", n_chars)
    return made.select(*docs.columns)
