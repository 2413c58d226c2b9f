"""Secret scans with column functions only.

Three patterns give the base spans. Besides, every long run of code letters is put to a
battery of randomness tests (uniform use of its encoding's alphabet, runs above and
below the alphabet's middle, serial correlation of neighbours), whose result is a score.
The hypothesis is that a run is no key but words written together, as identifiers are. How
such runs score is learnt, for each stratum of length, from words of the texts themselves,
written together; a run is reported where it looks so much more random that the rate
of false discoveries in its stratum allows it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

# The patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of letters that codes are written in, long enough for the tests to tell something.
RUN = r"[A-Za-z0-9+/_-]{20,}"
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, narrowest first: the letters and what a run in it looks like. Runs in none of them are in the last.
ENCODINGS = (
    (_DIGITS + "abcdef", "^[0-9a-f]+$"), (_DIGITS + "ABCDEF", "^[0-9A-F]+$"), (_UP + "234567", "^[A-Z2-7]+$"),
    (_DIGITS + _LOW, "^[0-9a-z]+$"), (_DIGITS + _UP, "^[0-9A-Z]+$"), (_UP + _LOW + _DIGITS + "+/", ""),
)
#: Least lengths of the strata within which discoveries are controlled.
STRATA = (20, 28, 40, 64, 128)
#: Parts of a text whose words are put in order together; only a word as long as a part is cut.
PART = r"(?s).{1,4000}(?=\s|\z)|.{1,4000}"
#: Words of prose, and digits of the number that examples of words written together hold.
WORD, NUMBER = "[A-Za-z][a-z]{2,}", 4
#: Runs with three or more stretches of digits are no words' source: most keys are such. No run is tried from within, so long ones take no square.
DENSE = "(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]*+(?:[0-9]++[A-Za-z+/_-]++){3,}+[0-9]*+"
#: Steps of -log10(p) by which p-values are counted, and the largest that is told apart.
PER_DECADE, MOST = 50, 20
_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Matches that one fold adds up; sums of such blocks are added up by another, so long lists cost no square.
_BLOCK = 256


def _running(values: Column) -> Column:
    """Sums of the first 1, 2, ... values."""
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    zero = F.array(F.lit(0))

    def whole(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))
        return _let(blocks, lambda bs: _let(F.aggregate(bs, zero, lambda sums, b: add(sums, F.element_at(b, -1))), lambda before: F.flatten(
            F.zip_with(bs, F.slice(before, 1, F.size(bs)), lambda b, first: F.transform(F.slice(b, 2, F.size(b) - 1), lambda x: first + x)),
        )))

    return _let(values, whole)


def _matches(text: Column, pattern: str, group: int = 0, maybe: Column | None = None) -> Column:
    """(start, end, whole, tested) of each match; the text between matches gives their places. ``maybe``: false only where nothing matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(parts):
        ends = _running(F.transform(parts, lambda p: p["gap"] + F.length(p["whole"])))
        return F.zip_with(parts, ends, lambda p, end: F.struct((end - F.length(p["whole"])).cast("int").alias("start"), end.cast("int").alias("end"), p["whole"].alias("whole"), p["tested"].alias("tested")))

    found = _let(F.arrays_zip(whole.alias("whole"), tested.alias("tested"), F.slice(gaps, 1, F.size(whole)).alias("gap")), placed)
    matches = text.rlike(pattern) if maybe is None else maybe & text.rlike(pattern)
    return F.when(matches, found).otherwise(F.array().cast("array<struct<start:int,end:int,whole:string,tested:string>>"))


def _each_match(text: Column, pattern: str, kind: int, least: int, group: int = 0, maybe: Column | None = None) -> Column:
    """Spans of the matches whose tested part has ``least`` characters."""
    good = F.filter(_matches(text, pattern, group, maybe), lambda m: F.length(m["tested"]) >= least)
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind. Plain searches for the letters that a match must have come first."""
    low = F.lower(text)
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    return F.sort_array(F.concat(
        _each_match(text, ASSIGN, 0, 6, group=2, maybe=named),
        _each_match(text, ACCESS, 1, 20, maybe=F.contains(text, F.lit("AKIA"))),
        _each_match(text, HEX, 2, 24),
    ))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by the usual rational approximation for each side."""

    def tail(z, t):
        series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        side = series * F.exp(-z * z / 2) / 2.5066282746310002
        return F.greatest(F.when(z >= 0, side).otherwise(1 - side), F.lit(10.0**-MOST))

    return _let(z, lambda z: _let(1 / (1 + 0.2316419 * F.abs(z)), lambda t: tail(z, t)))


def alphabet(run: Column) -> Column:
    """The alphabet of the narrowest encoding that a run fits."""
    found = F.lit(ENCODINGS[-1][0])
    for letters, looks in reversed(ENCODINGS[:-1]):
        found = F.when(run.rlike(looks), letters).otherwise(found)
    return found


def codelike(run: Column) -> Column:
    """Runs that the battery judges: letters and digits together."""
    return run.rlike("[A-Za-z]") & run.rlike("[0-9]")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


#: A run whose use of the alphabet is less likely than this is no key, whatever the other tests say.
HOPELESS = 1e-3


def battery(run: Column) -> Column:
    """The p-value of a run under randomness: the least of the three tests', each by its weight, 1 at most.

    Uniformity tells words from keys best and has the largest weight. Where it is below ``HOPELESS`` the others aren't needed.
    """
    plain = F.translate(run, "-_", "+/")

    def tested(letters, text):
        codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(letters, c).cast("double"))
        others = lambda u: F.least(F.lit(1.0), u, middle_runs(text, letters) / 0.1, _let(codes, neighbours) / 0.1)
        return _let(uniformity(text, F.length(letters).cast("double")) / 0.8, lambda u: F.when(u < HOPELESS, u).otherwise(others(u)))

    return _let(plain, lambda text: _let(alphabet(run), lambda letters: tested(letters, text)))


def uniformity(text: Column, m: Column) -> Column:
    """Chi-squared test of equal use of m symbols; its tail by the cube-root transformation.

    Of few symbols of a large alphabet the tail is only roughly right; it is used as a score.
    """
    n = F.length(text).cast("double")
    alike = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(.)\1*+"), F.lit(0))
    squares = _sum(F.transform(alike, lambda s: F.pow(F.length(s).cast("double"), F.lit(2.0))))
    free, spread = m - 1, 2 / (9 * (m - 1))
    statistic = F.greatest(m / n * squares - n, F.lit(0.0))
    return upper_tail((F.cbrt(statistic / free) - (1 - spread)) / F.sqrt(spread))


def middle_runs(text: Column, letters: Column) -> Column:
    """Wald-Wolfowitz test on stretches below and above the alphabet's middle, two-sided."""
    low = F.floor(F.length(letters) / 2).cast("int")
    sides = F.call_function("translate", text, letters, F.concat(F.repeat(F.lit("0"), low), F.repeat(F.lit("1"), F.length(letters) - low)))
    count = lambda sides, part: ((F.length(sides) - F.length(F.replace(sides, F.lit(part), F.lit("")))) / len(part)).cast("double")

    def test(n, high, turns, expected):
        variance = (expected - 1) * (expected - 2) / (n - 1)
        return _let(variance, lambda v: F.when(v > 0, 2 * upper_tail(F.abs((turns + 1 - expected) / F.sqrt(v)))).otherwise(10.0**-MOST))

    def counted(sides):
        n = F.length(sides).cast("double")
        turns = count(sides, "01") + count(sides, "10")
        return _let(count(sides, "1"), lambda h: _let(turns, lambda t: _let(2 * h * (n - h) / n + 1, lambda e: test(n, h, t, e))))

    return _let(sides, counted)


def neighbours(codes: Column) -> Column:
    """Test of the correlation of each symbol's place in the alphabet with the next one's, two-sided."""
    n = F.size(codes).cast("double")
    squares = _sum(F.transform(codes, lambda x: x * x))
    products = _sum(F.zip_with(codes, F.concat(F.slice(codes, 2, F.size(codes) - 1), F.slice(codes, 1, 1)), lambda a, b: a * b))

    def test(total, spread):
        z = ((n * products - total * total) / spread + 1 / (n - 1)) * F.sqrt(n - 1)
        return F.when(spread > 0, 2 * upper_tail(F.abs(z))).otherwise(10.0**-MOST)

    return _let(_sum(codes), lambda total: _let(n * squares - total * total, lambda spread: test(total, spread)))


def step(p: Column) -> Column:
    return F.floor(-F.log10(p) * PER_DECADE).cast("int")


def stratum(length: Column) -> Column:
    found = F.lit(0)
    for k, least in enumerate(STRATA[1:], 1):
        found = F.when(length >= least, k).otherwise(found)
    return found


def _judged(run: Column) -> Column:
    return step(battery(run))


def code_runs(text: Column) -> Column:
    """Places of the runs that the battery judges, with stratum and p-value step."""
    return F.transform(F.filter(_matches(text, RUN), lambda m: codelike(m["whole"])), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), stratum(F.length(m["whole"])).alias("stratum"), _judged(m["whole"]).alias("step"),
    ))


def words_together(text: Column) -> Column:
    """(stratum, step) of runs that are no keys: all words of a text, with capitals and a number in each run, in an order drawn by each part of some pages.

    The words, written together, are cut into stretches that with their number are as long as each stratum's shortest, in turn; what
    is left is a run of its own length, if it is long enough to be one. So each word is in a run, but for an end of 15 letters or fewer. A part
    also begins with a run for each stratum, so short texts give some for all that they have words enough for.
    """
    letters = [least - NUMBER for least in STRATA]

    def stretches(turn):
        return F.filter(F.array(*[F.substr(turn, F.lit(sum(letters[:k]) + 1), F.lit(n)) for k, n in enumerate(letters)]), lambda s: F.length(s) >= letters[0])

    def written(s, drawn):
        number, half = F.lpad(F.pmod(F.hash(s, drawn), F.lit(10_000)).cast("string"), NUMBER, "0"), F.floor((F.length(s) + NUMBER) / 2).cast("int")
        return F.concat(F.left(s, half), number, F.substr(s, half + 1))

    def runs(joined, drawn):
        first = F.filter(F.array(*[F.when(F.length(joined) >= n, F.left(joined, F.lit(n))) for n in letters[1:]]), lambda s: s.isNotNull())
        turns = F.regexp_extract_all(joined, F.lit(f".{{1,{sum(letters)}}}"), F.lit(0))
        made = F.transform(F.concat(first, F.flatten(F.transform(turns, stretches))), lambda s: written(s, drawn))
        return F.transform(made, lambda r: F.struct(stratum(F.length(r)).alias("stratum"), _judged(r).alias("step")))

    def together(found, drawn):
        mixed = F.sort_array(F.transform(found, lambda w, i: F.struct(F.hash(w, i, drawn).alias("order"), w.alias("w"))))
        joined = F.array_join(F.transform(mixed, lambda d: F.concat(F.upper(F.left(d["w"], F.lit(1))), F.substr(d["w"], F.lit(2)))), "")
        return _let(joined, lambda j: runs(j, drawn))

    words = lambda p: F.regexp_extract_all(F.regexp_replace(p, DENSE, " "), F.lit(WORD), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(PART), F.lit(0))
    return F.flatten(F.transform(parts, lambda p: _let(F.hash(p), lambda drawn: together(words(p), drawn))))


BASE, RUNS, WORDS = "base spans", "code runs", "words together"


def examine(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds base spans, judged runs and examples of words written together: all that is needed of a text, in one scan."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({BASE: base_spans(text), RUNS: code_runs(text), WORDS: words_together(text)})


@dataclass(frozen=True)
class Control:
    """Up to which p-value step runs of a stratum are reported (None: none are)."""

    to_step: tuple[int | None, ...]


def control(df: DataFrame, text_col: str = "text", rate: float = 0.05) -> Control:
    """False-discovery control over all runs of all texts, within each stratum of length."""
    return control_of(examine(df.select(text_col), text_col), rate)


def control_of(examined: DataFrame, rate: float = 0.05) -> Control:
    """Benjamini-Hochberg within each stratum; a discovery is a run that words written together wouldn't give.

    A run's p-value under that hypothesis is the share of examples that look as random, itself counted among
    them. P-values are counted by steps, so at most 2 x 5 x 1001 counts are sorted and 5 rows come to the driver.
    """
    from pyspark.sql import Window as W

    seen = F.concat(F.transform(RUNS, lambda r: F.struct(r["stratum"].alias("stratum"), r["step"].alias("step"), F.lit(1).alias("run"))),
                    F.transform(WORDS, lambda r: F.struct(r["stratum"].alias("stratum"), r["step"].alias("step"), F.lit(0).alias("run"))))
    counts = examined.select(F.explode(seen).alias("r")).groupBy("r.stratum", "r.step").agg(F.sum(F.col("r.run")).alias("runs"), F.sum(1 - F.col("r.run")).alias("words"))
    whole = W.partitionBy("stratum")
    upto = whole.orderBy("step")
    ranked = counts.select("stratum", "step", *[F.sum(c).over(w).alias(f"{c}_{k}") for c in ("runs", "words") for k, w in (("upto", upto), ("all", whole))])
    p = (1 + F.col("words_upto")) / (1 + F.col("words_all"))
    most = ranked.where(p * F.col("runs_all") <= rate * F.col("runs_upto")).groupBy("stratum").agg(F.max("step").alias("step"))
    found = {r["stratum"]: r["step"] for r in most.collect()}
    return Control(tuple(found.get(k) for k in range(len(STRATA))))


def decide(examined: DataFrame, found: Control, base_col: str = "base_spans", spans_col: str = "secret_spans") -> DataFrame:
    """Adds base spans, and all spans with those of reported runs that no base span touches; drops what ``examine`` added."""
    limits = F.array(*[F.lit(s).cast("int") for s in found.to_step])
    kept = F.filter(RUNS, lambda r: F.coalesce(r["step"] <= F.element_at(limits, r["stratum"] + 1), F.lit(False))
                    & ~F.exists(F.col(BASE), lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"])))
    random = F.transform(kept, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return examined.withColumns({base_col: F.col(BASE), spans_col: F.sort_array(F.concat(BASE, random))}).drop(BASE, RUNS, WORDS)


def scan_secrets(df: DataFrame, found: Control, text_col: str = "text", base_col: str = "base_spans", spans_col: str = "secret_spans") -> DataFrame:
    """Adds base spans, and all spans with those of random-looking runs that no base span touches.

    Spans are structs of start, kind (a place in KINDS) and end, by start, then kind; code points,
    end exclusive. Null and empty text: no spans. All columns stay; those named like an added
    one are replaced. Equal and repeated rows have equal spans; an empty table gives no rows. A text's matches are
    arrays of its row: a very long text is one row's work, in time that grows little faster than its length.
    """
    return decide(examine(df, text_col), found, base_col, spans_col)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(id, base_spans, secret_spans) of each row, with control and scan from one reading of the texts."""
    examined = cut(examine(df.select(id_col, text_col), text_col).drop(text_col), "secrets")
    return decide(examined, control_of(examined, rate))


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
