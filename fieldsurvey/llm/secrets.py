"""Secrets in texts: patterns, and strings that a battery of tests can't tell from random ones.

Everything is Column code. Spans count code points, ends are exclusive.

Pattern spans (``assign``, ``access``, ``hex``) are the leftmost matches that do not
overlap, without those that are too short. ``random`` spans are added where they do
not touch a pattern span: runs of the alphabets of common encodings with a digit in
them. The encoding is inferred from the characters, and three tests ask whether the
run could be a uniform draw from its alphabet: chi-squared of the symbol counts, runs
above and below the middle of the alphabet, correlation of neighbouring symbols. Their
p-values are combined by Fisher's rule. Short runs can hardly fail and long ones fail
easily, so runs are dismissed as ordinary by the Benjamini-Hochberg rule within their
encoding and length class, over all texts: among the dismissed runs of a class the
expected share of truly random ones is at most ``rate``. What is not dismissed is a span.

Defined results: NULL and empty texts have no spans; repeated rows get the same spans
and count separately in the false-discovery rule; ties of p-values are dismissed
together; an empty table gives an empty table; other columns pass through, a column
named like the output is replaced. A very long text is one row like any other: work grows
with its length and its matches (matches are gathered in parts, runs look up the spans near them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsurvey.llm.columns import bound, folded, unused
from fieldsurvey.skew import fixed

#: Pattern kinds in the order in which spans are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of one alphabet is matched from its start, so a minimum inside the pattern drops what is too short.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A whole run of at least 20 characters that holds a digit; a word before `=` is no part of it.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
ASSIGN_VALUE = 8

HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: p-values are held as whole steps of 1/10 decade; smaller ones than the last step count as that one.
LAST_STEP = 300

SPAN = "array<struct<start:int,end:int,kind:string>>"
FOUND_ROW = "struct<start:int,end:int,value:string,part:string>"
#: Code points of a piece of a text, when spans are cut out of it.
PIECE = 4_096
#: Steps of a search in a sorted list, whatever its length.
HALVES = tuple(1 << i for i in range(30, -1, -1))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that do not overlap: start, end, value and one group of each.

    The texts between the matches give their places.
    """
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    cells = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(value)).alias("gap"), value.alias("value"), part.alias("part")
    )

    def step(at: Column, cell: Column) -> tuple[Column, Column]:
        start = at + F.char_length(cell["gap"])
        end = start + F.char_length(cell["value"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), cell["value"].alias("value"), cell["part"].alias("part")))

    # Most texts have no match: they are read once and nothing is built.
    return F.when(text.rlike(pattern), folded(cells, FOUND_ROW, step)["out"]).otherwise(F.array().cast(f"array<{FOUND_ROW}>"))


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def ordered(spans: Column) -> Column:
    """By start, then kind in the order of KINDS, ``random`` last."""
    key = lambda s: F.struct(
        s["start"].alias("start"),
        F.when(s["kind"] == KINDS[0], 0).when(s["kind"] == KINDS[1], 1).when(s["kind"] == KINDS[2], 2).otherwise(3).alias("nth"),
        s["end"].alias("end"),
        s["kind"].alias("kind"),
    )
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return F.transform(F.array_sort(F.transform(spans, key)), plain)


def pattern_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.char_length(m["part"]) >= ASSIGN_VALUE)
    return ordered(F.concat(_named(assign, "assign"), _named(matches(text, ACCESS), "access"), _named(matches(text, HEX), "hex")))


def alphabet(run: Column) -> Column:
    """Symbols of the narrowest encoding that has all characters of the run."""
    return (
        F.when(run.rlike("^[0-9a-f]+$"), HEX_LOWER)
        .when(run.rlike("^[0-9A-F]+$"), HEX_UPPER)
        .when(run.rlike("^[A-Z2-7]+$"), BASE32)
        .when(run.rlike("^[0-9a-z]+$"), BASE36)
        .when(run.rlike("^[0-9A-Za-z]+$"), BASE62)
        .otherwise(BASE64)
    )


def _upper_tail(z: Column) -> Column:
    """1 minus the normal distribution function, by its logistic approximation."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.070566 * z * z * z, F.lit(700.0))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def tested(run: Column) -> Column:
    """Alphabet size, length class and step of the combined p-value of one run."""
    # Padding is no symbol; the web-safe signs stand for the two last symbols.
    clean = F.translate(F.regexp_replace(run, "=+$", ""), "-_", "+/")
    with_symbols = lambda r: F.struct(r.alias("run"), alphabet(r).alias("symbols"))
    return bound(clean, lambda r: bound(with_symbols(r), lambda x: _battery(x["run"], x["symbols"])))


def _battery(run: Column, symbols: Column) -> Column:
    index = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.position(c, symbols).cast("double") - 1)
    counts = F.transform(
        F.filter(F.split(symbols, ""), lambda c: c != ""), lambda c: (F.char_length(run) - F.char_length(F.replace(run, c, F.lit("")))).cast("double")
    )

    def sums(ix: Column) -> Column:
        k = F.char_length(symbols).cast("double")
        pairs = F.arrays_zip(F.slice(ix, F.lit(1), F.size(ix) - 1).alias("a"), F.slice(ix, F.lit(2), F.size(ix) - 1).alias("b"))
        return F.struct(
            F.char_length(run).cast("double").alias("n"), k.alias("k"), ix.alias("index"), pairs.alias("pairs"),
            _total(F.transform(counts, lambda c: c * c)).alias("squares"),
            _total(F.transform(ix, lambda x: (x >= k / 2).cast("double"))).alias("high"),
            _total(F.transform(pairs, lambda p: ((p["a"] >= k / 2) != (p["b"] >= k / 2)).cast("double"))).alias("changes"),
            (_total(ix) / F.char_length(run).cast("double")).alias("mean"),
        )

    def about_mean(s: Column) -> Column:
        more = F.struct(
            _total(F.transform(s["index"], lambda x: (x - s["mean"]) * (x - s["mean"]))).alias("square"),
            _total(F.transform(s["pairs"], lambda p: (p["a"] - s["mean"]) * (p["b"] - s["mean"]))).alias("product"),
        )
        return bound(more, lambda m: _combined(s, m["square"], m["product"]))

    return bound(index, lambda ix: bound(sums(ix), about_mean))


def _combined(s: Column, square: Column, product: Column) -> Column:
    """The three tests of one run, from its sums."""
    n, k, high = s["n"], s["k"], s["high"]
    chi = s["squares"] * k / n - n
    uniform = _upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
    expected = 1 + 2 * high * (n - high) / n
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    # All symbols on one side: as if every change was missing.
    runs = F.when(high * (n - high) > 0, 2 * _upper_tail(F.abs((s["changes"] + 1 - expected) / spread))).otherwise(F.pow(F.lit(2.0), 1 - n))
    serial = F.when(square > 0, 2 * _upper_tail(F.abs((product / square + 1 / n) * F.sqrt(n)))).otherwise(F.lit(0.0))
    logs = [F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))) for p in (uniform, runs, serial)]
    return bound(-(logs[0] + logs[1] + logs[2]), lambda half: F.struct(
        k.cast("int").alias("symbols"),
        F.least(F.floor(F.log2(n) * 2), F.lit(40)).cast("int").alias("length_class"),
        F.least(F.floor(-10 * F.log10(F.greatest(F.exp(-half) * (1 + half + half * half / 2), F.lit(1e-36)))), F.lit(LAST_STEP)).cast("int").alias("step"),
    ))


def _touched(m: Column, starts: Column, ends: Column) -> Column:
    """Whether a match overlaps a span of sorted spans that do not overlap: the first one that ends after its start decides."""
    halves = F.array(*[F.lit(h) for h in HALVES])
    passed = F.aggregate(halves, F.lit(0), lambda c, h: F.when(F.get(ends, c + h - 1) <= m["start"], c + h).otherwise(c))
    return F.coalesce(F.get(starts, passed) < m["end"], F.lit(False))


def candidates(text: Column, base: Column) -> Column:
    """Tested runs that touch no span of ``base``."""
    # Spans of one kind are sorted and do not overlap.
    sides = lambda kind: bound(F.filter(base, lambda b: b["kind"] == kind), lambda own: F.struct(
        F.transform(own, lambda b: b["start"]).alias("starts"), F.transform(own, lambda b: b["end"]).alias("ends")
    ))

    def free(found: Column) -> Column:
        of_kinds = F.array(*[sides(kind) for kind in KINDS])
        apart = bound(of_kinds, lambda kinds: F.filter(found, lambda m: ~F.exists(kinds, lambda s: _touched(m, s["starts"], s["ends"]))))
        return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(apart)

    return F.transform(
        bound(matches(text, RUN), free), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), tested(m["value"]).alias("test"))
    )


def dismissal_steps(tests: DataFrame, rate: float) -> dict[tuple[int, int], int]:
    """Smallest step that is dismissed, for each alphabet size and length class that dismisses any.

    The steps are counted first: what is compared is a table of at most 6 x 41 x 301 rows.
    """
    counts = tests.groupBy("symbols", "length_class", "step").agg(F.count("*").alias("n"))
    cell = Window.partitionBy("symbols", "length_class")
    ranked = counts.select(
        "symbols", "length_class", "step",
        F.sum("n").over(cell.orderBy(F.desc("step"))).alias("up_to"), F.sum("n").over(cell).alias("all"),
    )
    passing = ranked.filter(F.pow(F.lit(10.0), -F.col("step") / 10) <= rate * F.col("up_to") / F.col("all"))
    rows = passing.groupBy("symbols", "length_class").agg(F.min("step").alias("step")).collect()
    return {(r.symbols, r.length_class): r.step for r in rows}


def scan(df: DataFrame, text: str = "text", spans: str = "secret_spans", rate: float = 0.05, keep_text: bool = False) -> DataFrame:
    """``df`` with its spans as ``spans`` (array of start, end, kind); the text only with ``keep_text``.

    Texts are read once; what is kept for the second step, in the shared folder, are
    the other columns and the spans.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    base, runs = unused(df, "__base"), unused(df, "__runs")
    tests = df.withColumn(base, pattern_spans(value))
    tests = tests.withColumn(runs, candidates(value, F.col(base))).drop(spans)
    found = fixed(tests if keep_text else tests.drop(text))
    steps = dismissal_steps(found.select(F.explode(f"{runs}.test").alias("t")).select("t.*"), rate)
    # At most 6 x 41 cells.
    table = F.create_map(*[F.lit(x) for (k, c), s in sorted(steps.items()) for x in (k * 100 + c, s)]) if steps else None
    held = F.col(runs)
    if table is not None:
        held = F.filter(
            held, lambda r: r["test"]["step"] < F.coalesce(table[r["test"]["symbols"] * 100 + r["test"]["length_class"]], F.lit(LAST_STEP + 1))
        )
    return found.withColumn(spans, ordered(F.concat(base, _named(held, "random")))).drop(base, runs)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced by ``mask``; spans that overlap count as one.

    The text is cut into pieces first, so that no gap between spans is looked for from the text's begin.
    """

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.struct(at.alias("low"), s["start"].alias("high"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(gap)).otherwise(F.array().cast("array<struct<low:int,high:int>>"))

    def part(pieces: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
        begin, end = F.get(pieces, first), F.coalesce(F.get(pieces, last), F.lit(""))
        across = F.concat(
            F.substring(begin, low % PIECE + 1, F.lit(PIECE)),
            F.array_join(F.slice(pieces, first + 2, last - first - 1), ""),
            F.substring(end, F.lit(1), high % PIECE),
        )
        return F.when(low >= high, "").when(first == last, F.substring(begin, low % PIECE + 1, high - low)).otherwise(across)

    def cut(pieces: Column, gaps: Column) -> Column:
        tail = F.struct(gaps["at"].alias("low"), F.char_length(text).alias("high"))
        return F.array_join(F.transform(F.concat(gaps["out"], F.array(tail)), lambda g: part(pieces, g["low"], g["high"])), mask)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    gaps = folded(spans, "struct<low:int,high:int>", step)
    return F.when(F.size(spans) > 0, bound(pieces, lambda p: bound(gaps, lambda g: cut(p, g)))).otherwise(text)
